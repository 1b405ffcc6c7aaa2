"""A job log derived from the star-schema tables.

One job per event, with the event's order for its volume and destination and
the order's line items for the tables it reads.  The mapping is a plain
projection over two joins on the order key, so it spreads over the cluster like
any other scan, and a query that does not look at the references never reads
the line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns used of each table; given, so that no job has to look for them.
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"
ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE"
LINEITEM = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT"

JOB_COLUMNS = [
    "event_id",
    "concat('proj-', user_id % 3) AS project_id",
    """CASE WHEN user_id % 50 = 49 THEN NULL
            WHEN user_id % 5 = 0 THEN concat('runner-', user_id, '@proj.iam.gserviceaccount.com')
            WHEN user_id % 5 = 1 THEN concat('service-', user_id, '@agents.example.com')
            ELSE concat('user-', user_id, '@example.com') END AS user_email""",
    "concat('job_', event_id) AS job_id",
    "creation_time",
    "timestampadd(SECOND, CAST(floor(value) AS INT), creation_time) AS end_time",
    r"""concat(
          CASE WHEN event_id % 5 = 0 THEN concat(
            '-- Query for project: proj-', user_id % 3, '\n',
            '-- Team: team-', user_id % 4, '\n',
            '-- Owner: owner-', user_id % 6, '\n',
            '-- Query ID: q-', event_id % 100, '\n',
            '-- Query Type: ', if(event_id % 2 = 0, 'report', 'etl'), '\n') ELSE '' END,
          CASE WHEN event_id % 9 = 0 THEN 'SELECT 1' ELSE concat(
            'SELECT * FROM `data-', event_id % 2, '.ds_', event_id % 4, '.t_', event_id % 20,
            '` WHERE x > 1') END) AS query""",
    """CASE WHEN event_type = 'view' THEN 'CREATE_TABLE_AS_SELECT'
            WHEN event_type = 'purchase' THEN 'MERGE'
            WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'SCRIPT'
            WHEN event_type = 'signup' AND event_id % 4 = 2 THEN NULL
            ELSE 'SELECT' END AS statement_type""",
    "if(event_type = 'signup' AND event_id % 4 = 0, 'LOAD', 'QUERY') AS job_type",
    "bytes AS total_bytes_processed",
    "CASE WHEN cached THEN 0 ELSE ((bytes + 1048575) div 1048576) * 1048576 END AS total_bytes_billed",
    "CAST(floor(value * 1000) AS BIGINT) AS total_slot_ms",
    """CASE WHEN event_type = 'error' THEN
         named_struct('reason', 'backendError', 'message', CAST(NULL AS STRING)) END AS error_result""",
    "cached AS cache_hit",
    """CASE WHEN event_type IN ('view', 'purchase') THEN named_struct(
         'project_id', 'data-0',
         'dataset_id', concat('ds_', o_custkey % 4),
         'table_id', concat('t_', o_custkey % 20)) END AS destination_table""",
    "CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>) AS labels",
    "if(event_id % 2 = 0, 'INTERACTIVE', 'BATCH') AS priority",
]


def job_rows(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Jobs without their references; ``events`` may be a stream."""
    joined = events.join(orders, events["event_id"] == orders["o_orderkey"], "left")
    derived = joined.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "o_custkey",
        "CAST(ts AS TIMESTAMP) AS creation_time",
        """CASE WHEN event_id % 11 = 0 THEN 0
                WHEN event_id % 13 = 0 THEN 500000
                ELSE CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS bytes""",
        "CASE WHEN event_id % 17 <> 0 THEN event_id % 4 = 1 END AS cached",
    )
    return derived.selectExpr(*JOB_COLUMNS)


def references(lineitem: DataFrame) -> DataFrame:
    """Tables read per order, repeats folded into a count.

    Lines are dealt by their order once, as small numbers, and both groupings stay
    there: few lines of an order name one table, so counts made ahead of a shuffle
    are hardly fewer.  Counting bounds the array by the number of tables however
    long an order is.  The names are spelled out last.
    """
    lines = lineitem.selectExpr(
        "l_orderkey AS event_id",
        "CAST(l_suppkey % 2 AS INT) AS source",
        "CAST(l_partkey % 20 AS INT) AS item",
        "if(l_linenumber IN (6, 7), l_linenumber, 0) AS gap",
    ).repartition("event_id")
    counted = lines.groupBy("event_id", "source", "item", "gap").count()
    named = counted.sortWithinPartitions("event_id").selectExpr(
        "event_id",
        """named_struct(
             'project_id', concat('data-', source),
             'dataset_id', if(gap = 7, NULL, concat('ds_', item % 4)),
             'table_id', if(gap = 6, NULL, concat('t_', item)),
             'ref_count', count) AS ref""",
    )
    return named.groupBy("event_id").agg({"ref": "collect_list"}).toDF("event_id", "referenced_tables")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def read_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")


def read_star_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived job log over one test-data folder."""
    lineitem = spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    # The references grow with the log and arrive grouped by job already, so they
    # are merged where they are; sending them to every task is never wanted.
    refs = references(lineitem).hint("merge")
    jobs = job_rows(read_events(spark, sf_dir), read_orders(spark, sf_dir))
    return jobs.join(refs, "event_id", "left").drop("event_id")
