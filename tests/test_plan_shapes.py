"""What the physical plans must look like to hold at scale."""

import re

import pytest

from catalog import queries
from scanledger.operators.jobs import job_stats
from scanledger.plans.mart import latest_queries, user_day_mart
from scanledger.sources.job_log import read_job_log
from scanledger.sources.star_log import read_star_log
from tests.conftest import SF_DIR, job

WRITES_FIRST = {
    "stored_tables", "monitoring_run", "alert_stream", "latest_snapshot", "retained_snapshots",
    "latest_run_summary", "dataset_summary", "dataset_top_users", "account_summary",
    "account_top_datasets", "user_dataset_attribution", "checked_run", "scheduled_run", "project_run",
    "newest_folders", "replaced_range", "small_job_share", "alert_changes", "newest_first", "history_order",
    "table_set", "catalog_sizes", "sketched_users", "report_bundle", "stored_user_days", "configured_settings",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    """The plan before run-time changes."""
    return plan(df).split("Initial Plan")[0]


def exchanges(text):
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def nested_log(spark, tmp_path_factory):
    """A stored nested log, as the library meets it in use."""
    path = str(tmp_path_factory.mktemp("log") / "jobs")
    read_star_log(spark, SF_DIR).write.parquet(path)
    return read_job_log(spark, path)


def test_mart_reads_the_log_three_times_and_joins_in_place(nested_log, params):
    mart = user_day_mart(nested_log, params)
    mart.collect()
    final = plan(mart).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 3 and final.count("Reused") == 1
    assert exchanges(initial(user_day_mart(nested_log, params))) == 8
    assert "BroadcastNestedLoopJoin" not in final and "CartesianProduct" not in final


def test_joins_of_a_large_mart_add_no_shuffle(nested_log, params):
    spark = nested_log.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = initial(user_day_mart(nested_log, params))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.count("SortMergeJoin") == 3 and exchanges(text) == 8


def test_mart_reads_only_needed_columns_per_branch(nested_log, params):
    mode = nested_log.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = user_day_mart(nested_log, params)._jdf.queryExecution().explainString(mode)
    schemas = re.findall(r"ReadSchema: struct<(.*)", text)
    assert sum("query:" in s for s in schemas) == 1
    assert all("end_time" not in s for s in schemas if "query:" not in s)
    assert not any("labels" in s for s in schemas)
    assert text.count("GreaterThanOrEqual(creation_time") == len(schemas)


def test_both_top_lists_limit_groups_before_the_shuffle(nested_log, params):
    text = initial(user_day_mart(nested_log, params))
    assert text.count("WindowGroupLimit") == 4


def test_latest_queries_limit_groups_before_the_shuffle(nested_log, params):
    text = initial(latest_queries(job_stats(nested_log, params), params))
    below_shuffle = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below_shuffle


def test_scalar_reports_read_no_detail(spark):
    text = initial(queries.QUERIES["summary_metrics"](spark, SF_DIR))
    assert "lineitem" not in text


def test_main_table_reads_the_log_once(nested_log, params):
    from scanledger.plans.main_table import main_cost_table

    text = initial(main_cost_table(nested_log, params))
    assert text.count("FileScan") == 1 and exchanges(text) == 2 and "Join" not in text


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - WRITES_FIRST))
def test_no_pairwise_joins_and_no_python(name, spark):
    text = plan(queries.QUERIES[name](spark, SF_DIR))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "BatchEval"):
        assert banned not in text


def test_day_partition_prunes_folders(spark, tmp_path, params):
    from pyspark.sql import functions as F
    from scanledger.schema import JOBS
    from pyspark.sql import types as T

    path = str(tmp_path / "log")
    rows = spark.createDataFrame([job("a")], JOBS).withColumn("log_day", F.to_date("creation_time"))
    rows.write.partitionBy("log_day").parquet(path)
    schema = T.StructType([*JOBS.fields, T.StructField("log_day", T.DateType())])
    stats = job_stats(read_job_log(spark, path, schema=schema), params, day_partition="log_day")
    assert re.search(r"PartitionFilters: \[.*log_day.*2024-01-01", plan(stats))
    assert stats.count() == 1
