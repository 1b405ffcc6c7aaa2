"""The user-day mart: one row per day, project and user, with nested detail.

Three reads of the log feed it, each of the columns it needs:

* hours   -> scalars, hourly and weekday detail (the date fixes the weekday)
* refs    -> table and dataset costs
* texts   -> latest queries

Table costs are aggregated once: datasets and tables need the same columns of
them, so the second use reuses the first one's shuffle.  Each part ends up
hash-partitioned on the user-day, so the joins that put them together move no
data.  Rows are aggregated before they are shuffled, or limited to the top k, so
a single user with a third of all jobs sends little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.functions.cost import cost_usd
from scanledger.operators.allocation import (
    dataset_costs_from_tables,
    dataset_of_table,
    table_costs,
)
from scanledger.operators.jobs import KEY, job_stats, present, query_details
from scanledger.operators.ranking import dearest_first, gathered, ranked_arrays, top_k
from scanledger.operators.rollups import MEASURES, added_up, hourly, scalar_columns
from scanledger.params import Params
from scanledger.schema import MART


def day_profile(stats: DataFrame, params: Params) -> DataFrame:
    """Scalars with hourly and weekday detail."""
    hours = hourly(stats, params)
    hour = F.struct(
        "hour_of_day",
        F.col("query_count").alias("hourly_queries"),
        F.col("estimated_cost_usd").alias("hourly_cost"),
    )
    rows = gathered(hours.select(*KEY, *MEASURES, hour.alias("hour")), *KEY)
    grouped = rows.groupBy(*KEY).agg(*added_up(), F.sort_array(F.collect_list("hour")).alias("hours"))
    by_weekday = F.array(
        F.struct(
            F.dayofweek("day").alias("day_of_week"),
            F.col("query_count").alias("daily_queries"),
            cost_usd(F.col("total_bytes_billed"), params.price_per_tb).alias("daily_cost"),
        )
    )
    # Detail is matched on equal keys, and a missing key equals nothing.
    matched = F.col("project_id").isNotNull() & F.col("user_email").isNotNull()
    return grouped.select(
        *KEY,
        *scalar_columns(params),
        F.when(matched, F.col("hours")).alias("hourly_breakdown"),
        F.when(matched, by_weekday).alias("daily_breakdown"),
    )


def dataset_array(tables: DataFrame) -> DataFrame:
    """``dataset_costs`` per user-day.

    The array holds every dataset the account read that day, as asked for; what
    is collected are finished sums, one per dataset.
    """
    entry = F.struct(
        "dataset", "bytes_processed", "bytes_billed", "dataset_cost_usd", "rebuild_operations"
    )
    rows = gathered(dataset_costs_from_tables(tables).select(*KEY, entry.alias("entry")), *KEY)
    collected = rows.groupBy(*KEY).agg(F.collect_list("entry").alias("datasets"))
    return collected.select(
        *KEY, dearest_first("datasets", "dataset_cost_usd", "dataset").alias("dataset_costs")
    )


def table_fields() -> list[Column | str]:
    """What is kept of a table's cost in a user-day."""
    rebuild, price = F.col("is_rebuild_operation"), F.col("table_cost_usd")
    return [
        "table_name",
        "table_id",
        dataset_of_table().alias("dataset_name"),
        "bytes_processed",
        "bytes_billed",
        "table_cost_usd",
        "is_rebuild_operation",
        F.when(rebuild, price).otherwise(F.lit(0.0)).alias("rebuild_cost_usd"),
        F.when(~rebuild, price).otherwise(F.lit(0.0)).alias("incremental_cost_usd"),
        F.when(rebuild, 1).otherwise(0).cast("long").alias("rebuild_count"),
    ]


def table_array(tables: DataFrame, params: Params) -> DataFrame:
    """``table_costs`` per user-day: its dearest tables."""
    order = [F.desc_nulls_last("table_cost_usd"), F.asc_nulls_first("table_name")]
    return ranked_arrays(top_k(tables, KEY, order, params.table_limit), KEY, table_fields(), "table_costs")


def latest_queries(stats: DataFrame, params: Params) -> DataFrame:
    """The newest queries per user-day, as rows with their rank."""
    return top_k(
        query_details(stats, params),
        KEY,
        [F.desc_nulls_last("creation_time"), F.asc_nulls_first("job_id")],
        params.query_limit,
    )


def recent_queries(stats: DataFrame, params: Params) -> DataFrame:
    fields = [
        "job_id",
        "timestamp",
        "statement_type",
        "priority",
        "total_bytes_processed",
        "query_cost_usd",
        "execution_time_seconds",
        "cache_hit",
        "has_error",
        "query_text",
    ]
    return ranked_arrays(latest_queries(stats, params), KEY, fields, "recent_queries")


def mart_of(stats: DataFrame, params: Params) -> DataFrame:
    """The mart from job rows (see ``job_stats``)."""
    tables = table_costs(stats, params)
    return present(
        day_profile(stats, params)
        .join(dataset_array(tables), KEY, "left")
        .join(table_array(tables, params), KEY, "left")
        .join(recent_queries(stats, params), KEY, "left")
    ).select(MART.fieldNames())


def user_day_mart(jobs: DataFrame, params: Params, day_partition: str | None = None) -> DataFrame:
    """The mart from a job log; unordered, see ``sinks`` for stored order."""
    return mart_of(job_stats(jobs, params, day_partition=day_partition), params)
