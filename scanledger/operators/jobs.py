"""From the raw job log to job rows: filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.functions import arrays, cost, identity, text, time
from scanledger.params import Params

# What identifies a user-day.  The service account is a function of the email,
# so it is derived after grouping instead of being shuffled as a key.
KEY = ["day", "project_id", "user_email"]


def history_window(
    jobs: DataFrame, params: Params, column: str = "creation_time", day_partition: str | None = None
) -> DataFrame:
    """Jobs of the last ``history_days`` days.

    Name the log's day partition column, if it has one, and older folders are
    not even listed.
    """
    kept = jobs.where(F.col(column) >= params.history_start())
    if day_partition:
        kept = kept.where(F.col(day_partition) >= F.to_date(params.history_start()))
    return kept


def _is_query() -> Column:
    return F.col("job_type") == "QUERY"


def _is_no_script() -> Column:
    return F.col("statement_type") != "SCRIPT"


def _is_large(params: Params) -> Column:
    return F.col("total_bytes_processed") > params.min_bytes


def queries_only(jobs: DataFrame) -> DataFrame:
    return jobs.where(_is_query())


def without_scripts(jobs: DataFrame) -> DataFrame:
    """Drops scripts, and rows whose statement type is unknown."""
    return jobs.where(_is_no_script())


def without_small_jobs(jobs: DataFrame, params: Params) -> DataFrame:
    return jobs.where(_is_large(params))


def filter_counts(jobs: DataFrame, params: Params) -> DataFrame:
    """(project_id, filter, jobs): how many jobs each filter leaves after those before it, counted in one pass."""
    steps = {
        "history": F.col("creation_time") >= params.history_start(),
        "queries": _is_query(),
        "no_scripts": _is_no_script(),
        "no_small": _is_large(params),
    }
    kept, counts = F.lit(True), []
    for name, passes in steps.items():
        kept = kept & passes
        counts.append(F.struct(F.lit(name).alias("filter"), F.count_if(kept).alias("jobs")))
    counted = jobs.groupBy("project_id").agg(F.array(*counts).alias("steps"))
    return counted.select("project_id", F.inline("steps")).where("jobs > 0")


def billable(jobs: DataFrame, params: Params, day_partition: str | None = None) -> DataFrame:
    """The jobs every report is about."""
    return without_scripts(queries_only(history_window(jobs, params, day_partition=day_partition)))


def usage_extract(jobs: DataFrame, params: Params) -> DataFrame:
    """Raw usage rows; order by ``creation_time`` at the sink if wanted."""
    return billable(jobs, params).select(
        "project_id",
        "user_email",
        "job_id",
        "creation_time",
        "end_time",
        time.elapsed_seconds(F.col("creation_time"), F.col("end_time")).alias("duration_seconds"),
        "query",
        "total_bytes_processed",
        "total_bytes_billed",
        "total_slot_ms",
        "error_result",
        "cache_hit",
        "destination_table",
        "referenced_tables",
        "labels",
    )


def job_stats(
    jobs: DataFrame,
    params: Params,
    skip_small: bool = False,
    day_partition: str | None = None,
) -> DataFrame:
    """Billable jobs with everything derived from a single row."""
    kept = billable(jobs, params, day_partition)
    if skip_small:
        kept = without_small_jobs(kept, params)
    created = F.col("creation_time")
    return kept.withColumns(
        {
            "day": time.day(created),
            "service_account": identity.service_account(F.col("user_email")),
            "hour_of_day": F.hour(created),
            "day_of_week": F.dayofweek(created),
            "execution_time_seconds": time.elapsed_seconds(created, F.col("end_time")),
            "referenced_datasets": arrays.distinct_datasets("referenced_tables"),
            "referenced_tables_detail": arrays.full_tables("referenced_tables"),
            "is_table_rebuild": arrays.writes_own_source("destination_table", "referenced_tables"),
        }
    )


def query_details(stats: DataFrame, params: Params) -> DataFrame:
    """One row per query, with its own cost and the start of its text."""
    return stats.select(
        "day",
        "job_id",
        "creation_time",
        time.timestamp_text(F.col("creation_time")).alias("timestamp"),
        "project_id",
        "user_email",
        "service_account",
        "statement_type",
        "priority",
        "hour_of_day",
        "day_of_week",
        "execution_time_seconds",
        "total_bytes_processed",
        "total_bytes_billed",
        "total_slot_ms",
        "cache_hit",
        F.col("error_result").isNotNull().alias("has_error"),
        text.truncated(F.col("query"), params.text_limit).alias("query_text"),
        F.size("referenced_datasets").alias("num_datasets_referenced"),
        cost.cost_usd(F.col("total_bytes_billed"), params.price_per_tb).alias("query_cost_usd"),
        "referenced_datasets",
    )


def present(df: DataFrame) -> DataFrame:
    """Grouped rows as reports show them: text date first, service account added."""
    rest = [c for c in df.columns if c not in (*KEY, "service_account")]
    return df.select(
        time.date_text(F.col("day")).alias("date"),
        "project_id",
        "user_email",
        identity.service_account(F.col("user_email")).alias("service_account"),
        *rest,
    )
