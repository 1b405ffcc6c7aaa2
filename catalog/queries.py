"""Every operator of the library as a query over one test-data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.functions import arrays, cost, display, identity, text, time
from scanledger.operators import allocation, estimates, jobs as job_ops, quality, rollups, shaping, sketches, tags
from scanledger.params import DEFAULT_DAILY_COST_THRESHOLD, Params
from scanledger.plans import main_table, mart as mart_plan, reports, runs, summaries
from scanledger.schema import MAIN_TABLE, MART
from scanledger.session import adopt, kept, work_path
from scanledger.sinks import snapshots as snapshot_sink, tables as table_sink, versions
from scanledger.sources import checked_log, job_log, projects as project_source, snapshots as snapshot_source
from scanledger.sources.star_log import EVENTS, job_rows, read_orders, read_star_log
from scanledger.streaming import alerts

# The events span 2024-01-01 to 2024-01-30: thirty days back from here is all of them.
PARAMS = Params(as_of="2024-01-31 00:00:00")
PERIOD = 30
RUN_TIME = datetime(2024, 1, 31)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(adopt(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_ops.job_stats(read_star_log(spark, sf_dir), PARAMS)


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_plan.user_day_mart(read_star_log(spark, sf_dir), PARAMS)


def in_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.in_period(mart(spark, sf_dir), PARAMS, PERIOD)


def main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_table.main_cost_table(read_star_log(spark, sf_dir), PARAMS)


def stored_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main table written once and read back, as its summaries use it."""
    path = work_path(spark, "main")
    table_sink.write_folder(main(spark, sf_dir), path, table_sink.MAIN_CLUSTER)
    return spark.read.schema(MAIN_TABLE).parquet(path)


def whole(name: str, alias: str | None = None) -> Column:
    """Split bytes as whole bytes."""
    return F.round(F.col(name), 0).cast("long").alias(alias or name.split(".")[-1])


def instant(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def second(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def hours(name: str) -> Column:
    return cost.half_up(F.col(name), 6).alias(name)


IDENTITY = ["date", "project_id", "user_email", "service_account"]
SCALARS = [
    "query_count",
    "cache_hit_count",
    "error_count",
    "total_bytes_processed",
    "total_bytes_billed",
    "estimated_cost_usd",
]


def scalar_view(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select(*IDENTITY, *SCALARS, hours("slot_hours"), "cache_hit_percentage", *extra)


def unnested(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """One row per array element, with its place from 1."""
    placed = df.select(*keys, F.posexplode(array).alias("place", "e"))
    return placed.select(*keys, (F.col("place") + 1).cast("long").alias("rank"), "e.*")


# --- job log -----------------------------------------------------------------


@query
def usage_extract(spark, sf_dir):
    return job_ops.usage_extract(read_star_log(spark, sf_dir), PARAMS).select(
        "project_id", "user_email", "job_id", instant("creation_time"), instant("end_time"),
        "duration_seconds", "query", "total_bytes_processed", "total_bytes_billed", "total_slot_ms",
        F.col("error_result.reason").alias("error_reason"), "cache_hit",
        text.qualified(
            F.col("destination_table.project_id"), F.col("destination_table.dataset_id"),
            F.col("destination_table.table_id"),
        ).alias("destination"),
        arrays.reference_total("referenced_tables").alias("reference_count"),
        F.size("labels").cast("long").alias("label_count"),
    )


@query
def project_job_log(spark, sf_dir):
    """The log of one project, every job type."""
    return job_log.of_project(read_star_log(spark, sf_dir), "proj-1").select(
        "job_id", "job_type", "statement_type", "priority", "total_bytes_billed"
    )


@query
def job_filter_counts(spark, sf_dir):
    """How many jobs each filter leaves, per project."""
    return job_ops.filter_counts(read_star_log(spark, sf_dir), PARAMS)


@query
def job_stats_flat(spark, sf_dir):
    return stats(spark, sf_dir).select(
        "job_id",
        time.date_text(F.col("day")).alias("date"),
        "service_account",
        F.col("hour_of_day").cast("long").alias("hour_of_day"),
        F.col("day_of_week").cast("long").alias("day_of_week"),
        "execution_time_seconds",
        F.size("referenced_datasets").cast("long").alias("dataset_count"),
        arrays.reference_total("referenced_tables_detail").alias("table_references"),
        "is_table_rebuild",
    )


@query
def referenced_datasets(spark, sf_dir):
    return stats(spark, sf_dir).select("job_id", F.explode("referenced_datasets").alias("dataset"))


@query
def referenced_tables(spark, sf_dir):
    """Fully named references, repeats shown as a count."""
    exploded = stats(spark, sf_dir).select("job_id", F.explode("referenced_tables_detail").alias("r"))
    return exploded.select(
        "job_id",
        text.qualified(F.col("r.project_id"), F.col("r.dataset_id"), F.col("r.table_id")).alias("table_name"),
        F.col("r.ref_count").alias("reference_count"),
    )


@query
def query_details(spark, sf_dir):
    return job_ops.query_details(stats(spark, sf_dir), PARAMS).select(
        "job_id", time.date_text(F.col("day")).alias("date"), "timestamp", "project_id", "user_email",
        "service_account", "statement_type", "priority", "execution_time_seconds",
        "total_bytes_processed", "total_bytes_billed", "total_slot_ms", "cache_hit", "has_error",
        "query_text", F.col("num_datasets_referenced").cast("long").alias("num_datasets_referenced"),
        "query_cost_usd",
    )


# --- roll-ups ----------------------------------------------------------------


@query
def user_daily_base(spark, sf_dir):
    return scalar_view(job_ops.present(rollups.user_days(stats(spark, sf_dir), PARAMS)))


@query
def main_user_stats(spark, sf_dir):
    return scalar_view(main_table.main_user_days(read_star_log(spark, sf_dir), PARAMS))


@query
def table_costs(spark, sf_dir):
    return job_ops.present(allocation.table_costs(stats(spark, sf_dir), PARAMS)).select(
        *IDENTITY, "table_name", "table_project", "table_dataset", "table_id", "query_count",
        "is_rebuild_operation", whole("bytes_processed"), whole("bytes_billed"), "table_cost_usd",
    )


@query
def dataset_costs_from_tables(spark, sf_dir):
    tables = allocation.table_costs(stats(spark, sf_dir), PARAMS)
    return job_ops.present(allocation.dataset_costs_from_tables(tables)).select(
        *IDENTITY, "dataset", "query_count", whole("bytes_processed"), whole("bytes_billed"),
        "dataset_cost_usd", "rebuild_operations",
    )


@query
def dataset_costs_direct(spark, sf_dir):
    large = main_table.main_stats(read_star_log(spark, sf_dir), PARAMS)
    return job_ops.present(allocation.dataset_costs_direct(large, PARAMS)).select(
        *IDENTITY, "dataset", "query_count", whole("bytes_processed"), whole("bytes_billed"),
        "dataset_cost_usd",
    )


@query
def hourly(spark, sf_dir):
    return job_ops.present(rollups.hourly(stats(spark, sf_dir), PARAMS)).select(
        *IDENTITY, F.col("hour_of_day").cast("long").alias("hour_of_day"), *SCALARS
    )


@query
def weekday(spark, sf_dir):
    return job_ops.present(rollups.weekday(stats(spark, sf_dir), PARAMS)).select(
        *IDENTITY, F.col("day_of_week").cast("long").alias("day_of_week"), "query_count",
        "total_bytes_billed", "estimated_cost_usd",
    )


# --- user-day mart -----------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole nested mart."""
    return mart(adopt(spark), sf_dir)


@query
def mart_scalars(spark, sf_dir):
    def size_or_null(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.size(name)).cast("long").alias(f"{name}_length")

    return scalar_view(
        mart(spark, sf_dir),
        *[
            size_or_null(name)
            for name in (
                "hourly_breakdown", "daily_breakdown", "dataset_costs", "table_costs", "recent_queries",
            )
        ],
    )


@query
def mart_hourly(spark, sf_dir):
    return unnested(mart(spark, sf_dir), IDENTITY, "hourly_breakdown").withColumn(
        "hour_of_day", F.col("hour_of_day").cast("long")
    )


@query
def mart_weekday(spark, sf_dir):
    return unnested(mart(spark, sf_dir), IDENTITY, "daily_breakdown").withColumn(
        "day_of_week", F.col("day_of_week").cast("long")
    )


@query
def mart_dataset_costs(spark, sf_dir):
    return unnested(mart(spark, sf_dir), IDENTITY, "dataset_costs").select(
        *IDENTITY, "rank", "dataset", whole("bytes_processed"), whole("bytes_billed"),
        "dataset_cost_usd", "rebuild_operations",
    )


@query
def mart_table_costs_top100(spark, sf_dir):
    return unnested(mart(spark, sf_dir), IDENTITY, "table_costs").select(
        *IDENTITY, "rank", "table_name", "table_id", "dataset_name", whole("bytes_processed"),
        whole("bytes_billed"), "table_cost_usd", "is_rebuild_operation", "rebuild_cost_usd",
        "incremental_cost_usd", "rebuild_count",
    )


@query
def mart_recent_top100(spark, sf_dir):
    return unnested(mart(spark, sf_dir), IDENTITY, "recent_queries")


# --- main table and summaries ------------------------------------------------


@query
def main_cost_table(spark, sf_dir):
    return scalar_view(
        main(spark, sf_dir), F.size("dataset_costs").cast("long").alias("dataset_costs_length")
    )


@query
def main_dataset_costs(spark, sf_dir):
    return unnested(main(spark, sf_dir), IDENTITY, "dataset_costs").select(
        *IDENTITY, "rank", "dataset", whole("bytes_processed"), whole("bytes_billed"), "dataset_cost_usd"
    )


@query
def daily_summary(spark, sf_dir):
    source = main_table.main_user_days(read_star_log(spark, sf_dir), PARAMS)
    return summaries.daily_summary(source).withColumn("total_slot_hours", hours("total_slot_hours"))


@query
def dataset_summary(spark, sf_dir):
    return summaries.dataset_summary(stored_main(spark, sf_dir)).select(
        "date", "project_id", "dataset_name", "unique_users", whole("total_bytes_processed"),
        whole("total_bytes_billed"), "total_cost_usd",
        F.size("top_users").cast("long").alias("top_users_length"),
    )


@query
def dataset_top_users(spark, sf_dir):
    keys = ["date", "project_id", "dataset_name"]
    return unnested(summaries.dataset_summary(stored_main(spark, sf_dir)), keys, "top_users").select(
        *keys, "rank", "user", "user_cost_usd", whole("user_bytes_processed")
    )


@query
def account_summary(spark, sf_dir):
    return summaries.account_summary(stored_main(spark, sf_dir)).select(
        "date", "project_id", "service_account", "total_queries", "total_bytes_processed",
        "total_bytes_billed", "total_cost_usd",
        F.size("top_datasets").cast("long").alias("top_datasets_length"),
    )


@query
def account_top_datasets(spark, sf_dir):
    keys = ["date", "project_id", "service_account"]
    return unnested(summaries.account_summary(stored_main(spark, sf_dir)), keys, "top_datasets").select(
        *keys, "rank", "dataset_name", "dataset_cost_usd", whole("dataset_bytes_processed")
    )


@query
def user_dataset_attribution(spark, sf_dir):
    keep = lambda rows: kept(rows, "attributed")
    return summaries.user_dataset_attribution(stored_main(spark, sf_dir), keep).withColumn(
        "bytes_processed", whole("bytes_processed")
    )


# --- reports -----------------------------------------------------------------


@query
def report_period_14(spark, sf_dir):
    """User-days of the default report period."""
    return reports.in_period(mart(spark, sf_dir), PARAMS).select(*IDENTITY, "query_count")


@query
def summary_metrics(spark, sf_dir):
    return reports.summary_metrics(in_report(spark, sf_dir))


@query
def cost_trend(spark, sf_dir):
    return reports.cost_trend(in_report(spark, sf_dir))


@query
def top_spenders(spark, sf_dir):
    return reports.top_spenders(in_report(spark, sf_dir))


@query
def cache_split(spark, sf_dir):
    split = reports.cache_split(in_report(spark, sf_dir))
    return split.select([cost.half_up(F.col(c), 6).alias(c) for c in split.columns])


def _history_view(history: DataFrame) -> DataFrame:
    return history.select(
        "dataset", "user", "user_display", "query_count", whole("total_bytes_processed"),
        "total_cost", "cache_hit_count", "error_count", second("last_queried"),
        cost.half_up(F.col("gigabytes_processed"), 2).alias("gigabytes_processed"),
        cost.half_up(F.col("cache_hit_percentage"), 2).alias("cache_hit_percentage"),
    )


@query
def query_history(spark, sf_dir):
    return _history_view(reports.query_history_of_jobs(stats(spark, sf_dir), PARAMS, PERIOD))


@query
def query_history_fallback(spark, sf_dir):
    """History over rows as older snapshots stored them: no texts, or scalars only."""
    stored = in_report(spark, sf_dir)
    kind = F.dayofmonth(F.to_date("date")) % 3
    older = stored.withColumns(
        {
            "recent_queries": F.when(kind == 0, F.col("recent_queries")),
            "dataset_costs": F.when(kind != 2, F.col("dataset_costs")),
        }
    )
    return _history_view(reports.query_history(older))


@query
def dataset_ranking(spark, sf_dir):
    return reports.dataset_ranking(in_report(spark, sf_dir)).select(
        "dataset", whole("bytes_processed"), "cost_usd",
        cost.half_up(F.col("pct_of_total"), 4).alias("pct_of_total"),
    )


@query
def table_cost_totals(spark, sf_dir):
    return reports.table_cost_totals_of_jobs(stats(spark, sf_dir), PARAMS).withColumn(
        "bytes_processed", whole("bytes_processed")
    )


@query
def table_rebuild_report(spark, sf_dir):
    totals = reports.table_cost_totals_of_jobs(stats(spark, sf_dir), PARAMS)
    return reports.table_rebuild_report(totals).select(
        "table_name", "dataset_name", "table_id", "total_cost", "rebuild_cost", "incremental_cost",
        whole("bytes_processed"), "rebuild_count",
        cost.half_up(F.col("rebuild_percent"), 4).alias("rebuild_percent"), "severity",
    )


@query
def user_dataset_report(spark, sf_dir):
    return reports.user_dataset_report(mart(spark, sf_dir)).withColumn(
        "bytes_processed", whole("bytes_processed")
    )


@query
def hourly_pattern(spark, sf_dir):
    return reports.hourly_pattern(mart(spark, sf_dir)).withColumn("hour", F.col("hour").cast("long"))


@query
def weekday_pattern(spark, sf_dir):
    return reports.weekday_pattern(mart(spark, sf_dir)).withColumn(
        "weekday", F.col("weekday").cast("long")
    )


# --- projects, runs and snapshots ---------------------------------------------


def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects derived from the customers; the first three own the jobs."""
    number = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        number.alias("index"),
        F.when(number % 11 != 5, F.concat(F.lit("proj-"), number)).alias("id"),
        F.when(number % 13 != 7, F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.when(number % 5 == 1, F.lit(True)).alias("disabled"),
    )


@query
def project_list(spark, sf_dir):
    return project_source.project_list(project_rows(spark, sf_dir))


@query
def enabled_project_jobs(spark, sf_dir):
    jobs = project_source.of_enabled_projects(read_star_log(spark, sf_dir), project_rows(spark, sf_dir))
    return jobs.groupBy("project_id").agg(F.count("*").alias("jobs"))


@query
def project_checks(spark, sf_dir):
    return quality.project_checks(project_rows(spark, sf_dir))


@query
def settings_checks(spark, sf_dir):
    """Settings derived from the parts; some sizes and prices fall to zero or below."""
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("index"),
        (F.col("p_size") - 10).cast("double").alias("historyDays"),
        (F.col("p_retailprice") - 1000).alias("costPerTerabyte"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("refreshInterval"),
    )
    return quality.settings_checks(rows)


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_source.enabled(project_rows(spark, sf_dir)).where("id IS NOT NULL")


@query
def run_totals(spark, sf_dir):
    return runs.run_totals(mart(spark, sf_dir), _watched(spark, sf_dir))


@query
def run_response(spark, sf_dir):
    """Good runs next to broken ones."""
    good = runs.run_totals(mart(spark, sf_dir), _watched(spark, sf_dir)).withColumn(
        "error", F.lit(None).cast("string")
    )
    watched = project_rows(spark, sf_dir).where("disabled AND id IS NOT NULL")
    broken = runs.failed_runs(watched, PARAMS, "2024-01-31_00-00-00", "log not readable")
    return runs.run_response(good.unionByName(broken.select(good.columns)))


@query
def monitoring_run(spark, sf_dir):
    """A whole run: snapshot written, totals read back from it, summary stored."""
    rows = runs.run_monitoring(
        spark, read_star_log(spark, sf_dir), _watched(spark, sf_dir), PARAMS,
        work_path(spark, "run"), RUN_TIME,
    )
    return rows.select(
        "project", "project_name", "run_ts", "records", "total_cost", "total_bytes_processed",
        "total_queries", "history_days", "price_per_tb", "error",
    )


def stored_snapshots(spark: SparkSession, sf_dir: str) -> str:
    """Snapshots of three times, the newest lacking one project, one past retention."""
    path = work_path(spark, "snapshots")
    rows = job_ops.present(rollups.user_days(stats(spark, sf_dir), PARAMS))
    snapshot_sink.write_snapshot(rows, path, "2023-10-01_05-00-00")
    snapshot_sink.write_snapshot(rows, path, "2024-01-30_05-00-00")
    partial = rows.where(F.col("project_id") != "proj-2")
    snapshot_sink.write_snapshot(partial, path, "2024-01-31_05-00-00")
    return path


@query
def latest_snapshot(spark, sf_dir):
    every = snapshot_source.read_snapshots(spark, stored_snapshots(spark, sf_dir))
    return scalar_view(snapshot_source.latest_per_project(every), F.col("snapshot_ts"))


@query
def retained_snapshots(spark, sf_dir):
    every = snapshot_source.read_snapshots(spark, stored_snapshots(spark, sf_dir))
    kept = snapshot_sink.retained(every, PARAMS)
    return kept.groupBy("snapshot_ts", "project_id").agg(
        F.count("*").alias("records"),
        cost.money_sum(F.col("estimated_cost_usd")).alias("cost_usd"),
    )


@query
def latest_run_summary(spark, sf_dir):
    path = work_path(spark, "summaries")
    totals = runs.run_totals(mart(spark, sf_dir), _watched(spark, sf_dir))
    for run_ts in ("2024-01-29_05-00-00", "2024-01-30_05-00-00"):
        snapshot_sink.write_run_summary(totals.withColumn("run_ts", F.lit(run_ts)), path)
    latest = snapshot_source.latest_run(snapshot_source.read_run_summaries(spark, path))
    return latest.select("project", "run_ts", "records", "total_cost", "total_queries")


@query
def upload_metadata(spark, sf_dir):
    rows = job_ops.present(rollups.user_days(stats(spark, sf_dir), PARAMS))
    return snapshot_sink.with_upload_metadata(rows, "scanledger", "2024-01-31_00-00-00").select(
        *IDENTITY, "estimated_cost_usd", "source", "uploaded_at", "uploaded_project"
    )


# --- tags, estimates, shaping --------------------------------------------------


@query
def cost_by_team(spark, sf_dir):
    return tags.cost_by_tag(stats(spark, sf_dir), PARAMS, "team")


@query
def cost_by_owner(spark, sf_dir):
    return tags.cost_by_tag(stats(spark, sf_dir), PARAMS, "owner")


@query
def cost_by_query_type(spark, sf_dir):
    return tags.cost_by_tag(stats(spark, sf_dir), PARAMS, "query_type")


@query
def tag_fields(spark, sf_dir):
    tagged = tags.with_tags(stats(spark, sf_dir))
    return tagged.select("job_id", *[f"tag_{name}" for name in text.TAG_LINES])


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "part")
        .groupBy(F.concat(F.lit("t_"), F.col("p_partkey") % 20).alias("table_id"))
        .agg((F.sum("p_size") * 1_000_000_000).alias("total_bytes_processed"))
    )


@query
def scan_cost_estimate(spark, sf_dir):
    estimate = estimates.scan_cost(table_sizes(spark, sf_dir))
    return estimate.select(
        "table_id", "total_bytes_processed",
        cost.half_up(F.col("terabytes_processed"), 6).alias("terabytes_processed"),
        cost.half_up(F.col("estimated_cost_usd"), 6).alias("estimated_cost_usd"),
    )


@query
def what_if_cost(spark, sf_dir):
    return estimates.what_if(table_sizes(spark, sf_dir))


def _dated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select(
        "job_id", time.date_text(F.col("day")).alias("date"), "total_bytes_billed"
    )


@query
def partition_filter(spark, sf_dir):
    return shaping.partition_filter(_dated_jobs(spark, sf_dir), "date", ">= '2024-01-15'")


@query
def incremental_build(spark, sf_dir):
    """Days after the ones built already, rolled up on their own."""
    days = _dated_jobs(spark, sf_dir)
    built = shaping.partition_filter(days, "date", "<= '2024-01-20'")
    fresh = shaping.newer_than(days, "date", built)
    return fresh.groupBy("date").agg(
        F.count("*").alias("jobs"), F.sum("total_bytes_billed").alias("total_bytes_billed")
    )


@query
def exploration_limit(spark, sf_dir):
    jobs = stats(spark, sf_dir).select("job_id", second("creation_time"))
    return shaping.exploration_limit(jobs.orderBy("job_id"))


# --- display -------------------------------------------------------------------


@query
def display_formats(spark, sf_dir):
    return stats(spark, sf_dir).select(
        "job_id",
        display.bytes_text(F.col("total_bytes_processed")).alias("bytes_text"),
        display.currency_text(F.col("total_bytes_billed") / 1e6).alias("currency_text"),
        display.share_text(F.col("total_bytes_billed"), F.col("total_bytes_processed")).alias("share_text"),
        display.date_display(F.col("creation_time"), "short").alias("short_date"),
        display.date_display(F.col("creation_time"), "medium").alias("medium_date"),
        display.date_display(F.col("creation_time"), "long").alias("long_date"),
    )


@query
def display_labels(spark, sf_dir):
    rows = stats(spark, sf_dir)
    spender = identity.spender(F.col("service_account"), F.col("user_email"))
    account = identity.is_account(F.col("service_account"))
    return rows.select(
        "job_id",
        spender.alias("spender"),
        identity.short_spender(spender, account).alias("display_name"),
        text.dataset_in_text(F.col("query")).alias("dataset_in_text"),
        time.hour_label(F.col("hour_of_day")).alias("hour_label"),
        time.weekday_label(F.col("day_of_week")).alias("weekday_label"),
        cost.weekend_factor(F.col("day")).alias("weekend_factor"),
        cost.billed_bytes(F.col("total_bytes_processed")).alias("granule_bytes"),
        cost.terabytes(F.col("total_bytes_processed")).alias("terabytes"),
        cost.gigabytes(F.col("total_bytes_processed")).alias("gigabytes"),
    )


@query
def displayed_datasets(spark, sf_dir):
    stored = in_report(spark, sf_dir)
    return reports.displayed_datasets(reports.dataset_ranking(stored), stored)


# --- alerts ----------------------------------------------------------------------


def _alert_view(rows: DataFrame) -> DataFrame:
    return rows.select("policy", second("window_start"), second("window_end"), "value", "threshold")


@query
def alert_daily_cost(spark, sf_dir):
    return _alert_view(alerts.daily_cost_alerts(read_star_log(spark, sf_dir)))


@query
def alert_failures(spark, sf_dir):
    return _alert_view(alerts.failure_alerts(read_star_log(spark, sf_dir)))


@query
def alert_any(spark, sf_dir):
    jobs = read_star_log(spark, sf_dir)
    return _alert_view(alerts.any_alert(alerts.daily_cost_alerts(jobs), alerts.failure_alerts(jobs)))


def streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with its events arriving as a stream."""
    # A pattern, as streams take a single file by pattern only; a table stored as a folder matches as well.
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return job_rows(events, read_orders(spark, sf_dir))


@query
def alert_stream(spark, sf_dir):
    """Both policies run as streams into one store of alerts, read back."""
    jobs, path = streamed_jobs(spark, sf_dir), work_path(spark, "alerts")
    for fired in (alerts.daily_cost_alerts(jobs), alerts.failure_alerts(jobs)):
        alerts.keep_alerts(fired, path, work_path(spark, "alert-state")).awaitTermination()
    return _alert_view(alerts.current_alerts(spark, path))


# --- stored tables ----------------------------------------------------------------


@query
def stored_tables(spark, sf_dir):
    """Days replaced in a stored main table, read back by partition."""
    path, rows = work_path(spark, "table"), main(spark, sf_dir)
    table_sink.write_folder(rows, path, table_sink.MAIN_CLUSTER)
    late = shaping.incremental(rows, "date", ">= '2024-01-25'")
    table_sink.replace_days(late, path, table_sink.MAIN_CLUSTER)
    back = spark.read.parquet(path)
    return back.groupBy(time.date_text(F.col("day")).alias("date")).agg(
        F.count("*").alias("records"),
        cost.money_sum(F.col("estimated_cost_usd")).alias("cost_usd"),
    )


# --- runs over broken logs, uploads, tables that change as a whole ----------------------


def _log_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per project id of the log, and the customers' projects that have no jobs."""
    own = read_star_log(spark, sf_dir).select(F.col("project_id").alias("id")).distinct()
    others = _watched(spark, sf_dir).select("id").join(own, "id", "left_anti")
    return own.unionByName(others).select(
        "id", F.concat(F.lit("Project "), "id").alias("name"), F.lit(None).cast("boolean").alias("disabled")
    )


def json_log(spark: SparkSession, sf_dir: str) -> str:
    """The log as JSON lines, a folder per project; some lines of proj-1 are cut off in the middle."""
    path, jobs = work_path(spark, "json-log"), read_star_log(spark, sf_dir)
    fields = F.struct(*[F.col(c) for c in jobs.columns if c != "project_id"])
    line = F.to_json(fields, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = (F.col("project_id") == "proj-1") & (F.substring("job_id", 5, 20).cast("long") % 701 == 0)
    lines = jobs.select("project_id", F.when(cut, F.left(line, F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("value"))
    lines.write.partitionBy("project_id").text(path)
    return path


@query
def checked_run(spark, sf_dir):
    """One run over a log with broken lines: the project they belong to fails, the others do not."""
    schema = read_star_log(spark, sf_dir).schema
    checked = checked_log.read_checked_log(spark, json_log(spark, sf_dir), schema=schema)
    rows = runs.run_monitoring(spark, checked, _log_projects(spark, sf_dir), PARAMS, work_path(spark, "checked"), RUN_TIME, "parquet")
    response = runs.run_response(rows)
    return response.select(
        "project", "success", "records", "total_cost", F.regexp_extract("error", "^([0-9]+) broken", 1).cast("long").alias("broken_rows")
    )


@query
def scheduled_run(spark, sf_dir):
    """The response of a scheduled run beside what it put into the shared store."""
    store = work_path(spark, "store")
    response = runs.scheduled_run(
        spark, read_star_log(spark, sf_dir), _watched(spark, sf_dir), PARAMS, work_path(spark, "scheduled"), store, "scanledger", RUN_TIME
    )
    rows = snapshot_sink.read_uploads(spark, store, MART)
    uploaded = rows.groupBy(F.col("uploaded_project").alias("project"), "source", "uploaded_at").agg(F.count("*").alias("uploaded"))
    return response.join(uploaded, "project", "left")


@query
def project_run(spark, sf_dir):
    """A run of one project, its totals observed while the snapshot is written."""
    rows = runs.monitor_project(
        spark, read_star_log(spark, sf_dir), _watched(spark, sf_dir), "proj-2", PARAMS, work_path(spark, "one"), RUN_TIME
    )
    return rows.select("project", "project_name", "records", "total_cost", "total_bytes_processed", "total_queries", "error")


@query
def newest_folders(spark, sf_dir):
    """The newest snapshot of every project, found by folder names."""
    return scalar_view(snapshot_source.read_latest(spark, stored_snapshots(spark, sf_dir)), F.col("snapshot_ts"))


@query
def replaced_range(spark, sf_dir):
    """Days published anew as a whole, one of them without rows now, the oldest expired."""
    path, rows = work_path(spark, "versions"), main(spark, sf_dir)
    versions.replace_range(rows, path, "2024-01-01", "2024-01-31", table_sink.MAIN_CLUSTER)
    late = rows.where(F.col("date").between("2024-01-20", "2024-01-25") & (F.col("date") != "2024-01-22"))
    versions.replace_range(late, path, "2024-01-20", "2024-01-25", table_sink.MAIN_CLUSTER)
    versions.drop_before(spark, path, "2024-01-05")
    back = versions.read_live(spark, path, MAIN_TABLE)
    return back.groupBy(time.date_text(F.col("day")).alias("date")).agg(
        F.count("*").alias("records"), cost.money_sum(F.col("estimated_cost_usd")).alias("cost_usd")
    )


@query
def small_job_share(spark, sf_dir):
    """What leaving out small jobs hides per user-day: two stored tables, joined bucket by bucket."""
    log = read_star_log(spark, sf_dir)
    every = job_ops.present(rollups.user_days(job_ops.job_stats(log, PARAMS), PARAMS))
    for name, rows in (("user_days", every), ("main_days", main_table.main_user_days(log, PARAMS))):
        table_sink.write_clustered(rows.where("user_email IS NOT NULL"), "scanledger_buckets", name, table_sink.MAIN_CLUSTER)
    since = F.col("day") >= F.to_date(F.lit("2024-01-10"))
    keys = ["day", "project_id", "user_email"]
    whole_days = job_log.named_table(spark, "scanledger_buckets", "user_days").where(since)
    large = job_log.named_table(spark, "scanledger_buckets", "main_days").where(since)
    large = large.select(*keys, F.col("query_count").alias("large_queries"), F.col("estimated_cost_usd").alias("large_cost"))
    return whole_days.join(large, keys, "left").select(
        "date", "project_id", "user_email", "query_count", "estimated_cost_usd",
        F.coalesce("large_queries", F.lit(0)).alias("large_queries"), F.coalesce("large_cost", F.lit(0.0)).alias("large_cost"),
    )


@query
def alert_changes(spark, sf_dir):
    """Both policies as streams that tell changes only, kept by key."""
    jobs, path = streamed_jobs(spark, sf_dir), work_path(spark, "alert-store")
    for fired in (alerts.alert_changes(jobs, DEFAULT_DAILY_COST_THRESHOLD, PARAMS.price_per_tb), alerts.alert_changes(jobs, 0)):
        alerts.keep_alerts(fired, path, work_path(spark, "alert-state")).awaitTermination()
    return _alert_view(alerts.current_alerts(spark, path))


@query
def newest_first(spark, sf_dir):
    """The usage extract written newest first; ranks are told by file and row number."""
    extract = job_ops.usage_extract(read_star_log(spark, sf_dir), PARAMS).select("job_id", "creation_time", "total_bytes_billed")
    path = table_sink.write_sorted(extract, work_path(spark, "sorted"), F.desc("creation_time"), F.col("job_id"))
    return table_sink.read_sorted(spark, path, extract.schema).select("rank", "job_id", instant("creation_time"), "total_bytes_billed")


@query
def history_order(spark, sf_dir):
    """The history in the order that is shown: latest first, then most bytes."""
    history = reports.query_history_of_jobs(stats(spark, sf_dir), PARAMS, PERIOD)
    keys = [F.desc("last_queried"), F.desc("total_bytes_processed"), F.asc("dataset"), F.asc("user")]
    rows = history.select("dataset", "user", second("last_queried").alias("shown"), "last_queried", "total_bytes_processed")
    path = table_sink.write_sorted(rows, work_path(spark, "history"), *keys)
    return table_sink.read_sorted(spark, path, rows.schema).select("rank", "dataset", "user", F.col("shown").alias("last_queried"))


@query
def config_checks(spark, sf_dir):
    """Configurations of fifty customers' projects each, checked as a whole; some lack parts."""
    rows = project_rows(spark, sf_dir).withColumn("config", F.floor(F.col("index") / 50).cast("long"))
    fields = [F.col(c) for c in ("index", "id", "name", "description", "disabled")]
    configs = rows.groupBy("config").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("projects"))
    number = F.col("config").cast("double")
    given = F.struct((number % 7 - 1).alias("historyDays"), (number % 5).alias("costPerTerabyte"), number.alias("refreshInterval"))
    whole_configs = configs.select(
        "config",
        F.when(F.col("config") % 10 != 7, F.transform("projects", lambda p: p.dropFields("index"))).alias("projects"),
        F.when(F.col("config") % 10 != 3, given).alias("settings"),
    )
    return quality.config_checks(whole_configs, "config")


def _table_set(spark: SparkSession, sf_dir: str, schema: str) -> dict[str, DataFrame]:
    return runs.build_all(spark, read_star_log(spark, sf_dir), PARAMS, schema)


@query
def table_set(spark, sf_dir):
    """Rows and cost of the stored main table, the views on it and the attribution table, read back by name."""
    spent = {
        "main": "estimated_cost_usd", "daily": "total_estimated_cost_usd", "datasets": "total_cost_usd",
        "accounts": "total_cost_usd", "attribution": "cost_usd",
    }
    built = _table_set(spark, sf_dir, "scanledger_set")
    counted = [
        built[key].groupBy(F.lit(key).alias("table")).agg(F.count("*").alias("records"), cost.money_sum(F.col(column)).alias("cost_usd"))
        for key, column in spent.items()
    ]
    return alerts.any_alert(*counted)


@query
def catalog_sizes(spark, sf_dir):
    """Rows per table of a set as the catalogue knows them, and whether each has a price."""
    _table_set(spark, sf_dir, "scanledger_sizes")
    sizes = estimates.catalog_sizes(spark, "scanledger_sizes")
    priced = estimates.scan_cost(sizes).select("table_id", (F.col("estimated_cost_usd") > 0).alias("priced"))
    return sizes.select("table_id", "row_count").join(priced, "table_id")


@query
def sketched_users(spark, sf_dir):
    """Distinct users per dataset over a period, exactly and from daily sketches alone."""
    usage = summaries.dataset_usage(stored_main(spark, sf_dir))
    path = work_path(spark, "sketches")
    sketches.user_sketches(usage, "date", "dataset_name").write.partitionBy("date").parquet(path)
    kept = spark.read.schema("dataset_name string, users binary, date string").parquet(path)
    period = F.col("date").between("2024-01-05", "2024-01-25")
    guessed = sketches.distinct_users(kept.where(period), "dataset_name")
    exact = usage.where(period).groupBy("dataset_name").agg(F.count_distinct(sketches.who()).alias("users"))
    error = F.abs(F.col("unique_users") - F.col("users")) / F.col("users")
    return exact.join(guessed, "dataset_name").select("dataset_name", "users", (error <= 0.05).alias("within_error"))


@query
def report_rows(spark, sf_dir):
    """What all reports add up, from one scan of the mart."""
    return reports.report_rows(mart(spark, sf_dir), PARAMS, PERIOD).select(
        "report", "key", "other", "account", "queries", "hits", whole("bytes"), "cost"
    )


@query
def report_bundle(spark, sf_dir):
    """All bundled reports split off the stored rows: their size and cost."""
    path = work_path(spark, "report-rows")
    reports.report_rows(mart(spark, sf_dir), PARAMS, PERIOD).write.parquet(path)
    rows = spark.read.schema("report string, key string, other string, account boolean, queries bigint, hits bigint, bytes double, cost double").parquet(path)
    spent = {
        "summary_metrics": F.col("total_cost_usd"), "cost_trend": F.col("cost_usd"),
        "top_spenders": F.col("user_cost") + F.col("service_account_cost"), "dataset_ranking": F.col("cost_usd"),
        "user_dataset_report": F.col("cost_usd"), "hourly_pattern": F.col("cost_usd"), "weekday_pattern": F.col("cost_usd"),
    }
    found = reports.bundled(rows)
    return alerts.any_alert(
        *[found[name].agg(F.count("*").alias("records"), cost.money_sum(amount).alias("cost_usd")).withColumn("report", F.lit(name)) for name, amount in spent.items()]
    )


@query
def stored_user_days(spark, sf_dir):
    """User-days stored as plain JSON rows without their arrays, read back."""
    path = work_path(spark, "rows")
    job_ops.present(rollups.user_days(stats(spark, sf_dir), PARAMS)).write.json(path)
    back = snapshot_source.read_user_days(spark, path, multi_line=False)
    return scalar_view(back, F.col("recent_queries").isNull().alias("without_texts"))


@query
def configured_settings(spark, sf_dir):
    """Settings and projects of configuration files that hold fifty customers' projects each."""
    rows = project_rows(spark, sf_dir).withColumn("config", F.floor(F.col("index") / 50).cast("long"))
    listed = F.collect_list(F.struct("id", "name", "description", "disabled")).alias("projects")
    configs = rows.groupBy("config").agg(listed)
    given = F.struct((F.col("config") % 3).cast("double").alias("historyDays"), F.lit(6.25).alias("costPerTerabyte"))
    path = work_path(spark, "configs")
    configs.withColumn("settings", given).write.partitionBy("config").json(path)
    config = project_source.read_config(spark, path)
    chosen = project_source.settings(config)
    kept = project_source.enabled(project_source.projects(config)).agg(F.count("*").alias("enabled"), F.count("id").alias("with_id"))
    return kept.withColumns({name: chosen.select(name).scalar() for name in ("costPerTerabyte", "refreshInterval")})
