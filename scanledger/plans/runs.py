"""Monitoring runs: all enabled projects in one job, totals, summaries, tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scanledger.functions.cost import money_sum
from scanledger.params import Params
from scanledger.plans import summaries
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from scanledger.schema import MART, PROJECTS, RUN_SUMMARY, conform
from scanledger.session import kept
from scanledger.sinks import tables
from scanledger.sinks.snapshots import stamp, upload, write_run_summary, write_snapshot
from scanledger.sources import checked_log
from scanledger.sources import projects as project_source
from scanledger.sources.job_log import named_table, of_project
from scanledger.sources.snapshots import read_run_summaries, read_snapshots


# What a job that breaks on its input raises; anything else is a fault of ours.
_JOB_FAILED = (PySparkException, Py4JJavaError)


def _totals() -> list[Column]:
    return [
        F.count("*").alias("records"),
        money_sum(F.col("estimated_cost_usd")).alias("total_cost"),
        F.sum("total_bytes_processed").alias("total_bytes_processed"),
        F.sum("query_count").alias("total_queries"),
    ]


def run_totals(mart: DataFrame, project_rows: DataFrame) -> DataFrame:
    """Records, cost, bytes and queries per project; zeros for one without records."""
    totals = mart.groupBy(F.col("project_id").alias("id")).agg(*_totals())
    zero = F.lit(0)
    return project_rows.join(totals, "id", "left").select(
        F.col("id").alias("project"),
        F.col("name").alias("project_name"),
        F.coalesce("records", zero).alias("records"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        F.coalesce("total_bytes_processed", zero).alias("total_bytes_processed"),
        F.coalesce("total_queries", zero).alias("total_queries"),
    )


def run_response(summary: DataFrame) -> DataFrame:
    """What a scheduled run reports back per project."""
    return summary.select(
        "project",
        F.col("error").isNull().alias("success"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        "error",
    )


def _run_rows(rows: DataFrame, params: Params, run_ts: str, **values) -> DataFrame:
    stamped = rows.withColumns(
        {
            "run_ts": F.lit(run_ts),
            "history_days": F.lit(params.history_days),
            "price_per_tb": F.lit(params.price_per_tb),
            **{name: F.lit(value) for name, value in values.items()},
        }
    )
    return conform(stamped, RUN_SUMMARY)


def failed_runs(project_rows: DataFrame, params: Params, run_ts: str, message: str | Column) -> DataFrame:
    """Run rows of projects whose run broke; the message is a text or a column of ``project_rows``."""
    told = message if isinstance(message, Column) else F.lit(message)
    named = project_rows.select(F.col("id").alias("project"), F.col("name").alias("project_name"), told.alias("error"))
    return _run_rows(named, params, run_ts)


def _snapshot_run(
    jobs: DataFrame, watched: DataFrame, params: Params, path: str, run_ts: str, fmt: str
) -> DataFrame:
    """Store the mart of these jobs and return the run rows of the watched projects, read back from it."""
    started = time.monotonic()
    write_snapshot(user_day_mart(jobs, params), path, run_ts, fmt)
    stored = read_snapshots(jobs.sparkSession, path, fmt).where(F.col("snapshot_ts") == run_ts)
    return _stored_run(run_totals(stored, watched), params, path, run_ts, started)


def _stored_run(totals: DataFrame, params: Params, path: str, run_ts: str, started: float) -> DataFrame:
    return _run_rows(
        totals,
        params,
        run_ts,
        elapsed_seconds=time.monotonic() - started,
        output_path=f"{path}/snapshot_ts={run_ts}",
    )


def _observed_run(
    jobs: DataFrame, watched: DataFrame, params: Params, path: str, run_ts: str, fmt: str
) -> DataFrame:
    """The run of a single project: its totals are counted while the snapshot is written, and nothing is read back."""
    started = time.monotonic()
    seen = Observation("run totals")
    write_snapshot(user_day_mart(jobs, params), path, run_ts, fmt, seen, _totals())
    found = seen.get
    named = watched.select(F.col("id").alias("project"), F.col("name").alias("project_name"))
    totals = {name: F.lit(found.get(name) or 0).cast("double" if name == "total_cost" else "long") for name in found}
    return _stored_run(named.withColumns(totals), params, path, run_ts, started)


def _checked_run(
    checked: DataFrame, watched: DataFrame, params: Params, path: str, run_ts: str, fmt: str
) -> DataFrame:
    """One run over a checked log: projects with broken input get error rows and no snapshot.

    The raw log is scanned once, when its rows are staged; which projects are
    broken is a grouping of the few broken rows.  The projects with what is broken
    of them are stored, as the jobs, the totals and the error rows ask for them.
    """
    staged = checked_log.stage(checked, params)
    broken = checked_log.broken_projects(staged).where("id IS NOT NULL")
    told = kept(conform(watched, PROJECTS).join(broken, "id", "left"), "watched")
    whole = told.where("broken_rows IS NULL").select(PROJECTS.fieldNames())
    jobs = project_source.spread_over_projects(checked_log.good_rows(staged), whole)
    failed = failed_runs(told.where("broken_rows IS NOT NULL"), params, run_ts, F.col("error"))
    return _snapshot_run(jobs, whole, params, path, run_ts, fmt).unionByName(failed)


def _one_by_one(
    jobs: DataFrame, watched: DataFrame, params: Params, path: str, run_ts: str, fmt: str
) -> DataFrame:
    """A run per configured project, so that only the broken ones end in error rows."""
    rows = None
    for row in watched.select("id").distinct().orderBy("id").collect():
        one = watched.where(F.col("id").eqNullSafe(F.lit(row["id"])))
        try:
            done = _snapshot_run(of_project(jobs, row["id"]), one, params, path, run_ts, fmt)
        except _JOB_FAILED as error:
            if isinstance(error, AnalysisException):
                raise
            done = failed_runs(one, params, run_ts, str(error))
        rows = done if rows is None else rows.unionByName(done)
    return rows


def run_monitoring(
    spark: SparkSession,
    jobs: DataFrame,
    project_rows: DataFrame,
    params: Params,
    output: str,
    moment: datetime | None = None,
    fmt: str = "json",
) -> DataFrame:
    """Snapshot the mart of all enabled projects and return one run row per project.

    One job serves all projects, keyed by project.  The totals come from the
    stored snapshot, so the log is read once.  Jobs of ``read_checked_log``
    carry their problems along: projects with broken input end in error rows of
    the same run.  Of other logs, where a broken row fails the job, the projects
    are then run one by one.  Faults of a plan itself are raised.
    ``fmt="parquet"`` stores the snapshot in columns, for reports that read a few.
    """
    run_ts = stamp(moment or datetime.now(timezone.utc))
    watched = project_source.enabled(project_rows)
    path = f"{output}/snapshots"
    if checked_log.PROBLEM in jobs.columns:
        rows = _checked_run(jobs, watched, params, path, run_ts, fmt)
    else:
        try:
            together = project_source.spread_over_projects(jobs, project_rows)
            rows = _snapshot_run(together, watched, params, path, run_ts, fmt)
        except _JOB_FAILED as error:
            if isinstance(error, AnalysisException):
                raise
            one_by_one = _one_by_one(jobs, watched, params, path, run_ts, fmt)
            rows = failed_runs(watched, params, run_ts, str(error)) if one_by_one is None else one_by_one
    return _kept_rows(spark, rows, output, run_ts)


def _kept_rows(spark: SparkSession, rows: DataFrame, output: str, run_ts: str) -> DataFrame:
    summary_path = f"{output}/summaries"
    write_run_summary(rows, summary_path)
    return read_run_summaries(spark, summary_path, run_ts[:10]).where(F.col("run_ts") == run_ts)


def scheduled_run(
    spark: SparkSession,
    jobs: DataFrame,
    project_rows: DataFrame,
    params: Params,
    output: str,
    store: str,
    source: str,
    moment: datetime | None = None,
) -> DataFrame:
    """A whole scheduled run: snapshot, upload with metadata, run summary; returns the response per project.

    The rows go to the shared ``store`` from the snapshot just stored, with who
    wrote them and when.  A repeated run of one moment replaces its own rows.
    """
    moment = moment or datetime.now(timezone.utc)
    rows = run_monitoring(spark, jobs, project_rows, params, output, moment, "parquet")
    taken = F.col("snapshot_ts") == stamp(moment)
    stored = read_snapshots(spark, f"{output}/snapshots", "parquet").where(taken)
    upload(stored.select(MART.fieldNames()), store, source, stamp(moment))
    return run_response(rows)


def monitor_project(
    spark: SparkSession,
    jobs: DataFrame,
    project_row: DataFrame,
    project_id: str,
    params: Params,
    output: str,
    moment: datetime | None = None,
    fmt: str = "json",
) -> DataFrame:
    """A run for one project; ``project_row`` holds its id and name.

    The totals are observed while the snapshot is written.  Jobs of
    ``read_checked_log`` end in an error row when the project's input is broken.
    """
    one = project_row.where(F.col("id") == project_id)
    mine = of_project(jobs, project_id)
    if checked_log.PROBLEM in jobs.columns:
        return run_monitoring(spark, mine, one, params, output, moment, fmt)
    run_ts = stamp(moment or datetime.now(timezone.utc))
    path = f"{output}/snapshots"
    watched = project_source.enabled(one)
    try:
        rows = _observed_run(project_source.of_enabled_projects(mine, one), watched, params, path, run_ts, fmt)
    except _JOB_FAILED as error:
        if isinstance(error, AnalysisException):
            raise
        rows = failed_runs(watched, params, run_ts, str(error))
    return _kept_rows(spark, rows, output, run_ts)


@dataclass
class TableSet:
    """The stored main table, the views on it and the attribution table.

    Tables are partitioned by ``day`` and bucketed by account, so user-days are
    joined and rolled up where they lie, and the views, which keep ``day``, read
    the days they are asked for.  Every table is created once per set, however
    often it is asked for.  A view
    has two names: its own, which the set asked last holds, and one that begins
    with the schema and stays.
    """

    spark: SparkSession
    schema: str = "analytics"
    params: Params = field(default_factory=Params)
    names: dict[str, str] = field(
        default_factory=lambda: {
            "main": "cost_monitoring",
            "daily": "daily_cost_summary",
            "datasets": "dataset_cost_summary",
            "accounts": "service_account_cost_summary",
            "attribution": "user_dataset_attribution",
        }
    )
    created: set[str] = field(default_factory=set)
    buckets: int = tables.BUCKETS

    def _store(self, key: str, build, cluster_by: tuple[str, ...], tags: tuple[str, ...]) -> None:
        """Write a table unless it is known; after a failed write the next call tries again."""
        full = f"{self.schema}.{self.names[key]}"
        if full not in self.created:
            tables.write_clustered(build(), self.schema, self.names[key], cluster_by, self.buckets, tags)
            self.created.add(full)

    def main(self) -> DataFrame:
        """The stored table; filter ``day`` to read the folders of those days only."""
        return named_table(self.spark, self.schema, self.names["main"])

    def create_main(self, jobs: DataFrame) -> DataFrame:
        build = lambda: main_cost_table(jobs, self.params)
        self._store("main", build, tables.MAIN_CLUSTER, ("cost", "monitoring", "datasets"))
        return self.main()

    def _view(self, key: str, build) -> DataFrame:
        name = self.names[key]
        view = build(self.main())
        for full in (name, f"{self.schema}_{name}"):
            tables.register_view(view, full)
        return self.spark.table(f"{self.schema}_{name}")

    def create_daily_summary(self) -> DataFrame:
        return self._view("daily", summaries.daily_summary)

    def create_dataset_summary(self) -> DataFrame:
        return self._view("datasets", summaries.dataset_summary)

    def create_account_summary(self) -> DataFrame:
        return self._view("accounts", summaries.account_summary)

    def create_attribution(self) -> DataFrame:
        build = lambda: summaries.user_dataset_attribution(self.main(), lambda rows: kept(rows, "attributed"))
        self._store("attribution", build, tables.ATTRIBUTION_CLUSTER, ("cost", "attribution"))
        return named_table(self.spark, self.schema, self.names["attribution"])


def build_all(
    spark: SparkSession, jobs: DataFrame, params: Params, schema: str = "analytics"
) -> dict[str, DataFrame]:
    """Create the main table, the three views and the attribution table."""
    built = TableSet(spark, schema, params)
    return {
        "main": built.create_main(jobs),
        "daily": built.create_daily_summary(),
        "datasets": built.create_dataset_summary(),
        "accounts": built.create_account_summary(),
        "attribution": built.create_attribution(),
    }
