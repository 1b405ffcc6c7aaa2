"""Snapshots of the mart per project, run summaries, and retention."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.params import DEFAULT_RETENTION_DAYS, Params
from scanledger.sources.snapshots import live_run_rows

STAMP = "%Y-%m-%d_%H-%M-%S"


def stamp(moment: datetime) -> str:
    """Snapshot time as text that sorts by time and is safe in a path."""
    return moment.strftime(STAMP)


def stamp_time(column: str = "snapshot_ts"):
    return F.to_timestamp(column, "yyyy-MM-dd_HH-mm-ss")


def write_snapshot(
    mart: DataFrame,
    path: str,
    snapshot_ts: str,
    fmt: str = "json",
    seen: Observation | None = None,
    totals: Sequence[Column] = (),
) -> str:
    """Store the mart below ``path/snapshot_ts=.../project_id=...``.

    Only the folders of this snapshot are replaced, so a failed run can be
    repeated.  Any file system Spark can write to will do.  ``seen`` collects
    ``totals`` in the stage that writes, where a repeated task counts once.
    """
    rows = mart.withColumn("snapshot_ts", F.lit(snapshot_ts)).hint("rebalance", "project_id")
    rows = rows.sortWithinPartitions("project_id", F.desc("date"), F.desc("estimated_cost_usd"))
    if seen is not None:
        rows = rows.observe(seen, *totals)
    writer = rows.write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(
        "snapshot_ts", "project_id"
    ).format(fmt).save(path)
    return path


def write_run_summary(summary: DataFrame, path: str) -> str:
    """Store run rows below ``path/run_date=.../written=...``; a later run of a day replaces the rows of its own projects only.

    A write is a folder per day with as many files as it has tasks, however many
    projects it tells of.  Which rows are replaced is found when they are read,
    by the time of the write; folders without any other rows are deleted.
    """
    written = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    told = summary.withColumns({"run_date": F.substring("run_ts", 1, 10), "written": F.lit(written)})
    writer = told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "written").json(path)
    _drop_replaced(summary.sparkSession, path, written)
    return path


def _drop_replaced(spark: SparkSession, path: str, written: str) -> None:
    """Delete earlier writes of the days of this one that have no row left that is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(hadoop(f"{path}/run_date=*/written={written}")) or []:
        day = status.getPath().getParent()
        earlier = {name: f.getPath() for f in fs.listStatus(day) if "written=" < (name := f.getPath().getName()) < f"written={written}"}
        if earlier:
            rows = live_run_rows(spark, path, day.getName().split("=", 1)[1])
            live = {f"written={row['written']}" for row in rows.select("written").distinct().collect()}
            for name in earlier.keys() - live:
                fs.delete(earlier[name], True)


def with_upload_metadata(rows: DataFrame, source: str, run_ts: str) -> DataFrame:
    """Rows with who wrote them and when, for stores shared with others."""
    return rows.withColumns(
        {"source": F.lit(source), "uploaded_at": F.lit(run_ts), "uploaded_project": F.col("project_id")}
    )


def upload(rows: DataFrame, store: str, source: str, run_ts: str) -> str:
    """Put rows with their metadata into a shared store, by run and project; a repeated run replaces its own."""
    told = with_upload_metadata(rows, source, run_ts)
    writer = told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("uploaded_at", "uploaded_project").parquet(store)
    return store


def read_uploads(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """Rows of a shared store; ``schema`` is that of the rows without metadata."""
    metadata = [T.StructField(name, T.StringType()) for name in ("source", "uploaded_at", "uploaded_project")]
    return spark.read.schema(T.StructType([*schema.fields, *metadata])).parquet(store)


def retained(
    snapshots: DataFrame, params: Params, days: int = DEFAULT_RETENTION_DAYS
) -> DataFrame:
    """Snapshots not older than ``days`` days; prunes expired folders when reading."""
    return snapshots.where(stamp_time() >= params.days_ago(days))


def drop_expired(
    spark: SparkSession, path: str, as_of: datetime, days: int = DEFAULT_RETENTION_DAYS
) -> list[str]:
    """Delete the folders of snapshots older than ``days`` days; returns their stamps.

    Folder names tell the age, so no data is read or rewritten.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("snapshot_ts="):
            continue
        taken = name.split("=", 1)[1]
        if (as_of - datetime.strptime(taken, STAMP)).total_seconds() > days * 86400:
            fs.delete(status.getPath(), True)
            dropped.append(taken)
    return sorted(dropped)
