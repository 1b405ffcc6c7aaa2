"""Stored snapshots of the mart, and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.schema import MART, RUN_SUMMARY
from scanledger.sources.checked_log import decoded, file_path

SNAPSHOT_FORMAT = "yyyy-MM-dd_HH-mm-ss"

_PARTITIONS = [T.StructField("snapshot_ts", T.StringType())]


def read_snapshots(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """All snapshots below ``path``; arrays an old snapshot lacks are NULL."""
    fields = [f for f in MART.fields if f.name != "project_id"]
    schema = T.StructType(fields + _PARTITIONS + [MART["project_id"]])
    return spark.read.schema(schema).format(fmt).load(path)


def read_user_days(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """User-day rows from plain JSON files.

    A file is one array, or one object per line; an array is read by one task
    per file, lines (``multi_line=False``) by as many as the file has blocks.
    """
    return spark.read.schema(MART).option("multiLine", multi_line).json(path)


def latest_per_project(snapshots: DataFrame) -> DataFrame:
    """Rows of each project's newest snapshot, of any frame of snapshots.

    The newest time per project is an aggregate over the whole frame; of stored
    snapshots ``read_latest`` reads the newest folders alone.
    """
    newest = snapshots.groupBy("project_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return snapshots.join(newest, ["project_id", "snapshot_ts"], "left_semi")


def stored_stamps(spark: SparkSession, path: str) -> dict[str, str]:
    """Project to the stamp of its newest snapshot, told by folder names alone."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_ts=*/project_id=*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[str, str] = {}
    for status in fs.globStatus(pattern) or []:
        folder = status.getPath()
        project, taken = (name.split("=", 1)[1] for name in (folder.getName(), folder.getParent().getName()))
        newest[project] = max(newest.get(project, ""), taken)
    return newest


def read_latest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Rows of each project's newest snapshot below ``path``; only the folders that hold them are read.

    Which ones these are is told by folder names, one entry per project, so the
    scan gets the folders themselves, however many snapshots lie beside them.
    """
    newest = stored_stamps(spark, path)
    fields = [f for f in MART.fields if f.name != "project_id"]
    schema = T.StructType(fields + _PARTITIONS + [MART["project_id"]])
    if not newest:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/snapshot_ts={taken}/project_id={project}" for project, taken in sorted(newest.items())]
    return spark.read.schema(schema).option("basePath", path).format(fmt).load(folders)


def read_run_summaries(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Stored run rows, of a project and day those written last; ``day`` reads the files of that day only."""
    return live_run_rows(spark, path, day).select(RUN_SUMMARY.fieldNames())


def _run_folder(name: str) -> Column:
    """The value of a folder ``name=...`` below the day's, empty without one."""
    return decoded(F.regexp_extract(file_path(), f"/run_date=[^/]*/{name}=([^/]*)/[^/]*$", 1))


def live_run_rows(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Run rows that no later write of their project and day replaced, with ``run_date`` and ``written``.

    Rows of earlier stores, which had a folder per project and no time of
    writing, are read too and count as written before all others.
    """
    stored = spark.read.schema(RUN_SUMMARY).option("recursiveFileLookup", True).json(path)
    if day is not None:
        stored = stored.where(F.contains("_metadata.file_path", F.lit(f"/run_date={day}/")))
    folder = F.nullif(_run_folder("project"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = stored.withColumns(
        {
            # An empty name counts as none, as it does for the folders of snapshots.
            "project": F.nullif(F.coalesce("project", folder), F.lit("")),
            "run_date": F.substring("run_ts", 1, 10),
            "written": _run_folder("written"),
        }
    )
    newest = F.max("written").over(Window.partitionBy("run_date", "project"))
    return rows.withColumn("_newest", newest).where("written = _newest").drop("_newest")


def latest_run(summaries: DataFrame) -> DataFrame:
    """Rows of the newest run."""
    newest = summaries.agg(F.max("run_ts").alias("run_ts"))
    return summaries.where(F.col("run_ts") == newest.scalar())
