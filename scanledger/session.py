"""Spark session settings the library expects, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Dates and hours are read off timestamps, so the zone is part of the result.
RESULT_SETTINGS = {"spark.sql.session.timeZone": "UTC"}

# Runtime re-planning: coalesce small partitions, split skewed joins, and turn
# a shuffled join into a broadcast one only when its measured size allows it.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Looking up the caller of every column expression costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# The marts build arrays from rows that arrive sorted by their group: reuse that
# order instead of hashing again.
ARRAY_SETTINGS = {
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # Tables bucketed by account join on account and day without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app_name: str = "scanledger", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**CLUSTER_SETTINGS, **ARRAY_SETTINGS, **RESULT_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def adopt(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the library relies on to a session we were handed."""
    for key, value in {**ARRAY_SETTINGS, **RESULT_SETTINGS}.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing the session must be a local one (tests, trial
    runs), and a temporary folder on this machine serves.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="scanledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: it is computed once and survives lost executors."""
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
