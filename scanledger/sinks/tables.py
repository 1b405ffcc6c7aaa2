"""Stored tables, partitioned by day and sorted for pruning, and views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.schema import with_comments

MAIN_CLUSTER = ("project_id", "user_email")
ATTRIBUTION_CLUSTER = ("user", "dataset_name")

BUCKETS = 32


def laid_out(df: DataFrame, cluster_by: Sequence[str]) -> DataFrame:
    """Rows spread by day for writing, sorted within each task.

    Rebalancing merges small days and splits a large one over several tasks,
    where a plain repartition would leave one task per day.
    """
    dated = with_comments(df).withColumn("day", F.to_date("date"))
    return dated.hint("rebalance", "day").sortWithinPartitions("day", *cluster_by)


def write_clustered(
    df: DataFrame,
    schema: str,
    name: str,
    cluster_by: Sequence[str],
    buckets: int = BUCKETS,
    tags: Sequence[str] = (),
) -> str:
    """Create or replace ``schema.name``, partitioned by day and bucketed by ``cluster_by``.

    Rows are dealt by the hash the buckets use, so a day has one sorted file per
    bucket.  Reading by bucket needs no shuffle: roll-ups over the bucket columns
    (and more), and joins of tables bucketed alike on the bucket columns and the
    day.  A bucket holds one row per account and day at most, so none is hot.
    """
    spark, full = df.sparkSession, f"`{schema}`.`{name}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    dated = with_comments(df).withColumn("day", F.to_date("date")).repartition(buckets, *cluster_by)
    writer = dated.write.format("parquet").mode("overwrite").partitionBy("day")
    writer = writer.bucketBy(buckets, *cluster_by).sortBy(*cluster_by)
    writer.option("partitionOverwriteMode", "static").saveAsTable(full)
    if tags:
        spark.sql(f"ALTER TABLE {full} SET TBLPROPERTIES ('tags' = '{','.join(tags)}')")
    return full


def write_sorted(df: DataFrame, path: str, *keys: Column, files: int | None = None) -> str:
    """Write rows in one global order: each file holds a range of it, and file names follow the ranges.

    The bounds are sampled, every task sorts and writes its own range, and a
    frequent key is split over tasks by the keys after it.  Without ``files``
    their number follows the volume.
    """
    ranges = df.repartitionByRange(*keys) if files is None else df.repartitionByRange(files, *keys)
    ranges.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path


def read_sorted(spark: SparkSession, path: str, schema: T.StructType, rank: str = "rank") -> DataFrame:
    """Rows of ``write_sorted`` with their place in the order, from 1, told by file and row number: no sort."""
    names = [F.col(f"`{name}`") for name in schema.fieldNames()]
    stored = spark.read.schema(schema).parquet(path)
    rows = stored.select(*names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_rows"))
    # One row per file, so one task may add them up.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").select(*names, (F.col("_start") + F.col("_row") + 1).alias(rank))


def write_folder(df: DataFrame, path: str, cluster_by: Sequence[str]) -> str:
    """Write the whole table below ``path``."""
    writer = laid_out(df, cluster_by).write.mode("overwrite").partitionBy("day")
    writer.option("partitionOverwriteMode", "static").parquet(path)
    return path


def replace_days(df: DataFrame, path: str, cluster_by: Sequence[str]) -> str:
    """Replace only the days that ``df`` holds; a retry writes the same files again.

    Days that lost all their rows stay; ``sinks.versions`` removes those too and
    publishes a build as a whole.
    """
    writer = laid_out(df, cluster_by).write.mode("overwrite").partitionBy("day")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return path


def register_view(df: DataFrame, name: str) -> None:
    with_comments(df).createOrReplaceTempView(name)


def ordered(df: DataFrame, cost_column: str) -> DataFrame:
    """Newest day first, dearest first: for showing or exporting, not for storing."""
    return df.orderBy(F.desc("date"), F.desc(cost_column))


def table_comments(spark: SparkSession, full_name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE {full_name}").select("col_name", "comment")
