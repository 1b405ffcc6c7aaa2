"""Work tables, running positions and connected components shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# ASCII white space and everything else: what counts as a word in all operators.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def work_tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``stored`` writes inside, in the order they are finished."""
    token = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete work tables that no frame reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = frame.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def only(frame: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, without any others: extra columns never clash with ours."""
    return frame.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def packed(frame: DataFrame, *apart: str, **working: Column) -> DataFrame:
    """The caller's columns but ``apart`` in one struct ``row``, and working columns beside it: no two names clash.

    ``unpacked`` gives the caller's columns back.
    """
    held = [F.col(f"`{c}`") for c in frame.columns if c not in apart]
    if not held:  # a struct needs a field
        held = [F.lit(True).alias("none")]
    return frame.select(F.struct(*held).alias("row"), *[column.alias(name) for name, column in working.items()])


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The caller's ``columns`` of a packed frame, some of them given anew."""
    return [replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in columns]


def numbered(frame: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Add ``name``: the place of every row, from 0, in the order of ``keys``.

    Rows are dealt by range, so a frequent key spreads over tasks as long as
    the last one tells rows apart; rows equal in all keys come in any order.
    Each task numbers its own rows, and the tasks' sizes give where each begins.
    """
    columns = frame.columns
    sliced = frame.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()).sortWithinPartitions(*keys)

    def count(batches):
        seen = 0
        for batch in batches:
            places = pa.array(np.arange(seen, seen + batch.num_rows, dtype=np.int64))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "_local"])

    schema = StructType([*sliced.schema.fields, StructField("_local", LongType())])
    local = stored(sliced.mapInArrow(count, schema), "numbered")
    # One small row per task of the range shuffle, so one task may add them up and every task may hold them.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("_slice").agg(F.count("*").alias("_rows"))
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_slice").select(*columns, (F.col("_start") + F.col("_local")).alias(name))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component) of every id in ``links``: the smallest id reachable over links of any direction.

    Each round every node joins the neighbour (or itself) of smallest random
    rank and the links between merged nodes are contracted, so chains shrink by
    a constant factor and stars in one round. Only aggregates and equi-joins;
    every round is written to the shared folder.
    """
    links = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    edges = stored(links.union(links.select("v", "u")).distinct(), "edges")
    label = edges.select(F.col("u").alias("id"), F.col("u").alias("node")).distinct()
    turn = 0
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        nearest = edges.groupBy("u").agg(F.min(ranked("v")).alias("best"))
        parent = stored(nearest.select("u", F.least("best", ranked("u"))["n"].alias("p")), "parents")
        label = stored(
            label.join(parent, F.col("node") == F.col("u"), "left").select("id", F.coalesce("p", "node").alias("node")), "labels"
        )
        edges = stored(
            edges.join(parent.select("u", F.col("p").alias("pu")), "u")
            .join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .filter("pu <> pv")
            .select(F.col("pu").alias("u"), F.col("pv").alias("v"))
            .distinct(),
            "edges",
        )
        turn += 1
    smallest = label.groupBy("node").agg(F.min("id").alias("component"))
    return label.join(smallest, "node").select("id", "component")


def words(text: Column) -> Column:
    """How many words a text has; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")



def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    shifted = "list_reduce(list_prepend(xor(crc, code), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))"
    return f"xor(list_reduce({codes}, lambda crc, code: {shifted}), 4294967295)"
