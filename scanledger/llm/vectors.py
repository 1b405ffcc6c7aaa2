"""Which vectors take part, and their classes of exact copies; shared by operators 1 and 10."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    values = embedding.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def taking_part(table: DataFrame) -> DataFrame:
    """(vec_id, embedding, n, k1, k2): one row per id; ``n`` is the vector's length.

    Components stay double where the table holds doubles and are float
    otherwise. Of rows with one id the smallest vector counts. Equal vectors
    have equal keys.
    """
    kind = "double" if table.schema["embedding"].dataType.elementType.typeName() in ("double", "decimal", "long") else "float"
    rows = table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast(f"array<{kind}>")).alias("embedding"))
    same = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    rows = rows.withColumn("embedding", same).withColumn("n", F.size("embedding"))
    return rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths that vectors have, most frequent first: vectors are only compared with others of their length."""
    return [row["n"] for row in rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").collect()]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of its own precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)
