"""Top-k within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group, with their ``rank`` from 1.

    Spark turns the row-number filter into a group limit that runs before the
    shuffle: each task sends at most ``k`` rows of a group, so a group holding a
    large share of all rows never lands whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows brought together and sorted by their group, for groupings that only collect them.

    Lists do not get smaller when tasks collect what they hold ahead of the
    shuffle: rows are shuffled as they are, and every list is built once, in order
    of its group, instead of being built, stored, sorted and merged.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys)


def ranked_arrays(df: DataFrame, keys: Sequence[str], fields: Sequence[Column | str], name: str) -> DataFrame:
    """Per group the array ``name`` of structs of ``fields``, in the order of ``rank``, rank dropped.

    The structs are made ahead of the grouping, by compiled code; the grouping
    itself would put them together expression by expression.
    """
    items = df.select(*keys, F.struct("rank", F.struct(*fields).alias("entry")).alias("item"))
    ordered = F.sort_array(F.collect_list("item"))
    return items.groupBy(*keys).agg(F.transform(ordered, lambda item: item.entry).alias(name))


def dearest_first(entries: str, cost_field: str, name_field: str) -> Column:
    """Sort an array column of structs by cost, highest first, NULL last, then by name."""
    return F.expr(
        f"""transform(sort_array(transform({entries}, e -> struct(
              e.{cost_field} IS NULL AS unpriced, -e.{cost_field} AS cost,
              e.{name_field} AS name, e AS entry))), item -> item.entry)"""
    )
