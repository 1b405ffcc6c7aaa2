"""Cost by the tags that query headers carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.cost import cost_usd
from scanledger.functions.text import TAG_LINES, tag
from scanledger.params import Params


def with_tags(stats: DataFrame, *names: str) -> DataFrame:
    """Add a column per tag (``TAG_LINES`` lists them), NULL where a query has none."""
    return stats.withColumns({f"tag_{n}": tag(F.col("query"), n) for n in names or TAG_LINES})


def cost_by_tag(stats: DataFrame, params: Params, name: str) -> DataFrame:
    """Queries, bytes and cost per value of one tag; untagged queries share a NULL row."""
    return (
        stats.groupBy(tag(F.col("query"), name).alias(name))
        .agg(
            F.count("*").alias("query_count"),
            F.sum("total_bytes_billed").alias("total_bytes_billed"),
        )
        .withColumn("cost_usd", cost_usd(F.col("total_bytes_billed"), params.price_per_tb))
    )
