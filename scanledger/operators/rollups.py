"""Grouped measures per user-day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.functions import cost
from scanledger.operators.jobs import KEY
from scanledger.params import Params

MEASURES = [
    "query_count",
    "cache_hit_count",
    "error_count",
    "total_bytes_processed",
    "total_bytes_billed",
    "total_slot_ms",
]


def job_measures(counted: Column | None = None) -> list[Column]:
    """Aggregates over job rows; with ``counted``, over the rows it marks."""

    def on(value: Column) -> Column:
        return value if counted is None else F.when(counted, value)

    return [
        F.count(on(F.lit(1))).alias("query_count"),
        F.count_if(on(F.col("cache_hit"))).alias("cache_hit_count"),
        F.count_if(on(F.col("error_result").isNotNull())).alias("error_count"),
        F.sum(on(F.col("total_bytes_processed"))).alias("total_bytes_processed"),
        F.sum(on(F.col("total_bytes_billed"))).alias("total_bytes_billed"),
        F.sum(on(F.col("total_slot_ms"))).alias("total_slot_ms"),
    ]


def added_up() -> list[Column]:
    """The same aggregates over rows that already hold them."""
    return [F.sum(name).alias(name) for name in MEASURES]


def scalar_columns(params: Params) -> list[Column]:
    """The user-day scalars, from summed measures."""
    return [
        F.col("query_count"),
        F.col("cache_hit_count"),
        F.col("error_count"),
        F.col("total_bytes_processed"),
        F.col("total_bytes_billed"),
        cost.cost_usd(F.col("total_bytes_billed"), params.price_per_tb).alias("estimated_cost_usd"),
        cost.slot_hours(F.col("total_slot_ms")).alias("slot_hours"),
        cost.percentage(F.col("cache_hit_count"), F.col("query_count")).alias(
            "cache_hit_percentage"
        ),
    ]


def user_days(stats: DataFrame, params: Params) -> DataFrame:
    """One row of scalars per user-day."""
    return stats.groupBy(*KEY).agg(*job_measures()).select(*KEY, *scalar_columns(params))


def hourly(stats: DataFrame, params: Params) -> DataFrame:
    return (
        stats.groupBy(*KEY, "hour_of_day")
        .agg(*job_measures())
        .withColumn(
            "estimated_cost_usd", cost.cost_usd(F.col("total_bytes_billed"), params.price_per_tb)
        )
    )


def weekday(stats: DataFrame, params: Params) -> DataFrame:
    return (
        stats.groupBy(*KEY, "day_of_week")
        .agg(F.count("*").alias("query_count"), F.sum("total_bytes_billed").alias("total_bytes_billed"))
        .withColumn(
            "estimated_cost_usd", cost.cost_usd(F.col("total_bytes_billed"), params.price_per_tb)
        )
    )
