"""The main cost table: user-day scalars and cost per dataset, small jobs left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.functions.arrays import or_empty
from scanledger.functions.cost import cost_usd, split_sum
from scanledger.operators.jobs import KEY, job_stats, present
from scanledger.operators.ranking import dearest_first
from scanledger.operators.rollups import added_up, job_measures, scalar_columns, user_days
from scanledger.params import Params
from scanledger.schema import MAIN_DATASET_ENTRY, MAIN_TABLE


def main_stats(jobs: DataFrame, params: Params, day_partition: str | None = None) -> DataFrame:
    return job_stats(jobs, params, skip_small=True, day_partition=day_partition)


def main_user_days(jobs: DataFrame, params: Params) -> DataFrame:
    """The scalars alone, for consumers that need no dataset detail."""
    return present(user_days(main_stats(jobs, params), params))


def main_cost_table(
    jobs: DataFrame, params: Params, day_partition: str | None = None
) -> DataFrame:
    """One read of the log, two aggregations, no join.

    A job becomes one row per dataset (or one without) and is counted on the
    first of them only, so job totals and dataset shares come from the same
    grouping.
    """
    stats = main_stats(jobs, params, day_partition)
    datasets = F.col("referenced_datasets")
    rows = stats.select(
        *KEY,
        "cache_hit",
        "error_result",
        "total_bytes_processed",
        "total_bytes_billed",
        "total_slot_ms",
        F.nullif(F.size(datasets), F.lit(0)).cast("long").alias("datasets"),
        F.posexplode_outer(datasets).alias("position", "dataset"),
    )
    first = F.coalesce(F.col("position"), F.lit(0)) == 0
    per_dataset = rows.groupBy(*KEY, "dataset").agg(
        *job_measures(first),
        split_sum(F.col("total_bytes_processed"), F.col("datasets")).alias("bytes_processed"),
        split_sum(F.col("total_bytes_billed"), F.col("datasets")).alias("bytes_billed"),
    )
    entry = F.struct(
        "dataset",
        "bytes_processed",
        "bytes_billed",
        cost_usd(F.col("bytes_billed"), params.price_per_tb).alias("dataset_cost_usd"),
    )
    per_user = per_dataset.groupBy(*KEY).agg(
        *added_up(),
        F.collect_list(F.when(F.col("dataset").isNotNull(), entry)).alias("datasets"),
    )
    matched = F.col("project_id").isNotNull() & F.col("user_email").isNotNull()
    ordered = dearest_first("datasets", "dataset_cost_usd", "dataset")
    return present(
        per_user.select(
            *KEY,
            *scalar_columns(params),
            or_empty(F.when(matched, ordered), MAIN_DATASET_ENTRY.simpleString()).alias(
                "dataset_costs"
            ),
        )
    ).select(MAIN_TABLE.fieldNames())
