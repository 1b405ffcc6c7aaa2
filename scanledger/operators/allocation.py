"""Sharing out a job's bytes over the tables or datasets it read.

Two allocations exist and differ on purpose: by table, where a dataset's cost
is the sum of rounded table costs, and straight by dataset, rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.functions import arrays, cost, text
from scanledger.operators.jobs import KEY
from scanledger.params import Params


def table_costs(stats: DataFrame, params: Params) -> DataFrame:
    """Per user-day and table; every reference of a job gets an equal share."""
    # Counted ahead of the explode, where a job is one row; beside it every share would count them anew.
    counted = stats.withColumn("references", arrays.reference_total("referenced_tables_detail"))
    shares = counted.select(
        *KEY,
        "total_bytes_processed",
        "total_bytes_billed",
        "destination_table",
        "references",
        F.explode("referenced_tables_detail").alias("ref"),
    )
    target, ref = F.col("destination_table"), F.col("ref")
    own_source = (target.dataset_id == ref.dataset_id) & (target.table_id == ref.table_id)
    grouped = shares.groupBy(
        *KEY,
        F.col("ref.project_id").alias("table_project"),
        F.col("ref.dataset_id").alias("table_dataset"),
        F.col("ref.table_id").alias("table_id"),
    ).agg(
        F.sum("ref.ref_count").alias("query_count"),
        F.bool_or(F.coalesce(own_source, F.lit(False))).alias("is_rebuild_operation"),
        cost.split_sum(
            F.col("total_bytes_processed"), F.col("references"), F.col("ref.ref_count")
        ).alias("bytes_processed"),
        cost.split_sum(
            F.col("total_bytes_billed"), F.col("references"), F.col("ref.ref_count")
        ).alias("bytes_billed"),
    )
    return grouped.select(
        *KEY,
        text.qualified(F.col("table_project"), F.col("table_dataset"), F.col("table_id")).alias(
            "table_name"
        ),
        "table_project",
        "table_dataset",
        "table_id",
        "query_count",
        "is_rebuild_operation",
        "bytes_processed",
        "bytes_billed",
        cost.cost_usd(F.col("bytes_billed"), params.price_per_tb).alias("table_cost_usd"),
    )


def dataset_of_table() -> Column:
    return text.qualified(F.col("table_project"), F.col("table_dataset")).alias("dataset")


def dataset_costs_from_tables(tables: DataFrame) -> DataFrame:
    """Per user-day and dataset, added up from ``table_costs``."""
    return tables.groupBy(*KEY, dataset_of_table()).agg(
        F.sum("query_count").alias("query_count"),
        cost.byte_sum("bytes_processed").alias("bytes_processed"),
        cost.byte_sum("bytes_billed").alias("bytes_billed"),
        cost.money_sum(F.col("table_cost_usd")).alias("dataset_cost_usd"),
        F.count_if("is_rebuild_operation").alias("rebuild_operations"),
    )


def dataset_costs_direct(stats: DataFrame, params: Params) -> DataFrame:
    """Per user-day and dataset; a job is shared equally by its distinct datasets."""
    datasets = F.col("referenced_datasets")
    shares = stats.select(
        *KEY,
        "total_bytes_processed",
        "total_bytes_billed",
        F.size(datasets).cast("long").alias("datasets"),
        F.explode(datasets).alias("dataset"),
    )
    grouped = shares.groupBy(*KEY, "dataset").agg(
        F.count("*").alias("query_count"),
        cost.split_sum(F.col("total_bytes_processed"), F.col("datasets")).alias("bytes_processed"),
        cost.split_sum(F.col("total_bytes_billed"), F.col("datasets")).alias("bytes_billed"),
    )
    return grouped.withColumn(
        "dataset_cost_usd", cost.cost_usd(F.col("bytes_billed"), params.price_per_tb)
    )
