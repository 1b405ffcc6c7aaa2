"""Summaries of the main cost table: by day, dataset, service account, and user x dataset.

Each takes the main table (or any frame with its columns) and reads only the
columns it needs, so run them on the stored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanledger.functions.cost import byte_sum, half_up, money_sum, percentage
from scanledger.operators.ranking import top_k

TOP_ENTRIES = 10


def _days(main: DataFrame) -> list[str]:
    """The day columns to group by: a stored table has one that prunes folders too."""
    return ["day", "date"] if "day" in main.columns else ["date"]


def daily_summary(main: DataFrame) -> DataFrame:
    """Totals per day and project; the cache share is a plain mean over users."""
    return main.groupBy(*_days(main), "project_id").agg(
        F.sum("query_count").alias("total_queries"),
        F.sum("cache_hit_count").alias("total_cache_hits"),
        F.sum("error_count").alias("total_errors"),
        F.sum("total_bytes_processed").alias("total_bytes_processed"),
        F.sum("total_bytes_billed").alias("total_bytes_billed"),
        money_sum(F.col("estimated_cost_usd")).alias("total_estimated_cost_usd"),
        F.sum("slot_hours").alias("total_slot_hours"),
        half_up(F.avg("cache_hit_percentage"), 2).alias("avg_cache_hit_percentage"),
    )


def dataset_usage(main: DataFrame) -> DataFrame:
    """One row per user-day and dataset."""
    days = _days(main)
    return main.select(
        *days, "project_id", "user_email", "service_account", F.explode("dataset_costs").alias("d")
    ).select(
        *days,
        "project_id",
        F.col("d.dataset").alias("dataset_name"),
        "user_email",
        "service_account",
        "d.dataset_cost_usd",
        "d.bytes_processed",
        "d.bytes_billed",
    )


def _entries(main: DataFrame, *keys: str) -> DataFrame:
    """One row per user-day and dataset, and one without a dataset for a user-day that has none.

    ``is_first`` marks one row of each user-day, so that what belongs to the
    user-day is added once.
    """
    scalars = ["query_count", "total_bytes_processed", "total_bytes_billed", "estimated_cost_usd"]
    rows = main.select(*keys, "user_email", "service_account", *scalars, F.posexplode_outer("dataset_costs").alias("at", "d"))
    return rows.withColumn("is_first", F.coalesce("at", F.lit(0)) == 0)


def _with_top(totals_and_entries: DataFrame, keys: list[str], order: list[Column], entry: list[str], k: int, top: str) -> DataFrame:
    """Rows per group: its totals and an array of its first k entries.

    The input holds both, told apart by ``is_total``, as one grouping made them
    from one read; ranked after its group's totals, an entry is dropped in the
    task that ranks it, before the shuffle.
    """
    ranked = top_k(totals_and_entries, keys, [F.desc("is_total"), *order], k + 1)
    totals = [c for c in totals_and_entries.columns if c not in (*keys, *entry, "is_total")]
    listed = F.when(~F.col("is_total"), F.struct((F.col("rank") - 1).alias("rank"), *entry))
    found = ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("is_total"), F.col(c))).alias(c) for c in totals],
        F.array_sort(F.collect_list(listed)).alias(top),
    )
    return found.withColumn(top, F.transform(top, lambda e: F.struct(*[e[name].alias(name) for name in entry])))


def dataset_top_users(main: DataFrame, k: int = TOP_ENTRIES) -> DataFrame:
    """The k dearest users per day, project and dataset, as ranked rows."""
    keys = [*_days(main), "project_id", "dataset_name"]
    per_user = (
        dataset_usage(main)
        .groupBy(*keys, F.coalesce("service_account", "user_email").alias("user"))
        .agg(
            money_sum(F.col("dataset_cost_usd")).alias("user_cost_usd"),
            byte_sum("bytes_processed").alias("user_bytes_processed"),
        )
    )
    order = [F.desc_nulls_last("user_cost_usd"), F.asc_nulls_first("user")]
    return top_k(per_user, keys, order, k)


def dataset_summary(main: DataFrame, k: int = TOP_ENTRIES, exact: bool = True) -> DataFrame:
    """Totals, users and top users per day, project and dataset, from one read of the main table.

    Users are added up once; their sums make the totals and the ranking.  With
    ``exact`` off, users are counted by sketch, to about two percent.
    """
    keys = [*_days(main), "project_id", "dataset_name"]
    who = F.concat("user_email", F.coalesce("service_account", F.lit("")))
    per_user = dataset_usage(main).groupBy(*keys, who.alias("who"), F.coalesce("service_account", "user_email").alias("user")).agg(
        money_sum(F.col("dataset_cost_usd")).alias("cost"),
        F.sum(F.col("bytes_processed").cast("decimal(38,3)")).alias("processed"),
        F.sum(F.col("bytes_billed").cast("decimal(38,3)")).alias("billed"),
    )
    both = per_user.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col("user")]], *keys, "user").agg(
        (F.grouping("user") == 1).alias("is_total"),
        (F.count_distinct("who") if exact else F.approx_count_distinct("who", 0.02)).alias("unique_users"),
        F.sum("processed").cast("double").alias("bytes"),
        F.sum("billed").cast("double").alias("total_bytes_billed"),
        money_sum(F.col("cost")).alias("cost"),
    )
    rows = both.select(
        *keys, "is_total", "unique_users", F.col("bytes").alias("total_bytes_processed"), "total_bytes_billed", F.col("cost").alias("total_cost_usd"),
        "user", F.col("cost").alias("user_cost_usd"), F.col("bytes").alias("user_bytes_processed"),
    )
    order = [F.desc_nulls_last("user_cost_usd"), F.asc_nulls_first("user")]
    return _with_top(rows, keys, order, ["user", "user_cost_usd", "user_bytes_processed"], k, "top_users")


def account_top_datasets(main: DataFrame, k: int = TOP_ENTRIES) -> DataFrame:
    """The k dearest datasets per day, project and service account, as ranked rows."""
    keys = [*_days(main), "project_id", "service_account"]
    per_dataset = (
        dataset_usage(main.where(F.col("service_account").isNotNull()))
        .groupBy(*keys, "dataset_name")
        .agg(
            money_sum(F.col("dataset_cost_usd")).alias("dataset_cost_usd"),
            byte_sum("bytes_processed").alias("dataset_bytes_processed"),
        )
    )
    order = [F.desc_nulls_last("dataset_cost_usd"), F.asc_nulls_first("dataset_name")]
    return top_k(per_dataset, keys, order, k)


def account_summary(main: DataFrame, k: int = TOP_ENTRIES) -> DataFrame:
    """Totals and top datasets per day, project and service account, from one read of the main table."""
    days = _days(main)
    keys = [*days, "project_id", "service_account"]
    rows = _entries(main.where(F.col("service_account").isNotNull()), *days, "project_id")
    once = lambda name: F.when(F.col("is_first"), F.col(name))
    none = F.col("d").isNull()
    per_dataset = rows.groupBy(*keys, none.alias("none"), F.col("d.dataset").alias("dataset_name")).agg(
        F.sum(once("query_count")).alias("queries"),
        F.sum(once("total_bytes_processed")).alias("processed"),
        F.sum(once("total_bytes_billed")).alias("billed"),
        money_sum(once("estimated_cost_usd")).alias("spent"),
        money_sum(F.col("d.dataset_cost_usd")).alias("cost"),
        F.sum(F.col("d.bytes_processed").cast("decimal(38,3)")).alias("bytes"),
    )
    sets = [[*map(F.col, keys)], [*map(F.col, keys), F.col("none"), F.col("dataset_name")]]
    both = per_dataset.groupingSets(sets, *keys, "none", "dataset_name").agg(
        (F.grouping("dataset_name") == 1).alias("is_total"),
        F.sum("queries").alias("total_queries"),
        F.sum("processed").alias("total_bytes_processed"),
        F.sum("billed").alias("total_bytes_billed"),
        money_sum(F.col("spent")).alias("total_cost_usd"),
        money_sum(F.col("cost")).alias("dataset_cost_usd"),
        F.sum("bytes").cast("double").alias("dataset_bytes_processed"),
    )
    both = both.where(F.col("is_total") | ~F.col("none")).drop("none")
    order = [F.desc_nulls_last("dataset_cost_usd"), F.asc_nulls_first("dataset_name")]
    return _with_top(both, keys, order, ["dataset_name", "dataset_cost_usd", "dataset_bytes_processed"], k, "top_datasets")


def user_dataset_attribution(main: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Who spends how much on which dataset, with both shares.

    ``query_count`` counts user-day rows, and rows equal in every grouped value
    fold into one before their bytes and cost are added.  The totals a share is
    taken of leave the project out.  They are grouped sums joined back, not
    windows: partial sums absorb a dataset that everybody uses, and a row
    without a user finds no total, so its share is NULL.  The attributed rows
    serve three branches: ``keep`` stores them and returns them, so that they
    are computed once.
    """
    rows = (
        main.select(
            "date",
            "project_id",
            F.coalesce("service_account", "user_email").alias("user"),
            F.col("service_account").isNotNull().alias("is_service_account"),
            F.explode("dataset_costs").alias("d"),
        )
        .groupBy(
            "date",
            "project_id",
            "user",
            "is_service_account",
            F.col("d.dataset").alias("dataset_name"),
            F.col("d.bytes_processed").alias("bytes"),
            F.col("d.dataset_cost_usd").alias("cost"),
        )
        .agg(F.count("*").alias("rows"))
    )
    attributed = rows.groupBy(
        "date", "project_id", "user", "is_service_account", "dataset_name"
    ).agg(
        F.sum("rows").alias("query_count"),
        byte_sum("bytes").alias("bytes_processed"),
        money_sum(F.col("cost")).alias("cost_usd"),
    )
    if keep is not None:
        attributed = keep(attributed)
    of_user = attributed.groupBy("date", "user").agg(money_sum(F.col("cost_usd")).alias("user_total"))
    of_dataset = attributed.groupBy("date", "dataset_name").agg(
        money_sum(F.col("cost_usd")).alias("dataset_total")
    )
    return (
        attributed.join(of_user, ["date", "user"], "left")
        .join(of_dataset, ["date", "dataset_name"], "left")
        .select(
            "date",
            "project_id",
            "user",
            "is_service_account",
            "dataset_name",
            "query_count",
            "bytes_processed",
            "cost_usd",
            percentage(F.col("cost_usd"), F.col("user_total")).alias("pct_of_user_cost"),
            percentage(F.col("cost_usd"), F.col("dataset_total")).alias("pct_of_dataset_cost"),
        )
    )
