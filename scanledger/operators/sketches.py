"""Distinct users of days that add up: sketches kept per day and merged over any period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2 ** LG_K registers: a standard error of about 1.04 / 2 ** (LG_K / 2), here 1.6 percent.
LG_K = 12


def who() -> Column:
    """The account that a user-day counts as."""
    return F.concat("user_email", F.coalesce("service_account", F.lit("")))


def user_sketches(usage: DataFrame, *keys: str, lg_k: int = LG_K) -> DataFrame:
    """``(*keys, users)``: one sketch of the distinct accounts per group, of a few kilobytes at most.

    ``usage`` has a row per user-day and dataset (``summaries.dataset_usage``).
    Accounts without a name are no account.  Days are merged later, so a period
    of any length reads its sketches and no user-days.
    """
    return usage.groupBy(*keys).agg(F.hll_sketch_agg(who(), lg_k).alias("users"))


def distinct_users(sketches: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, unique_users)`` over all sketches of a group, to about the error of one."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"))
