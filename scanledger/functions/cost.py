"""Bytes, money and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte units and the billing granule.
GIB = 1024.0**3
TIB = 1024.0**4
BILLING_GRANULE = 1024 * 1024
WEEKEND_FACTOR = 0.3

# A percentage such as 15.625 sits exactly between two results and float noise
# would decide; the nudge makes a tie go up, as it does in exact arithmetic.
TIE_NUDGE = 1e-9


def half_up(value: Column, digits: int) -> Column:
    return F.round(value + F.lit(TIE_NUDGE), digits)


def cost_usd(nbytes: Column, price_per_tb: float) -> Column:
    """Price of billed bytes, to the cent."""
    return F.round(nbytes / F.lit(TIB) * F.lit(float(price_per_tb)), 2)


def money_sum(amounts: Column) -> Column:
    """Aggregate: a sum of amounts in cents, free of float noise.

    Equal sums compare equal, so rankings do not depend on the order in which
    partitions were added up.
    """
    return F.round(F.sum(amounts), 2)


def slot_hours(slot_ms: Column) -> Column:
    return slot_ms / F.lit(1000.0) / F.lit(3600.0)


def percentage(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent with two digits; NULL for a zero total."""
    return half_up(part / F.nullif(total, F.lit(0)) * F.lit(100.0), 2)


def ratio_or_zero(part: Column, total: Column) -> Column:
    """Unrounded percentage for reports; 0 unless the total is positive."""
    return F.when(total > 0, part / F.when(total > 0, total) * F.lit(100.0)).otherwise(F.lit(0.0))


def terabytes(nbytes: Column) -> Column:
    return F.round(nbytes / F.lit(TIB), 2)


def gigabytes(nbytes: Column) -> Column:
    return F.round(nbytes / F.lit(GIB), 2)


def billed_bytes(nbytes: Column) -> Column:
    """Bytes rounded up to whole billing granules."""
    return F.ceil(nbytes / F.lit(float(BILLING_GRANULE))).cast("long") * F.lit(BILLING_GRANULE)


def weekend_factor(day: Column) -> Column:
    return F.when(F.dayofweek(day).isin(1, 7), F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))


def what_if_cost(estimated_tb: Column, price_per_tb: float) -> Column:
    """Expected price of scanning ``estimated_tb``; NULL when unknown."""
    return F.round(estimated_tb.cast("double") * F.lit(float(price_per_tb)), 2)


def split_sum(nbytes: Column, shares: Column, weight: Column | int = 1) -> Column:
    """Aggregate: the sum of ``nbytes / shares * weight``, each share to a thousandth of a byte.

    Whole bytes and thousandths are summed as integers, so the result does not
    depend on the order or the number of partitions.
    """
    weight = F.lit(weight) if isinstance(weight, int) else weight
    div = lambda a, b: F.call_function("div", a, b)
    thousandths = div((nbytes % shares) * 2000 + shares, shares * 2)
    return F.sum(div(nbytes, shares) * weight).cast("double") + F.sum(thousandths * weight) / F.lit(1000.0)


def byte_sum(nbytes: Column | str) -> Column:
    """Aggregate: the exact sum of split bytes, which have three decimals."""
    column = F.col(nbytes) if isinstance(nbytes, str) else nbytes
    return F.sum(column.cast("decimal(38,3)")).cast("double")
