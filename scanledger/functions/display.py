"""Text forms of numbers and dates for reports (en-US)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BYTE_UNITS = ("Bytes", "KB", "MB", "GB", "TB", "PB")
DATE_STYLES = {
    "short": "M/d/yyyy",
    "medium": "M/d/yyyy hh:mm a",
    "long": "M/d/yyyy h:mm:ss a",
}


def bytes_text(nbytes: Column) -> Column:
    """1536 -> '1.5 KB'; zero, NULL and NaN -> '0 Bytes'."""
    value = nbytes.cast("double")
    power = F.greatest(
        F.lit(0),
        F.least(
            F.lit(len(BYTE_UNITS) - 1), F.floor(F.log(value) / F.log(F.lit(1024.0))).cast("int")
        ),
    )
    # The logarithm of an exact power of 1024 may come out a hair low.
    power = F.when(
        (value >= F.pow(F.lit(1024.0), power + 1)) & (power < len(BYTE_UNITS) - 1), power + 1
    ).otherwise(power)
    digits = F.format_string("%.2f", F.round(value / F.pow(F.lit(1024.0), power), 2))
    trimmed = F.regexp_replace(digits, r"\.?0+$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), power + 1)
    empty = value.isNull() | F.isnan(value) | (value == 0)
    return F.when(empty, F.lit("0 Bytes")).otherwise(F.concat(trimmed, F.lit(" "), unit))


def currency_text(value: Column) -> Column:
    """1234.5 -> '$1,234.50'; NULL and NaN -> '$0.00'."""
    amount = F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.concat(F.lit("$"), F.format_number(F.round(amount, 2), 2))


def share_text(value: Column, total: Column) -> Column:
    """Share in percent with one digit, at most 100; '0.0%' when undefined."""
    share = F.try_divide(value, total) * 100.0
    capped = F.when(share > 100, F.lit(100.0)).otherwise(share)
    shown = F.format_string("%.1f%%", F.round(capped, 1))
    missing = share.isNull() | F.isnan(share)
    return F.when(missing, F.lit("0.0%")).otherwise(shown)


def date_display(ts: Column, style: str = "short") -> Column:
    """Date in one of ``DATE_STYLES``; '' when missing."""
    return F.coalesce(F.date_format(ts, DATE_STYLES.get(style, DATE_STYLES["short"])), F.lit(""))


def rebuild_severity(percent: Column) -> Column:
    return (
        F.when(percent > 80, F.lit("danger")).when(percent > 50, F.lit("warning")).otherwise("")
    )
