"""Days, hours and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, Sunday first.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def day(ts: Column) -> Column:
    """Calendar day; grouping on it is cheaper than on the formatted date."""
    return F.to_date(ts)


def date_text(day_column: Column) -> Column:
    return day_column.cast("string")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", start, end)


def hour_label(hour: Column) -> Column:
    return F.concat(hour.cast("string"), F.lit(":00"))


def weekday_label(weekday: Column) -> Column:
    """Name of a weekday numbered from 1 (Sunday)."""
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), weekday.cast("int"))
