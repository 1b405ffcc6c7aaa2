"""Run parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The defaults every run starts from.
DEFAULT_HISTORY_DAYS = 30
DEFAULT_PRICE_PER_TB = 5.0
DEFAULT_REFRESH_HOURS = 24
DEFAULT_MIN_BYTES = 1_000_000
DEFAULT_DAILY_COST_THRESHOLD = 100.0
DEFAULT_RETENTION_DAYS = 90
REPORT_PERIODS = (7, 14, 30)
DEFAULT_REPORT_PERIOD = 14


@dataclass(frozen=True)
class Params:
    """Parameters of one run.

    ``as_of`` is the reference time ("now"), in UTC.  Give it for repeatable
    results; left out, it is the start time of the query.
    """

    as_of: datetime | str | None = None
    history_days: int = DEFAULT_HISTORY_DAYS
    price_per_tb: float = DEFAULT_PRICE_PER_TB
    min_bytes: int = DEFAULT_MIN_BYTES
    table_limit: int = 100
    query_limit: int = 100
    text_limit: int = 1000

    def with_settings(self, **overrides) -> "Params":
        """A copy with every override that is not None."""
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})

    def now(self) -> Column:
        """The reference time as a TIMESTAMP column (a constant when given)."""
        return timestamp_literal(self.as_of)

    def days_ago(self, days: int) -> Column:
        return self.now() - F.make_dt_interval(F.lit(int(days)))

    def history_start(self) -> Column:
        return self.days_ago(self.history_days)


def timestamp_literal(value: datetime | str | None) -> Column:
    if value is None:
        return F.current_timestamp()
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.to_timestamp(F.lit(value))
