"""Threshold alerts: daily cost, and failed jobs.

The same functions serve a stream and a batch frame.  An alert is a row
``(policy, window_start, window_end, value, threshold)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from scanledger.functions.cost import TIB, cost_usd
from scanledger.operators.jobs import queries_only, without_scripts
from scanledger.params import DEFAULT_DAILY_COST_THRESHOLD, DEFAULT_PRICE_PER_TB
from scanledger.schema import JOBS
from scanledger.sinks import versions
from scanledger.sources.job_log import normalise

# Window lengths of the two policies.
COST_WINDOW = "1 day"
FAILURE_WINDOW = "5 minutes"

# How late a job may arrive before its window is closed.
COST_LATENESS = "1 day"
FAILURE_LATENESS = "10 minutes"

ALERT = T.StructType(
    [
        T.StructField("policy", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
    ]
)


def job_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The job log as a stream of arriving files."""
    return normalise(spark.readStream.format(fmt).schema(JOBS).options(**options).load(path))


def _fired(windows: DataFrame, policy: str, threshold: float) -> DataFrame:
    return windows.where(F.col("value") > threshold).select(
        F.lit(policy).alias("policy"),
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "value",
        F.lit(float(threshold)).alias("threshold"),
    )


def daily_cost_alerts(
    jobs: DataFrame,
    threshold: float = DEFAULT_DAILY_COST_THRESHOLD,
    price_per_tb: float = DEFAULT_PRICE_PER_TB,
) -> DataFrame:
    """Days whose cost over all projects exceeds the threshold."""
    spent = (
        without_scripts(queries_only(jobs))
        .withWatermark("creation_time", COST_LATENESS)
        .groupBy(F.window("creation_time", COST_WINDOW))
        .agg(F.sum("total_bytes_billed").alias("billed"))
        .withColumn("value", cost_usd(F.col("billed"), price_per_tb))
    )
    return _fired(spent, f"daily-cost-above-{threshold:g}", threshold)


def failure_alerts(jobs: DataFrame, threshold: float = 0) -> DataFrame:
    """Five-minute windows with more failed jobs than the threshold."""
    failed = (
        jobs.where(F.col("error_result").isNotNull())
        .withWatermark("creation_time", FAILURE_LATENESS)
        .groupBy(F.window("creation_time", FAILURE_WINDOW))
        .agg(F.count("*").cast("double").alias("value"))
    )
    return _fired(failed, "failed-jobs", threshold)


def any_alert(*alerts: DataFrame) -> DataFrame:
    """Alerts of any of the policies."""
    combined = alerts[0]
    for more in alerts[1:]:
        combined = combined.unionByName(more)
    return combined


def _window_amounts(jobs: DataFrame, policy: str, window: str, amount: Column) -> DataFrame:
    """(policy, window_start, window_end, amount, seen): what each job adds to its window."""
    rows = jobs.select(F.window("creation_time", window).alias("w"), amount.cast("long").alias("amount"), "creation_time")
    return rows.where(F.col("w").isNotNull()).select(
        F.lit(policy).alias("policy"),
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "amount",
        F.col("creation_time").alias("seen"),
    )


def _added_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of a task, so a window of very many jobs is a few rows in the shuffle."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            # Sums may be null where amounts may not: the columns agree but for that.
            rows = pa.concat_tables([held, rows], promote_options="default")
        summed = rows.group_by(["policy", "window_start", "window_end"]).aggregate([("amount", "sum"), ("seen", "max")])
        held = summed.select(["policy", "window_start", "window_end", "amount_sum", "seen_max"]).rename_columns(rows.column_names)
    if held is not None:
        yield from held.to_batches()


_AMOUNTS = "policy string, window_start timestamp, window_end timestamp, amount long, seen timestamp"


def alert_changes(
    jobs: DataFrame,
    threshold: float,
    price_per_tb: float | None = None,
    policy: str | None = None,
) -> DataFrame:
    """A stream of alerts that are new or changed, each told once; ``jobs`` is a stream.

    With a price, days whose cost exceeds the threshold, else five-minute windows
    with more failed jobs.  The state holds one sum per policy and window and the
    value told last, and drops a window when the watermark passes its lateness;
    a restarted stream goes on from it.  Jobs are added up within each task
    before they are shuffled.  A sum without jobs to add is no change.
    """
    lateness, amount, window = FAILURE_LATENESS, F.lit(1), FAILURE_WINDOW
    rows = jobs.where(F.col("error_result").isNotNull())
    if price_per_tb is not None:
        lateness, window = COST_LATENESS, COST_WINDOW
        amount, rows = F.coalesce("total_bytes_billed", F.lit(0)), without_scripts(queries_only(jobs))
    name = policy or (f"daily-cost-above-{threshold:g}" if price_per_tb is not None else "failed-jobs")
    late_ms = int(pd.Timedelta(lateness).total_seconds() * 1000)

    def told(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, last = state.get if state.exists else (0, None)
        total += sum(int(frame["amount"].sum()) for frame in frames)
        value = float(total) if price_per_tb is None else _cents(total, price_per_tb)
        if value > threshold and value != last:
            last = value
            yield pd.DataFrame(
                {"policy": [key[0]], "window_start": [key[1]], "window_end": [key[2]], "value": [value], "threshold": [float(threshold)]}
            )
        state.update((total, last))
        closes = int(pd.Timestamp(key[2]).timestamp() * 1000) + late_ms
        if closes > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(closes)
        else:
            state.remove()

    amounts = _window_amounts(rows, name, window, amount).mapInArrow(_added_up, _AMOUNTS)
    return (
        amounts.withWatermark("seen", lateness)
        .groupBy("policy", "window_start", "window_end")
        .applyInPandasWithState(told, ALERT, "total long, last double", "update", "EventTimeTimeout")
    )


def _cents(nbytes: int, price_per_tb: float) -> float:
    """``functions.cost.cost_usd`` of one number."""
    price = Decimal(repr(nbytes / TIB * price_per_tb))
    return float(price.quantize(Decimal("0.01"), ROUND_HALF_UP))


def keep_alerts(
    alerts: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, **trigger
) -> StreamingQuery:
    """Keep a stream of alerts below ``path``, one row per policy and window.

    A micro-batch changes the days of its windows as a whole: their stored
    alerts, overlaid with those of the batch, are published as a new version,
    the version before it is removed.  So the store grows with alerts, not with
    batches, and a repeated batch, or a new stream that tells alerts again,
    changes nothing.  ``on_change`` gets the alerts that are new or differ from
    the stored ones.  One stream at a time writes to a store; streams of other
    policies get stores of their own, or follow one another.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("policy", "window_start").agg(
            F.max_by(F.struct("window_end", "value", "threshold"), "value").alias("f")
        ).select("policy", "window_start", "f.*")
        # Alerts of a batch: at most one per policy and window that it touched.
        fresh = fresh.withColumn("date", F.to_date("window_start")).cache()
        try:
            days = [str(row["date"]) for row in fresh.select("date").distinct().orderBy("date").collect()]
            if not days:
                return
            stored = versions.read_live(spark, path, STORED).where(F.col("day").isin([date.fromisoformat(d) for d in days])).drop("day")
            changed = fresh.join(stored, ["policy", "window_start", "window_end", "value", "threshold"], "left_anti")
            if changed.isEmpty():
                return
            if on_change is not None:
                on_change(changed.select(ALERT.fieldNames()), batch_id)
            others = stored.join(fresh, ["policy", "window_start"], "left_anti")
            whole = others.select(STORED.fieldNames()).unionByName(fresh.select(STORED.fieldNames()))
            versions.replace_listed(whole, path, days, ("policy", "window_start"))
            versions.vacuum(spark, path)
        finally:
            fresh.unpersist()

    return (
        alerts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


STORED = T.StructType([*ALERT.fields, T.StructField("date", T.DateType())])


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts kept by ``keep_alerts``, one per policy and window."""
    return versions.read_live(spark, path, STORED).select(ALERT.fieldNames())


def compact_alerts(spark: SparkSession, path: str, compacted: str) -> None:
    """Copy the alerts of a store to a new one, with one version of every day."""
    rows = versions.read_live(spark, path, STORED).select(STORED.fieldNames())
    days = sorted(versions.live_days(spark, path))
    if days:
        versions.replace_range(rows, compacted, days[0], days[-1], ("policy", "window_start"))
