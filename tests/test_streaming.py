"""Alert streams against their batch twins."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalog import queries
from scanledger.schema import JOBS
from scanledger.sources.job_log import normalise
from scanledger.streaming import alerts
from tests.conftest import job

START = datetime(2024, 1, 10, 23, 50)


def rows():
    made = []
    for n in range(60):
        made.append(
            job(
                f"j{n}",
                creation_time=START + timedelta(minutes=n),
                total_bytes_billed=2 * 1024**4,
                error_result=("bad", None) if n % 9 == 0 else None,
                job_type="LOAD" if n % 10 == 0 else "QUERY",
            )
        )
    return made


def as_set(df):
    return {tuple(r) for r in df.select("policy", "window_start", "window_end", "value", "threshold").collect()}


def test_streams_keep_what_batch_finds(spark, tmp_path):
    source, path = str(tmp_path / "log"), str(tmp_path / "alerts")
    made = rows()
    for part in range(0, 60, 15):  # files arrive in the order of their jobs
        spark.createDataFrame(made[part : part + 15], JOBS).coalesce(1).write.mode("append").parquet(source)
    jobs = normalise(spark.createDataFrame(made, JOBS))
    expected = as_set(alerts.any_alert(alerts.daily_cost_alerts(jobs), alerts.failure_alerts(jobs)))
    stream = alerts.job_stream(spark, source, maxFilesPerTrigger=1)
    for name, fired in (("cost", alerts.daily_cost_alerts(stream)), ("fail", alerts.failure_alerts(stream))):
        for _ in range(2):  # a restart finds nothing new and changes nothing
            alerts.keep_alerts(fired, path, str(tmp_path / name)).awaitTermination()
    kept = alerts.current_alerts(spark, path)
    assert kept.count() == len(expected)
    assert as_set(kept) == expected
    assert {p for p, *_ in expected} == {"daily-cost-above-100", "failed-jobs"}


def test_a_new_checkpoint_keeps_old_alerts(spark, tmp_path):
    path, made = str(tmp_path / "alerts"), rows()
    stored = set()
    for turn, part in enumerate((made[:30], made[30:])):
        source = str(tmp_path / f"log{turn}")
        spark.createDataFrame(part, JOBS).coalesce(1).write.parquet(source)
        fired = alerts.failure_alerts(alerts.job_stream(spark, source))
        alerts.keep_alerts(fired, path, str(tmp_path / f"state{turn}")).awaitTermination()
        now = {(r.policy, r.window_start) for r in alerts.current_alerts(spark, path).collect()}
        assert stored <= now
        stored = now
    before = as_set(alerts.current_alerts(spark, path))
    alerts.compact_alerts(spark, path, str(tmp_path / "compacted"))
    assert as_set(alerts.current_alerts(spark, str(tmp_path / "compacted"))) == before


def test_threshold_is_exclusive_and_scripts_do_not_count(spark):
    def value(threshold, **extra):
        jobs = normalise(spark.createDataFrame([job("a"), job("b", **extra)], JOBS))
        return [r["value"] for r in alerts.daily_cost_alerts(jobs, threshold).collect()]

    assert value(10) == []
    assert value(9.99) == [10.0]
    assert value(4, statement_type="SCRIPT") == [5.0]


def test_closed_windows_in_append_mode(spark, tmp_path):
    source = str(tmp_path / "log")
    spark.createDataFrame(rows(), JOBS).coalesce(1).write.parquet(source)
    late = job("late", creation_time=START + timedelta(hours=2))
    spark.createDataFrame([late], JOBS).coalesce(1).write.mode("append").parquet(source)
    fired = alerts.failure_alerts(alerts.job_stream(spark, source, maxFilesPerTrigger=1))
    query = (
        fired.writeStream.outputMode("append").format("memory").queryName("closed")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = as_set(spark.table("closed"))
    batch = as_set(alerts.failure_alerts(normalise(spark.createDataFrame(rows(), JOBS))))
    assert closed <= batch


def test_changes_are_told_once_and_the_store_follows_alerts(spark, tmp_path):
    source, path, made = str(tmp_path / "log"), str(tmp_path / "alerts"), rows()
    told = []

    def run(name):
        stream = alerts.job_stream(spark, source, maxFilesPerTrigger=1)
        changes = alerts.alert_changes(stream, 0)
        alerts.keep_alerts(changes, path, str(tmp_path / name), lambda df, n: told.extend(map(tuple, df.collect()))).awaitTermination()

    for part in range(0, 60, 15):
        spark.createDataFrame(made[part : part + 15], JOBS).coalesce(1).write.mode("append").parquet(source)
        run("state")  # a restart per file
    expected = as_set(alerts.failure_alerts(normalise(spark.createDataFrame(made, JOBS))))
    assert as_set(alerts.current_alerts(spark, path)) == expected
    assert len(told) == len(set(told)) and expected <= set(told)
    before = len(told)
    run("state")  # nothing new
    run("other")  # a new checkpoint reads all again
    assert len(told) == before and as_set(alerts.current_alerts(spark, path)) == expected
    files = [f for f in (tmp_path / "alerts").rglob("*.parquet")]
    assert len(files) <= len({day for _, start, *_ in expected for day in [start.date()]}) * 4


def test_cost_changes_end_where_batch_does(spark, tmp_path):
    source, path, made = str(tmp_path / "log"), str(tmp_path / "alerts"), rows()
    for part in range(0, 60, 15):
        spark.createDataFrame(made[part : part + 15], JOBS).coalesce(1).write.mode("append").parquet(source)
    stream = alerts.job_stream(spark, source, maxFilesPerTrigger=1)
    alerts.keep_alerts(alerts.alert_changes(stream, 100, 5.0), path, str(tmp_path / "state")).awaitTermination()
    assert as_set(alerts.current_alerts(spark, path)) == as_set(alerts.daily_cost_alerts(normalise(spark.createDataFrame(made, JOBS))))


def test_changes_of_tasks_that_take_several_batches_of_rows(spark, tmp_path):
    source, path, made = str(tmp_path / "log"), str(tmp_path / "alerts"), rows()
    spark.createDataFrame(made, JOBS).coalesce(1).write.parquet(source)
    jobs, stream = normalise(spark.createDataFrame(made, JOBS)), alerts.job_stream(spark, source)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        for name, fired in (("cost", alerts.alert_changes(stream, 100, 5.0)), ("fail", alerts.alert_changes(stream, 0))):
            alerts.keep_alerts(fired, path, str(tmp_path / name)).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    expected = as_set(alerts.any_alert(alerts.daily_cost_alerts(jobs, 100, 5.0), alerts.failure_alerts(jobs)))
    assert {p for p, *_ in expected} == {"daily-cost-above-100", "failed-jobs"}
    assert as_set(alerts.current_alerts(spark, path)) == expected


def test_streamed_events_may_be_a_file_or_a_folder(spark, tmp_path):
    moments = [(n, datetime(2024, 1, 10, n), n, "error", 1.5) for n in range(6)]
    events = spark.createDataFrame(moments, queries.EVENTS)
    orders = spark.createDataFrame([(n, n, 100.0) for n in range(6)], "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE")
    for name in ("folder", "file"):
        at = tmp_path / name
        orders.write.parquet(str(at / "orders.parquet"))
        if name == "folder":
            events.repartition(3).write.parquet(str(at / "events.parquet"))
        else:
            events.coalesce(1).write.parquet(str(tmp_path / "made"))
            (part,) = (tmp_path / "made").glob("part-*.parquet")
            part.rename(at / "events.parquet")
        fired = alerts.failure_alerts(queries.streamed_jobs(spark, str(at)))
        alerts.keep_alerts(fired, str(tmp_path / f"alerts-{name}"), str(tmp_path / f"state-{name}")).awaitTermination()
        assert alerts.current_alerts(spark, str(tmp_path / f"alerts-{name}")).count() == 6
