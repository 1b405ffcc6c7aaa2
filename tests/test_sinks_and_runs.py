"""Writers, snapshots, retention, runs and the table set."""

import json
import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scanledger.operators import quality, shaping
from scanledger.params import Params
from scanledger.plans import reports, runs
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from scanledger.schema import MART, PROJECTS, RUN_SUMMARY, conform
from scanledger.session import shared_folder
from scanledger.sinks import snapshots as snapshot_sink, tables
from scanledger.sources import job_log, projects, snapshots
from tests.conftest import job

A = ("data", "sales", "orders")


@pytest.fixture
def jobs(log):
    return log(
        job("a", referenced_tables=[A]),
        job("b", project_id="p2", creation_time=datetime(2024, 1, 16)),
        job("c", project_id="off"),
    )


@pytest.fixture
def project_rows(spark):
    rows = [("p1", "One", "", None), ("p2", "Two", "", False), ("off", "Off", "", True), ("idle", "Idle", "", None)]
    return spark.createDataFrame(rows, PROJECTS)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_snapshot_round_trip(spark, jobs, params, tmp_path):
    path, mart = str(tmp_path / "s"), user_day_mart(jobs, params)
    for _ in range(2):
        snapshot_sink.write_snapshot(mart, path, "2024-01-31_00-00-00")
    back = snapshots.read_snapshots(spark, path)
    same = back.drop("snapshot_ts").select(mart.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, mart.collect()))


def test_old_snapshots_without_arrays_are_readable(spark, tmp_path, params):
    file = tmp_path / "old.json"
    file.write_text(json.dumps([{"date": "2024-01-20", "project_id": "p", "user_email": "u@x", "query_count": 3,
                                 "total_bytes_processed": 10, "estimated_cost_usd": 1.5}]))
    rows = snapshots.read_user_days(spark, str(file))
    assert rows.first().recent_queries is None
    history = reports.query_history(rows).first()
    assert (history.dataset, history.query_count, history.total_cost) == ("Unknown", 3, 1.5)


def test_retention_drops_whole_snapshots(spark, jobs, params, tmp_path):
    path, mart = str(tmp_path / "s"), user_day_mart(jobs, params)
    taken = ["2023-10-01_05-00-00", "2024-01-30_05-00-00"]
    for stamp in taken:
        snapshot_sink.write_snapshot(mart, path, stamp)
    kept = snapshot_sink.retained(snapshots.read_snapshots(spark, path), params)
    assert {r.snapshot_ts for r in kept.collect()} == {taken[1]}
    assert snapshot_sink.drop_expired(spark, path, datetime(2024, 1, 31)) == taken[:1]
    assert {r.snapshot_ts for r in snapshots.read_snapshots(spark, path).collect()} == {taken[1]}


def test_run_covers_enabled_projects(spark, jobs, project_rows, params, tmp_path):
    rows = runs.run_monitoring(spark, jobs, project_rows, params, str(tmp_path), datetime(2024, 1, 31, 5))
    found = {r.project: r for r in rows.collect()}
    assert set(found) == {"p1", "p2", "idle"}
    assert (found["p1"].records, found["p1"].total_cost, found["p1"].total_queries) == (1, 5.0, 1)
    assert (found["idle"].records, found["idle"].total_cost) == (0, 0.0)
    assert found["p1"].error is None and found["p1"].elapsed_seconds > 0
    assert os.path.isdir(found["p1"].output_path)


def test_a_broken_log_becomes_error_rows(spark, jobs, project_rows, params, tmp_path):
    broken = jobs.withColumn("total_bytes_billed", F.raise_error(F.lit("log not readable")).cast("long"))
    rows = runs.run_monitoring(spark, broken, project_rows, params, str(tmp_path), datetime(2024, 1, 31, 5))
    answer = {r.project: r for r in runs.run_response(rows).collect()}
    assert set(answer) == {"p1", "p2", "idle"}
    assert all(not answer[p].success and answer[p].records == 0 and "log not readable" in answer[p].error for p in ("p1", "p2"))
    assert answer["idle"].success and answer["idle"].records == 0  # it has no row to break on


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_broken_project_leaves_the_others(spark, jobs, project_rows, params, tmp_path, fmt):
    unreadable = F.raise_error(F.lit("log not readable")).cast("long")
    broken = jobs.withColumn("total_bytes_billed", F.when(F.col("project_id") == "p2", unreadable).otherwise(F.col("total_bytes_billed")))
    rows = runs.run_monitoring(spark, broken, project_rows, params, str(tmp_path), datetime(2024, 1, 31, 5), fmt)
    found = {r.project: r for r in rows.collect()}
    assert (found["p1"].records, found["p1"].total_cost, found["p1"].error) == (1, 5.0, None)
    assert "log not readable" in found["p2"].error and found["idle"].error is None
    stored = snapshots.read_snapshots(spark, str(tmp_path / "snapshots"), fmt)
    assert {r.project_id for r in stored.collect()} == {"p1"}


def test_views_of_two_schemas_stay_apart(spark, jobs, params):
    first = runs.build_all(spark, jobs, params, "sa")["daily"]
    second = runs.build_all(spark, jobs.where("job_id = 'a'"), params, "sb")["daily"]
    assert (first.count(), second.count()) == (3, 1)
    assert (spark.table("sa_daily_cost_summary").count(), spark.table("daily_cost_summary").count()) == (3, 1)


def test_a_failed_write_is_tried_again(spark, jobs, params):
    built = runs.TableSet(spark, "sc", params)
    with pytest.raises(Exception, match="log not readable"):
        built.create_main(jobs.withColumn("total_bytes_billed", F.raise_error(F.lit("log not readable")).cast("long")))
    assert built.create_main(jobs).count() == 3


def test_period_and_newer_rows_are_pushed_to_the_scan(spark, jobs, params, tmp_path):
    path = str(tmp_path / "t")
    tables.write_folder(main_cost_table(jobs, params), path, tables.MAIN_CLUSTER)
    stored = spark.read.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(reports.in_period(stored, params, 16, day_partition="day"))
    assert "GreaterThanOrEqual(date," in text and "PartitionFilters: [isnotnull(day" in text
    fresh = shaping.newer_than(stored, "day", stored.where("day = '2024-01-15'"))
    assert "PartitionFilters: [isnotnull(day" in plan(fresh) and {r.date for r in fresh.collect()} == {"2024-01-16"}


def test_single_project_run_and_latest_summary(spark, jobs, project_rows, params, tmp_path):
    for hour in (5, 6):
        runs.monitor_project(spark, jobs, project_rows, "p2", params, str(tmp_path), datetime(2024, 1, 31, hour))
    latest = snapshots.latest_run(snapshots.read_run_summaries(spark, str(tmp_path / "summaries")))
    assert [(r.project, r.run_ts) for r in latest.collect()] == [("p2", "2024-01-31_06-00-00")]


def test_runs_of_two_projects_on_a_day_leave_each_other(spark, jobs, project_rows, params, tmp_path):
    for hour, project in ((5, "p1"), (6, "p2")):
        runs.monitor_project(spark, jobs, project_rows, project, params, str(tmp_path), datetime(2024, 1, 31, hour))
    rows = snapshots.read_run_summaries(spark, str(tmp_path / "summaries")).collect()
    assert sorted((r.project, r.run_ts) for r in rows) == [("p1", "2024-01-31_05-00-00"), ("p2", "2024-01-31_06-00-00")]


def test_table_set(spark, jobs, params):
    built = runs.build_all(spark, jobs, params, "costs")
    assert built["main"].count() == 3
    assert spark.table("daily_cost_summary").count() == 3
    assert built["attribution"].first().pct_of_user_cost == 100.0
    comments = {r.col_name: r.comment for r in tables.table_comments(spark, "costs.cost_monitoring").collect()}
    assert comments["slot_hours"] == "slot time in hours"
    partitions = spark.sql("SHOW PARTITIONS costs.cost_monitoring").collect()
    assert {r[0] for r in partitions} == {"day=2024-01-15", "day=2024-01-16"}
    again = runs.TableSet(spark, "costs", params)
    again.create_main(jobs)
    again.create_main(None)  # known already, so nothing is built
    assert job_log.named_table(spark, "costs", "cost_monitoring").count() == 3


def test_only_touched_days_are_replaced(spark, jobs, params, tmp_path):
    path, main = str(tmp_path / "t"), main_cost_table(jobs, params)
    tables.write_folder(main, path, tables.MAIN_CLUSTER)
    late = main.where("date = '2024-01-16'").withColumn("query_count", F.lit(99).cast("long"))
    for _ in range(2):
        tables.replace_days(late, path, tables.MAIN_CLUSTER)
    counts = {r.date: r.query_count for r in spark.read.parquet(path).where("project_id <> 'off'").collect()}
    assert counts == {"2024-01-15": 1, "2024-01-16": 99}


def test_newer_than_takes_all_when_nothing_is_built(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "date STRING")
    assert shaping.newer_than(rows, "date", rows.limit(0)).count() == 2
    assert shaping.newer_than(rows, "date", rows.where("date < '2024-01-02'")).count() == 1
    assert shaping.exploration_limit(rows, 1).count() == 1


def test_config(spark, tmp_path):
    file = tmp_path / "projects.json"
    file.write_text(json.dumps({"projects": [{"id": "p1", "name": "One"}, {"id": "", "disabled": True}],
                                "settings": {"historyDays": 7, "refreshInterval": -1}}))
    config = projects.read_config(spark, str(file))
    assert [r.id for r in projects.enabled(projects.projects(config)).collect()] == ["p1"]
    assert tuple(projects.settings(config).first()) == (7.0, 5.0, 24.0)  # not above zero: the default
    params = projects.load_params(spark, str(file), price_per_tb=6.25)
    assert (params.history_days, params.price_per_tb) == (7, 6.25)
    failed = {(r["index"], r.rule) for r in quality.config_checks(config).collect()}
    assert failed == {(1, "id_required"), (1, "name_required"), (None, "refreshInterval_positive")}


@pytest.mark.parametrize("content", [None, "not json at all {"])
def test_missing_or_broken_config_gives_defaults(spark, tmp_path, content):
    file = tmp_path / "projects.json"
    if content is not None:
        file.write_text(content)
    config = projects.read_config(spark, str(file))
    assert tuple(projects.settings(config).first()) == (30.0, 5.0, 24.0)
    assert projects.projects(config).count() == 0


def test_params():
    params = Params().with_settings(history_days=None, price_per_tb=6.0)
    assert (params.history_days, params.price_per_tb) == (30, 6.0)


def run_rows(spark, *rows):
    """Run rows of (project, run_ts, records)."""
    made = spark.createDataFrame(list(rows), "project STRING, run_ts STRING, records BIGINT")
    return conform(made, RUN_SUMMARY)


def summary_rows(spark, path, day=None):
    rows = snapshots.read_run_summaries(spark, path, day).collect()
    return sorted(((r.project, r.run_ts, r.records) for r in rows), key=str)


def test_a_summary_of_many_projects_is_a_few_files(spark, tmp_path):
    path = str(tmp_path / "summaries")
    projects = spark.range(3000).select(F.concat(F.lit("p/"), "id").alias("project"), F.lit("2024-01-31_05-00-00").alias("run_ts"), F.col("id").alias("records"))
    snapshot_sink.write_run_summary(conform(projects.coalesce(3), RUN_SUMMARY), path)
    assert len(list((tmp_path / "summaries").rglob("*.json"))) == 3
    assert summary_rows(spark, path) == sorted(((f"p/{n}", "2024-01-31_05-00-00", n) for n in range(3000)), key=str)


def test_a_later_summary_replaces_the_rows_of_its_projects_on_its_day(spark, tmp_path):
    path, day, next_day = str(tmp_path / "summaries"), "2024-01-30_05-00-00", "2024-01-31_05-00-00"
    snapshot_sink.write_run_summary(run_rows(spark, ("a", day, 1), ("b", day, 2), ("b", day, 3), (None, day, 4), ("a", next_day, 5)), path)
    first = len(list((tmp_path / "summaries").glob("run_date=*/written=*")))
    assert first == 2
    snapshot_sink.write_run_summary(run_rows(spark, ("a", day, 6), (None, day, 7)), path)  # a repeated run of the same time
    now = [("b", day, 2), ("b", day, 3), ("a", day, 6), (None, day, 7)]
    assert summary_rows(spark, path, "2024-01-30") == sorted(now, key=str)
    assert summary_rows(spark, path) == sorted([*now, ("a", next_day, 5)], key=str)
    later = "2024-01-30_06-00-00"
    snapshot_sink.write_run_summary(run_rows(spark, ("a", later, 8), ("b", later, 9)), path)
    assert summary_rows(spark, path, "2024-01-30") == sorted([("a", later, 8), ("b", later, 9), (None, day, 7)], key=str)
    # The first write of the day holds no row any more that is read.
    assert len(list((tmp_path / "summaries").glob("run_date=2024-01-30/written=*"))) == 2
    assert len(list((tmp_path / "summaries").glob("run_date=2024-01-31/written=*"))) == 1


def test_summaries_stored_by_project_are_still_read(spark, tmp_path):
    path, day = str(tmp_path / "summaries"), "2024-01-30_05-00-00"
    old = run_rows(spark, ("a", day, 1), ("b 1/2", day, 2), (None, day, 3)).withColumn("run_date", F.substring("run_ts", 1, 10))
    old.write.partitionBy("run_date", "project").json(path)
    assert summary_rows(spark, path) == sorted([("a", day, 1), ("b 1/2", day, 2), (None, day, 3)], key=str)
    snapshot_sink.write_run_summary(run_rows(spark, ("a", day, 4)), path)
    assert summary_rows(spark, path) == sorted([("a", day, 4), ("b 1/2", day, 2), (None, day, 3)], key=str)


def test_a_run_of_no_projects_has_no_rows(spark, tmp_path):
    path = str(tmp_path / "summaries")
    snapshot_sink.write_run_summary(run_rows(spark), path)
    assert summary_rows(spark, path) == [] and summary_rows(spark, path, "2024-01-30") == []


@pytest.fixture
def many_projects(spark):
    """Two projects with jobs among 1,200."""
    idle = spark.range(1198).select(F.concat(F.lit("idle-"), "id").alias("id"), F.lit("Idle").alias("name"))
    own = spark.createDataFrame([("p1", "One"), ("p2", "Two")], "id STRING, name STRING")
    return conform(own.unionByName(idle).coalesce(2), PROJECTS)


def summary_files(tmp_path):
    return len(list((tmp_path / "summaries").rglob("*.json")))


def test_a_run_over_many_projects_stores_few_files(spark, jobs, many_projects, params, tmp_path):
    rows = runs.run_monitoring(spark, jobs, many_projects, params, str(tmp_path), datetime(2024, 1, 31, 5))
    found = {r.project: r.records for r in rows.collect()}
    assert len(found) == 1200 and (found["p1"], found["p2"], found["idle-7"]) == (1, 1, 0)
    assert summary_files(tmp_path) <= 20


def test_a_scheduled_run_over_many_projects_stores_few_files(spark, jobs, many_projects, params, tmp_path):
    store = str(tmp_path / "store")
    response = runs.scheduled_run(spark, jobs, many_projects, params, str(tmp_path), store, "scanledger", datetime(2024, 1, 31, 5))
    found = {r.project: (r.success, r.records) for r in response.collect()}
    assert len(found) == 1200 and (found["p1"], found["idle-7"]) == ((True, 1), (True, 0))
    assert {r.uploaded_project for r in snapshot_sink.read_uploads(spark, store, MART).collect()} == {"p1", "p2"}
    assert summary_files(tmp_path) <= 20


BY_PROJECT = r"hashpartitioning\(project_id#\d+, \d+\)"


def test_jobs_of_a_run_are_not_gathered_by_project(spark, jobs, many_projects, params, tmp_path, stored_plans):
    """The list of projects is of no known size; a project's jobs must not meet in one task for it."""
    rows = runs.run_monitoring(spark, jobs, many_projects, params, str(tmp_path), datetime(2024, 1, 31, 5))
    assert {r.project: r.records for r in rows.where("records > 0").collect()} == {"p1": 1, "p2": 1}
    assert len(stored_plans) == 1 and not re.search(BY_PROJECT, stored_plans[0])


def test_a_run_keeps_to_enabled_projects_with_a_name(spark, log, params, tmp_path):
    """Projects listed twice count once a row; those disabled, without id or not listed have no jobs in the snapshot."""
    listed = spark.createDataFrame([("p1", "1", "", None), ("p1", "1", "", False), ("off", "2", "", True), (None, "3", "", None)], PROJECTS)
    mixed = log(job("a"), job("b", project_id="off"), job("c", project_id=None), job("d", project_id="unlisted"))
    rows = runs.run_monitoring(spark, mixed, listed, params, str(tmp_path), datetime(2024, 1, 31, 5))
    assert {(r.project, r.records) for r in rows.collect()} == {("p1", 1), (None, 0)}
    stored = snapshots.read_snapshots(spark, str(tmp_path / "snapshots"))
    assert [(r.project_id, r.query_count) for r in stored.collect()] == [("p1", 1)]


def test_jobs_of_a_scheduled_run_are_not_gathered_by_project(spark, jobs, many_projects, params, tmp_path, stored_plans):
    store = str(tmp_path / "store")
    response = runs.scheduled_run(spark, jobs, many_projects, params, str(tmp_path), store, "scanledger", datetime(2024, 1, 31, 5))
    assert {r.project: r.records for r in response.where("records > 0").collect()} == {"p1": 1, "p2": 1}
    assert len(stored_plans) == 1 and not re.search(BY_PROJECT, stored_plans[0])


def test_a_scheduled_run_collects_after_the_shuffle(spark, log, params, tmp_path, stored_plans):
    """No task builds lists that are shuffled and merged; hours, datasets and ranked entries stay in their order."""
    tables = [("data", f"d{n}", "t") for n in range(3)]
    jobs = log(*[job(f"j{n:02}", creation_time=datetime(2024, 1, 15, 23 - n), referenced_tables=tables[: n % 3 + 1]) for n in range(9)])
    watched = spark.createDataFrame([("p1", "One", "", None)], PROJECTS)
    store = str(tmp_path / "store")
    response = runs.scheduled_run(spark, jobs.repartition(4), watched, params, str(tmp_path), store, "scanledger", datetime(2024, 1, 31, 5))
    assert [(r.project, r.success, r.records) for r in response.collect()] == [("p1", True, 1)]
    row = snapshot_sink.read_uploads(spark, store, MART).first()
    assert [h.hour_of_day for h in row.hourly_breakdown] == list(range(15, 24))
    assert [d.dataset for d in row.dataset_costs] == ["data.d0", "data.d1", "data.d2"]
    assert [t.table_name for t in row.table_costs] == ["data.d0.t", "data.d1.t", "data.d2.t"]
    assert [q.job_id for q in row.recent_queries] == [f"j{n:02}" for n in range(9)]
    assert not re.search(r"Exchange [^\n]*\n[^\n]*partial_collect_list", stored_plans[0])
