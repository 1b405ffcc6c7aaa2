"""Runs over logs with broken rows and files."""

import json
import os
import re
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scanledger.plans import runs
from scanledger.schema import JOBS, PROJECTS, conform
from scanledger.sources import checked_log, snapshots, star_log
from tests.conftest import job

PROJECTS_N = 1500
RUN = datetime(2024, 1, 31, 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log_folder(tmp_path_factory):
    """A JSON log of 1,500 projects; three are broken: no JSON, a wrong type, a cut-off line."""
    path = tmp_path_factory.mktemp("checked") / "log"
    names = JOBS.fieldNames()
    for n in range(PROJECTS_N):
        folder = path / f"project_id=p{n}"
        folder.mkdir(parents=True)
        row = dict(zip(names, job(f"j{n}", project_id=f"p{n}"), strict=True))
        row["creation_time"], row["end_time"] = "2024-01-15T10:00:00Z", "2024-01-15T10:00:05Z"
        row.pop("project_id")
        line = json.dumps(row)
        if n == 7:
            line += "\nnot json at all"
        elif n == 700:
            line = json.dumps({**row, "total_bytes_billed": "many"})
        elif n == 1400:
            line += "\n" + line[: len(line) // 2]
        (folder / "part.json").write_text(line + "\n")
    return str(path)


def test_broken_projects_are_rows_of_the_same_run(spark, log_folder, params, tmp_path):
    watched = spark.createDataFrame([(f"p{n}", f"Project {n}", "", None) for n in range(PROJECTS_N)], PROJECTS)
    checked = checked_log.read_checked_log(spark, log_folder)
    rows = {r.project: r for r in runs.run_monitoring(spark, checked, watched, params, str(tmp_path), RUN, "parquet").collect()}
    assert len(rows) == PROJECTS_N
    broken = {p for p, r in rows.items() if r.error}
    assert broken == {"p7", "p700", "p1400"}
    assert "not json at all" in rows["p7"].error and "1 broken, first in " in rows["p1400"].error
    assert all(r.records == 1 and r.total_cost == 5.0 for p, r in rows.items() if p not in broken)
    stored = snapshots.read_snapshots(spark, str(tmp_path / "snapshots"), "parquet")
    assert stored.count() == PROJECTS_N - 3


def test_the_raw_log_is_scanned_once(spark, log_folder, params):
    staged = checked_log.stage(checked_log.read_checked_log(spark, log_folder), params)
    for frame in (checked_log.good_rows(staged), checked_log.broken_projects(staged)):
        assert log_folder not in plan(frame) and "checked-log" in plan(frame)
    assert re.search(r"PartitionFilters: \[[^\]]*is_broken", plan(checked_log.broken_projects(staged)))
    assert checked_log.good_rows(staged).count() == PROJECTS_N - 1


def test_unreadable_parquet_files_are_problems(spark, params, tmp_path):
    path = str(tmp_path / "log")
    rows = [job("a"), job("b", project_id="p 2"), job("c", project_id="p3")]
    spark.createDataFrame(rows, JOBS).repartition("project_id").write.partitionBy("project_id").parquet(path)
    folder = os.path.join(path, "project_id=p3")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(os.path.join(folder, name), "r+b") as file:
                file.truncate(20)
        elif name.endswith(".crc"):
            os.remove(os.path.join(folder, name))
    watched = spark.createDataFrame([("p1", "1", "", None), ("p 2", "2", "", None), ("p3", "3", "", None)], PROJECTS)
    checked = checked_log.read_checked_log(spark, path, "parquet")
    rows = {r.project: r for r in runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN).collect()}
    assert "file cannot be read" in rows["p3"].error and rows["p3"].records is None
    assert (rows["p1"].error, rows["p 2"].error, rows["p 2"].records) == (None, None, 1)


def test_values_of_the_wrong_type_are_problems(spark):
    rows = spark.createDataFrame([("a", "12"), ("b", "x"), ("c", None)], "job_id string, total_bytes_billed string")
    checked = checked_log.typed(rows.withColumn("_file", F.lit("f")))
    found = {r.job_id: (r.total_bytes_billed, r.problem and r.problem.message) for r in checked.collect()}
    assert found == {"a": (12, None), "b": (None, "total_bytes_billed is no bigint: x"), "c": (None, None)}


def test_an_empty_log_and_an_unknown_project(spark, params, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text("broken\n")
    checked = checked_log.read_checked_log(spark, str(tmp_path / "log"))
    staged = checked_log.stage(checked, params)
    assert [(r.id, r.broken_rows) for r in checked_log.broken_projects(staged).collect()] == [(None, 1)]
    watched = spark.createDataFrame([("p1", "1", "", None)], PROJECTS)
    rows = runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN).collect()
    assert [(r.project, r.records, r.error) for r in rows] == [("p1", 0, None)]


def test_faults_of_a_plan_are_raised(spark, log, params, tmp_path):
    watched = spark.createDataFrame([("p1", "1", "", None)], PROJECTS)
    with pytest.raises(AnalysisException):
        runs.run_monitoring(spark, log(job("a")).drop("query"), watched, params, str(tmp_path), RUN)


def test_totals_of_one_project_are_observed_while_writing(spark, log, params, tmp_path):
    watched = spark.createDataFrame([("p1", "1", "", None), ("p2", "2", "", None)], PROJECTS)
    jobs = log(job("a"), job("b"), job("c", project_id="p2"))
    together = runs.run_monitoring(spark, jobs, watched, params, str(tmp_path / "a"), RUN).collect()
    alone = [runs.monitor_project(spark, jobs, watched, p, params, str(tmp_path / p), RUN).collect()[0] for p in ("p1", "p2")]
    same = lambda r: (r.project, r.records, r.total_cost, r.total_bytes_processed, r.total_queries, r.error)
    assert sorted(map(same, together)) == sorted(map(same, alone))
    idle = spark.createDataFrame([("idle", "1", "", None)], PROJECTS)
    row = runs.monitor_project(spark, jobs, idle, "idle", params, str(tmp_path / "i"), RUN).first()
    assert (row.records, row.total_cost, row.total_queries) == (0, 0.0, 0)


def test_a_checked_run_over_many_projects_stores_few_files(spark, params, tmp_path):
    (tmp_path / "log").mkdir()
    line = json.dumps(dict(zip(JOBS.fieldNames(), job("a", creation_time="2024-01-15T10:00:00Z", end_time="2024-01-15T10:00:05Z"), strict=True)))
    for project, text in (("p1", line), ("p2", line[:40])):
        (tmp_path / "log" / f"project_id={project}").mkdir()
        (tmp_path / "log" / f"project_id={project}" / "part.json").write_text(text + "\n")
    idle = spark.range(1198).select(F.concat(F.lit("idle-"), "id").alias("id"), F.lit("Idle").alias("name"))
    own = spark.createDataFrame([("p1", "One"), ("p2", "Two")], "id STRING, name STRING")
    watched = conform(own.unionByName(idle).coalesce(2), PROJECTS)
    checked = checked_log.read_checked_log(spark, str(tmp_path / "log"))
    rows = {r.project: r for r in runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN).collect()}
    assert len(rows) == 1200 and (rows["p1"].records, rows["p1"].error, rows["idle-7"].records) == (1, None, 0)
    assert rows["p2"].error.startswith("1 broken, first in ")
    assert len(list((tmp_path / "out" / "summaries").rglob("*.json"))) <= 20


def test_jobs_of_a_checked_run_are_not_gathered_by_project_and_costs_are_split_once(spark, params, tmp_path, stored_plans):
    line = dict(zip(JOBS.fieldNames(), job("a", creation_time="2024-01-15T10:00:00Z", end_time="2024-01-15T10:00:05Z"), strict=True))
    line["referenced_tables"] = [{"project_id": "data", "dataset_id": "sales", "table_id": "orders"}]
    line["destination_table"] = line["referenced_tables"][0]
    (tmp_path / "log.json").write_text("".join(json.dumps({**line, "project_id": f"p{n % 3}", "job_id": f"j{n}"}) + "\n" for n in range(30)))
    idle = spark.range(1198).select(F.concat(F.lit("idle-"), "id").alias("id"), F.lit("Idle").alias("name"))
    own = spark.createDataFrame([("p0", "Zero"), ("p1", "One")], "id STRING, name STRING")
    watched = conform(own.unionByName(idle).coalesce(2), PROJECTS)
    checked = checked_log.read_checked_log(spark, str(tmp_path / "log.json"))
    rows = runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN, "parquet")
    assert {(r.project, r.records, r.total_queries) for r in rows.where("records > 0").collect()} == {("p0", 1, 10), ("p1", 1, 10)}
    stored = snapshots.read_snapshots(spark, str(tmp_path / "out" / "snapshots"), "parquet")
    assert {(r.project_id, r.table_costs[0].is_rebuild_operation) for r in stored.collect()} == {("p0", True), ("p1", True)}
    assert len(stored_plans) == 1 and not re.search(r"hashpartitioning\(project_id#\d+, \d+\)", stored_plans[0])
    # Datasets and tables come from one split of the jobs' costs.
    assert stored_plans[0].count("Generate explode(referenced_tables_detail") == 1


def test_a_checked_run_collects_after_the_shuffle_and_counts_references_once_a_job(spark, params, tmp_path, stored_plans):
    """Lists are built after the shuffle alone, and the references of a job are counted ahead of the explode."""
    line = dict(zip(JOBS.fieldNames(), job("a", creation_time="2024-01-15T10:00:00Z", end_time="2024-01-15T10:00:05Z"), strict=True))
    line["referenced_tables"] = [{"project_id": "data", "dataset_id": f"d{n}", "table_id": "t"} for n in range(3)]
    (tmp_path / "log.json").write_text("".join(json.dumps({**line, "job_id": f"j{n}"})[: 40 if n == 7 else None] + "\n" for n in range(9)))
    checked = checked_log.read_checked_log(spark, str(tmp_path / "log.json"))
    watched = spark.createDataFrame([("p1", "One", "", None)], PROJECTS)
    rows = runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN, "parquet").collect()
    assert [(r.project, r.records, r.total_queries, r.error) for r in rows] == [("p1", 1, 8, None)]
    stored = snapshots.read_snapshots(spark, str(tmp_path / "out" / "snapshots"), "parquet").first()
    assert [(d.dataset, d.bytes_billed) for d in stored.dataset_costs] == [(f"data.d{n}", 2932031007402.664) for n in range(3)]
    assert not re.search(r"Exchange [^\n]*\n[^\n]*partial_collect_list", stored_plans[0])
    above = stored_plans[0].split("Generate explode(referenced_tables_detail")[0].splitlines()
    assert not any("aggregate(" in text and "Project" in text for text in above)


def test_a_checked_run_asks_for_its_projects_once(spark, params, tmp_path, monkeypatch):
    """The totals and the error rows come from the stored list of projects, which is not put together again."""
    line = json.dumps(dict(zip(JOBS.fieldNames(), job("a", creation_time="2024-01-15T10:00:00Z", end_time="2024-01-15T10:00:05Z"), strict=True)))
    for project, text in (("p1", line), ("p2", line[:40])):
        (tmp_path / "log" / f"project_id={project}").mkdir(parents=True)
        (tmp_path / "log" / f"project_id={project}" / "part.json").write_text(text + "\n")
    idle = spark.range(3).select(F.concat(F.lit("idle-"), "id").alias("id"), F.lit("Idle").alias("name"))
    # Ids may be missing or come twice.
    own = spark.createDataFrame([("p1", "One"), ("p2", "Two"), ("p2", "Two again"), (None, "None")], "id STRING, name STRING")
    watched = conform(own.unionByName(idle), PROJECTS)
    plans, write = [], runs.write_run_summary
    monkeypatch.setattr(runs, "write_run_summary", lambda rows, path: (plans.append(plan(rows)), write(rows, path))[1])
    checked = checked_log.read_checked_log(spark, str(tmp_path / "log"))
    rows = runs.run_monitoring(spark, checked, watched, params, str(tmp_path / "out"), RUN, "parquet").collect()
    told = sorted((r.project or "", r.project_name, r.records, r.error is None) for r in rows)
    assert told == [
        ("", "None", 0, True), ("idle-0", "Idle", 0, True), ("idle-1", "Idle", 0, True), ("idle-2", "Idle", 0, True),
        ("p1", "One", 1, True), ("p2", "Two", None, False), ("p2", "Two again", None, False),
    ]
    assert len(plans) == 1 and "watched-" in plans[0] and "Range" not in plans[0]


def test_staged_rows_are_written_without_dictionaries(spark, log_folder, params):
    staged = checked_log.stage(checked_log.read_checked_log(spark, log_folder), params)
    files = [name.removeprefix("file://") for name in checked_log.good_rows(staged).inputFiles()]
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    assert not any(group.column(n).has_dictionary_page for n in range(group.num_columns))


def test_lines_of_an_order_are_shuffled_once(spark):
    """References of the derived log: lines are dealt by order, counted and collected there."""
    lines = [(1, 3, 2, 1), (1, 23, 4, 2), (1, 3, 2, 6), (1, 4, 1, 7), (2, 5, 1, 1), (2, 5, 1, 1), (None, 1, 1, 1)]
    refs = star_log.references(spark.createDataFrame(lines, star_log.LINEITEM))
    found = {r.event_id: sorted((str(x.project_id), str(x.dataset_id), str(x.table_id), x.ref_count) for x in r.referenced_tables) for r in refs.collect()}
    assert found[1] == [("data-0", "ds_3", "None", 1), ("data-0", "ds_3", "t_3", 2), ("data-1", "None", "t_4", 1)]
    assert found[2] == [("data-1", "ds_1", "t_5", 2)]
    assert plan(refs).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
