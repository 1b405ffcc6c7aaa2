"""Tables that change as a whole, bucketed tables and sorted files."""

import os
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.plans import runs
from scanledger.plans.main_table import main_cost_table
from scanledger.sinks import snapshots as snapshot_sink, tables, versions
from scanledger.sources import snapshots
from tests.conftest import job

DAYS = "date string, n long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    def build(*pairs):
        return spark.createDataFrame([(f"2024-01-{d:02d}", n) for d, n in pairs], DAYS)

    return build


def live(spark, path):
    return sorted((r.day.day, r.n) for r in versions.read_live(spark, path, T._parse_datatype_string(DAYS)).collect())


def test_a_day_without_rows_goes(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert live(spark, path) == []
    versions.replace_range(rows((1, 1), (2, 2), (3, 3), (4, 4)), path, "2024-01-01", "2024-01-31")
    versions.replace_range(rows((3, 30), (3, 31)), path, "2024-01-02", "2024-01-03")
    assert live(spark, path) == [(1, 1), (3, 30), (3, 31), (4, 4)]
    versions.replace_range(rows(), path, "2024-01-04", "2024-01-04")
    assert live(spark, path) == [(1, 1), (3, 30), (3, 31)]
    assert sorted(versions.live_days(spark, path, 1)) == [f"2024-01-0{d}" for d in (1, 2, 3, 4)]


def test_a_failed_build_leaves_the_old_state(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_range(rows((1, 1), (2, 2)), path, "2024-01-01", "2024-01-31")
    broken = rows((1, 9), (2, 9)).withColumn("n", F.when(F.col("date") == "2024-01-02", F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("n")))
    for bad, message in ((broken, "broken"), (rows((1, 9), (9, 9)), "outside")):
        with pytest.raises(Exception, match=message):
            versions.replace_range(bad, path, "2024-01-01", "2024-01-02")
    assert live(spark, path) == [(1, 1), (2, 2)] and versions.versions(spark, path) == [1]
    before = set(os.listdir(path))
    versions.vacuum(spark, path)  # what the failed builds left
    assert len([n for n in os.listdir(path) if n.startswith("version=")]) == 1 and len(before) > 2
    assert live(spark, path) == [(1, 1), (2, 2)]


def test_a_second_writer_fails_instead_of_undoing(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_range(rows((1, 1)), path, "2024-01-01", "2024-01-31")
    versions._publish(spark, path, 1, versions.live_days(spark, path))
    with pytest.raises(versions.ConcurrentChange):
        versions._publish(spark, path, 1, {})
    assert live(spark, path) == [(1, 1)]


def test_retention_and_vacuum(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_range(rows((1, 1), (2, 2), (3, 3)), path, "2024-01-01", "2024-01-31")
    versions.replace_range(rows((3, 4)), path, "2024-01-03", "2024-01-03")
    versions.drop_before(spark, path, "2024-01-02")
    versions.vacuum(spark, path)
    assert live(spark, path) == [(2, 2), (3, 4)] and len(versions.versions(spark, path)) == 1
    assert len([f for f in os.walk(path) if "day=" in f[0]]) == 2


def test_filters_on_day_prune_live_folders(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_range(rows(*[(d, d) for d in range(1, 20)]), path, "2024-01-01", "2024-01-31")
    some = versions.read_live(spark, path, T._parse_datatype_string(DAYS)).where(F.col("day") >= F.lit(date(2024, 1, 18)))
    assert re.search(r"PartitionFilters: \[isnotnull\(day", plan(some)) and some.count() == 2


@pytest.fixture
def stored(spark, log, params):
    many = [job(f"j{n}", project_id=f"p{n % 3}", user_email=f"u{n % 7}@x.com", creation_time=datetime(2024, 1, 10 + n % 5),
                referenced_tables=[("d", f"s{n % 4}", "t")]) for n in range(60)]
    built = runs.TableSet(spark, "clustered", params, buckets=4)
    built.create_main(log(*many))
    built.create_daily_summary()
    tables.write_clustered(main_cost_table(log(*many[:30]), params), "clustered", "second", tables.MAIN_CLUSTER, 4)
    return built


def test_user_days_are_joined_and_rolled_up_where_they_lie(spark, stored):
    keys = ["day", "project_id", "user_email"]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        since = F.col("day") >= F.lit(date(2024, 1, 12))
        left = stored.main().where(since).select(*keys, "query_count")
        right = spark.table("clustered.second").where(since).select(*keys, F.col("query_count").alias("other"))
        joined = left.join(right, keys)
        text = plan(joined).split("Initial Plan")[0]
        assert "SortMergeJoin" in text and "Exchange hash" not in text and "Exchange range" not in text
        assert text.count("Bucketed: true") == 2 and text.count("PartitionFilters: [isnotnull(day") >= 2
        assert joined.count() > 0
        per_user = stored.main().groupBy("project_id", "user_email").agg(F.sum("query_count").alias("n"))
        assert "Exchange hash" not in plan(per_user) and sum(r.n for r in per_user.collect()) == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_views_of_the_table_set_prune_days(spark, stored):
    view = spark.table("clustered_daily_cost_summary")
    some = view.where(F.col("day") == F.lit(date(2024, 1, 12)))
    assert re.search(r"PartitionFilters: \[isnotnull\(day", plan(some))
    assert {r.date for r in some.collect()} == {"2024-01-12"}


def test_sorted_files_hold_ranges_that_do_not_overlap(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000 % 97).alias("k"), "id")
    tables.write_sorted(rows, path, F.desc("k"), F.col("id"), files=4)
    back = tables.read_sorted(spark, path, rows.schema)
    ranked = [(r["k"], r["id"]) for r in back.orderBy("rank").collect()]
    assert ranked == sorted(((r["k"], r["id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    bounds = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.max(F.struct(-F.col("k"), "id")).alias("hi"), F.min(F.struct(-F.col("k"), "id")).alias("lo"))
    files = [(tuple(r.lo), tuple(r.hi)) for r in bounds.orderBy("f").collect()]
    assert len(files) > 1 and all(a[1] < b[0] for a, b in zip(files, files[1:], strict=False))
    assert tables.read_sorted(spark, path, rows.schema).select(F.max("rank")).first()[0] == 5000


def test_the_newest_snapshot_is_found_by_folder_names(spark, log, params, tmp_path):
    from scanledger.plans.mart import user_day_mart

    path = str(tmp_path / "s")
    mart = user_day_mart(log(job("a"), job("b", project_id="p 2")), params).cache()
    for n in range(9):
        snapshot_sink.write_snapshot(mart if n == 3 else mart.where("project_id = 'p1'"), path, f"2024-01-{n + 10}_05-00-00")
    newest = snapshots.read_latest(spark, path)
    assert {(r.project_id, r.snapshot_ts) for r in newest.collect()} == {("p1", "2024-01-18_05-00-00"), ("p 2", "2024-01-13_05-00-00")}
    assert len(newest.inputFiles()) == 2
    assert snapshots.read_latest(spark, str(tmp_path / "none")).count() == 0
    mart.unpersist()
