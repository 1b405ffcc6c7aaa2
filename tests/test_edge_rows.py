"""Hand-made log rows at the edges of the rules."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scanledger.operators import allocation, jobs as job_ops
from scanledger.operators.tags import with_tags
from scanledger.params import Params
from scanledger.plans import reports, summaries
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from tests.conftest import job

A = ("data", "sales", "orders")
B = ("data", "sales", "items")
C = ("data", "web", "hits")


def by(rows, key):
    return {row[key]: row for row in rows}


def test_filters(log, params):
    cutoff = datetime(2024, 1, 1)
    kept = job_ops.billable(
        log(
            job("at_cutoff", creation_time=cutoff),
            job("before", creation_time=cutoff - timedelta(microseconds=1)),
            job("script", statement_type="SCRIPT"),
            job("no_type", statement_type=None),
            job("load", job_type="LOAD"),
        ),
        params,
    )
    assert [r.job_id for r in kept.collect()] == ["at_cutoff"]


def test_small_jobs_are_left_out_of_the_main_table_only(log, params):
    rows = log(
        job("none", total_bytes_processed=0),
        job("limit", total_bytes_processed=1_000_000),
        job("above", total_bytes_processed=1_000_001),
        job("unknown", total_bytes_processed=None),
    )
    assert main_cost_table(rows, params).first().query_count == 1
    assert user_day_mart(rows, params).first().query_count == 4


def test_references(log, params):
    stats = job_ops.job_stats(
        log(
            job("null", referenced_tables=None),
            job("empty", referenced_tables=[]),
            job("gaps", referenced_tables=[A, ("data", None, "x"), ("data", "web", None), (None, "s", "t")]),
            job("twice", referenced_tables=[A, A, B]),
        ),
        params,
    )
    rows = by(stats.collect(), "job_id")
    assert rows["null"].referenced_datasets == [] and rows["null"].referenced_tables_detail == []
    assert rows["empty"].referenced_datasets == []
    assert rows["gaps"].referenced_datasets == ["data.sales", "data.web"]
    assert [r.table_id for r in rows["gaps"].referenced_tables_detail] == ["orders"]
    assert len(rows["twice"].referenced_tables_detail) == 3


def test_repeated_reference_takes_two_shares(log, params):
    stats = job_ops.job_stats(log(job("j", referenced_tables=[A, A, B], total_bytes_billed=3 * 1024**4)), params)
    rows = by(allocation.table_costs(stats, params).collect(), "table_id")
    assert (rows["orders"].query_count, rows["orders"].table_cost_usd) == (2, 10.0)
    assert (rows["items"].query_count, rows["items"].table_cost_usd) == (1, 5.0)


def test_rebuild_ignores_project_and_needs_both_names(log, params):
    def rebuilt(destination):
        stats = job_ops.job_stats(log(job("j", referenced_tables=[A, C], destination_table=destination)), params)
        flag = stats.first().is_table_rebuild
        tables = allocation.table_costs(stats, params).where("is_rebuild_operation").collect()
        return flag, [t.table_id for t in tables]

    assert rebuilt(("other", "sales", "orders")) == (True, ["orders"])
    assert rebuilt(("data", "sales", "hits")) == (False, [])
    assert rebuilt(("data", None, "orders")) == (False, [])
    assert rebuilt(("data", "sales", None)) == (False, [])
    assert rebuilt(None) == (False, [])


def test_accounts(log, params):
    emails = {
        "a@x.iam.gserviceaccount.com": True,
        "service-desk@company.com": True,
        "ann@example.com": False,
        "": False,
        None: False,
    }
    rows = log(*[job(f"j{i}", user_email=e) for i, e in enumerate(emails)])
    found = {r.user_email: r.service_account for r in job_ops.job_stats(rows, params).collect()}
    assert found == {email: email if account else None for email, account in emails.items()}
    spenders = {r.spender for r in reports.top_spenders(user_day_mart(rows, params)).collect()}
    assert spenders == {"a@x.iam.gserviceaccount.com", "service-desk@company.com", "ann@example.com", "Unknown"}


def test_user_day_without_email_has_no_detail(log, params):
    rows = log(job("j", user_email=None, referenced_tables=[A]))
    mart = user_day_mart(rows, params).first()
    assert mart.query_count == 1
    for detail in ("hourly_breakdown", "daily_breakdown", "dataset_costs", "table_costs", "recent_queries"):
        assert mart[detail] is None
    assert main_cost_table(rows, params).first().dataset_costs == []


def test_unknown_cache_flag_is_a_miss(log, params):
    rows = log(job("a", cache_hit=None), job("b", cache_hit=True), job("c", cache_hit=False))
    mart = user_day_mart(rows, params).first()
    assert (mart.cache_hit_count, mart.cache_hit_percentage) == (1, 33.33)


def test_elapsed_seconds_are_whole(log, params):
    start = datetime(2024, 1, 15, 10, 0, 0, 900_000)
    rows = log(job("j", creation_time=start, end_time=start + timedelta(milliseconds=1_300)))
    assert job_ops.job_stats(rows, params).first().execution_time_seconds == 1


def test_recent_queries_ties_caps_and_text(log):
    params = Params(as_of="2024-01-31 00:00:00", query_limit=2, table_limit=1)
    moment = datetime(2024, 1, 15, 12)
    rows = log(
        job("b", creation_time=moment, query="x" * 1500, error_result=("bad", None)),
        job("a", creation_time=moment, query=None),
        job("c", creation_time=moment - timedelta(hours=1), referenced_tables=[A, B], total_bytes_billed=4 * 1024**4),
        job("d", creation_time=moment - timedelta(hours=2), referenced_tables=[B], total_bytes_billed=1024**4),
    )
    mart = user_day_mart(rows, params).first()
    assert [(q.job_id, q.has_error) for q in mart.recent_queries] == [("a", False), ("b", True)]
    assert mart.recent_queries[0].query_text is None and len(mart.recent_queries[1].query_text) == 1000
    assert [(t.table_id, t.table_cost_usd) for t in mart.table_costs] == [("items", 15.0)]
    assert [(d.dataset, d.dataset_cost_usd) for d in mart.dataset_costs] == [("data.sales", 25.0)]
    assert [h.hour_of_day for h in mart.hourly_breakdown] == [10, 11, 12]


def test_both_splits_disagree_as_meant(log, params):
    rows = log(job("j", referenced_tables=[A, B, C], total_bytes_billed=6 * 1024**4))
    stats = job_ops.job_stats(rows, params)
    by_table = by(allocation.dataset_costs_from_tables(allocation.table_costs(stats, params)).collect(), "dataset")
    direct = by(allocation.dataset_costs_direct(stats, params).collect(), "dataset")
    assert (by_table["data.sales"].dataset_cost_usd, by_table["data.web"].dataset_cost_usd) == (20.0, 10.0)
    assert (direct["data.sales"].dataset_cost_usd, direct["data.web"].dataset_cost_usd) == (15.0, 15.0)


def test_shares_of_a_free_day_are_null(log, params):
    rows = log(job("j", referenced_tables=[A], total_bytes_billed=0))
    share = summaries.user_dataset_attribution(main_cost_table(rows, params)).first()
    assert share.cost_usd == 0 and share.pct_of_user_cost is None and share.pct_of_dataset_cost is None


def test_shares_cross_projects(log, params):
    rows = log(
        job("a", project_id="p1", referenced_tables=[A]),
        job("b", project_id="p2", referenced_tables=[A], total_bytes_billed=3 * 1024**4),
        job("c", project_id="p2", user_email=None, referenced_tables=[A]),
    )
    shares = by(summaries.user_dataset_attribution(main_cost_table(rows, params)).collect(), "project_id")
    assert (shares["p1"].pct_of_user_cost, shares["p1"].pct_of_dataset_cost) == (25.0, 25.0)
    assert set(shares) == {"p1", "p2"}


def test_equal_rows_of_one_account_fold_before_bytes_are_added(spark):
    from scanledger.schema import MAIN_TABLE

    def day(email):
        entry = [("data.sales", 10.0, 10.0, 2.0)]
        return ("2024-01-15", "p1", email, "robot", 1, 0, 0, 10, 10, 2.0, 0.0, 0.0, entry)

    main = spark.createDataFrame([day("x"), day("y")], MAIN_TABLE)
    row = summaries.user_dataset_attribution(main).first()
    assert (row.query_count, row.bytes_processed, row.cost_usd) == (2, 10.0, 2.0)


def test_ties_in_percentages_go_up(log, params):
    hits = [job(f"h{i}", cache_hit=i < 5) for i in range(32)]
    assert user_day_mart(log(*hits), params).first().cache_hit_percentage == 15.63


def test_tags_and_dataset_in_text(log, params):
    text = "-- Query for project: p\n-- Team: core\n-- Purpose: daily load\nselect * from `data.sales`"
    row = with_tags(job_ops.job_stats(log(job("j", query=text)), params)).first()
    assert (row.tag_project, row.tag_team, row.tag_purpose, row.tag_owner) == ("p", "core", "daily load", None)
    from scanledger.functions.text import dataset_in_text, tagged

    texts = log(job("a", query="select 1 from a-b.c_d where from x.y"), job("b", query="select 1"), job("c", query=None))
    found = by(texts.select("job_id", dataset_in_text(F.col("query")).alias("d")).collect(), "job_id")
    assert [found[k].d for k in "abc"] == ["a-b.c_d", "Unknown", "Unknown"]
    built = texts.where("job_id = 'b'").select(tagged(F.col("query"), team=F.lit("core"), owner=F.lit(None).cast("string")).alias("t"))
    assert built.first().t == "-- Team: core\nselect 1"


def test_history_falls_back_row_by_row(spark, params):
    from scanledger.schema import MART

    def day(date, queries, datasets):
        return (date, "p1", "ann@example.com", None, 7, 2, 1, 100, 100, 3.0, 0.0, 0.0, None, None, datasets, None, queries)

    query = ("j", "2024-01-15 08:00:00", "SELECT", "BATCH", 5, 1.0, 1, True, False, "select 1 from d.s")
    stored = spark.createDataFrame(
        [
            day("2024-01-15", [query], [("d.other", 1.0, 1.0, 1.0, 0)]),
            day("2024-01-16", [], [("d.other", 1.0, 1.0, 1.0, 0)]),
            day("2024-01-17", None, [("", 4.0, 1.0, 2.0, 0)]),
            day("2024-01-18", None, None),
        ],
        MART,
    )
    rows = by(reports.query_history(stored).collect(), "dataset")
    assert set(rows) == {"d.s", "Unknown"}
    assert (rows["d.s"].query_count, rows["d.s"].cache_hit_count, rows["d.s"].total_cost) == (1, 1, 1.0)
    unknown = rows["Unknown"]
    assert (unknown.query_count, unknown.total_bytes_processed, unknown.total_cost) == (7, 104.0, 5.0)
    assert str(unknown.last_queried) == "2024-01-18 00:00:00"


def test_period_cutoff_keeps_its_time_of_day(spark):
    from scanledger.schema import MART, conform

    days = spark.createDataFrame([("2024-01-17",), ("2024-01-18",)], "date STRING")
    noon = Params(as_of="2024-01-31 12:00:00")
    kept = reports.in_period(conform(days, MART), noon, 14).collect()
    assert [r.date for r in kept] == ["2024-01-18"]
