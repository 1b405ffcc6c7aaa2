"""The report bundle, and paths the registered queries do not take."""

from datetime import datetime

from scanledger.operators.jobs import job_stats
from scanledger.plans import reports, summaries
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from scanledger.sinks import tables
from scanledger.sources.job_log import named_table, read_job_table
from tests.conftest import job

A = ("data", "sales", "orders")


def test_bundle_applies_the_period_to_the_overview_only(log, params):
    mart = user_day_mart(
        log(
            job("old", creation_time=datetime(2024, 1, 3, 9), referenced_tables=[A]),
            job("new", creation_time=datetime(2024, 1, 29, 10), referenced_tables=[A], query="select 1 from data.sales"),
        ),
        params,
    )
    bundle = reports.reports(mart, params, 7)
    assert bundle["summary_metrics"].first().total_queries == 1
    assert [r.date for r in bundle["cost_trend"].collect()] == ["2024-01-29"]
    assert bundle["top_spenders"].first().user_cost == 5.0
    assert tuple(bundle["cache_split"].first()) == (0.0, 100.0)
    assert [r.dataset for r in bundle["query_history"].collect()] == ["data.sales"]
    assert bundle["dataset_ranking"].first().pct_of_total == 100.0
    assert bundle["table_rebuild_report"].first().total_cost == 10.0
    assert bundle["user_dataset_report"].first().cost_usd == 10.0
    assert [r.label for r in bundle["hourly_pattern"].collect()] == ["9:00", "10:00"]
    assert {r.label for r in bundle["weekday_pattern"].collect()} == {"Wednesday", "Monday"}


def test_empty_mart_gives_zeros(log, params):
    mart = user_day_mart(log(job("j", job_type="LOAD")), params)
    assert tuple(reports.summary_metrics(mart).first()) == (0.0, 0.0, 0)
    assert tuple(reports.cache_split(mart).first()) == (0.0, 100.0)
    assert reports.dataset_ranking(mart).count() == 0


def test_users_by_sketch_and_order(log, params):
    main = main_cost_table(
        log(
            job("a", referenced_tables=[A]),
            job("b", user_email="bob@example.com", referenced_tables=[A]),
            job("c", creation_time=datetime(2024, 1, 20), referenced_tables=[A]),
        ),
        params,
    )
    exact = summaries.dataset_summary(main)
    sketch = summaries.dataset_summary(main, exact=False)
    shown = tables.ordered(exact, "total_cost_usd").collect()
    assert [(r.date, r.unique_users) for r in shown] == [("2024-01-20", 1), ("2024-01-15", 2)]
    assert {(r.date, r.unique_users) for r in sketch.collect()} == {("2024-01-20", 1), ("2024-01-15", 2)}
    assert [u.user for u in shown[1].top_users] == ["ann@example.com", "bob@example.com"]


def test_log_kept_as_a_table(spark, log, params):
    spark.sql("CREATE DATABASE IF NOT EXISTS logs")
    log(job("a", referenced_tables=[A])).write.mode("overwrite").saveAsTable("logs.jobs")
    assert named_table(spark, "logs", "jobs").count() == 1
    assert user_day_mart(read_job_table(spark, "logs", "jobs"), params).first().table_costs[0].table_id == "orders"


def test_totals_know_no_cap(log, params):
    """150 tables and queries of one user-day, the dataset behind the first 1,000 characters."""
    many = [
        job(
            f"j{i:03d}",
            query="x " * 700 + "FROM `d.s.t`",
            referenced_tables=[{"project_id": "d", "dataset_id": "s", "table_id": f"t{i}"}],
        )
        for i in range(150)
    ]
    stats = job_stats(log(*many), params)
    totals = reports.table_cost_totals_of_jobs(stats, params).collect()
    assert len(totals) == 150 and sum(t.total_cost for t in totals) == 750.0
    history = reports.query_history_of_jobs(stats, params, 30).collect()
    assert [(r.dataset, r.query_count) for r in history] == [("d.s", 150)]
