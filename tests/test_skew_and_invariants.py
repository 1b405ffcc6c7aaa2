"""One account owning most jobs, checked against a plain Python sum."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scanledger.operators import allocation, jobs as job_ops, rollups
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from scanledger.plans.summaries import user_dataset_attribution
from tests.conftest import job

TABLES = [("data", f"set{i % 4}", f"table{i}") for i in range(150)]


@pytest.fixture(scope="module")
def rows():
    made = []
    for n in range(1200):
        hot = n % 2 == 0
        made.append(
            job(
                f"job{n:05d}",
                user_email="service-hot@example.com" if hot else f"user{n % 7}@example.com",
                creation_time=datetime(2024, 1, 10 + (0 if hot else n % 3)) + timedelta(seconds=n * 37 % 86_000),
                total_bytes_processed=n * 7_777_777_777,
                total_bytes_billed=n * 5_555_555_555,
                referenced_tables=[TABLES[(n // 2 * k) % 150] for k in range(1, 2 + n % 7)],
            )
        )
    return made


def plain_split(rows, part):
    total = defaultdict(float)
    for row in rows:
        refs = row[14]
        for ref in refs:
            total[(row[3].strftime("%Y-%m-%d"), row[1], *part(ref))] += row[9] / len(refs)
    return total


def test_table_split_matches_plain_sums(log, rows, params):
    stats = job_ops.job_stats(log(*rows), params)
    found = {
        (r.date, r.user_email, r.table_dataset, r.table_id): r.bytes_billed
        for r in job_ops.present(allocation.table_costs(stats, params)).collect()
    }
    expected = plain_split(rows, lambda ref: ref[1:])
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], rel=1e-12) for k in found)


def test_split_bytes_add_up_to_job_bytes(log, rows, params):
    stats = job_ops.job_stats(log(*rows), params)
    whole = sum(row[9] for row in rows)
    for split in (allocation.table_costs(stats, params), allocation.dataset_costs_direct(stats, params)):
        assert split.agg(F.sum("bytes_billed")).first()[0] == pytest.approx(whole, rel=1e-12)


def test_split_does_not_depend_on_partitions(log, rows, params):
    def costs(parts):
        stats = job_ops.job_stats(log(*rows).repartition(parts), params)
        kept = allocation.table_costs(stats, params).select("day", "user_email", "table_id", "bytes_billed")
        return sorted(tuple(r) for r in kept.collect())

    assert costs(1) == costs(13)


def test_hot_account_keeps_its_newest_hundred(log, rows, params):
    mart = user_day_mart(log(*rows), params).where("service_account IS NOT NULL").first()
    mine = sorted((r for r in rows if r[1].startswith("service-")), key=lambda r: (-r[3].timestamp(), r[2]))
    assert [q.job_id for q in mart.recent_queries] == [r[2] for r in mine[:100]]
    costs = [t.table_cost_usd for t in mart.table_costs]
    assert len(costs) == 100 and costs == sorted(costs, reverse=True)
    assert mart.query_count == len(mine)


def test_mart_parts_agree(log, rows, params):
    frame = log(*rows)
    stats = job_ops.job_stats(frame, params)
    marts = user_day_mart(frame, params).collect()
    alone = {(r.date, r.user_email): r for r in job_ops.present(rollups.user_days(stats, params)).collect()}
    assert len(marts) == len(alone)
    for row in marts:
        same = alone[row.date, row.user_email]
        assert all(row[name] == same[name] for name in same.__fields__)
        assert sum(h.hourly_queries for h in row.hourly_breakdown) == row.query_count
        assert [w.daily_queries for w in row.daily_breakdown] == [row.query_count]
        costs = [d.dataset_cost_usd for d in row.dataset_costs]
        assert costs == sorted(costs, reverse=True)


def test_main_table_equals_its_two_parts(log, rows, params):
    from scanledger.plans.main_table import main_stats, main_user_days

    frame = log(*rows)
    main = {(r.date, r.user_email): r for r in main_cost_table(frame, params).collect()}
    for row in main_user_days(frame, params).collect():
        assert all(main[row.date, row.user_email][name] == row[name] for name in row.__fields__)
    shares = defaultdict(dict)
    direct = allocation.dataset_costs_direct(main_stats(frame, params), params)
    for row in job_ops.present(direct).collect():
        shares[row.date, row.user_email][row.dataset] = row.dataset_cost_usd
    assert {k: {d.dataset: d.dataset_cost_usd for d in r.dataset_costs} for k, r in main.items()} == shares


def test_user_shares_add_up(log, rows, params):
    shares = user_dataset_attribution(main_cost_table(log(*rows), params))
    sums = shares.groupBy("date", "user").agg(F.sum("pct_of_user_cost").alias("pct"), F.count("*").alias("n"))
    for row in sums.where("pct IS NOT NULL").collect():
        assert row.pct == pytest.approx(100, abs=0.01 * row.n)
