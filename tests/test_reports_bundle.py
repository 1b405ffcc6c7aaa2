"""Reports from one scan, summaries from one read."""

import pytest
from pyspark.sql import functions as F

from scanledger.plans import reports, summaries
from scanledger.plans.main_table import main_cost_table
from scanledger.plans.mart import user_day_mart
from scanledger.sinks import tables
from scanledger.schema import MAIN_TABLE, MART
from scanledger.sources.star_log import read_star_log
from tests.conftest import SF_DIR


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan")


@pytest.fixture(scope="module")
def stored_mart(spark, tmp_path_factory):
    from scanledger.params import Params

    path = str(tmp_path_factory.mktemp("bundle") / "mart")
    user_day_mart(read_star_log(spark, SF_DIR), Params(as_of="2024-01-31 00:00:00")).write.parquet(path)
    return spark.read.schema(MART).parquet(path)


def test_the_bundle_equals_the_single_reports(stored_mart, params):
    rows = reports.report_rows(stored_mart, params, 14)
    assert scans(rows) == 1
    rows = rows.cache()
    single = reports.reports(stored_mart, params, 14)
    for name, made in reports.bundled(rows).items():
        want = single[name]
        assert made.columns == want.columns, name
        near = lambda r: tuple(round(v, 4) if isinstance(v, float) else v for v in r)
        assert [near(r) for r in made.collect()] == [near(r) for r in want.collect()], name
    rows.unpersist()


def test_an_empty_mart_has_no_report_rows(stored_mart, params):
    rows = reports.report_rows(stored_mart.where("false"), params)
    assert rows.count() == 0
    assert {name: df.count() for name, df in reports.bundled(rows).items() if df.count()} == {}


def test_ranking_and_summaries_read_their_table_once(spark, stored_mart, params, tmp_path):
    assert scans(reports.dataset_ranking(stored_mart)) == 1
    path = str(tmp_path / "main")
    tables.write_folder(main_cost_table(read_star_log(spark, SF_DIR), params), path, tables.MAIN_CLUSTER)
    main = spark.read.schema(MAIN_TABLE).parquet(path)
    for build in (summaries.dataset_summary, summaries.account_summary):
        assert scans(build(main)) == 1
    top = summaries.dataset_summary(main, k=2).where(F.size("top_users") > 2)
    assert top.count() == 0
