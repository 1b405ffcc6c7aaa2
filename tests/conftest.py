from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scanledger.params import Params  # noqa: E402
from scanledger.plans import runs  # noqa: E402
from scanledger.schema import JOBS  # noqa: E402
from scanledger.session import build_session  # noqa: E402
from scanledger.sources.job_log import normalise  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(work / "shared"),
            "spark.sql.warehouse.dir": str(work / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params():
    return Params(as_of="2024-01-31 00:00:00")


def job(job_id, **values):
    """One log row; a plain successful query unless told otherwise."""
    row = {
        "project_id": "p1",
        "user_email": "ann@example.com",
        "job_id": job_id,
        "creation_time": datetime(2024, 1, 15, 10, 0, 0),
        "end_time": datetime(2024, 1, 15, 10, 0, 5),
        "query": "SELECT 1",
        "statement_type": "SELECT",
        "job_type": "QUERY",
        "total_bytes_processed": 2 * 1024**4,
        "total_bytes_billed": 1024**4,
        "total_slot_ms": 3_600_000,
        "error_result": None,
        "cache_hit": False,
        "destination_table": None,
        "referenced_tables": None,
        "labels": [],
        "priority": "BATCH",
    }
    row.update(values)
    return tuple(row[name] for name in JOBS.fieldNames())


@pytest.fixture
def log(spark):
    def build(*rows):
        return normalise(spark.createDataFrame(list(rows), JOBS))

    return build


@pytest.fixture
def stored_plans(monkeypatch):
    """The final plans of the marts that runs store."""
    plans, write = [], runs.write_snapshot

    def noted(mart, *args):
        mart.collect()
        plans.append(mart._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(mart, *args)

    monkeypatch.setattr(runs, "write_snapshot", noted)
    return plans
