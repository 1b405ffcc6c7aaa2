from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scanledger.functions import cost, display, identity, time


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], ddl).select(column).collect()]


@pytest.mark.parametrize(
    ("number", "shown"),
    [
        (None, "0 Bytes"), (0.0, "0 Bytes"), (float("nan"), "0 Bytes"), (1.0, "1 Bytes"), (0.5, "0.5 Bytes"),
        (1023.0, "1023 Bytes"), (1024.0, "1 KB"), (1536.0, "1.5 KB"), (1024.0**2 * 10, "10 MB"),
        (1024.0**3, "1 GB"), (1024.0**4 * 2.25, "2.25 TB"), (1024.0**5, "1 PB"), (1024.0**6, "1024 PB"),
        (100.0, "100 Bytes"),
    ],
)
def test_bytes(spark, number, shown):
    assert values(spark, [number], "v DOUBLE", display.bytes_text(F.col("v"))) == [shown]


def test_currency(spark):
    rows = [None, float("nan"), 0.125, 1234.5, 1e6]
    shown = values(spark, rows, "v DOUBLE", display.currency_text(F.col("v")))
    assert shown == ["$0.00", "$0.00", "$0.13", "$1,234.50", "$1,000,000.00"]


def test_share(spark):
    rows = spark.createDataFrame([(1.0, 8.0), (9.0, 3.0), (1.0, 0.0), (None, 2.0)], "v DOUBLE, t DOUBLE")
    shown = [r[0] for r in rows.select(display.share_text(F.col("v"), F.col("t"))).collect()]
    assert shown == ["12.5%", "100.0%", "0.0%", "0.0%"]


def test_dates(spark):
    moment = datetime(2024, 3, 5, 13, 4, 9)
    for style, shown in (("short", "3/5/2024"), ("medium", "3/5/2024 01:04 PM"), ("long", "3/5/2024 1:04:09 PM"), ("x", "3/5/2024")):
        assert values(spark, [moment, None], "v TIMESTAMP", display.date_display(F.col("v"), style)) == [shown, ""]


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(
        cost.billed_bytes(F.lit(1)).alias("granule"),
        cost.billed_bytes(F.lit(0)).alias("nothing"),
        cost.weekend_factor(F.to_date(F.lit("2024-01-06"))).alias("saturday"),
        cost.weekend_factor(F.to_date(F.lit("2024-01-08"))).alias("monday"),
        cost.what_if_cost(F.lit(2.5), 5).alias("price"),
        cost.what_if_cost(F.lit(None), 5).alias("unknown"),
        time.weekday_label(F.lit(1)).alias("first"),
        display.rebuild_severity(F.lit(80.0)).alias("at80"),
        display.rebuild_severity(F.lit(80.1)).alias("over80"),
        display.rebuild_severity(F.lit(50.0)).alias("at50"),
        identity.short_spender(F.lit("service-a-service-b@x"), F.lit(True)).alias("short"),
    ).first()
    assert tuple(row) == (1048576, 0, 0.3, 1.0, 12.5, None, "Sunday", "warning", "danger", "", "SA:a-service-b")
