"""Expected cost of a query before it runs, from table sizes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanledger.functions.cost import TIB, terabytes, what_if_cost
from scanledger.params import DEFAULT_PRICE_PER_TB


def read_table_sizes(spark: SparkSession, name: str = "tables_meta") -> DataFrame:
    """Table sizes ``(table_id, total_bytes_processed)`` from a stored table."""
    return spark.table(name).select("table_id", "total_bytes_processed")


def catalog_sizes(spark: SparkSession, schema: str, analyze: bool = True) -> DataFrame:
    """``(table_id, total_bytes_processed, row_count)`` of every table of a schema, from the catalogue.

    With ``analyze`` the statistics are brought up to date first, one pass over
    file ends per table; without, tables never analysed have none and are left
    out.  One row per table reaches the driver.
    """
    found = []
    for row in spark.sql(f"SHOW TABLES IN `{schema}`").where("NOT isTemporary").collect():
        full = f"`{schema}`.`{row['tableName']}`"
        if analyze:
            spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS")
        told = spark.sql(f"DESCRIBE TABLE EXTENDED {full}").where("col_name = 'Statistics'").first()
        numbers = [int(n) for n in re.findall(r"(\d+) (?:bytes|rows)", told["data_type"])] if told else []
        if numbers:
            found.append((row["tableName"], numbers[0], numbers[1] if len(numbers) > 1 else None))
    return spark.createDataFrame(found, "table_id string, total_bytes_processed long, row_count long")


def scan_cost(
    sizes: DataFrame, table_id: str | None = None, price_per_tb: float = DEFAULT_PRICE_PER_TB
) -> DataFrame:
    """Terabytes and cost of reading one table (or each table) in full."""
    if table_id is not None:
        sizes = sizes.where(F.col("table_id") == table_id)
    tb = F.col("total_bytes_processed") / F.lit(TIB)
    return sizes.select(
        "table_id",
        "total_bytes_processed",
        tb.alias("terabytes_processed"),
        (tb * F.lit(float(price_per_tb))).alias("estimated_cost_usd"),
    )


def what_if(sizes: DataFrame, price_per_tb: float = DEFAULT_PRICE_PER_TB) -> DataFrame:
    """Cost at two digits for the terabytes a query is expected to read."""
    tb = terabytes(F.col("total_bytes_processed"))
    return sizes.select(
        "table_id",
        tb.alias("estimated_tb"),
        what_if_cost(tb, price_per_tb).alias("estimated_cost_usd"),
    )
