"""The job log, and tables stored by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.schema import COUNTED_REF, JOBS


def read_job_log(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = JOBS
) -> DataFrame:
    """All jobs below ``path``.

    The schema is given, never inferred, and columns a query does not use are
    not read.  Extra partition columns of the folder (a project, a day) stay
    available for pruning.
    """
    known = spark.read.format(fmt).schema(schema).load(path)
    return normalise(known)


def read_job_table(spark: SparkSession, schema: str, name: str) -> DataFrame:
    return normalise(named_table(spark, schema, name))


def named_table(spark: SparkSession, schema: str, name: str) -> DataFrame:
    """A stored table or view, ``schema.name``."""
    return spark.table(f"`{schema}`.`{name}`")


def of_project(jobs: DataFrame, project_id: str) -> DataFrame:
    """The log of one project; prunes folders when the log is partitioned by it."""
    return jobs.where(F.col("project_id") == project_id)


def normalise(jobs: DataFrame) -> DataFrame:
    """Bring a log to the types the operators expect.

    Times become TIMESTAMP (watermarks refuse the zoneless type), and every
    table reference gets a ``ref_count``, 1 where the log has none.
    """
    for name in ("creation_time", "end_time"):
        if isinstance(jobs.schema[name].dataType, T.TimestampNTZType):
            jobs = jobs.withColumn(name, F.col(name).cast("timestamp"))
    element = jobs.schema["referenced_tables"].dataType.elementType
    if "ref_count" not in element.fieldNames():
        counted = F.transform(
            "referenced_tables",
            lambda r: F.struct(
                r.project_id.alias("project_id"),
                r.dataset_id.alias("dataset_id"),
                r.table_id.alias("table_id"),
                F.lit(1).cast("long").alias("ref_count"),
            ),
        )
        jobs = jobs.withColumn("referenced_tables", counted.cast(T.ArrayType(COUNTED_REF)))
    return jobs
