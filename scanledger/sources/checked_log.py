"""A job log whose unreadable rows and files become rows of their own.

One scan of the raw log sorts good rows from broken ones, so a run over many
projects is one job and names the projects whose input is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.params import Params
from scanledger.schema import JOBS
from scanledger.session import work_path
from scanledger.sources.job_log import normalise

PROBLEM = "problem"
PROBLEM_TYPE = T.StructType([T.StructField("file", T.StringType()), T.StructField("message", T.StringType())])
_BROKEN = T.StructType([T.StructField("project_id", T.StringType()), *PROBLEM_TYPE.fields])

_RAW = "_broken_row"
_RAW_SHOWN = 80


def _problem(broken: Column, message: Column) -> Column:
    return F.when(broken, F.struct(F.col("_file").alias("file"), message.alias("message")).cast(PROBLEM_TYPE))


def decoded(text: Column) -> Column:
    """Percent signs decoded; a plus sign is a plus sign."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """The path of a row's file as the file system names it."""
    return decoded(F.col("_metadata.file_path"))


def _project_of_file(file: Column) -> Column:
    """The project of a folder ``project_id=...`` above the file, else NULL."""
    return F.nullif(decoded(F.regexp_extract(file, "/project_id=([^/]+)/", 1)), F.lit(""))


def typed(df: DataFrame, schema: T.StructType = JOBS) -> DataFrame:
    """The columns of ``schema``, cast where they came as another type, and ``problem``.

    A value that does not fit its type makes the row a problem instead of
    failing the job.  Columns the log lacks are NULL.  Needs ``_file``.
    """
    kept, problems = [], []
    for field in schema.fields:
        if field.name not in df.columns:
            kept.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType in (field.dataType, T.TimestampNTZType()) or isinstance(
            field.dataType, (T.StructType, T.ArrayType)
        ):
            kept.append(F.col(field.name))
        else:
            value = F.col(field.name).try_cast(field.dataType)
            kept.append(value.alias(field.name))
            shown = F.left(F.col(field.name).cast("string"), F.lit(_RAW_SHOWN))
            problems.append(
                _problem(
                    F.col(field.name).isNotNull() & value.isNull(),
                    F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), shown),
                )
            )
    if PROBLEM in df.columns:
        problems.insert(0, F.col(PROBLEM))
    none = F.lit(None).cast(PROBLEM_TYPE)
    return df.select(*kept, F.coalesce(*problems, none).alias(PROBLEM))


def read_checked_log(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = JOBS) -> DataFrame:
    """All jobs below ``path`` with ``problem`` (file, message), NULL for good rows.

    Of line formats (JSON) a row that cannot be read, or holds a value of the
    wrong type, keeps its place as a problem.  The project is that of the folder
    ``project_id=...``, where the log has such folders, else the row's own, which
    a broken row may lack.  Files that cannot be read at all give one problem row
    each; of columnar formats they are found by reading no more than file ends.
    """
    if fmt == "json":
        raw = T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])
        rows = spark.read.schema(raw).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW).json(path)
        rows = rows.withColumn("_file", file_path())
        shown = F.concat(F.lit("row cannot be read: "), F.left(F.col(_RAW), F.lit(_RAW_SHOWN)))
        rows = rows.withColumn(PROBLEM, _problem(F.col(_RAW).isNotNull(), shown))
        # The reader gives what it could parse of a broken row; only its project is of use.
        return normalise(typed(rows, schema))
    rows = spark.read.format(fmt).schema(schema).option("ignoreCorruptFiles", True).load(path)
    rows = rows.withColumn("_file", file_path())
    lost = unreadable_files(spark, path, fmt).withColumn(PROBLEM, F.struct("file", "message").cast(PROBLEM_TYPE))
    lost = lost.withColumn("_file", F.col("file"))
    return normalise(typed(rows, schema)).unionByName(normalise(typed(lost.select("project_id", PROBLEM, "_file"), schema)))


def unreadable_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(project_id, file, message): files of a columnar log that yield no row at all.

    Files are listed by name and length; which of them hold rows is known from
    their ends alone, as no column is asked for.  An empty table file counts as
    readable only when it holds no bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = listed.where(F.col("length") > 0).select(F.col("path").alias("listed"))
    # Both sides name files, but write the scheme of local ones differently.
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = spark.read.format(fmt).schema(T.StructType()).option("ignoreCorruptFiles", True).load(path)
    seen = rows.select(file_path().alias("file")).distinct()
    missing = listed.join(seen, bare(F.col("listed")) == bare(F.col("file")), "left_anti")
    return missing.select(
        _project_of_file(F.col("listed")).alias("project_id"),
        F.col("listed").alias("file"),
        F.lit("file cannot be read").alias("message"),
    )


def stage(checked: DataFrame, params: Params, day_partition: str | None = None) -> DataFrame:
    """Good rows of the history window and all broken ones, written once in columns and read back.

    The raw log is scanned here and nowhere else: whatever reads the result
    several times reads the columns it needs of the stored copy, and the few
    broken rows lie in a folder of their own.  The copy lives for a run, and values
    are written as they are: dictionaries would cost more than they save.
    """
    spark = checked.sparkSession
    wanted = F.col(PROBLEM).isNotNull() | (F.col("creation_time") >= params.history_start())
    if day_partition:
        wanted = wanted & (F.col(day_partition) >= F.to_date(params.history_start()))
    rows = checked.where(wanted).withColumn("is_broken", F.col(PROBLEM).isNotNull())
    path = work_path(spark, "checked-log")
    rows.write.option("parquet.enable.dictionary", "false").partitionBy("is_broken").parquet(path)
    schema = T.StructType([*checked.schema.fields, T.StructField("is_broken", T.BooleanType())])
    return spark.read.schema(schema).parquet(path)


def good_rows(staged: DataFrame) -> DataFrame:
    return staged.where(~F.col("is_broken")).drop("is_broken", PROBLEM)


def broken_projects(staged: DataFrame) -> DataFrame:
    """(id, broken_rows, error): one row per project with broken input; the first problem is told.

    Broken rows whose project is unknown are one row without id.
    """
    rows = staged.where("is_broken").select(F.coalesce("project_id", _project_of_file(F.col("problem.file"))).alias("id"), PROBLEM)
    first = F.min(F.struct("problem.file", "problem.message"))
    return rows.groupBy("id").agg(F.count("*").alias("broken_rows"), first.alias("first")).select(
        "id",
        "broken_rows",
        F.concat(F.col("broken_rows").cast("string"), F.lit(" broken, first in "), "first.file", F.lit(": "), "first.message").alias("error"),
    )
