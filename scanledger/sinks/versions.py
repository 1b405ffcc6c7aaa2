"""A folder of days that changes as a whole: a manifest names the live version of every day.

``path/version=<v>/day=<d>/`` holds the files of one build of a day, and
``path/_manifest/<n>.json`` maps each live day to its version.  A build writes
its folders first and then one manifest file; readers take the newest manifest,
so a failed or running build is unseen, and a day that lost all its rows is
simply not named any more.  One writer at a time; a second one that began from
the same manifest fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanledger.sinks.tables import laid_out

MANIFESTS = "_manifest"


class ConcurrentChange(RuntimeError):
    """Another writer published a version since this build began."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none when it is absent.  Folders are listed, no data is read."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(at(path)))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published manifests, oldest first."""
    return [int(name[: -len(".json")]) for name in _names(spark, f"{path}/{MANIFESTS}") if name.endswith(".json") and name[:-5].isdigit()]


def live_days(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Day to version folder of the newest (or the given) manifest; empty before the first build.

    One entry per day, whatever the number of rows.
    """
    known = versions(spark, path)
    if not known:
        return {}
    file = f"{path}/{MANIFESTS}/{known[-1] if version is None else version:012d}.json"
    return json.loads(spark.read.option("wholetext", True).text(file).first()[0])


def _publish(spark: SparkSession, path: str, base: int, days: dict[str, str]) -> int:
    fs, at = _fs(spark, path)
    target = at(f"{path}/{MANIFESTS}/{base + 1:012d}.json")
    written = at(f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray(json.dumps(dict(sorted(days.items()))).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(written, target):
        fs.delete(written, False)
        raise ConcurrentChange(f"{path}: version {base + 1} was published meanwhile")
    return base + 1


def replace_range(
    df: DataFrame, path: str, first: str, last: str, cluster_by: Sequence[str] = (), fmt: str = "parquet"
) -> int:
    """Make the days from ``first`` to ``last`` exactly those of ``df``; returns the new version.

    Days of the range that ``df`` has no rows of vanish; days outside are left
    alone, and a row of ``df`` outside fails the build.  ``df`` needs a column
    ``date``.
    """
    inside = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return _replace(df, path, inside, lambda day: first <= day <= last, cluster_by, fmt)


def replace_listed(
    df: DataFrame, path: str, days: Sequence[str], cluster_by: Sequence[str] = (), fmt: str = "parquet"
) -> int:
    """As ``replace_range`` for the listed days, all of them in one version."""
    inside = F.col("day").cast("string").isin(list(days))
    return _replace(df, path, inside, set(days).__contains__, cluster_by, fmt)


def _replace(df: DataFrame, path: str, inside: Column, covers: Callable[[str], bool], cluster_by: Sequence[str], fmt: str) -> int:
    spark = df.sparkSession
    known = versions(spark, path)
    base = known[-1] if known else 0
    build = uuid.uuid4().hex
    told = F.concat(F.lit("a row lies outside the days to replace: "), F.coalesce(F.col("day").cast("string"), F.lit("no day")))
    dated = laid_out(df, cluster_by)
    dated = dated.withColumn("day", F.when(F.coalesce(inside, F.lit(False)), F.col("day")).otherwise(F.raise_error(told).cast("date")))
    dated.write.partitionBy("day").format(fmt).save(f"{path}/version={build}")
    made = [name.split("=", 1)[1] for name in _names(spark, f"{path}/version={build}") if name.startswith("day=")]
    days = {day: version for day, version in live_days(spark, path).items() if not covers(day)}
    return _publish(spark, path, base, days | dict.fromkeys(made, build))


def drop_before(spark: SparkSession, path: str, day: str) -> int:
    """Retention: days before ``day`` are not live any more; no data is read or written."""
    known = versions(spark, path)
    kept = {d: v for d, v in live_days(spark, path).items() if d >= day}
    return _publish(spark, path, known[-1] if known else 0, kept)


def read_live(
    spark: SparkSession, path: str, schema: T.StructType, version: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The live days with their column ``day``; filters on it prune folders.

    An older ``version`` is readable until it is vacuumed.
    """
    dated = T.StructType([f for f in schema.fields if f.name not in ("day", "version")] + [T.StructField("day", T.DateType())])
    days = live_days(spark, path, version)
    if not days:
        return spark.createDataFrame([], dated)
    folders = [f"{path}/version={v}/day={day}" for day, v in sorted(days.items())]
    return spark.read.schema(dated).option("basePath", path).format(fmt).load(folders)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete builds that none of the last ``keep`` versions names; returns them.

    Not while a build runs: its folders are not named yet.
    """
    fs, at = _fs(spark, path)
    known = versions(spark, path)
    named = {v for n in known[-keep:] for v in live_days(spark, path, n).values()}
    for n in known[:-keep]:
        fs.delete(at(f"{path}/{MANIFESTS}/{n:012d}.json"), False)
    builds = [name.split("=", 1)[1] for name in _names(spark, path) if name.startswith("version=")]
    dropped = sorted(set(builds) - named)
    for build in dropped:
        fs.delete(at(f"{path}/version={build}"), True)
    # A build with live and replaced days keeps only the live ones.
    live = {(v, d) for n in known[-keep:] for d, v in live_days(spark, path, n).items()}
    for build in set(builds) & named:
        for name in _names(spark, f"{path}/version={build}"):
            if name.startswith("day=") and (build, name.split("=", 1)[1]) not in live:
                fs.delete(at(f"{path}/version={build}/{name}"), True)
    return dropped
