"""Checks on project settings, as rows of failed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAILURE = "array<struct<rule:string,message:string>>"


def _failures(rules: list[tuple[Column, str, Column]]) -> Column:
    listed = F.array(
        *[
            F.when(broken, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
            for broken, rule, message in rules
        ]
    )
    return F.explode(F.array_compact(listed).cast(_FAILURE)).alias("failure")


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def project_checks(project_rows: DataFrame, index: str = "index", *keys: str) -> DataFrame:
    """``(*keys, index, rule, message)`` for every project lacking an id or a name."""
    place = F.concat(F.lit("project "), F.col(index).cast("string"))
    rules = [
        (_missing(name), f"{name}_required", F.concat(place, F.lit(f" has no {name}")))
        for name in ("id", "name")
    ]
    found = project_rows.select(*keys, F.col(index).cast("long").alias("index"), _failures(rules))
    return found.select(*keys, "index", "failure.*")


def settings_checks(settings_rows: DataFrame, index: str = "index", *keys: str) -> DataFrame:
    """``(*keys, index, rule, message)`` for every given setting that is not positive."""
    rules = [
        (
            F.coalesce(F.col(name) <= 0, F.lit(False)),
            f"{name}_positive",
            F.lit(f"{name} must be above zero"),
        )
        for name in ("historyDays", "costPerTerabyte", "refreshInterval")
    ]
    found = settings_rows.select(*keys, F.col(index).cast("long").alias("index"), _failures(rules))
    return found.select(*keys, "index", "failure.*")


def config_checks(config: DataFrame, *keys: str) -> DataFrame:
    """All checks of configurations as read by ``sources.projects.read_config``.

    ``keys`` name columns that tell several configurations apart.  Each is one
    row, checked where it is: nothing is shuffled.
    """
    whole = config.select(
        *keys,
        F.lit(None).cast("long").alias("index"),
        _failures(
            [
                (F.col("projects").isNull(), "projects_required", F.lit("no list of projects")),
                (F.col("settings").isNull(), "settings_required", F.lit("no settings")),
            ]
        ),
    ).select(*keys, "index", "failure.*")
    listed = config.select(*keys, F.posexplode("projects").alias("index", "p")).select(*keys, "index", "p.*")
    given = config.select(*keys, F.lit(None).cast("long").alias("index"), "settings.*")
    return whole.unionByName(project_checks(listed, "index", *keys)).unionByName(
        settings_checks(given, "index", *keys)
    )
