"""Project settings: which projects to watch and at what price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scanledger.params import (
    DEFAULT_HISTORY_DAYS,
    DEFAULT_PRICE_PER_TB,
    DEFAULT_REFRESH_HOURS,
    Params,
)
from scanledger.schema import CONFIG
from scanledger.session import kept


_DEFAULTS = {
    "historyDays": float(DEFAULT_HISTORY_DAYS),
    "costPerTerabyte": DEFAULT_PRICE_PER_TB,
    "refreshInterval": float(DEFAULT_REFRESH_HOURS),
}


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(projects, settings)``; empty when the file is absent or broken."""
    try:
        return spark.read.schema(CONFIG).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], CONFIG)


def projects(config: DataFrame) -> DataFrame:
    """One row per configured project."""
    return config.select(F.explode("projects").alias("project")).select("project.*")


def settings(config: DataFrame) -> DataFrame:
    """Exactly one row of settings; what is missing or not above zero is the default."""
    return config.agg(
        *[
            F.coalesce(
                F.first(F.when(F.col(f"settings.{name}") > 0, F.col(f"settings.{name}")), ignorenulls=True), F.lit(default)
            ).alias(name)
            for name, default in _DEFAULTS.items()
        ]
    )


def load_params(spark: SparkSession, path: str, **arguments) -> Params:
    """Parameters of a run: argument, else config file, else default."""
    row = settings(read_config(spark, path)).first()
    configured = Params().with_settings(
        history_days=max(1, int(row["historyDays"])), price_per_tb=row["costPerTerabyte"]
    )
    return configured.with_settings(**arguments)


def project_list(project_rows: DataFrame) -> DataFrame:
    return project_rows.select("id", "name")


def enabled(project_rows: DataFrame) -> DataFrame:
    return project_rows.where(~F.coalesce("disabled", F.lit(False)))


def of_enabled_projects(jobs: DataFrame, project_rows: DataFrame) -> DataFrame:
    """Jobs of enabled projects.

    No broadcast is forced: the optimiser sends the project rows to every task
    only when their size is known to allow it.
    """
    ids = enabled(project_rows).select(F.col("id").alias("project_id"))
    return jobs.join(ids, "project_id", "left_semi")


def spread_over_projects(jobs: DataFrame, project_rows: DataFrame) -> DataFrame:
    """Jobs of enabled projects, not gathered by project, for plans that group them by more than that.

    A long list of projects is merged with the jobs: all jobs of a project meet in
    one task, and groupings by the project and more stay there.  So the projects
    that have jobs are found first, from one column of the log, and stored: their
    size is known then, and the optimiser sends them to every task if it allows.
    """
    named = jobs.where(F.col("project_id").isNotNull())
    found = kept(of_enabled_projects(named.select("project_id").distinct(), project_rows), "projects")
    return named.join(found, "project_id", "left_semi")
