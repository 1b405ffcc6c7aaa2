"""Schemas of the job log, the stored marts and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


TABLE_REF = _struct(project_id=_S, dataset_id=_S, table_id=_S)

# A reference may carry how often the job names the table.  Logs without the
# field mean one per element; see sources.job_log.normalise.
COUNTED_REF = _struct(project_id=_S, dataset_id=_S, table_id=_S, ref_count=_L)

JOBS = _struct(
    project_id=_S,
    user_email=_S,
    job_id=_S,
    creation_time=_TS,
    end_time=_TS,
    query=_S,
    statement_type=_S,
    job_type=_S,
    total_bytes_processed=_L,
    total_bytes_billed=_L,
    total_slot_ms=_L,
    error_result=_struct(reason=_S, message=_S),
    cache_hit=_B,
    destination_table=TABLE_REF,
    referenced_tables=T.ArrayType(TABLE_REF),
    labels=T.ArrayType(_struct(key=_S, value=_S)),
    priority=_S,
)

HOUR_ENTRY = _struct(hour_of_day=T.IntegerType(), hourly_queries=_L, hourly_cost=_D)
WEEKDAY_ENTRY = _struct(day_of_week=T.IntegerType(), daily_queries=_L, daily_cost=_D)
DATASET_ENTRY = _struct(
    dataset=_S, bytes_processed=_D, bytes_billed=_D, dataset_cost_usd=_D, rebuild_operations=_L
)
MAIN_DATASET_ENTRY = _struct(
    dataset=_S, bytes_processed=_D, bytes_billed=_D, dataset_cost_usd=_D
)
TABLE_ENTRY = _struct(
    table_name=_S,
    table_id=_S,
    dataset_name=_S,
    bytes_processed=_D,
    bytes_billed=_D,
    table_cost_usd=_D,
    is_rebuild_operation=_B,
    rebuild_cost_usd=_D,
    incremental_cost_usd=_D,
    rebuild_count=_L,
)
QUERY_ENTRY = _struct(
    job_id=_S,
    timestamp=_S,
    statement_type=_S,
    priority=_S,
    total_bytes_processed=_L,
    query_cost_usd=_D,
    execution_time_seconds=_L,
    cache_hit=_B,
    has_error=_B,
    query_text=_S,
)

SCALARS = _struct(
    date=_S,
    project_id=_S,
    user_email=_S,
    service_account=_S,
    query_count=_L,
    cache_hit_count=_L,
    error_count=_L,
    total_bytes_processed=_L,
    total_bytes_billed=_L,
    estimated_cost_usd=_D,
    slot_hours=_D,
    cache_hit_percentage=_D,
)

MART = T.StructType(
    SCALARS.fields
    + _struct(
        hourly_breakdown=T.ArrayType(HOUR_ENTRY),
        daily_breakdown=T.ArrayType(WEEKDAY_ENTRY),
        dataset_costs=T.ArrayType(DATASET_ENTRY),
        table_costs=T.ArrayType(TABLE_ENTRY),
        recent_queries=T.ArrayType(QUERY_ENTRY),
    ).fields
)

MAIN_TABLE = T.StructType(
    SCALARS.fields + _struct(dataset_costs=T.ArrayType(MAIN_DATASET_ENTRY)).fields
)

RUN_SUMMARY = _struct(
    project=_S,
    project_name=_S,
    run_ts=_S,
    records=_L,
    total_cost=_D,
    total_bytes_processed=_L,
    total_queries=_L,
    elapsed_seconds=_D,
    output_path=_S,
    history_days=_L,
    price_per_tb=_D,
    error=_S,
)

SETTINGS = _struct(historyDays=_D, costPerTerabyte=_D, refreshInterval=_D)
PROJECTS = _struct(id=_S, name=_S, description=_S, disabled=_B)
CONFIG = _struct(projects=T.ArrayType(PROJECTS), settings=SETTINGS)

# What each column of the stored tables means; written as column comments.
COMMENTS = {
    "date": "UTC day of the queries, yyyy-MM-dd",
    "project_id": "project that ran the queries",
    "user_email": "account that ran the queries",
    "service_account": "the account when it is a service account, else NULL",
    "user": "service account or user that ran the queries",
    "is_service_account": "true for service accounts",
    "query_count": "number of queries",
    "cache_hit_count": "queries answered from the result cache",
    "error_count": "queries that ended in an error",
    "total_bytes_processed": "bytes the queries read",
    "total_bytes_billed": "bytes the queries were billed for",
    "estimated_cost_usd": "cost of the billed bytes in USD",
    "slot_hours": "slot time in hours",
    "cache_hit_percentage": "share of queries answered from the cache, in percent",
    "hourly_breakdown": "queries and cost per hour of the day",
    "daily_breakdown": "queries and cost per weekday",
    "dataset_costs": "cost per dataset, dearest first",
    "table_costs": "cost per table, dearest first",
    "recent_queries": "latest queries, newest first",
    "total_queries": "number of queries",
    "total_cache_hits": "queries answered from the result cache",
    "total_errors": "queries that ended in an error",
    "total_estimated_cost_usd": "cost of the billed bytes in USD",
    "total_slot_hours": "slot time in hours",
    "avg_cache_hit_percentage": "mean over users of their cache share, in percent",
    "dataset_name": "project.dataset",
    "unique_users": "distinct accounts that read the dataset",
    "total_cost_usd": "cost in USD",
    "top_users": "accounts that spent most on the dataset",
    "top_datasets": "datasets the account spent most on",
    "bytes_processed": "bytes read",
    "cost_usd": "cost in USD",
    "pct_of_user_cost": "share of the account's cost of that day, in percent",
    "pct_of_dataset_cost": "share of the dataset's cost of that day, in percent",
}


def with_comments(df: DataFrame, comments: dict[str, str] = COMMENTS) -> DataFrame:
    """Attach the column comments as metadata, which table writers store."""
    return df.select(
        [
            F.col(name).alias(name, metadata={"comment": comments[name]})
            if name in comments
            else F.col(name)
            for name in df.columns
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order; columns an old file lacks are NULL."""

    def pick(field: T.StructField) -> Column:
        if field.name in df.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    return df.select([pick(field) for field in schema.fields])
