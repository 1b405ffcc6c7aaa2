"""Reports over stored user-day rows (the mart, or old snapshots of it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanledger.functions import display, identity, text, time
from scanledger.functions.cost import byte_sum, gigabytes, money_sum, ratio_or_zero, terabytes
from scanledger.operators.allocation import table_costs
from scanledger.operators.jobs import KEY, present, query_details
from scanledger.operators.rollups import user_days
from scanledger.params import DEFAULT_REPORT_PERIOD, Params
from scanledger.plans.mart import table_fields
from scanledger.schema import MART

TOP_SPENDERS = 8
TOP_DATASETS = 10
TOP_ROWS = 100


def in_period(
    mart: DataFrame, params: Params, days: int = DEFAULT_REPORT_PERIOD, day_partition: str | None = None
) -> DataFrame:
    """Days of the last ``days`` days; the cutoff keeps its time of day.

    The date text is compared as well, which a scan can push down.  Name the
    day partition column of a stored table, and older folders are not listed.
    """
    cutoff = params.days_ago(days)
    kept = mart.where((F.col("date") >= F.date_format(cutoff, "yyyy-MM-dd")) & (F.to_timestamp("date") >= cutoff))
    return kept.where(F.col(day_partition) >= F.to_date(cutoff)) if day_partition else kept


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _money(name: str) -> Column:
    return F.coalesce(money_sum(F.col(name)), F.lit(0.0))


def _spender() -> Column:
    return identity.spender(F.col("service_account"), F.col("user_email"))


def _is_account() -> Column:
    return identity.is_account(F.col("service_account"))


def summary_metrics(mart: DataFrame) -> DataFrame:
    """One row: total cost, terabytes read, queries."""
    return mart.agg(
        _money("estimated_cost_usd").alias("total_cost_usd"),
        _total("total_bytes_processed").alias("total_bytes_processed"),
        _total("query_count").alias("total_queries"),
    ).select(
        "total_cost_usd",
        terabytes(F.col("total_bytes_processed")).alias("total_terabytes"),
        "total_queries",
    )


def cost_trend(mart: DataFrame) -> DataFrame:
    """Cost per day, oldest first."""
    return mart.groupBy("date").agg(_money("estimated_cost_usd").alias("cost_usd")).orderBy("date")


def top_spenders(mart: DataFrame, k: int = TOP_SPENDERS) -> DataFrame:
    """The k dearest spenders, their cost in the column of their kind."""
    per_spender = mart.groupBy(_spender().alias("spender")).agg(
        F.bool_or(_is_account()).alias("is_service_account"),
        _money("estimated_cost_usd").alias("cost_usd"),
    )
    account, cost = F.col("is_service_account"), F.col("cost_usd")
    return (
        per_spender.orderBy(F.desc("cost_usd"), F.asc("spender"))
        .limit(k)
        .select(
            "spender",
            identity.short_spender(F.col("spender"), account).alias("display_name"),
            "is_service_account",
            F.when(account, F.lit(0.0)).otherwise(cost).alias("user_cost"),
            F.when(account, cost).otherwise(F.lit(0.0)).alias("service_account_cost"),
        )
    )


def cache_split(mart: DataFrame) -> DataFrame:
    """One row: share of queries answered from the cache and not, in percent."""
    totals = mart.agg(
        _total("query_count").alias("queries"), _total("cache_hit_count").alias("hits")
    )
    hit = ratio_or_zero(F.col("hits"), F.col("queries"))
    return totals.select(hit.alias("cache_hit_pct"), (F.lit(100.0) - hit).alias("cache_miss_pct"))


def _history_entries() -> Column:
    """What one user-day adds to the history: its queries, else its datasets, else itself."""
    nothing = F.lit(None).cast("string")
    day = F.try_to_timestamp("date")

    def entry(dataset, sql, from_text, queries, nbytes, cost, hits, errors, queried):
        zero = F.lit(0)
        return F.struct(
            dataset.alias("dataset"),
            sql.alias("sql"),
            F.lit(from_text).alias("from_text"),
            F.coalesce(queries, zero).cast("long").alias("queries"),
            F.coalesce(nbytes.cast("double"), F.lit(0.0)).alias("bytes"),
            F.coalesce(cost, F.lit(0.0)).alias("cost"),
            F.coalesce(hits.cast("long"), zero).cast("long").alias("hits"),
            F.coalesce(errors.cast("long"), zero).cast("long").alias("errors"),
            queried.alias("queried"),
        )

    none = F.lit(0)
    from_queries = F.transform(
        "recent_queries",
        lambda q: entry(
            nothing, q.query_text, True, F.lit(1), q.total_bytes_processed, q.query_cost_usd,
            q.cache_hit, q.has_error, F.try_to_timestamp(q.timestamp),
        ),
    )
    from_datasets = F.transform(
        "dataset_costs",
        lambda d: entry(
            d.dataset, nothing, False, none, d.bytes_processed, d.dataset_cost_usd, none, none, day
        ),
    )
    from_row = F.array(
        entry(
            nothing, nothing, False, F.col("query_count"), F.col("total_bytes_processed"),
            F.col("estimated_cost_usd"), F.col("cache_hit_count"), F.col("error_count"), day,
        )
    )
    return (
        F.when(F.col("recent_queries").isNotNull(), from_queries)
        .when(F.col("dataset_costs").isNotNull(), from_datasets)
        .otherwise(from_row)
    )


def query_history(mart: DataFrame) -> DataFrame:
    """Use per dataset and spender as far as a stored mart tells.

    The dataset is read off the query texts.  Rows stored without texts fall
    back to their dataset costs, and rows without those to their own totals.
    A mart keeps the newest queries of a user-day and the start of their texts,
    so this covers those only; ``query_history_of_jobs`` covers all.
    """
    return _history(mart.select(_spender().alias("user"), F.explode(_history_entries()).alias("e")))


def query_history_of_jobs(stats: DataFrame, params: Params, days: int = DEFAULT_REPORT_PERIOD) -> DataFrame:
    """Use per dataset and spender in the period, over every query and its whole text.

    Queries without a user add to the day totals of no user, as in the mart.
    """
    whole_texts = params.with_settings(text_limit=2**31 - 1)
    named = stats.where(F.col("user_email").isNotNull())
    details = in_period(present(query_details(named, whole_texts)), params, days)
    unnamed = in_period(present(user_days(stats.where(F.col("user_email").isNull()), params)), params, days)

    def entry(sql, from_text, queries, cost, hits, errors, queried):
        return F.struct(
            F.lit(None).cast("string").alias("dataset"),
            sql.cast("string").alias("sql"),
            F.lit(from_text).alias("from_text"),
            queries.cast("long").alias("queries"),
            F.coalesce(F.col("total_bytes_processed").cast("double"), F.lit(0.0)).alias("bytes"),
            F.coalesce(cost, F.lit(0.0)).alias("cost"),
            F.coalesce(hits.cast("long"), F.lit(0)).alias("hits"),
            F.coalesce(errors.cast("long"), F.lit(0)).alias("errors"),
            F.try_to_timestamp(queried).alias("queried"),
        ).alias("e")

    col = F.col
    of_queries = entry(
        col("query_text"), True, F.lit(1), col("query_cost_usd"), col("cache_hit"), col("has_error"), col("timestamp")
    )
    of_days = entry(
        F.lit(None), False, col("query_count"), col("estimated_cost_usd"), col("cache_hit_count"), col("error_count"), col("date")
    )
    user = _spender().alias("user")
    return _history(details.select(user, of_queries).unionByName(unnamed.select(user, of_days)))


def _history(entries: DataFrame) -> DataFrame:
    named = F.coalesce(F.nullif(F.col("e.dataset"), F.lit("")), F.lit(identity.UNKNOWN))
    dataset = F.when(F.col("e.from_text"), text.dataset_in_text(F.col("e.sql"))).otherwise(named)
    return (
        entries.groupBy(dataset.alias("dataset"), "user")
        .agg(
            F.sum("e.queries").alias("query_count"),
            byte_sum("e.bytes").alias("total_bytes_processed"),
            _money("e.cost").alias("total_cost"),
            F.sum("e.hits").alias("cache_hit_count"),
            F.sum("e.errors").alias("error_count"),
            F.coalesce(F.max("e.queried"), F.timestamp_seconds(F.lit(0))).alias("last_queried"),
        )
        .withColumns(
            {
                "user_display": identity.short_name(F.col("user")),
                "gigabytes_processed": gigabytes(F.col("total_bytes_processed")),
                "cache_hit_percentage": ratio_or_zero(
                    F.col("cache_hit_count"), F.col("query_count")
                ),
            }
        )
    )


def history_order(history: DataFrame) -> DataFrame:
    """Latest first, then most bytes; for the sink that shows the history."""
    return history.orderBy(
        F.desc("last_queried"), F.desc("total_bytes_processed"), F.asc("dataset"), F.asc("user")
    )


def dataset_ranking(mart: DataFrame, k: int = TOP_DATASETS) -> DataFrame:
    """The k dearest datasets and their share of all cost (at most 100 percent).

    A row adds its datasets and its own total to one grouping, so the mart is
    read once; the total is then the first of the k + 1 rows that remain.
    """
    none = F.lit(None).cast("string")
    own = F.struct(F.lit(True).alias("whole"), none.alias("dataset"), F.lit(None).cast("double").alias("bytes"), F.col("estimated_cost_usd").alias("cost"))
    entries = F.transform(
        F.coalesce("dataset_costs", F.array().cast(MART["dataset_costs"].dataType)),
        lambda d: F.struct(F.lit(False).alias("whole"), d["dataset"].alias("dataset"), d["bytes_processed"].alias("bytes"), d["dataset_cost_usd"].alias("cost")),
    )
    grouped = (
        mart.select(F.inline(F.array_append(entries, own)))
        .groupBy("whole", "dataset")
        .agg(F.coalesce(byte_sum("bytes"), F.lit(0.0)).alias("bytes_processed"), _money("cost").alias("cost_usd"))
    )
    top = grouped.orderBy(F.desc("whole"), F.desc("cost_usd"), F.asc("dataset")).limit(k + 1)
    total = F.max(F.when(F.col("whole"), F.col("cost_usd"))).over(Window.partitionBy(F.lit(1)))
    share = F.least(ratio_or_zero(F.col("cost_usd"), F.col("total")), F.lit(100.0))
    return top.withColumn("total", total).where(~F.col("whole")).select(
        "dataset", "bytes_processed", "cost_usd", share.alias("pct_of_total")
    ).orderBy(F.desc("cost_usd"), F.asc("dataset"))


_TABLE_ROW = ["date", "estimated_cost_usd", "project_id", "user_email"]


def table_cost_totals(mart: DataFrame) -> DataFrame:
    """Cost per table as far as a stored mart tells: it keeps the dearest tables of a user-day only."""
    return _table_totals(mart.select(*_TABLE_ROW, F.explode("table_costs").alias("t")))


def table_cost_totals_of_jobs(stats: DataFrame, params: Params) -> DataFrame:
    """Cost per table over every table that every job read."""
    costs = table_costs(stats, params).join(user_days(stats, params).select(*KEY, "estimated_cost_usd"), KEY)
    rows = present(costs.select(*KEY, "estimated_cost_usd", F.struct(*table_fields()).alias("t")))
    return _table_totals(rows.select(*_TABLE_ROW, "t"))


def _table_totals(tables: DataFrame) -> DataFrame:
    """Cost per table, rebuilt and incremental, with the newest row's attributes."""
    newest = F.max_by(
        F.struct("t.dataset_name", "t.table_id", "t.is_rebuild_operation"),
        F.struct("date", "estimated_cost_usd", "project_id", "user_email"),
    )
    return (
        tables.groupBy(F.col("t.table_name").alias("table_name"))
        .agg(
            newest.alias("newest"),
            _money("t.table_cost_usd").alias("total_cost"),
            _money("t.rebuild_cost_usd").alias("rebuild_cost"),
            _money("t.incremental_cost_usd").alias("incremental_cost"),
            F.coalesce(byte_sum("t.bytes_processed"), F.lit(0.0)).alias("bytes_processed"),
            _total("t.rebuild_count").alias("rebuild_count"),
        )
        .select(
            "table_name",
            "newest.dataset_name",
            "newest.table_id",
            "total_cost",
            "rebuild_cost",
            "incremental_cost",
            "bytes_processed",
            "rebuild_count",
            F.coalesce("newest.is_rebuild_operation", F.lit(False)).alias("is_rebuild_operation"),
        )
    )


def table_rebuild_report(totals: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """The k dearest of ``table_cost_totals`` with the share and severity of their rebuilds."""
    percent = ratio_or_zero(F.col("rebuild_cost"), F.col("total_cost"))
    return (
        totals.orderBy(F.desc("total_cost"), F.asc("table_name"))
        .limit(k)
        .withColumn("rebuild_percent", percent)
        .withColumn("severity", display.rebuild_severity(F.col("rebuild_percent")))
    )


def user_dataset_report(mart: DataFrame, k: int = TOP_ROWS) -> DataFrame:
    """The k dearest pairs of spender and dataset."""
    return (
        mart.select(
            _spender().alias("user"),
            _is_account().alias("account"),
            F.explode("dataset_costs").alias("d"),
        )
        .groupBy("user", F.col("d.dataset").alias("dataset"))
        .agg(
            F.bool_or("account").alias("is_service_account"),
            _money("d.dataset_cost_usd").alias("cost_usd"),
            F.coalesce(byte_sum("d.bytes_processed"), F.lit(0.0)).alias("bytes_processed"),
        )
        .orderBy(F.desc("cost_usd"), F.asc("user"), F.asc("dataset"))
        .limit(k)
        .withColumn("user_display", identity.short_name(F.col("user")))
        .withColumn(
            "user_type",
            F.when(F.col("is_service_account"), F.lit("Service Account")).otherwise(F.lit("User")),
        )
    )


def hourly_pattern(mart: DataFrame) -> DataFrame:
    """Queries and cost per hour of the day, over all users and days."""
    return (
        mart.select(F.explode("hourly_breakdown").alias("h"))
        .groupBy(F.col("h.hour_of_day").alias("hour"))
        .agg(_total("h.hourly_queries").alias("queries"), _money("h.hourly_cost").alias("cost_usd"))
        .withColumn("label", time.hour_label(F.col("hour")))
        .orderBy("hour")
    )


def weekday_pattern(mart: DataFrame) -> DataFrame:
    """Queries and cost per weekday, over all users."""
    return (
        mart.select(F.explode("daily_breakdown").alias("w"))
        .groupBy(F.col("w.day_of_week").alias("weekday"))
        .agg(_total("w.daily_queries").alias("queries"), _money("w.daily_cost").alias("cost_usd"))
        .withColumn("label", time.weekday_label(F.col("weekday")))
        .orderBy("weekday")
    )


def reports(
    mart: DataFrame, params: Params, period: int = DEFAULT_REPORT_PERIOD
) -> dict[str, DataFrame]:
    """All reports.

    The overview covers the period; tables, user-dataset pairs and time
    patterns cover everything stored.  Pass a stored mart: every report is its
    own query over the columns it needs.
    """
    recent = in_period(mart, params, period)
    return {
        "summary_metrics": summary_metrics(recent),
        "cost_trend": cost_trend(recent),
        "top_spenders": top_spenders(recent),
        "cache_split": cache_split(recent),
        "query_history": history_order(query_history(recent)),
        "dataset_ranking": dataset_ranking(recent),
        "table_rebuild_report": table_rebuild_report(table_cost_totals(mart)),
        "user_dataset_report": user_dataset_report(mart),
        "hourly_pattern": hourly_pattern(mart),
        "weekday_pattern": weekday_pattern(mart),
    }


REPORT_ROW = "struct<report:string,key:string,other:string,account:boolean,queries:bigint,hits:bigint,bytes:decimal(38,3),cost:double>"


def report_rows(mart: DataFrame, params: Params, period: int = DEFAULT_REPORT_PERIOD) -> DataFrame:
    """Everything the reports add up, from one scan and one shuffle: ``(report, key, other, account, queries, hits, bytes, cost)``.

    A user-day adds to the totals, its day, its spender, its datasets, its pairs
    of spender and dataset, its hours and its weekday; equal report and keys are
    added within a task first, so what is shuffled follows the number of groups.
    The overview (total, day, spender, dataset) covers the period, the rest all
    days.  Keep the rows and give them to ``bundled``.
    """
    cutoff = params.days_ago(period)
    recent = (F.col("date") >= F.date_format(cutoff, "yyyy-MM-dd")) & (F.try_to_timestamp("date") >= cutoff)
    nothing, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def entry(report, key, cost, other=nothing, account=F.lit(False), queries=zero, hits=zero, nbytes=F.lit(0)):
        return F.struct(
            F.lit(report).alias("report"), key.alias("key"), other.alias("other"), account.alias("account"), queries.alias("queries"),
            hits.alias("hits"), nbytes.cast("decimal(38,3)").alias("bytes"), cost.alias("cost"),
        ).cast(REPORT_ROW)

    own = {"queries": F.col("query_count"), "hits": F.col("cache_hit_count"), "nbytes": F.col("total_bytes_processed")}
    cost, user, account = F.col("estimated_cost_usd"), F.col("spender"), F.col("is_account")
    overview = F.array(
        entry("total", nothing, cost, **own), entry("day", F.col("date"), cost, **own), entry("spender", user, cost, account=account, **own)
    )
    datasets = F.transform("dataset_costs", lambda d: entry("dataset", d["dataset"], d["dataset_cost_usd"], nbytes=d["bytes_processed"]))
    none = F.array().cast(f"array<{REPORT_ROW}>")
    pairs = F.transform(
        "dataset_costs", lambda d: entry("user_dataset", user, d["dataset_cost_usd"], d["dataset"], account, nbytes=d["bytes_processed"])
    )
    hours = F.transform("hourly_breakdown", lambda h: entry("hour", h["hour_of_day"].cast("string"), h["hourly_cost"], queries=h["hourly_queries"]))
    weekdays = F.transform("daily_breakdown", lambda w: entry("weekday", w["day_of_week"].cast("string"), w["daily_cost"], queries=w["daily_queries"]))
    of_all = F.concat(*[F.coalesce(part, none) for part in (pairs, hours, weekdays)])
    rows = mart.withColumns({"spender": _spender(), "is_account": _is_account()})
    rows = rows.select(F.inline(F.concat(F.when(F.coalesce(recent, F.lit(False)), F.concat(overview, F.coalesce(datasets, none))).otherwise(none), of_all)))
    return rows.groupBy("report", "key", "other").agg(
        F.bool_or("account").alias("account"),
        _total("queries").alias("queries"),
        _total("hits").alias("hits"),
        F.coalesce(F.sum("bytes").cast("double"), F.lit(0.0)).alias("bytes"),
        _money("cost").alias("cost"),
    )


def bundled(rows: DataFrame, k_spenders: int = TOP_SPENDERS, k_datasets: int = TOP_DATASETS, k_pairs: int = TOP_ROWS) -> dict[str, DataFrame]:
    """The reports that ``report_rows`` (best stored) feeds, each split off by its name."""
    of = lambda name: rows.where(F.col("report") == name)
    cost, account = F.col("cost"), F.col("account")
    total, other = of("total"), F.lit(0.0)
    hit = ratio_or_zero(F.col("hits"), F.col("queries"))
    spenders = of("spender").orderBy(F.desc("cost"), F.asc("key")).limit(k_spenders)
    whole = total.agg(F.coalesce(F.first("cost"), F.lit(0.0)))
    datasets = of("dataset").orderBy(F.desc("cost"), F.asc("key")).limit(k_datasets)
    pairs = of("user_dataset").orderBy(F.desc("cost"), F.asc("key"), F.asc("other")).limit(k_pairs)
    number = F.col("key").cast("int")
    return {
        "summary_metrics": total.select(cost.alias("total_cost_usd"), terabytes(F.col("bytes")).alias("total_terabytes"), F.col("queries").alias("total_queries")),
        "cost_trend": of("day").select(F.col("key").alias("date"), cost.alias("cost_usd")).orderBy("date"),
        "top_spenders": spenders.select(
            F.col("key").alias("spender"),
            identity.short_spender(F.col("key"), account).alias("display_name"),
            account.alias("is_service_account"),
            F.when(account, other).otherwise(cost).alias("user_cost"),
            F.when(account, cost).otherwise(other).alias("service_account_cost"),
        ),
        "cache_split": total.select(hit.alias("cache_hit_pct"), (F.lit(100.0) - hit).alias("cache_miss_pct")),
        "dataset_ranking": datasets.select(
            F.col("key").alias("dataset"),
            F.col("bytes").alias("bytes_processed"),
            cost.alias("cost_usd"),
            F.least(ratio_or_zero(cost, whole.scalar()), F.lit(100.0)).alias("pct_of_total"),
        ),
        "user_dataset_report": pairs.select(
            F.col("key").alias("user"),
            F.col("other").alias("dataset"),
            account.alias("is_service_account"),
            cost.alias("cost_usd"),
            F.col("bytes").alias("bytes_processed"),
            identity.short_name(F.col("key")).alias("user_display"),
            F.when(account, F.lit("Service Account")).otherwise(F.lit("User")).alias("user_type"),
        ),
        "hourly_pattern": of("hour").select(number.alias("hour"), "queries", cost.alias("cost_usd"), time.hour_label(number).alias("label")).orderBy("hour"),
        "weekday_pattern": of("weekday").select(number.alias("weekday"), "queries", cost.alias("cost_usd"), time.weekday_label(number).alias("label")).orderBy("weekday"),
    }


def displayed_datasets(ranking: DataFrame, mart: DataFrame) -> DataFrame:
    """The dataset ranking as text."""
    total = mart.agg(_money("estimated_cost_usd").alias("total"))
    return ranking.select(
        "dataset",
        display.bytes_text(F.col("bytes_processed")).alias("data"),
        display.currency_text(F.col("cost_usd")).alias("cost"),
        display.share_text(F.col("cost_usd"), total.scalar()).alias("share"),
    )
