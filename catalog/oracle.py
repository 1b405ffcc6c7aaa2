"""The registered queries in SQL, over flat jobs and references.

Written from the meaning of each result with plain joins, so that a mistake in
the nested Spark form shows.
"""

from __future__ import annotations

# --- the derived log -----------------------------------------------------------

JOBS = """
jobs AS (
  SELECT event_id, 'job_' || event_id AS job_id, 'proj-' || (user_id % 3) AS project_id,
         CASE WHEN user_id % 50 = 49 THEN NULL
              WHEN user_id % 5 = 0 THEN 'runner-' || user_id || '@proj.iam.gserviceaccount.com'
              WHEN user_id % 5 = 1 THEN 'service-' || user_id || '@agents.example.com'
              ELSE 'user-' || user_id || '@example.com' END AS user_email,
         ts AS creation_time, ts + to_seconds(CAST(floor(value) AS INTEGER)) AS end_time,
         (CASE WHEN event_id % 5 = 0 THEN
            '-- Query for project: proj-' || (user_id % 3) || chr(10) || '-- Team: team-' || (user_id % 4) || chr(10)
            || '-- Owner: owner-' || (user_id % 6) || chr(10) || '-- Query ID: q-' || (event_id % 100) || chr(10)
            || '-- Query Type: ' || (CASE WHEN event_id % 2 = 0 THEN 'report' ELSE 'etl' END) || chr(10)
          ELSE '' END)
         || (CASE WHEN event_id % 9 = 0 THEN 'SELECT 1'
             ELSE 'SELECT * FROM `data-' || (event_id % 2) || '.ds_' || (event_id % 4) || '.t_' || (event_id % 20) || '` WHERE x > 1' END) AS query,
         CASE WHEN event_type = 'view' THEN 'CREATE_TABLE_AS_SELECT'
              WHEN event_type = 'purchase' THEN 'MERGE'
              WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'SCRIPT'
              WHEN event_type = 'signup' AND event_id % 4 = 2 THEN NULL
              ELSE 'SELECT' END AS statement_type,
         CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'LOAD' ELSE 'QUERY' END AS job_type,
         b AS total_bytes_processed,
         CASE WHEN event_id % 17 <> 0 AND event_id % 4 = 1 THEN 0
              ELSE ((b + 1048575) // 1048576) * 1048576 END AS total_bytes_billed,
         CAST(floor(value * 1000) AS BIGINT) AS total_slot_ms,
         CASE WHEN event_type = 'error' THEN 'backendError' END AS error_reason,
         CASE WHEN event_id % 17 <> 0 THEN event_id % 4 = 1 END AS cache_hit,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'ds_' || (o_custkey % 4) END AS dest_dataset,
         CASE WHEN event_type IN ('view', 'purchase') THEN 't_' || (o_custkey % 20) END AS dest_table,
         CASE WHEN event_id % 2 = 0 THEN 'INTERACTIVE' ELSE 'BATCH' END AS priority
  FROM (SELECT e.*, o.o_custkey,
               CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 500000
                    ELSE CAST(floor(o_totalprice) AS BIGINT) * 1000000 END AS b
        FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id)
),
refs AS (
  SELECT l_orderkey AS event_id, 'data-' || (l_suppkey % 2) AS project_id,
         CASE WHEN l_linenumber <> 7 THEN 'ds_' || (l_partkey % 4) END AS dataset_id,
         CASE WHEN l_linenumber <> 6 THEN 't_' || (l_partkey % 20) END AS table_id
  FROM lineitem
),
js AS (
  SELECT j.*, strftime(creation_time, '%Y-%m-%d') AS date,
         CASE WHEN user_email LIKE '%.gserviceaccount.com' OR user_email LIKE 'service-%' THEN user_email END AS service_account,
         CAST(hour(creation_time) AS BIGINT) AS hour_of_day,
         CAST(dayofweek(creation_time) + 1 AS BIGINT) AS day_of_week,
         date_sub('second', creation_time, end_time) AS execution_time_seconds,
         round(total_bytes_billed / power(1024, 4) * 5, 2) AS query_cost_usd
  FROM jobs j
  WHERE creation_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
    AND job_type = 'QUERY' AND statement_type <> 'SCRIPT'
),
big AS (SELECT * FROM js WHERE total_bytes_processed > 1000000)"""

FULL_REFS = """
full_refs AS (
  SELECT *, count(*) OVER (PARTITION BY event_id) AS parts FROM refs
  WHERE project_id IS NOT NULL AND dataset_id IS NOT NULL AND table_id IS NOT NULL
)"""

DATASET_REFS = """
dataset_refs AS (
  SELECT *, count(*) OVER (PARTITION BY event_id) AS parts
  FROM (SELECT DISTINCT event_id, project_id || '.' || dataset_id AS dataset FROM refs
        WHERE project_id IS NOT NULL AND dataset_id IS NOT NULL)
)"""

MEASURES = """
  CAST(count(*) AS BIGINT) AS query_count,
  CAST(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hit_count,
  CAST(sum(CASE WHEN error_reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
  CAST(sum(total_bytes_processed) AS BIGINT) AS total_bytes_processed,
  CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed,
  round(sum(total_bytes_billed) / power(1024, 4) * 5, 2) AS estimated_cost_usd"""


def _user_days(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT date, project_id, user_email, service_account, {MEASURES},
         sum(total_slot_ms) / 1000 / 3600 AS slot_hours,
         round(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) / nullif(count(*), 0) * 100 + 1e-9, 2) AS cache_hit_percentage
  FROM {source} GROUP BY ALL
)"""


BASE = _user_days("base", "js")
MAIN = _user_days("main_days", "big")

HOURS = f"""
hours AS (
  SELECT date, project_id, user_email, service_account, hour_of_day, {MEASURES} FROM js GROUP BY ALL
)"""

WEEKDAYS = f"""
weekdays AS (
  SELECT date, project_id, user_email, service_account, day_of_week, {MEASURES} FROM js GROUP BY ALL
)"""

TABLES = """
tc AS (
  SELECT date, j.project_id, user_email, service_account,
         r.project_id || '.' || r.dataset_id || '.' || r.table_id AS table_name,
         r.project_id AS table_project, r.dataset_id AS table_dataset, r.table_id,
         CAST(count(*) AS BIGINT) AS query_count,
         bool_or(coalesce(dest_dataset = r.dataset_id AND dest_table = r.table_id, false)) AS is_rebuild_operation,
         (sum(total_bytes_processed // parts)::DOUBLE + sum(((total_bytes_processed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) AS bytes_processed,
         (sum(total_bytes_billed // parts)::DOUBLE + sum(((total_bytes_billed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) AS bytes_billed,
         round((sum(total_bytes_billed // parts)::DOUBLE + sum(((total_bytes_billed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) / power(1024, 4) * 5, 2) AS table_cost_usd
  FROM js j JOIN full_refs r USING (event_id) GROUP BY ALL
)"""

DATASETS = """
dc AS (
  SELECT date, project_id, user_email, service_account, table_project || '.' || table_dataset AS dataset,
         CAST(sum(query_count) AS BIGINT) AS query_count, sum(bytes_processed::DECIMAL(38,3))::DOUBLE AS bytes_processed,
         sum(bytes_billed::DECIMAL(38,3))::DOUBLE AS bytes_billed, round(sum(table_cost_usd), 2) AS dataset_cost_usd,
         CAST(sum(CASE WHEN is_rebuild_operation THEN 1 ELSE 0 END) AS BIGINT) AS rebuild_operations
  FROM tc GROUP BY ALL
)"""

DIRECT = """
direct AS (
  SELECT date, project_id, user_email, service_account, dataset, CAST(count(*) AS BIGINT) AS query_count,
         (sum(total_bytes_processed // parts)::DOUBLE + sum(((total_bytes_processed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) AS bytes_processed, (sum(total_bytes_billed // parts)::DOUBLE + sum(((total_bytes_billed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) AS bytes_billed,
         round((sum(total_bytes_billed // parts)::DOUBLE + sum(((total_bytes_billed % parts) * 2000 + parts) // (2 * parts)) / 1000.0::DOUBLE) / power(1024, 4) * 5, 2) AS dataset_cost_usd
  FROM big JOIN dataset_refs USING (event_id) GROUP BY ALL
)"""

# Nested detail hangs on equal keys, so user-days without an email have none.
MATCHED = "project_id IS NOT NULL AND user_email IS NOT NULL"
K = "date, project_id, user_email, service_account"

MART_TABLES = f"""
mart_tables AS (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY table_cost_usd DESC NULLS LAST, table_name) AS rank
  FROM tc WHERE {MATCHED} QUALIFY rank <= 100
)"""
MART_DATASETS = f"""
mart_datasets AS (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY dataset_cost_usd DESC NULLS LAST, dataset) AS rank
  FROM dc WHERE {MATCHED}
)"""
MART_QUERIES = f"""
mart_queries AS (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY creation_time DESC NULLS LAST, job_id) AS rank
  FROM js WHERE {MATCHED} QUALIFY rank <= 100
)"""
MAIN_DATASETS = f"""
main_datasets AS (
  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY dataset_cost_usd DESC NULLS LAST, dataset) AS rank
  FROM direct WHERE {MATCHED}
)"""

SPENDER = "coalesce(nullif(service_account, ''), nullif(user_email, ''), 'Unknown')"
IS_ACCOUNT = "coalesce(service_account <> '', false)"
TEXT_DATASET = (
    "coalesce(nullif(regexp_extract(query, "
    "'FROM\\s+`?([a-zA-Z0-9_-]+\\.[a-zA-Z0-9_-]+)`?', 1, 'i'), ''), 'Unknown')"
)


def whole(column: str, alias: str | None = None) -> str:
    return f"CAST(round({column}) AS BIGINT) AS {alias or column}"


def ratio(part: str, total: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN {part} / {total} * 100.0::DOUBLE ELSE 0.0::DOUBLE END)"


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join([JOBS, *parts]) + "\n" + select


def _slot(column: str) -> str:
    return f"round({column} + 1e-9, 6) AS {column}"


SCALARS = (
    "query_count, cache_hit_count, error_count, total_bytes_processed, total_bytes_billed, estimated_cost_usd"
)
SCALAR_VIEW = f"{K}, {SCALARS}, {_slot('slot_hours')}, cache_hit_percentage"


def _sizes(source: str, name: str) -> str:
    return f"(SELECT {K}, count(*) AS {name} FROM {source} WHERE {MATCHED} GROUP BY ALL) {name}"


def _display_bytes(column: str) -> str:
    unit = f"least(5, greatest(0, CAST(floor(ln({column}) / ln(1024) + 1e-12) AS INTEGER)))"
    digits = f"printf('%.2f', round({column} / power(1024, {unit}), 2))"
    return (
        f"CASE WHEN {column} = 0 THEN '0 Bytes' ELSE regexp_replace({digits}, '\\.?0+$', '') || ' ' || "
        f"['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB'][{unit} + 1] END"
    )


def _tag(label: str) -> str:
    return f"nullif(regexp_extract(query, '-- {label}: ([^\\n]+)', 1), '')"


def _cost_by_tag(name: str, label: str) -> str:
    return sql(
        f"SELECT {_tag(label)} AS {name}, CAST(count(*) AS BIGINT) AS query_count, "
        "CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed, "
        "round(sum(total_bytes_billed) / power(1024, 4) * 5, 2) AS cost_usd FROM js GROUP BY 1"
    )


PROJECTS = """
projects AS (
  SELECT c_custkey AS index, CASE WHEN c_custkey % 11 <> 5 THEN 'proj-' || c_custkey END AS id,
         CASE WHEN c_custkey % 13 <> 7 THEN c_name END AS name,
         CASE WHEN c_custkey % 5 = 1 THEN true END AS disabled
  FROM customer
),
watched AS (SELECT * FROM projects WHERE NOT coalesce(disabled, false) AND id IS NOT NULL)"""

RUNS = """
totals AS (
  SELECT w.id AS project, w.name AS project_name, CAST(count(b.date) AS BIGINT) AS records,
         coalesce(round(sum(b.estimated_cost_usd), 2), 0.0) AS total_cost,
         CAST(coalesce(sum(b.total_bytes_processed), 0) AS BIGINT) AS total_bytes_processed,
         CAST(coalesce(sum(b.query_count), 0) AS BIGINT) AS total_queries
  FROM watched w LEFT JOIN base b ON b.project_id = w.id GROUP BY w.id, w.name
)"""

DAILY_ALERT = """
SELECT 'daily-cost-above-100' AS policy, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, value, 100.0::DOUBLE AS threshold
FROM (SELECT date_trunc('day', creation_time) AS w,
             round(sum(total_bytes_billed) / power(1024, 4) * 5, 2) AS value
      FROM jobs WHERE job_type = 'QUERY' AND statement_type <> 'SCRIPT' GROUP BY 1)
WHERE value > 100"""

FAILURE_ALERT = """
SELECT 'failed-jobs' AS policy, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(w + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, value, 0.0::DOUBLE AS threshold
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, creation_time) AS w, CAST(count(*) AS DOUBLE) AS value
      FROM jobs WHERE error_reason IS NOT NULL GROUP BY 1)"""

SIZES = """
sizes AS (
  SELECT 't_' || (p_partkey % 20) AS table_id, CAST(sum(p_size) * 1000000000 AS BIGINT) AS total_bytes_processed
  FROM part GROUP BY 1
)"""

TABLE_TOTALS = """
table_totals AS (
  SELECT table_name, arg_max(table_project || '.' || table_dataset, row(date, estimated_cost_usd, t.project_id, t.user_email)) AS dataset_name,
         arg_max(table_id, row(date, estimated_cost_usd, t.project_id, t.user_email)) AS table_id,
         round(sum(table_cost_usd), 2) AS total_cost,
         round(sum(CASE WHEN is_rebuild_operation THEN table_cost_usd ELSE 0 END), 2) AS rebuild_cost,
         round(sum(CASE WHEN is_rebuild_operation THEN 0 ELSE table_cost_usd END), 2) AS incremental_cost,
         CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS bytes_processed,
         CAST(sum(CASE WHEN is_rebuild_operation THEN 1 ELSE 0 END) AS BIGINT) AS rebuild_count,
         arg_max(is_rebuild_operation, row(date, estimated_cost_usd, t.project_id, t.user_email)) AS is_rebuild_operation
  FROM mart_tables t JOIN base b USING (date, project_id, user_email)
  GROUP BY table_name
)"""


def _history(entries: str) -> str:
    return f"""
SELECT dataset, user, split_part(user, '@', 1) AS user_display, CAST(sum(queries) AS BIGINT) AS query_count,
       CAST(round(sum(bytes::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS total_bytes_processed, round(sum(cost), 2) AS total_cost,
       CAST(sum(hits) AS BIGINT) AS cache_hit_count, CAST(sum(errors) AS BIGINT) AS error_count,
       strftime(max(queried), '%Y-%m-%d %H:%M:%S') AS last_queried,
       round(round(sum(bytes::DECIMAL(38,3))::DOUBLE / power(1024, 3), 2) + 1e-9, 2) AS gigabytes_processed,
       round({ratio('sum(hits)', 'sum(queries)')} + 1e-9, 2) AS cache_hit_percentage
FROM ({entries}) GROUP BY dataset, user"""


def _from_queries(source: str) -> str:
    return f"""
SELECT {TEXT_DATASET} AS dataset, {SPENDER} AS user, 1 AS queries, CAST(total_bytes_processed AS DOUBLE) AS bytes,
       query_cost_usd AS cost, CASE WHEN cache_hit THEN 1 ELSE 0 END AS hits,
       CASE WHEN error_reason IS NOT NULL THEN 1 ELSE 0 END AS errors, date_trunc('second', creation_time) AS queried
FROM {source}"""


def _from_datasets(source: str) -> str:
    return f"""
SELECT dataset, {SPENDER} AS user, 0 AS queries, bytes_processed AS bytes, dataset_cost_usd AS cost,
       0 AS hits, 0 AS errors, CAST(date AS TIMESTAMP) AS queried FROM {source}"""


def _from_rows(source: str) -> str:
    return f"""
SELECT 'Unknown' AS dataset, {SPENDER} AS user, query_count AS queries,
       CAST(total_bytes_processed AS DOUBLE) AS bytes, estimated_cost_usd AS cost, cache_hit_count AS hits,
       error_count AS errors, CAST(date AS TIMESTAMP) AS queried FROM {source}"""


KIND = "day(CAST(date AS DATE)) % 3"
HAS_DATASETS = f"EXISTS (SELECT 1 FROM mart_datasets d WHERE (d.date, d.project_id, d.user_email) = (b.date, b.project_id, b.user_email))"
# A user-day without an email has no nested detail at all and counts by its own totals.
QUERY_BRANCH = "(SELECT * FROM mart_queries)"
HISTORY_ALL = (
    _from_queries("mart_queries")
    + " UNION ALL "
    + _from_rows("(SELECT * FROM base WHERE user_email IS NULL OR project_id IS NULL)")
)
HISTORY_OLD = " UNION ALL ".join(
    [
        _from_queries(f"(SELECT * FROM mart_queries WHERE {KIND} = 0)"),
        _from_datasets(f"(SELECT * FROM mart_datasets WHERE {KIND} = 1)"),
        _from_rows(
            f"(SELECT * FROM base b WHERE user_email IS NULL OR project_id IS NULL OR {KIND} = 2"
            f" OR ({KIND} = 1 AND NOT {HAS_DATASETS}))"
        ),
    ]
)

RANKING = """
ranking AS (
  SELECT dataset, round(sum(dataset_cost_usd), 2) AS cost_usd, sum(bytes_processed::DECIMAL(38,3))::DOUBLE AS bytes_processed
  FROM mart_datasets GROUP BY dataset ORDER BY cost_usd DESC, dataset LIMIT 10
),
total AS (SELECT round(sum(estimated_cost_usd), 2) AS total FROM base)"""

SPENDERS = f"""
SELECT spender,
       CASE WHEN account THEN regexp_replace(split_part(spender, '@', 1), 'service-', 'SA:')
            ELSE split_part(spender, '@', 1) END AS display_name,
       account AS is_service_account,
       CASE WHEN account THEN 0.0::DOUBLE ELSE cost END AS user_cost,
       CASE WHEN account THEN cost ELSE 0.0::DOUBLE END AS service_account_cost
FROM (SELECT {SPENDER} AS spender, bool_or({IS_ACCOUNT}) AS account, round(sum(estimated_cost_usd), 2) AS cost
      FROM base GROUP BY 1 ORDER BY cost DESC, spender LIMIT 8)"""

WEEKDAY_NAMES = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"

SNAPSHOT_ROWS = """
snaps AS (
  SELECT *, '2023-10-01_05-00-00' AS snapshot_ts FROM base
  UNION ALL SELECT *, '2024-01-30_05-00-00' FROM base
  UNION ALL SELECT *, '2024-01-31_05-00-00' FROM base WHERE project_id <> 'proj-2'
)"""

USAGE = """
usage AS (
  SELECT date, project_id, coalesce(service_account, user_email) AS user, user_email, service_account,
         service_account IS NOT NULL AS is_service_account, dataset AS dataset_name,
         bytes_processed, bytes_billed, dataset_cost_usd FROM main_datasets
)"""

ATTRIBUTION = """
SELECT u.date, u.project_id, u.user, is_service_account, u.dataset_name, CAST(count(*) AS BIGINT) AS query_count,
       CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS bytes_processed, round(sum(dataset_cost_usd), 2) AS cost_usd,
       round(round(sum(dataset_cost_usd), 2) / nullif(
         (SELECT round(sum(x.dataset_cost_usd), 2) FROM usage x WHERE x.date = u.date AND x.user = u.user), 0) * 100 + 1e-9, 2) AS pct_of_user_cost,
       round(round(sum(dataset_cost_usd), 2) / nullif(
         (SELECT round(sum(x.dataset_cost_usd), 2) FROM usage x WHERE x.date = u.date AND x.dataset_name = u.dataset_name), 0) * 100 + 1e-9, 2) AS pct_of_dataset_cost
FROM usage u GROUP BY u.date, u.project_id, u.user, is_service_account, u.dataset_name"""

FILTER_COUNTS = """
SELECT project_id, CAST(count(*) AS BIGINT) AS jobs, 'history' AS filter FROM jobs
WHERE creation_time >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1
UNION ALL SELECT project_id, count(*), 'queries' FROM jobs WHERE job_type = 'QUERY' GROUP BY 1
UNION ALL SELECT project_id, count(*), 'no_scripts' FROM js GROUP BY 1
UNION ALL SELECT project_id, count(*), 'no_small' FROM big GROUP BY 1"""

REPORT_PARTS = f"""
SELECT 'total' AS report, NULL::VARCHAR AS key, NULL::VARCHAR AS other, false AS account, query_count AS queries, cache_hit_count AS hits,
       total_bytes_processed::DOUBLE AS bytes, estimated_cost_usd AS cost FROM base
UNION ALL SELECT 'day', date, NULL, false, query_count, cache_hit_count, total_bytes_processed::DOUBLE, estimated_cost_usd FROM base
UNION ALL SELECT 'spender', {SPENDER}, NULL, {IS_ACCOUNT}, query_count, cache_hit_count, total_bytes_processed::DOUBLE, estimated_cost_usd FROM base
UNION ALL SELECT 'dataset', dataset, NULL, false, 0, 0, bytes_processed, dataset_cost_usd FROM mart_datasets
UNION ALL SELECT 'user_dataset', {SPENDER}, dataset, {IS_ACCOUNT}, 0, 0, bytes_processed, dataset_cost_usd FROM mart_datasets
UNION ALL SELECT 'hour', hour_of_day::VARCHAR, NULL, false, query_count, 0, 0, estimated_cost_usd FROM hours WHERE {MATCHED}
UNION ALL SELECT 'weekday', day_of_week::VARCHAR, NULL, false, query_count, 0, 0, estimated_cost_usd FROM weekdays WHERE {MATCHED}"""

ORACLE: dict[str, str] = {
    "usage_extract": sql(
        """SELECT project_id, user_email, job_id, strftime(creation_time, '%Y-%m-%d %H:%M:%S.%f') AS creation_time,
        strftime(end_time, '%Y-%m-%d %H:%M:%S.%f') AS end_time, execution_time_seconds AS duration_seconds, query,
        total_bytes_processed, total_bytes_billed, total_slot_ms, error_reason, cache_hit,
        'data-0.' || dest_dataset || '.' || dest_table AS destination,
        coalesce(n, 0) AS reference_count, CAST(0 AS BIGINT) AS label_count
        FROM js LEFT JOIN (SELECT event_id, count(*) AS n FROM refs GROUP BY 1) USING (event_id)"""
    ),
    "project_job_log": sql(
        "SELECT job_id, job_type, statement_type, priority, total_bytes_billed FROM jobs WHERE project_id = 'proj-1'"
    ),
    "job_filter_counts": sql(FILTER_COUNTS),
    "job_stats_flat": sql(
        """SELECT job_id, date, service_account, hour_of_day, day_of_week, execution_time_seconds,
        coalesce(d.n, 0) AS dataset_count, coalesce(t.n, 0) AS table_references,
        EXISTS (SELECT 1 FROM refs r WHERE r.event_id = js.event_id AND r.table_id = dest_table AND r.dataset_id = dest_dataset) AS is_table_rebuild
        FROM js LEFT JOIN (SELECT event_id, count(*) AS n FROM dataset_refs GROUP BY 1) d USING (event_id)
        LEFT JOIN (SELECT event_id, count(*) AS n FROM full_refs GROUP BY 1) t USING (event_id)""",
        FULL_REFS,
        DATASET_REFS,
    ),
    "referenced_datasets": sql(
        "SELECT job_id, dataset FROM js JOIN dataset_refs USING (event_id)", DATASET_REFS
    ),
    "referenced_tables": sql(
        "SELECT job_id, r.project_id || '.' || r.dataset_id || '.' || r.table_id AS table_name, "
        "CAST(count(*) AS BIGINT) AS reference_count FROM js JOIN full_refs r USING (event_id) GROUP BY 1, 2",
        FULL_REFS,
    ),
    "query_details": sql(
        """SELECT job_id, date, strftime(creation_time, '%Y-%m-%d %H:%M:%S') AS timestamp, project_id, user_email,
        service_account, statement_type, priority, execution_time_seconds, total_bytes_processed, total_bytes_billed,
        total_slot_ms, cache_hit, error_reason IS NOT NULL AS has_error, substr(query, 1, 1000) AS query_text,
        coalesce(n, 0) AS num_datasets_referenced, query_cost_usd
        FROM js LEFT JOIN (SELECT event_id, count(*) AS n FROM dataset_refs GROUP BY 1) USING (event_id)""",
        DATASET_REFS,
    ),
    "user_daily_base": sql(f"SELECT {SCALAR_VIEW} FROM base", BASE),
    "main_user_stats": sql(f"SELECT {SCALAR_VIEW} FROM main_days", MAIN),
    "table_costs": sql(
        f"SELECT {K}, table_name, table_project, table_dataset, table_id, query_count, is_rebuild_operation, "
        f"{whole('bytes_processed')}, {whole('bytes_billed')}, table_cost_usd FROM tc",
        FULL_REFS,
        TABLES,
    ),
    "dataset_costs_from_tables": sql(
        f"SELECT {K}, dataset, query_count, {whole('bytes_processed')}, {whole('bytes_billed')}, "
        "dataset_cost_usd, rebuild_operations FROM dc",
        FULL_REFS,
        TABLES,
        DATASETS,
    ),
    "dataset_costs_direct": sql(
        f"SELECT {K}, dataset, query_count, {whole('bytes_processed')}, {whole('bytes_billed')}, dataset_cost_usd FROM direct",
        DATASET_REFS,
        DIRECT,
    ),
    "hourly": sql(f"SELECT {K}, hour_of_day, {SCALARS} FROM hours", HOURS),
    "weekday": sql(
        f"SELECT {K}, day_of_week, query_count, total_bytes_billed, estimated_cost_usd FROM weekdays", WEEKDAYS
    ),
    "mart_scalars": sql(
        f"""SELECT {SCALAR_VIEW}, h.hourly_breakdown_length, CASE WHEN {MATCHED} THEN 1 END::BIGINT AS daily_breakdown_length,
        d.dataset_costs_length, t.table_costs_length, q.recent_queries_length
        FROM base
        LEFT JOIN (SELECT date, project_id, user_email, count(*) AS hourly_breakdown_length FROM hours GROUP BY ALL) h USING (date, project_id, user_email)
        LEFT JOIN (SELECT date, project_id, user_email, count(*) AS dataset_costs_length FROM mart_datasets GROUP BY ALL) d USING (date, project_id, user_email)
        LEFT JOIN (SELECT date, project_id, user_email, count(*) AS table_costs_length FROM mart_tables GROUP BY ALL) t USING (date, project_id, user_email)
        LEFT JOIN (SELECT date, project_id, user_email, count(*) AS recent_queries_length FROM mart_queries GROUP BY ALL) q USING (date, project_id, user_email)""",
        FULL_REFS, BASE, HOURS, TABLES, DATASETS, MART_TABLES, MART_DATASETS, MART_QUERIES,
    ),
    "mart_hourly": sql(
        f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY hour_of_day) AS rank, hour_of_day, "
        f"query_count AS hourly_queries, estimated_cost_usd AS hourly_cost FROM hours WHERE {MATCHED}",
        HOURS,
    ),
    "mart_weekday": sql(
        f"SELECT {K}, CAST(1 AS BIGINT) AS rank, day_of_week, query_count AS daily_queries, "
        f"estimated_cost_usd AS daily_cost FROM weekdays WHERE {MATCHED}",
        WEEKDAYS,
    ),
    "mart_dataset_costs": sql(
        f"SELECT {K}, rank, dataset, {whole('bytes_processed')}, {whole('bytes_billed')}, dataset_cost_usd, "
        "rebuild_operations FROM mart_datasets",
        FULL_REFS, TABLES, DATASETS, MART_DATASETS,
    ),
    "mart_table_costs_top100": sql(
        f"SELECT {K}, rank, table_name, table_id, table_project || '.' || table_dataset AS dataset_name, "
        f"{whole('bytes_processed')}, {whole('bytes_billed')}, table_cost_usd, is_rebuild_operation, "
        "CASE WHEN is_rebuild_operation THEN table_cost_usd ELSE 0 END AS rebuild_cost_usd, "
        "CASE WHEN NOT is_rebuild_operation THEN table_cost_usd ELSE 0 END AS incremental_cost_usd, "
        "CAST(CASE WHEN is_rebuild_operation THEN 1 ELSE 0 END AS BIGINT) AS rebuild_count FROM mart_tables",
        FULL_REFS, TABLES, MART_TABLES,
    ),
    "mart_recent_top100": sql(
        f"SELECT {K}, rank, job_id, strftime(creation_time, '%Y-%m-%d %H:%M:%S') AS timestamp, statement_type, priority, "
        "total_bytes_processed, query_cost_usd, execution_time_seconds, cache_hit, error_reason IS NOT NULL AS has_error, "
        "substr(query, 1, 1000) AS query_text FROM mart_queries",
        MART_QUERIES,
    ),
    "main_cost_table": sql(
        f"""SELECT {SCALAR_VIEW}, coalesce(n, 0) AS dataset_costs_length FROM main_days
        LEFT JOIN (SELECT date, project_id, user_email, count(*) AS n FROM main_datasets GROUP BY ALL) USING (date, project_id, user_email)""",
        DATASET_REFS, MAIN, DIRECT, MAIN_DATASETS,
    ),
    "main_dataset_costs": sql(
        f"SELECT {K}, rank, dataset, {whole('bytes_processed')}, {whole('bytes_billed')}, dataset_cost_usd FROM main_datasets",
        DATASET_REFS, DIRECT, MAIN_DATASETS,
    ),
    "daily_summary": sql(
        f"""SELECT date, project_id, CAST(sum(query_count) AS BIGINT) AS total_queries,
        CAST(sum(cache_hit_count) AS BIGINT) AS total_cache_hits, CAST(sum(error_count) AS BIGINT) AS total_errors,
        CAST(sum(total_bytes_processed) AS BIGINT) AS total_bytes_processed,
        CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed,
        round(sum(estimated_cost_usd), 2) AS total_estimated_cost_usd,
        round(sum(slot_hours) + 1e-9, 6) AS total_slot_hours,
        round(avg(cache_hit_percentage) + 1e-9, 2) AS avg_cache_hit_percentage FROM main_days GROUP BY 1, 2""",
        MAIN,
    ),
    "dataset_summary": sql(
        """SELECT date, project_id, dataset_name,
        CAST(count(DISTINCT user_email || coalesce(service_account, '')) AS BIGINT) AS unique_users,
        CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS total_bytes_processed,
        CAST(round(sum(bytes_billed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS total_bytes_billed,
        round(sum(dataset_cost_usd), 2) AS total_cost_usd,
        CAST(least(10, count(DISTINCT user)) AS BIGINT) AS top_users_length FROM usage GROUP BY 1, 2, 3""",
        DATASET_REFS, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "dataset_top_users": sql(
        """SELECT *, row_number() OVER (PARTITION BY date, project_id, dataset_name
                                        ORDER BY user_cost_usd DESC NULLS LAST, user NULLS FIRST) AS rank
        FROM (SELECT date, project_id, dataset_name, user, round(sum(dataset_cost_usd), 2) AS user_cost_usd,
                     CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS user_bytes_processed FROM usage GROUP BY 1, 2, 3, 4)
        QUALIFY rank <= 10""",
        DATASET_REFS, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "account_summary": sql(
        """SELECT date, project_id, service_account, CAST(sum(query_count) AS BIGINT) AS total_queries,
        CAST(sum(total_bytes_processed) AS BIGINT) AS total_bytes_processed,
        CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed,
        round(sum(estimated_cost_usd), 2) AS total_cost_usd, coalesce(any_value(n), 0) AS top_datasets_length
        FROM main_days LEFT JOIN (SELECT date, project_id, service_account, least(10, count(DISTINCT dataset_name)) AS n
                                  FROM usage GROUP BY ALL) USING (date, project_id, service_account)
        WHERE service_account IS NOT NULL GROUP BY 1, 2, 3""",
        DATASET_REFS, MAIN, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "account_top_datasets": sql(
        """SELECT *, row_number() OVER (PARTITION BY date, project_id, service_account
                                        ORDER BY dataset_cost_usd DESC NULLS LAST, dataset_name) AS rank
        FROM (SELECT date, project_id, service_account, dataset_name, round(sum(dataset_cost_usd), 2) AS dataset_cost_usd,
                     CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS dataset_bytes_processed
              FROM usage WHERE service_account IS NOT NULL GROUP BY 1, 2, 3, 4)
        QUALIFY rank <= 10""",
        DATASET_REFS, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "user_dataset_attribution": sql(ATTRIBUTION, DATASET_REFS, DIRECT, MAIN_DATASETS, USAGE),
    "report_period_14": sql(f"SELECT {K}, query_count FROM base WHERE date >= '2024-01-17'", BASE),
    "summary_metrics": sql(
        "SELECT round(sum(estimated_cost_usd), 2) AS total_cost_usd, "
        "round(sum(total_bytes_processed) / power(1024, 4), 2) AS total_terabytes, "
        "CAST(sum(query_count) AS BIGINT) AS total_queries FROM base",
        BASE,
    ),
    "cost_trend": sql(
        "SELECT date, round(sum(estimated_cost_usd), 2) AS cost_usd FROM base GROUP BY 1 ORDER BY 1", BASE
    ),
    "top_spenders": sql(SPENDERS, BASE),
    "cache_split": sql(
        f"SELECT round({ratio('h', 'n')} + 1e-9, 6) AS cache_hit_pct, "
        f"round(100.0::DOUBLE - {ratio('h', 'n')} + 1e-9, 6) AS cache_miss_pct "
        "FROM (SELECT sum(cache_hit_count) AS h, sum(query_count) AS n FROM base)",
        BASE,
    ),
    "query_history": sql(_history(HISTORY_ALL), BASE, MART_QUERIES),
    "query_history_fallback": sql(
        _history(HISTORY_OLD), FULL_REFS, BASE, TABLES, DATASETS, MART_DATASETS, MART_QUERIES
    ),
    "dataset_ranking": sql(
        f"SELECT dataset, {whole('bytes_processed')}, cost_usd, "
        f"round(least({ratio('cost_usd', 'total')}, 100.0::DOUBLE) + 1e-9, 4) AS pct_of_total FROM ranking, total",
        FULL_REFS, BASE, TABLES, DATASETS, MART_DATASETS, RANKING,
    ),
    "table_cost_totals": sql("SELECT * FROM table_totals", FULL_REFS, BASE, TABLES, MART_TABLES, TABLE_TOTALS),
    "table_rebuild_report": sql(
        f"""SELECT * EXCLUDE (is_rebuild_operation), round({ratio('rebuild_cost', 'total_cost')} + 1e-9, 4) AS rebuild_percent,
        CASE WHEN {ratio('rebuild_cost', 'total_cost')} > 80 THEN 'danger'
             WHEN {ratio('rebuild_cost', 'total_cost')} > 50 THEN 'warning' ELSE '' END AS severity
        FROM table_totals ORDER BY total_cost DESC, table_name LIMIT 100""",
        FULL_REFS, BASE, TABLES, MART_TABLES, TABLE_TOTALS,
    ),
    "user_dataset_report": sql(
        f"""SELECT user, dataset, is_service_account, cost_usd, bytes_processed, split_part(user, '@', 1) AS user_display,
        CASE WHEN is_service_account THEN 'Service Account' ELSE 'User' END AS user_type
        FROM (SELECT {SPENDER} AS user, dataset, bool_or({IS_ACCOUNT}) AS is_service_account,
                     round(sum(dataset_cost_usd), 2) AS cost_usd, CAST(round(sum(bytes_processed::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS bytes_processed
              FROM mart_datasets GROUP BY 1, 2)
        ORDER BY cost_usd DESC, user, dataset LIMIT 100""",
        FULL_REFS, TABLES, DATASETS, MART_DATASETS,
    ),
    "hourly_pattern": sql(
        "SELECT hour_of_day AS hour, CAST(sum(query_count) AS BIGINT) AS queries, round(sum(estimated_cost_usd), 2) AS cost_usd, "
        f"hour_of_day || ':00' AS label FROM hours WHERE {MATCHED} GROUP BY 1 ORDER BY 1",
        HOURS,
    ),
    "weekday_pattern": sql(
        "SELECT day_of_week AS weekday, CAST(sum(query_count) AS BIGINT) AS queries, round(sum(estimated_cost_usd), 2) AS cost_usd, "
        f"{WEEKDAY_NAMES}[day_of_week] AS label FROM weekdays WHERE {MATCHED} GROUP BY 1 ORDER BY 1",
        WEEKDAYS,
    ),
    "project_list": sql("SELECT id, name FROM projects", PROJECTS),
    "enabled_project_jobs": sql(
        "SELECT project_id, CAST(count(*) AS BIGINT) AS jobs FROM jobs JOIN watched ON id = project_id GROUP BY 1",
        PROJECTS,
    ),
    "project_checks": sql(
        """SELECT index, 'id_required' AS rule, 'project ' || index || ' has no id' AS message FROM projects WHERE id IS NULL
        UNION ALL SELECT index, 'name_required', 'project ' || index || ' has no name' FROM projects WHERE name IS NULL""",
        PROJECTS,
    ),
    "settings_checks": """
        SELECT p_partkey AS index, 'historyDays_positive' AS rule, 'historyDays must be above zero' AS message FROM part WHERE p_size <= 10
        UNION ALL SELECT p_partkey, 'costPerTerabyte_positive', 'costPerTerabyte must be above zero' FROM part WHERE p_retailprice - 1000 <= 0
        UNION ALL SELECT p_partkey, 'refreshInterval_positive', 'refreshInterval must be above zero' FROM part WHERE p_partkey % 2 = 0 AND p_size <= 0""",
    "run_totals": sql("SELECT * FROM totals", PROJECTS, BASE, RUNS),
    "run_response": sql(
        """SELECT project, true AS success, records, total_cost, NULL::VARCHAR AS error FROM totals
        UNION ALL SELECT id, false, CAST(0 AS BIGINT), 0.0::DOUBLE, 'log not readable' FROM projects WHERE disabled AND id IS NOT NULL""",
        PROJECTS, BASE, RUNS,
    ),
    "monitoring_run": sql(
        "SELECT *, '2024-01-31_00-00-00' AS run_ts, CAST(30 AS BIGINT) AS history_days, 5.0::DOUBLE AS price_per_tb, "
        "NULL::VARCHAR AS error FROM totals",
        PROJECTS, BASE, RUNS,
    ),
    "latest_snapshot": sql(
        f"""SELECT {SCALAR_VIEW}, snapshot_ts FROM snaps
        JOIN (SELECT project_id AS p, max(snapshot_ts) AS newest FROM snaps GROUP BY 1) ON p = project_id AND newest = snapshot_ts""",
        BASE, SNAPSHOT_ROWS,
    ),
    "retained_snapshots": sql(
        "SELECT snapshot_ts, project_id, CAST(count(*) AS BIGINT) AS records, round(sum(estimated_cost_usd), 2) AS cost_usd "
        "FROM snaps WHERE strptime(snapshot_ts, '%Y-%m-%d_%H-%M-%S') >= TIMESTAMP '2024-01-31' - INTERVAL 90 DAY GROUP BY 1, 2",
        BASE, SNAPSHOT_ROWS,
    ),
    "latest_run_summary": sql(
        "SELECT project, '2024-01-30_05-00-00' AS run_ts, records, total_cost, total_queries FROM totals",
        PROJECTS, BASE, RUNS,
    ),
    "upload_metadata": sql(
        f"SELECT {K}, estimated_cost_usd, 'scanledger' AS source, '2024-01-31_00-00-00' AS uploaded_at, project_id AS uploaded_project FROM base",
        BASE,
    ),
    "cost_by_team": _cost_by_tag("team", "Team"),
    "cost_by_owner": _cost_by_tag("owner", "Owner"),
    "cost_by_query_type": _cost_by_tag("query_type", "Query Type"),
    "tag_fields": sql(
        f"SELECT job_id, {_tag('Query for project')} AS tag_project, {_tag('Team')} AS tag_team, {_tag('Owner')} AS tag_owner, "
        f"NULL::VARCHAR AS tag_purpose, {_tag('Query ID')} AS tag_query_id, {_tag('Query Type')} AS tag_query_type FROM js"
    ),
    "scan_cost_estimate": sql(
        "SELECT table_id, total_bytes_processed, round(total_bytes_processed / power(1024, 4) + 1e-9, 6) AS terabytes_processed, "
        "round(total_bytes_processed / power(1024, 4) * 5 + 1e-9, 6) AS estimated_cost_usd FROM sizes",
        SIZES,
    ),
    "what_if_cost": sql(
        "SELECT table_id, round(total_bytes_processed / power(1024, 4), 2) AS estimated_tb, "
        "round(round(total_bytes_processed / power(1024, 4), 2) * 5, 2) AS estimated_cost_usd FROM sizes",
        SIZES,
    ),
    "partition_filter": sql("SELECT job_id, date, total_bytes_billed FROM js WHERE date >= '2024-01-15'"),
    "incremental_build": sql(
        "SELECT date, CAST(count(*) AS BIGINT) AS jobs, CAST(sum(total_bytes_billed) AS BIGINT) AS total_bytes_billed "
        "FROM js WHERE date > '2024-01-20' GROUP BY 1"
    ),
    "exploration_limit": sql(
        "SELECT job_id, strftime(creation_time, '%Y-%m-%d %H:%M:%S') AS creation_time FROM js ORDER BY job_id LIMIT 1000"
    ),
    "display_formats": sql(
        f"""SELECT job_id, {_display_bytes('total_bytes_processed')} AS bytes_text,
        '$' || format('{{:,.2f}}', round(total_bytes_billed / 1e6, 2)) AS currency_text,
        CASE WHEN total_bytes_processed = 0 THEN '0.0%'
             ELSE printf('%.1f', round(least(total_bytes_billed / total_bytes_processed * 100.0::DOUBLE, 100.0::DOUBLE), 1)) || '%' END AS share_text,
        strftime(creation_time, '%-m/%-d/%Y') AS short_date,
        strftime(creation_time, '%-m/%-d/%Y %I:%M %p') AS medium_date,
        strftime(creation_time, '%-m/%-d/%Y %-I:%M:%S %p') AS long_date FROM js"""
    ),
    "display_labels": sql(
        f"""SELECT job_id, {SPENDER} AS spender,
        CASE WHEN {IS_ACCOUNT} THEN regexp_replace(split_part({SPENDER}, '@', 1), 'service-', 'SA:')
             ELSE split_part({SPENDER}, '@', 1) END AS display_name,
        {TEXT_DATASET} AS dataset_in_text, hour_of_day || ':00' AS hour_label, {WEEKDAY_NAMES}[day_of_week] AS weekday_label,
        CASE WHEN day_of_week IN (1, 7) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS weekend_factor,
        ((total_bytes_processed + 1048575) // 1048576) * 1048576 AS granule_bytes,
        round(total_bytes_processed / power(1024, 4), 2) AS terabytes,
        round(total_bytes_processed / power(1024, 3), 2) AS gigabytes FROM js"""
    ),
    "displayed_datasets": sql(
        f"""SELECT dataset, {_display_bytes('bytes_processed')} AS data, '$' || format('{{:,.2f}}', cost_usd) AS cost,
        printf('%.1f', round(least(cost_usd / total * 100.0::DOUBLE, 100.0::DOUBLE), 1)) || '%' AS share FROM ranking, total""",
        FULL_REFS, BASE, TABLES, DATASETS, MART_DATASETS, RANKING,
    ),
    "alert_daily_cost": sql(DAILY_ALERT),
    "alert_failures": sql(FAILURE_ALERT),
    "alert_any": sql(f"{DAILY_ALERT} UNION ALL {FAILURE_ALERT}"),
    "alert_stream": sql(f"{DAILY_ALERT} UNION ALL {FAILURE_ALERT}"),
    "stored_tables": sql(
        "SELECT date, CAST(count(*) AS BIGINT) AS records, round(sum(estimated_cost_usd), 2) AS cost_usd FROM main_days GROUP BY 1",
        MAIN,
    ),
    "checked_run": sql(
        """SELECT p.id AS project, coalesce(broken, 0) = 0 AS success,
        CASE WHEN coalesce(broken, 0) = 0 THEN CAST(count(b.date) AS BIGINT) ELSE 0 END AS records,
        CASE WHEN coalesce(broken, 0) = 0 THEN coalesce(round(sum(b.estimated_cost_usd), 2), 0.0) ELSE 0.0 END AS total_cost,
        CAST(broken AS BIGINT) AS broken_rows
        FROM (SELECT DISTINCT project_id AS id FROM jobs UNION SELECT id FROM watched) p
        LEFT JOIN base b ON b.project_id = p.id
        LEFT JOIN (SELECT project_id, count(*) AS broken FROM jobs WHERE project_id = 'proj-1' AND event_id % 701 = 0 GROUP BY 1) x ON x.project_id = p.id
        GROUP BY p.id, broken""",
        PROJECTS, BASE,
    ),
    "scheduled_run": sql(
        """SELECT project, true AS success, records, total_cost, NULL::VARCHAR AS error,
        CASE WHEN records > 0 THEN 'scanledger' END AS source, CASE WHEN records > 0 THEN '2024-01-31_00-00-00' END AS uploaded_at,
        nullif(records, 0) AS uploaded FROM totals""",
        PROJECTS, BASE, RUNS,
    ),
    "project_run": sql("SELECT *, NULL::VARCHAR AS error FROM totals WHERE project = 'proj-2'", PROJECTS, BASE, RUNS),
    "newest_folders": sql(
        f"""SELECT {SCALAR_VIEW}, snapshot_ts FROM snaps
        JOIN (SELECT project_id AS p, max(snapshot_ts) AS newest FROM snaps GROUP BY 1) ON p = project_id AND newest = snapshot_ts""",
        BASE, SNAPSHOT_ROWS,
    ),
    "replaced_range": sql(
        "SELECT date, CAST(count(*) AS BIGINT) AS records, round(sum(estimated_cost_usd), 2) AS cost_usd FROM main_days "
        "WHERE date <> '2024-01-22' AND date >= '2024-01-05' GROUP BY 1",
        MAIN,
    ),
    "small_job_share": sql(
        """SELECT b.date, b.project_id, b.user_email, b.query_count, b.estimated_cost_usd,
        coalesce(m.query_count, 0) AS large_queries, coalesce(m.estimated_cost_usd, 0.0) AS large_cost
        FROM base b LEFT JOIN main_days m USING (date, project_id, user_email) WHERE b.user_email IS NOT NULL AND b.date >= '2024-01-10'""",
        BASE, MAIN,
    ),
    "alert_changes": sql(f"{DAILY_ALERT} UNION ALL {FAILURE_ALERT}"),
    "newest_first": sql(
        "SELECT row_number() OVER (ORDER BY creation_time DESC, job_id) AS rank, job_id, "
        "strftime(creation_time, '%Y-%m-%d %H:%M:%S.%f') AS creation_time, total_bytes_billed FROM js"
    ),
    "history_order": sql(
        f"""SELECT row_number() OVER (ORDER BY queried DESC, bytes DESC, dataset, user) AS rank, dataset, user,
        strftime(queried, '%Y-%m-%d %H:%M:%S') AS last_queried
        FROM (SELECT dataset, user, max(queried) AS queried, sum(bytes::DECIMAL(38,3)) AS bytes FROM ({HISTORY_ALL}) GROUP BY dataset, user)""",
        BASE, MART_QUERIES,
    ),
    "config_checks": sql(
        """SELECT config, i AS index, 'id_required' AS rule, 'project ' || i || ' has no id' AS message FROM listed WHERE id IS NULL
        UNION ALL SELECT config, i, 'name_required', 'project ' || i || ' has no name' FROM listed WHERE name IS NULL
        UNION ALL SELECT config, NULL, 'projects_required', 'no list of projects' FROM configs WHERE config % 10 = 7
        UNION ALL SELECT config, NULL, 'settings_required', 'no settings' FROM configs WHERE config % 10 = 3
        UNION ALL SELECT config, NULL, 'historyDays_positive', 'historyDays must be above zero' FROM configs WHERE config % 10 <> 3 AND config % 7 <= 1
        UNION ALL SELECT config, NULL, 'costPerTerabyte_positive', 'costPerTerabyte must be above zero' FROM configs WHERE config % 10 <> 3 AND config % 5 = 0
        UNION ALL SELECT config, NULL, 'refreshInterval_positive', 'refreshInterval must be above zero' FROM configs WHERE config % 10 <> 3 AND config = 0""",
        PROJECTS,
        """
configs AS (SELECT DISTINCT index // 50 AS config FROM projects),
listed AS (
  SELECT index // 50 AS config, id, name, row_number() OVER (PARTITION BY index // 50 ORDER BY index) - 1 AS i FROM projects WHERE index // 50 % 10 <> 7
)""",
    ),
    "table_set": sql(
        f"""SELECT 'main' AS table, CAST(count(*) AS BIGINT) AS records, round(sum(estimated_cost_usd), 2) AS cost_usd FROM main_days
        UNION ALL SELECT 'daily', count(*), round(sum(c), 2) FROM (SELECT sum(estimated_cost_usd) AS c FROM main_days GROUP BY date, project_id)
        UNION ALL SELECT 'datasets', count(*), round(sum(c), 2) FROM (SELECT sum(dataset_cost_usd) AS c FROM usage GROUP BY date, project_id, dataset_name)
        UNION ALL SELECT 'accounts', count(*), round(sum(c), 2) FROM (
            SELECT sum(estimated_cost_usd) AS c FROM main_days WHERE service_account IS NOT NULL GROUP BY date, project_id, service_account)
        UNION ALL SELECT 'attribution', count(*), round(sum(cost_usd), 2) FROM ({ATTRIBUTION})""",
        DATASET_REFS, MAIN, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "catalog_sizes": sql(
        f"""SELECT 'cost_monitoring' AS table_id, CAST(count(*) AS BIGINT) AS row_count, true AS priced FROM main_days
        UNION ALL SELECT 'user_dataset_attribution', count(*), true FROM ({ATTRIBUTION})""",
        DATASET_REFS, MAIN, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "sketched_users": sql(
        "SELECT dataset_name, CAST(count(DISTINCT user_email) AS BIGINT) AS users, true AS within_error "
        "FROM usage WHERE date BETWEEN '2024-01-05' AND '2024-01-25' GROUP BY 1",
        DATASET_REFS, DIRECT, MAIN_DATASETS, USAGE,
    ),
    "report_rows": sql(
        f"""SELECT report, key, other, bool_or(account) AS account, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(hits) AS BIGINT) AS hits,
        CAST(round(sum(bytes::DECIMAL(38,3))::DOUBLE) AS BIGINT) AS bytes, round(sum(cost), 2) AS cost FROM ({REPORT_PARTS}) GROUP BY 1, 2, 3""",
        FULL_REFS, BASE, TABLES, DATASETS, MART_DATASETS, HOURS, WEEKDAYS,
    ),
    "report_bundle": sql(
        f"""SELECT 'summary_metrics' AS report, CAST(1 AS BIGINT) AS records, round(sum(estimated_cost_usd), 2) AS cost_usd FROM base
        UNION ALL SELECT 'cost_trend', count(DISTINCT date), round(sum(estimated_cost_usd), 2) FROM base
        UNION ALL SELECT 'top_spenders', count(*), round(sum(user_cost + service_account_cost), 2) FROM ({SPENDERS})
        UNION ALL SELECT 'dataset_ranking', count(*), round(sum(cost_usd), 2) FROM ranking
        UNION ALL SELECT 'user_dataset_report', count(*), round(sum(cost), 2) FROM (
            SELECT round(sum(dataset_cost_usd), 2) AS cost FROM mart_datasets GROUP BY {SPENDER}, dataset ORDER BY cost DESC, {SPENDER}, dataset LIMIT 100)
        UNION ALL SELECT 'hourly_pattern', count(DISTINCT hour_of_day), round(sum(estimated_cost_usd), 2) FROM hours WHERE {MATCHED}
        UNION ALL SELECT 'weekday_pattern', count(DISTINCT day_of_week), round(sum(estimated_cost_usd), 2) FROM weekdays WHERE {MATCHED}""",
        FULL_REFS, BASE, TABLES, DATASETS, MART_DATASETS, HOURS, WEEKDAYS, RANKING,
    ),
    "stored_user_days": sql(f"SELECT {SCALAR_VIEW}, true AS without_texts FROM base", BASE),
    "configured_settings": sql(
        "SELECT CAST(count(*) AS BIGINT) AS enabled, CAST(count(id) AS BIGINT) AS with_id, 6.25::DOUBLE AS \"costPerTerabyte\", "
        "24.0::DOUBLE AS \"refreshInterval\" FROM projects WHERE NOT coalesce(disabled, false)",
        PROJECTS,
    ),
}
