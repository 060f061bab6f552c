"""Queries of sources and sinks (S)."""

from datetime import datetime

from pyspark.sql import functions as F

from stmtwarden.registry import query
from stmtwarden.session import fresh_dir
from stmtwarden.sources import files as SF
from stmtwarden.sources import pull as P

c = F.col
NOW = datetime(2024, 1, 20)


@query("s1_slow_log_window", """
SELECT id, ts, sql_text FROM statement_log WHERE ts > TIMESTAMP '2024-01-19 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return P.log_window(t.statement_log, NOW).select("id", "ts", "sql_text")


@query("s1_slow_log_window_next", """
SELECT id, ts FROM statement_log WHERE ts > TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return P.log_window(t.statement_log, NOW, last_end=datetime(2024, 1, 5, 12)).select("id", "ts")


@query("s2_slow_log_window_vendor", """
SELECT id, ts, schema_name AS db, query_time AS seconds FROM statement_log
WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND project_id = 'p1'""")
def _(t):
    log = t.statement_log.filter("project_id = 'p1'")
    mapping = {"id": "id", "ts": "ts", "db": "schema_name", "seconds": "query_time"}
    return P.log_window(log, NOW, first_hours=24 * 7, mapping=mapping, refilter=False)


@query("s3_audit_log_window", """
SELECT id, ts, db_user FROM statement_log WHERE ts > TIMESTAMP '2023-10-22 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    return P.log_window(t.statement_log, NOW, first_hours=24 * 90).select("id", "ts", "db_user")


@query("s4_processlist_filter", """
SELECT sid, sql_text FROM sessions WHERE seconds_in_call >= 100 AND sql_text <> '' AND sid <> 777
  AND schema_name NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys')""")
def _(t):
    return P.processlist_filter(t.sessions, 100, own_id=777).select("sid", "sql_text")


@query("s5_schema_snapshot", """
SELECT table_name AS meta_name, 'table' AS meta_type, CONCAT('CREATE TABLE `', table_name, '` (', STRING_AGG(
  CONCAT('`', column_name, '` ', data_type, '(', column_width, ')', CASE WHEN is_nullable THEN '' ELSE ' NOT NULL' END), ', ' ORDER BY ordinal), ')') AS sql_text
FROM schema_columns GROUP BY 1
UNION ALL SELECT CONCAT('v', s_suppkey), 'view', CONCAT('CREATE VIEW `v', s_suppkey, '` AS SELECT ', s_name) FROM supplier""")
def _(t):
    views = t.sql("SELECT CONCAT('v', s_suppkey) AS view_name, CONCAT('SELECT ', s_name) AS definition FROM {supplier}")
    return P.schema_snapshot(t.schema_columns, views)


_ACTIVE = """SELECT s.*, u.username FROM statement_stats s JOIN db_users u ON u.user_id = s.user_id
  WHERE s.last_active_time >= TIMESTAMP '1998-01-01' - INTERVAL 525600 MINUTE AND s.executions > 0 AND u.username NOT IN ('SYS', 'SYSTEM')"""


@query("s6_top_sql_by_metric", f"WITH a AS ({_ACTIVE}) " + " UNION ALL ".join(
    f"SELECT sql_id, username, {m} AS value, '{m}' AS metric FROM (SELECT * FROM a ORDER BY {m} DESC, sql_id LIMIT 10) x{n}"
    for n, m in enumerate(P.TOP_METRICS)))
def _(t):
    top = P.top_sql_by_metric(t.statement_stats, t.db_users, "1998-01-01", 525600, ["SYS", "SYSTEM"])
    value = F.coalesce(*[F.when(c("metric") == m, c(m)) for m in P.TOP_METRICS])
    return top.select("sql_id", "username", value.alias("value"), "metric")


@query("s7_slow_sql_by_avg", f"""
SELECT sql_id, username, elapsed_time / executions AS elapsed_avg FROM ({_ACTIVE}) a WHERE elapsed_time / executions > 1000
ORDER BY 3 DESC, 1 LIMIT 100""")
def _(t):
    return P.slow_sql_by_avg(t.statement_stats, t.db_users, "1998-01-01", 525600, 1000, ["SYS", "SYSTEM"]).select("sql_id", "username", "elapsed_avg")


@query("s8_active_sessions", """
SELECT s.sid, s.username, q.sql_text AS full_text, s.seconds_in_call FROM sessions s
LEFT JOIN statement_stats q ON q.sql_id = s.sql_id AND q.child_number = s.child_number
WHERE s.session_type = 'USER' AND s.status = 'ACTIVE' AND s.sid <> 42 AND s.seconds_in_call >= 30""")
def _(t):
    return P.active_sessions(t.sessions, t.statement_stats, own_id=42, min_seconds=30).select("sid", "username", "full_text", "seconds_in_call")


@query("s9_sql_file_scan", r"""
WITH p AS (SELECT path, UNNEST(string_split_regex(content, ';[ \t\r]*(\n|$)')) AS piece,
  generate_subscripts(string_split_regex(content, ';[ \t\r]*(\n|$)'), 1) - 1 AS position FROM sql_scripts),
q AS (SELECT *, len(piece) - len(replace(piece, CHR(10), '')) AS lines, regexp_replace(piece, '^\s+|[\s;]+$', '', 'g') AS sql_text FROM p),
r AS (SELECT *, SUM(lines + 1) OVER (PARTITION BY path ORDER BY position) - lines AS first_line,
  len(regexp_extract(piece, '^\s*')) - len(replace(regexp_extract(piece, '^\s*'), CHR(10), '')) AS skipped FROM q)
SELECT path, sql_text, CAST(first_line + skipped AS BIGINT) AS start_line FROM r WHERE sql_text <> ''""")
def _(t):
    return SF.sql_file_scan(t.sql_scripts).select("path", "sql_text", "start_line")


@query("s10_mapper_xml_scan", """
SELECT path, 'select' AS tag, regexp_extract(content, '<select[^>]*>(.*?)</select>', 1) AS sql_text FROM mapper_files
UNION ALL SELECT path, 'update', replace(regexp_extract(content, '<update[^>]*>(.*?)</update>', 1), '&lt;', '<') FROM mapper_files""")
def _(t):
    return SF.mapper_xml_scan(t.mapper_files)


@query("s11_log_user_schema_filter", """
SELECT id, db_user, schema_name FROM statement_log WHERE db_user IN ('u1', 'u2', 'u3', 'u6') AND schema_name NOT IN ('db1')""")
def _(t):
    return P.log_user_schema_filter(t.statement_log, include_users=["u1", "u2", "u3", "u6"], exclude_schemas=["db1"]).select("id", "db_user", "schema_name")


@query("s12_lock_wait_load", """
SELECT id, scan_plan_id, granted_trx, waiting_trx, lock_type FROM lock_waits WHERE NOT (scan_plan_id = 2 AND lock_type = 'TABLE')""")
def _(t):
    bag = F.to_json(F.struct("granted_trx", "waiting_trx", "lock_type", "object_name"))
    rows = SF.lock_wait_load(t.lock_waits.select("id", "scan_plan_id", bag.alias("info")))
    path = fresh_dir(t.spark, "lock_waits")
    SF.write_lock_waits(rows, path)
    # The next load of plan 2 brings fewer rows; the other plans stay.
    SF.write_lock_waits(rows.filter("scan_plan_id = 2 AND lock_type = 'RECORD'"), path)
    return t.spark.read.parquet(path).select("id", c("scan_plan_id").cast("bigint"), "granted_trx", "waiting_trx", "lock_type")


@query("s13_export_report", """
SELECT CAST(id AS VARCHAR) AS id, COALESCE(status, '') AS status, project_id FROM workflows""")
def _(t):
    rows = t.workflows.select("id", "status", "project_id", F.lit("  ").alias("blank"), F.lit(None).cast("string").alias("missing"))
    return SF.export_report(rows)
