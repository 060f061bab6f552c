"""Queries of metric series and retention (X, R)."""

from pyspark.sql import functions as F

from stmtwarden.functions import keys
from stmtwarden.operators import intervals as I
from stmtwarden.operators import retention as R
from stmtwarden.operators import series as X
from stmtwarden.operators import waits as W
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query, texts
from stmtwarden.session import fresh_dir

c = F.col
_IN_RANGE = "record_begin_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


def plan_rows(t):
    return t.plan_rows.select(c("sql_id").alias("record_id"), "select_id", "access_type", "rows_est")


@query("x1_metric_range", f"""
SELECT m.record_id, m.metric_name, CAST(m.metric_value AS DOUBLE) AS metric_value, CAST(p.select_id AS VARCHAR) AS select_id, p.access_type, CAST(p.rows_est AS VARCHAR) AS rows_est FROM metric_records m
LEFT JOIN plan_rows p ON p.sql_id = m.record_id WHERE m.sql_id = 's5' AND {_IN_RANGE}""")
def _(t):
    found = X.metric_range(t.metric_records, plan_rows(t), "s5", "2024-01-05", "2024-01-25")
    shown = found.select("record_id", "metric_name", c("metric_value").cast("double").alias("metric_value"), "select_id", "access_type", "rows_est")
    return texts(shown, "select_id", "rows_est")


@query("x2_metric_peak", f"""
SELECT sql_id, record_id, record_begin_at, CAST(metric_value AS DOUBLE) AS metric_value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sql_id ORDER BY metric_value DESC, record_id DESC) AS k FROM metric_records
  WHERE metric_name = 'explain_cost' AND {_IN_RANGE}) x WHERE k = 1""")
def _(t):
    peaks = X.metric_peak(t.metric_records, "explain_cost", "2024-01-05", "2024-01-25")
    return peaks.withColumn("metric_value", c("metric_value").cast("double"))


def _queue(t):
    fp_free = keys.record_key(c("sql_text"), c("schema_name"))
    return t.statement_log.select("id", "ts", "sql_text", fp_free.alias("sql_id"), F.when(c("id") % 7 == 0, "schema_meta").otherwise("slow_log").alias("source"))


_QUERIES = f"SELECT id FROM statement_log WHERE id % 7 <> 0 AND {D.sql_kind('sql_text')} = 'DQL'"


def _cost(t):
    costs = t.events.select(c("event_id").alias("record_id"), c("value").alias("cost"))
    return X.cost_records(_queue(t), costs, plan_rows(t))


@query("x3_cost_record", f"SELECT s.id AS record_id, 1 AS execution_count, s.ts AS record_begin_at FROM statement_log s WHERE s.id IN ({_QUERIES})")
def _(t):
    return _cost(t)[0].select("record_id", "execution_count", "record_begin_at")


@query("x3_cost_value", f"""
SELECT event_id AS record_id, 'explain_cost' AS metric_name, CAST(value AS DOUBLE) AS metric_value FROM events WHERE event_id IN ({_QUERIES})""")
def _(t):
    return _cost(t)[1].withColumn("metric_value", c("metric_value").cast("double"))


@query("x3_cost_plan_rows", f"""
SELECT sql_id AS record_id, select_id, access_type, rows_est FROM plan_rows WHERE sql_id IN ({_QUERIES})""")
def _(t):
    return _cost(t)[2]


@query("x4_cost_trend", f"""
SELECT record_id, record_begin_at AS ts, CAST(metric_value AS DOUBLE) AS cost FROM metric_records
WHERE sql_id = 's8' AND metric_name = 'explain_cost' AND {_IN_RANGE}""")
def _(t):
    return X.cost_trend(t.metric_records, "s8", "2024-01-05", "2024-01-25").withColumn("cost", c("cost").cast("double"))


@query("x4_cost_trend_latest", f"""
SELECT record_id, record_begin_at AS ts, CAST(metric_value AS DOUBLE) AS cost FROM metric_records
WHERE sql_id = 's8' AND metric_name = 'explain_cost' AND {_IN_RANGE} ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def _(t):
    return X.cost_trend(t.metric_records, "s8", "2024-01-05", "2024-01-25", latest_only=True).withColumn("cost", c("cost").cast("double"))


@query("x5_workload_insight", """
SELECT date_trunc('hour', ts) AS window_start, instance_id, COUNT(*) AS statement_count,
  ROUND(CAST(SUM(CAST(query_time AS DECIMAL(20,4))) AS DOUBLE) / COUNT(*), 6) AS avg_time, MAX(query_time) AS max_time
FROM statement_log WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1, 2""")
def _(t):
    exact = t.statement_log.withColumn("query_time", c("query_time").cast("decimal(20,4)"))
    lines = X.workload_insight(exact, "2024-01-05", "2024-01-25", by=("instance_id",))
    return lines.select(
        "window_start", "instance_id", "statement_count", F.round(c("avg_time").cast("double"), 6).alias("avg_time"), c("max_time").cast("double").alias("max_time")
    )


@query("x5_counter_rate", """
SELECT id, instance_id, ROUND((n - LAG(n) OVER w) / ((epoch_us(ts) - LAG(epoch_us(ts)) OVER w) / 1000000), 6) AS rate
FROM (SELECT *, id * 3 + rows_examined AS n FROM statement_log) x WINDOW w AS (PARTITION BY instance_id ORDER BY ts, id)""")
def _(t):
    samples = t.statement_log.withColumn("questions", c("id") * 3 + c("rows_examined"))
    return X.counter_rate(samples, "instance_id", "questions").select("id", "instance_id", F.round("rate", 6).alias("rate"))


@query("x6_related_statements", """
SELECT id, sql_text, ts, query_time FROM statement_log WHERE ts BETWEEN TIMESTAMP '2024-01-15' - INTERVAL 3600 SECOND AND TIMESTAMP '2024-01-15' + INTERVAL 3600 SECOND""")
def _(t):
    return X.related_statements(t.statement_log, "2024-01-15", 3600)


@query("x7_related_transactions", """
SELECT granted_trx, waiting_trx, COUNT(*) AS wait_count, MIN(wait_started) AS first_wait, MAX(wait_started) AS last_wait,
  granted_trx IN (SELECT waiting_trx FROM lock_waits) AS blocker_waits FROM lock_waits GROUP BY 1, 2""")
def _(t):
    return X.related_transactions(t.lock_waits)


# One statement in 900 has no end yet.
_SPANS = "SELECT id, instance_id, ts AS begun, CASE WHEN id % 900 <> 0 THEN ts + INTERVAL '1' SECOND * rows_examined END AS ended FROM {statement_log}"
# Held locks, some of them for weeks.
_HELD = "SELECT event_id AS id, ts AS begun, CASE WHEN event_id % 500 = 0 THEN ts + INTERVAL '20' DAY ELSE ts + INTERVAL '1' SECOND * (event_id % 90) END AS ended FROM {events}"


_SPANS_SQL, _HELD_SQL = (text.replace("{", "").replace("}", "") for text in (_SPANS, _HELD))


@query("x5_active_trend", f"""
WITH s AS ({_SPANS_SQL}), e AS (SELECT instance_id, begun AS ts, 1 AS step FROM s UNION ALL SELECT instance_id, ended, -1 FROM s WHERE ended IS NOT NULL),
g AS (SELECT instance_id, ts, SUM(step) AS step FROM e GROUP BY 1, 2)
SELECT instance_id, ts, CAST(SUM(step) OVER (PARTITION BY instance_id ORDER BY ts) AS BIGINT) AS active FROM g""")
def _(t):
    return I.active_trend(t.sql(_SPANS), "instance_id", "begun", "ended")


@query("x6_overlapping_statements", f"""
WITH s AS ({_SPANS_SQL}), h AS ({_HELD_SQL})
SELECT h.id AS trx_id, COUNT(*) AS statement_count, MIN(s.id) AS first_id, MAX(s.id) AS last_id, CAST(SUM(s.id % 1009) AS BIGINT) AS id_check
FROM h JOIN s ON s.begun <= h.ended AND (s.ended IS NULL OR h.begun <= s.ended) GROUP BY 1""")
def _(t):
    s = c("id")
    totals = {"statement_count": ("sum", F.lit(1)), "first_id": ("min", s), "last_id": ("max", s), "id_check": ("sum", s % 1009)}
    found = I.overlapping(t.sql(_HELD), t.sql(_SPANS), ("id", "begun", "ended"), ("id", "begun", "ended"), totals)
    return found.withColumnRenamed("left_id", "trx_id")


@query("x7_blocking_chains", """
WITH RECURSIVE f AS (SELECT waiting_trx AS trx, FIRST(granted_trx ORDER BY wait_started, granted_trx) AS blocker FROM lock_waits GROUP BY 1),
walk AS (SELECT trx, blocker AS at_trx, 1 AS depth, [trx] AS seen FROM f
  UNION ALL SELECT w.trx, f.blocker, w.depth + 1, list_append(w.seen, w.at_trx) FROM walk w JOIN f ON f.trx = w.at_trx WHERE NOT list_contains(w.seen, w.at_trx)),
ends AS (SELECT trx, at_trx, depth, seen FROM walk WHERE at_trx NOT IN (SELECT trx FROM f) OR list_contains(seen, at_trx)),
told AS (SELECT trx, at_trx, depth, seen, list_contains(seen, at_trx) AS deadlocked, list_position(seen, at_trx) - 1 AS before FROM ends)
SELECT f.trx, f.blocker, CASE WHEN deadlocked THEN list_min(list_slice(seen, before + 1, len(seen))) ELSE at_trx END AS root_trx,
  CAST(CASE WHEN deadlocked THEN before ELSE depth END AS BIGINT) AS depth, deadlocked AND before = 0 AS in_cycle, deadlocked FROM told JOIN f USING (trx)""")
def _(t):
    return W.blocking_chains(t.lock_waits)


@query("r1_expired_workflows", """
SELECT id, status FROM workflows WHERE created_at < TIMESTAMP '1996-01-01' AND (status IN ('exec_failed', 'finished', 'canceled') OR status IS NULL)""")
def _(t):
    return R.expired_workflows(t.workflows, "1996-01-01").select("id", "status")


@query("r2_expired_tasks", """
SELECT id FROM tasks WHERE exec_start_at < TIMESTAMP '2025-01-01' AND id NOT IN (SELECT task_id FROM workflows WHERE status = 'finished')
  AND id NOT IN (SELECT task_id FROM audit_records WHERE creator = 'u5')""")
def _(t):
    tasks = t.tasks.withColumnRenamed("exec_start_at", "created_at")
    return R.expired_tasks(tasks, t.workflows.filter("status = 'finished'"), t.audit_records.filter("creator = 'u5'"), "2025-01-01").select("id")


@query("r3_expired_raw", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS removed_count FROM statement_log WHERE ts < TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1")
def _(t):
    return R.expired_raw(t.statement_log, "2024-01-10 12:00:00").withColumn("day", c("day").cast("string"))


@query("r3_expired_partitions", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10 12:00:00') AS removed_count,
  COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10 12:00:00') AS kept_count FROM statement_log GROUP BY 1""")
def _(t):
    path = fresh_dir(t.spark, "raw")
    R.store_by_day(t.statement_log, path)
    removed = R.expire_days(t.spark, path, "2024-01-10 12:00:00")
    kept = t.spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("kept_count"))
    n = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return removed.join(kept, "day", "full").select(c("day").cast("string"), n("removed_count"), n("kept_count"))


@query("r4_expired_files", """
SELECT f.id, f.file_name FROM (SELECT id, task_id, file_name, TIMESTAMP '2024-01-01' + CAST(id % 12 AS INTEGER) * INTERVAL 1 DAY AS created_at FROM audit_files) f
WHERE f.created_at < TIMESTAMP '2024-01-12' - INTERVAL 24 HOUR AND (f.created_at < TIMESTAMP '2024-01-12' - INTERVAL 7 DAY
  OR NOT EXISTS (SELECT 1 FROM workflows w WHERE w.task_id = f.task_id AND w.status = 'finished'))""")
def _(t):
    aged = t.audit_files.withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01' + CAST(id % 12 AS INT) * INTERVAL '1' DAY"))
    return R.expired_files(aged, t.workflows.filter("status = 'finished'"), "2024-01-12").select("id", "file_name")


@query("r5_orphan_cleanup", """
SELECT r.id, CASE WHEN r.id % 7 = 0 THEN TIMESTAMP '2024-01-05' WHEN NOT EXISTS (SELECT 1 FROM scan_plans p WHERE p.id = r.source_id AND NOT p.is_deleted) THEN TIMESTAMP '2024-02-01' END AS deleted_at
FROM sql_records r""")
def _(t):
    records = t.sql_records.withColumn("deleted_at", F.when(F.col("id") % 7 == 0, F.lit("2024-01-05").cast("timestamp_ntz")))
    return R.orphan_cleanup(records, t.scan_plans, "2024-02-01").select("id", "deleted_at")
