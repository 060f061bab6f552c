"""Queries of the streaming jobs (T, A7): run until the input is used up.

Each is compared with the SQL of its batch twin.
"""

from pyspark.sql import functions as F

from stmtwarden.functions.text import fingerprint
from stmtwarden.lint import text_rules
from stmtwarden.operators import governance
from stmtwarden.plans import dialect as D
from stmtwarden.plans import lists as PL
from stmtwarden.plans.merge import _QUEUE
from stmtwarden.registry import query
from stmtwarden.session import fresh_dir
from stmtwarden.streaming import jobs as J
from stmtwarden.streaming import records as R
from stmtwarden.views import VIEWS, references

c = F.col


def log_stream(t):
    """The statement log view over the events table read as a stream."""
    events = J.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
    text = VIEWS["statement_log"]
    assert references(text) == ["events"]
    return t.spark.sql(text, events=events)


def _rolled_up(t):
    out, checkpoint = fresh_dir(t.spark, "rollup"), fresh_dir(t.spark, "rollup-checkpoint")
    J.stream_rollup(log_stream(t), out, checkpoint).awaitTermination()
    J.compact(t.spark, out, J.rolled_up)
    return J.current_records(t.spark, out)


_ROLLUP = f"SELECT sql_id, COUNT(*) AS counter, ARG_MAX(sql_text, id) AS sql_text, MAX(ts) AS ts FROM ({_QUEUE}) q GROUP BY 1"


@query("t1_stream_rollup", _ROLLUP)
def _(t):
    return _rolled_up(t).select("sql_id", "counter", "sql_text", "ts")


@query("a7_queue_drain", f"""
SELECT COALESCE(a.sql_id, b.sql_id) AS sql_id, COALESCE(a.counter, b.counter) AS counter FROM ({_ROLLUP}) a
FULL JOIN (SELECT MD5(CONCAT('stored', s_suppkey)) AS sql_id, s_suppkey AS counter FROM supplier) b ON b.sql_id = a.sql_id""")
def _(t):
    from stmtwarden.operators.merge import record_upsert

    stored = t.sql("SELECT MD5(CONCAT('stored', s_suppkey)) AS sql_id, s_suppkey AS counter FROM {supplier}")
    return record_upsert(stored, _rolled_up(t).select("sql_id", "counter"))


_NEWEST = f"SELECT sql_id, ARG_MAX(sql_text, id) AS sql_text FROM ({_QUEUE}) q GROUP BY 1"
_LEVELS = "CASE level WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END"


@query("t2_stream_audit", f"""
WITH newest AS ({_NEWEST}), {D.text_features('newest')},
v AS ({D.violations('f3', text_rules.RULES, 'sql_id')}),
r AS (SELECT sql_id, MAX({_LEVELS}) AS k, COUNT(*) AS result_count FROM v GROUP BY 1)
SELECT n.sql_id, CASE COALESCE(k, 0) WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' ELSE 'normal' END AS audit_level,
  CASE WHEN k = 3 THEN 'high' ELSE '' END AS priority, COALESCE(result_count, 0) AS result_count FROM newest n LEFT JOIN r ON r.sql_id = n.sql_id""")
def _(t):
    out, checkpoint = fresh_dir(t.spark, "audit"), fresh_dir(t.spark, "audit-checkpoint")
    J.stream_audit(log_stream(t), out, checkpoint).awaitTermination()
    newest = J.newest_audits(t.spark, out)
    return newest.select("sql_id", "audit_level", "priority", F.size("audit_results").cast("bigint").alias("result_count"))


def _statements(t):
    return log_stream(t).select("*", F.array(F.expr(PL._END)).alias("endpoints"), fingerprint(c("sql_text")).alias("sql_fingerprint"))


def _blocked(t):
    kept, counts = fresh_dir(t.spark, "kept"), fresh_dir(t.spark, "counts")
    J.stream_blocklist(_statements(t), PL.blocklist(t), kept, counts, fresh_dir(t.spark, "blocklist-checkpoint")).awaitTermination()
    return kept, counts


@query("t3_stream_blocklist", f"SELECT id, ts FROM ({PL._BLOCKED}) x WHERE matched_id IS NULL")
def _(t):
    return J.read_batches(t.spark, _blocked(t)[0]).select("id", "ts")


@query("t3_stream_blocklist_counts", f"SELECT matched_id AS id, COUNT(*) AS matched_count, MAX(ts) AS last_match_time FROM ({PL._BLOCKED}) x WHERE matched_id IS NOT NULL GROUP BY 1")
def _(t):
    return J.blocklist_counts(t.spark, _blocked(t)[1]).withColumn("id", c("id").cast("int"))


@query("t4_stream_high_water", "SELECT id, ts, sql_text FROM statement_log")
def _(t):
    out = fresh_dir(t.spark, "high-water")
    J.stream_high_water(log_stream(t), out, fresh_dir(t.spark, "high-water-checkpoint")).awaitTermination()
    return J.read_batches(t.spark, out).select("id", "ts", "sql_text")


@query("t5_stream_window_counts", f"""
SELECT date_trunc('hour', ts) AS window_start, sql_id, COUNT(*) AS statement_count FROM ({_QUEUE}) q GROUP BY 1, 2""")
def _(t):
    out = fresh_dir(t.spark, "windows")
    queue = governance.queue_rows(log_stream(t), "slow_log", "1")
    J.stream_window_counts(queue, out, fresh_dir(t.spark, "windows-checkpoint")).awaitTermination()
    J.compact(t.spark, out, J.summed_windows)
    return J.window_counts(t.spark, out)


@query("t4_within_watermark", "SELECT id, ts, sql_text FROM statement_log")
def _(t):
    out = fresh_dir(t.spark, "within")
    J.stream_within_watermark(log_stream(t), out, fresh_dir(t.spark, "within-checkpoint")).awaitTermination()
    return J.read_batches(t.spark, out).select("id", "ts", "sql_text")


@query("t5_closed_windows", f"""
WITH q AS ({_QUEUE}), closed AS (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 2 HOUR AS upto FROM q)
SELECT date_trunc('hour', ts) AS window_start, sql_id, COUNT(*) AS statement_count FROM q WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT upto FROM closed) GROUP BY 1, 2""")
def _(t):
    out = fresh_dir(t.spark, "closed")
    queue = governance.queue_rows(log_stream(t), "slow_log", "1")
    J.stream_closed_windows(queue, out, fresh_dir(t.spark, "closed-checkpoint")).awaitTermination()
    return J.read_batches(t.spark, out)


_SPLIT, _FIRST, _SECOND = "2024-01-15", "2024-02-01", "2024-02-02"


@query("t2_audited_records", f"""
WITH newest AS (SELECT sql_id, COUNT(*) AS counter, MAX(ts) AS ts, ARG_MAX(sql_text, id) AS sql_text FROM ({_QUEUE}) q GROUP BY 1), {D.text_features('newest')},
v AS ({D.violations('f3', text_rules.RULES, 'sql_id')}),
r AS (SELECT sql_id, MAX({_LEVELS}) AS k FROM v GROUP BY 1)
SELECT n.sql_id, n.counter, CASE COALESCE(k, 0) WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' ELSE 'normal' END AS audit_level,
  CASE WHEN n.ts >= TIMESTAMP '{_SPLIT}' THEN TIMESTAMP '{_SECOND}' ELSE TIMESTAMP '{_FIRST}' END AS last_audit_time FROM newest n LEFT JOIN r ON r.sql_id = n.sql_id""")
def _(t):
    queue, path = fresh_dir(t.spark, "queue"), fresh_dir(t.spark, "records")
    rows = governance.queue_rows(t.statement_log, "slow_log", "1")
    late = c("ts") >= F.lit(_SPLIT).cast("timestamp_ntz")
    for batch, (part, now) in enumerate([(rows.where(~late), _FIRST), (rows.where(late), _SECOND)]):
        J.write_batch(J.rolled_up(part), queue, batch)
        R.drain(t.spark, queue, path, now)
        version = R.audit(t.spark, path, now)
    R.clean(t.spark, queue, path)
    return R.read(t.spark, path, version).select("sql_id", "counter", "audit_level", "last_audit_time")
