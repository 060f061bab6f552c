"""Queries of grouping and merging (A)."""

from pyspark.sql import functions as F

from stmtwarden.operators import merge as M
from stmtwarden.operators.governance import queue_rows
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query

c = F.col

_QUEUE = "SELECT *, " + D.json_md5(
    ProjectId="project_id", Fingerprint=D.fingerprint("sql_text"), Schema="schema_name", InstID="instance_id", Source="'slow_log'", AuditPlanID="'1'"
) + " AS sql_id FROM statement_log"


@query("a1_fingerprint_rollup", f"""
SELECT sql_id, COUNT(*) AS counter, ARG_MAX(sql_text, id) AS sql_text, MAX(ts) AS last_receive_timestamp FROM ({_QUEUE}) q GROUP BY 1""")
def _(t):
    rolled = M.fingerprint_rollup(queue_rows(t.statement_log, "slow_log", "1"))
    return rolled.select("sql_id", "counter", "sql_text", c("ts").alias("last_receive_timestamp"))


@query("a2_last_snapshot_wins", """
SELECT s.user_id AS sql_id, s.executions, s.elapsed_time, s.disk_reads, s.last_active_time AS ts FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY last_active_time DESC, sql_id DESC) AS k FROM statement_stats) s WHERE k = 1""")
def _(t):
    snaps = t.statement_stats.select(
        c("user_id").alias("sql_id"), c("sql_id").alias("id"), c("last_active_time").alias("ts"), "executions", "elapsed_time", "disk_reads"
    )
    return M.last_snapshot_wins(snaps, ["executions", "elapsed_time", "disk_reads"])


@query("a3_incremental_avg_max", """
SELECT instance_id, COUNT(*) AS n, ROUND(CAST(SUM(CAST(query_time AS DECIMAL(20,4))) AS DOUBLE) / COUNT(*), 6) AS average, MAX(query_time) AS maximum
FROM statement_log GROUP BY 1""")
def _(t):
    rows = t.statement_log.withColumn("query_time", c("query_time").cast("decimal(20,4)"))
    early = M.average_parts(rows.filter("ts < '2024-01-10'"), ["instance_id"], "query_time")
    late = M.average_parts(rows.filter("ts >= '2024-01-10'"), ["instance_id"], "query_time")
    return M.incremental_avg_max(early, late, ["instance_id"]).select(
        "instance_id", "n", F.round(c("average").cast("double"), 6).alias("average"), c("maximum").cast("double").alias("maximum")
    )


@query("a4_schema_snapshot_merge", """
SELECT COALESCE(a.k, b.k) AS meta_id, COALESCE(b.x, a.x) AS sql_text, b.k IS NULL AS deleted FROM
  (SELECT p_partkey AS k, CONCAT('old ', p_name) AS x FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN
  (SELECT p_partkey AS k, CONCAT('new ', p_name) AS x FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k""")
def _(t):
    # Every seventh stored object is already deleted, every fifth is not seen.
    stored = t.part.select(c("p_partkey").alias("meta_id"), F.concat(F.lit("old "), "p_name").alias("sql_text"), (c("p_partkey") % 7 == 0).alias("deleted"))
    seen = t.part.filter("p_partkey % 5 <> 0").select(c("p_partkey").alias("meta_id"), F.concat(F.lit("new "), "p_name").alias("sql_text"))
    return M.schema_snapshot_merge(stored, seen)


@query("a5_record_upsert", """
SELECT o_orderkey AS sql_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS audit_level, o_totalprice AS price FROM orders""")
def _(t):
    row = lambda level: [c("o_orderkey").alias("sql_id"), F.lit(level).alias("audit_level"), c("o_totalprice").alias("price")]
    stored = t.orders.filter("o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0").select(row("old"))
    new = t.orders.filter("o_orderkey % 3 = 0").select(row("new"))
    # each record comes in twice, the second time with its price
    twice = new.withColumn("price", F.lit(0).cast(new.schema["price"].dataType)).unionByName(new)
    return M.record_upsert(stored, twice, newest_by="price")


@query("a6_process_insert_if_absent", """
SELECT id AS record_id, CASE WHEN id % 4 = 0 THEN status ELSE 'unhandled' END AS status FROM sql_records""")
def _(t):
    states = t.sql_records.filter("id % 4 = 0").select(c("id").alias("record_id"), "status")
    return M.process_insert_if_absent(states, t.sql_records)


@query("a8_scrape_high_water", """
SELECT CAST(user_id % 9 AS BIGINT) AS source_id, event_type AS source, MAX(date_trunc('second', ts)) AS last_start_time,
  MAX(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_start_text FROM events GROUP BY 1, 2""")
def _(t):
    records = t.events.select(
        (c("user_id") % 9).alias("source_id"),
        c("event_type").alias("source"),
        F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time_of_last_scraped_sql"))).alias("info"),
    )
    return M.scrape_high_water(records)


@query("a9_records_to_audit", """
SELECT r.id, r.sql_id FROM sql_records r JOIN scan_plans p ON p.id = r.source_id
WHERE NOT r.is_deleted AND NOT p.is_deleted AND (r.last_audit_time IS NULL OR r.updated_at > r.last_audit_time)""")
def _(t):
    return M.records_to_audit(t.sql_records, t.scan_plans).select("id", "sql_id")


@query("a10_distinct_values", "SELECT DISTINCT db_user FROM sql_records WHERE db_user IS NOT NULL")
def _(t):
    return M.distinct_values(t.sql_records, "db_user")


@query("a10_distinct_lock_types", "SELECT DISTINCT lock_type FROM lock_waits WHERE scan_plan_id = 3")
def _(t):
    return M.distinct_values(t.lock_waits.withColumnRenamed("scan_plan_id", "source_id"), "lock_type", 3)


@query("a11_merge_candidates", """
SELECT id, task_id, table_name FROM (SELECT o_orderkey AS id, o_custkey AS task_id, CONCAT('t', o_orderkey % 3) AS table_name,
  ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS k FROM orders) x WHERE k > 1""")
def _(t):
    alters = t.sql("SELECT o_orderkey AS id, o_custkey AS task_id, CONCAT('ALTER TABLE `T', o_orderkey % 3, '` ADD COLUMN c', o_orderkey, ' INT') AS sql_text FROM {orders}")
    return M.merge_candidates(alters).select("id", "task_id", "table_name")


@query("a12_plans_with_records", """
SELECT id FROM scan_plans p WHERE EXISTS (SELECT 1 FROM sql_records r WHERE r.source_id = p.id AND NOT r.is_deleted)""")
def _(t):
    return M.plans_with_records(t.scan_plans, t.sql_records).select("id")


@query("a12_type_enabled", """
SELECT DISTINCT p.instance_id FROM scan_plans p WHERE NOT p.is_deleted AND p.active_status = 'normal'
  AND EXISTS (SELECT 1 FROM plan_types x WHERE x.plan_id = p.id AND x.plan_type = 'top_sql' AND NOT x.is_deleted)""")
def _(t):
    return M.type_enabled(t.scan_plans, t.plan_types, "top_sql")
