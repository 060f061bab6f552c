"""Queries of lists and list searches (F)."""

from pyspark.sql import functions as F

from stmtwarden.functions.text import fingerprint
from stmtwarden.operators import lists as L
from stmtwarden.operators import search as S
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query, texts

c = F.col

BLOCK = (
    "(VALUES (1,'cidr','10.0.1.0/24'), (2,'ip','10.0.2.2'), (3,'sql','order by rand()'), (4,'fp_sql','DELETE FROM'), (5,'instance','i3'), "
    "(6,'db_user','u7'), (7,'host','Local'), (8,'cidr','fe80::/10'), (9,'cidr','10.0.0.0/33')) AS b(id, filter_type, content)"
)
ALLOW = "(VALUES (1,'exact_match','delete from lineitem'), (2,'fp_match','SELECT * FROM orders WHERE o_custkey = 1')) AS a(id, match_type, value)"

# Every tenth endpoint is a host name, every tenth a longer address, so that all kinds of entries are tried.
_END = "CASE WHEN id % 10 = 0 THEN 'db.LOCAL.net' WHEN id % 10 = 5 THEN CONCAT(CASE WHEN id % 4 = 1 THEN 'fe9' ELSE 'fd0' END, '0::', id % 10, ':1') ELSE endpoint END"

_BLOCKED = f"""
SELECT s.id, s.ts, (SELECT FIRST(b.id ORDER BY CASE b.filter_type WHEN 'sql' THEN 1 WHEN 'fp_sql' THEN 2 WHEN 'instance' THEN 3 WHEN 'db_user' THEN 4 ELSE 0 END,
    CASE WHEN b.filter_type = 'cidr' THEN 1 ELSE 0 END, b.id) FROM {BLOCK}
  WHERE (b.filter_type = 'ip' AND s.e = b.content)
    OR (b.filter_type = 'cidr' AND s.n BETWEEN 167772416 AND 167772671)
    OR (b.id = 8 AND starts_with(s.e, 'fe90:'))
    OR (b.filter_type = 'host' AND s.n IS NULL AND NOT contains(s.e, ':') AND contains(lower(s.e), lower(b.content)))
    OR (b.filter_type = 'sql' AND contains(lower(s.sql_text), lower(b.content)))
    OR (b.filter_type = 'fp_sql' AND contains(lower(s.fp), lower(b.content)))
    OR (b.filter_type = 'instance' AND s.instance_id = b.content)
    OR (b.filter_type = 'db_user' AND s.db_user = b.content)) AS matched_id
FROM (SELECT *, {_END} AS e, {D.fingerprint('sql_text')} AS fp,
  CASE WHEN id % 5 = 0 THEN NULL ELSE 16777216 * CAST(split_part(endpoint, '.', 1) AS BIGINT) + 65536 * CAST(split_part(endpoint, '.', 2) AS BIGINT)
    + 256 * CAST(split_part(endpoint, '.', 3) AS BIGINT) + CAST(split_part(endpoint, '.', 4) AS BIGINT) END AS n FROM statement_log) s"""


def blocklist(t, counters=False):
    extra = ", 10 AS matched_count, CAST(NULL AS TIMESTAMP_NTZ) AS last_match_time" if counters else ""
    return t.spark.sql(f"SELECT CAST(id AS BIGINT) AS id, filter_type, content{extra} FROM {BLOCK}")


def allowlist(t):
    df = t.spark.sql(f"SELECT CAST(id AS BIGINT) AS id, match_type, value, 10 AS matched_count, CAST(NULL AS TIMESTAMP_NTZ) AS last_matched_time FROM {ALLOW}")
    return df.withColumn("fingerprint", fingerprint(c("value")))


def statements(t):
    return t.statement_log.select(
        "*", F.array(F.expr(_END)).alias("endpoints"), fingerprint(c("sql_text")).alias("sql_fingerprint")
    )


@query("f1_blocklist_match", f"SELECT id, CAST(matched_id AS VARCHAR) AS matched_id FROM ({_BLOCKED}) x")
def _(t):
    return texts(L.blocklist_match(statements(t), blocklist(t)).select("id", "matched_id"), "matched_id")


@query("f1_blocklist_match_long_list", f"SELECT id, CAST(matched_id AS VARCHAR) AS matched_id FROM ({_BLOCKED}) x")
def _(t):
    return texts(L.blocklist_match(statements(t), blocklist(t)).select("id", "matched_id"), "matched_id")


@query("f2_blocklist_ip", f"""SELECT id, CAST(matched_id AS BIGINT) AS matched_id FROM ({_BLOCKED}) x WHERE matched_id IN (1, 2, 7, 8)""")
def _(t):
    only = blocklist(t).filter("filter_type IN ('ip', 'cidr', 'host')")
    return L.blocklist_match(statements(t), only).filter("matched_id IS NOT NULL").select("id", "matched_id")


@query("f3_blocklist_counters", f"""
SELECT b.id, b.filter_type, b.content, 10 + COALESCE(n, 0) AS matched_count, m AS last_match_time FROM {BLOCK}
LEFT JOIN (SELECT matched_id, COUNT(*) AS n, MAX(ts) AS m FROM ({_BLOCKED}) x GROUP BY 1) y ON y.matched_id = b.id""")
def _(t):
    return L.blocklist_counters(L.blocklist_match(statements(t), blocklist(t)), blocklist(t, counters=True))


@query("f3_blocklist_survivors", f"SELECT id FROM ({_BLOCKED}) x WHERE matched_id IS NULL")
def _(t):
    return L.blocklist_survivors(L.blocklist_match(statements(t), blocklist(t))).select("id")


_ALLOWED = f"""SELECT s.id, s.ts, GREATEST(CASE WHEN UPPER(TRIM(sql_text)) = 'DELETE FROM LINEITEM' THEN 1 END,
  CASE WHEN {D.fingerprint('sql_text')} = 'SELECT * FROM orders WHERE o_custkey = ?' THEN 2 END) AS allowed_by FROM statement_log s"""


@query("f4_allowlist_match", f"SELECT id, CAST(allowed_by AS VARCHAR) AS allowed_by FROM ({_ALLOWED}) x")
def _(t):
    return texts(L.allowlist_match(statements(t), allowlist(t)).select("id", "allowed_by"), "allowed_by")


@query("f4_allowlist_counters", f"""
SELECT a.id, a.match_type, a.value, 10 + COALESCE(n, 0) AS matched_count, m AS last_matched_time FROM {ALLOW}
LEFT JOIN (SELECT allowed_by, COUNT(*) AS n, MAX(ts) AS m FROM ({_ALLOWED}) x GROUP BY 1) y ON y.allowed_by = a.id""")
def _(t):
    return L.allowlist_counters(L.allowlist_match(statements(t), allowlist(t)), allowlist(t))


CONDITIONS = (L.Condition("audit_level", ">", "2", "int"), L.Condition("query_time_avg", ">", "20"), L.Condition("no_such_metric", ">", "1"))


@query("f5_high_priority", """
SELECT id, CASE WHEN audit_level = 'error' OR query_time_avg > 20 THEN 'high' ELSE '' END AS priority,
  CONCAT_WS('|', CASE WHEN audit_level = 'error' THEN 'audit_level > 2, is 3' END,
    CASE WHEN query_time_avg > 20 THEN CONCAT('query_time_avg > 20, is ', query_time_avg) END) AS reasons FROM sql_records""")
def _(t):
    return L.high_priority(t.sql_records, CONDITIONS).select("id", "priority", F.array_join("reasons", "|").alias("reasons"))


def records(t):
    both = F.array(*[F.struct(c(n).alias("rule_name")) for n in ("rule_a", "rule_b")])
    return t.sql_records.withColumn("audit_results", F.when(c("rule_a").isNotNull(), both))


_LIVE = """SELECT r.*, x.id AS plan_type_id, CASE WHEN r.rule_a IS NULL THEN 'being_audited' ELSE '' END AS audit_status FROM sql_records r
JOIN plan_types x ON x.plan_id = r.source_id AND x.plan_type = r.source JOIN scan_plans p ON p.id = r.source_id
WHERE NOT r.is_deleted AND NOT p.is_deleted"""


@query("f6_record_search", f"""
SELECT id, plan_type_id, sql_fingerprint, audit_status, counter FROM ({_LIVE}) x
WHERE (rule_a = 'rule_3' OR rule_b = 'rule_3') AND query_time_avg >= 100 AND sql_fingerprint ILIKE '%from t1%'
  AND last_receive_timestamp >= TIMESTAMP '1993-01-01' ORDER BY counter DESC, id, plan_type_id LIMIT 20 OFFSET 5""")
def _(t):
    found = S.record_matches(
        records(t), t.scan_plans, t.plan_types, rule_name="rule_3", query_time_avg=100, sql="FROM T1", received_from="1993-01-01"
    )
    # A record shows once per plan entry of its source, so the entry breaks ties.
    return S.page(found, [F.desc("counter"), "id", "plan_type_id"], 20, 5).select("id", "plan_type_id", "sql_fingerprint", "audit_status", "counter")


@query("f6_record_search_total", f"SELECT COUNT(*) AS total_count FROM ({_LIVE}) x WHERE priority = 'high'")
def _(t):
    return S.total(S.record_matches(records(t), t.scan_plans, t.plan_types, priority="high"))


@query("f7_plan_search", """
SELECT p.id, p.instance_id, e.ids AS plan_type_ids, e.types FROM scan_plans p LEFT JOIN (
  SELECT plan_id, STRING_AGG(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, STRING_AGG(plan_type, ',' ORDER BY plan_type) AS types, LIST(plan_type) AS l
  FROM plan_types WHERE NOT is_deleted GROUP BY 1) e ON e.plan_id = p.id
WHERE NOT p.is_deleted AND p.db_type = 'mysql' AND list_contains(e.l, 'slow_log') AND (p.create_user_id = 7 OR p.instance_id IN ('i1', 'i2', 'i3'))""")
def _(t):
    found = S.plan_search(
        t.scan_plans, t.plan_types, user_id=7, accessible_instances=["i1", "i2", "i3"], db_type="mysql", plan_type="slow_log"
    )
    return found.select("id", "instance_id", F.array_join(c("plan_type_ids").cast("array<string>"), ",").alias("plan_type_ids"), F.array_join("types", ",").alias("types"))


@query("f8_manage_search", """
SELECT id, status, counter FROM sql_records WHERE NOT is_deleted AND status = 'unhandled' AND source = 'slow_log' AND audit_level = 'error'
ORDER BY counter DESC, id LIMIT 50""")
def _(t):
    found = S.manage_matches(records(t), status="unhandled", source="slow_log", audit_level="error")
    return S.manage_search(found, "counter", limit=50).select("id", "status", "counter")


@query("f8_manage_search_total", """
SELECT COUNT(*) AS total_count FROM sql_records WHERE NOT is_deleted AND project_id = 'p3' AND contains(endpoint, '0.3.')
  AND last_audit_time >= TIMESTAMP '1996-01-01'""")
def _(t):
    return S.total(S.manage_matches(records(t), project_id="p3", endpoint="0.3.", audited_from="1996-01-01"))


_WORKFLOWS = """
SELECT w.id, w.project_id, w.status, i.ids AS instance_ids, i.vs AS versions,
  CASE WHEN w.status = 'rejected' THEN w.creator ELSE COALESCE(s.a, w.assignee) END AS current_assignee
FROM workflows w LEFT JOIN (SELECT workflow_id, LIST(DISTINCT instance_id) AS l,
    array_to_string(list_sort(LIST(DISTINCT instance_id)), ',') AS ids, array_to_string(list_sort(LIST(DISTINCT version)), ',') AS vs
  FROM workflow_instances GROUP BY 1) i ON i.workflow_id = w.id
LEFT JOIN (SELECT workflow_id, ARG_MAX(assignee, id) AS a FROM workflow_steps GROUP BY 1) s ON s.workflow_id = w.id
WHERE w.status IN ('rejected', 'wait_for_audit') AND contains(w.subject, 'ject 1') AND list_contains(i.l, 7)"""


@query("f9_workflow_search", _WORKFLOWS)
def _(t):
    found = S.workflow_matches(
        t.workflows, t.workflow_instances, t.workflow_steps, status=["rejected", "wait_for_audit"], subject="JECT 1", instance_id=7
    )
    return found.select(
        "id", "project_id", "status", "current_assignee", F.array_join("versions", ",").alias("versions"),
        F.array_join(c("instance_ids").cast("array<string>"), ",").alias("instance_ids"),
    )


@query("f10_task_sql_search", "SELECT id, task_id, audit_level, exec_status FROM task_sql WHERE exec_status = 'failed' AND source_file = 'f1.sql'")
def _(t):
    return S.task_sql_search(t.task_sql, exec_status="failed", source_file="f1.sql").select("id", "task_id", "audit_level", "exec_status")


@query("f10_task_sql_no_duplicate", """
SELECT id, task_id, audit_fingerprint, audit_level FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY task_id, COALESCE(audit_fingerprint, CAST(id AS VARCHAR)) ORDER BY id) AS k FROM task_sql) x WHERE k = 1""")
def _(t):
    return S.task_sql_search(t.task_sql, no_duplicate=True).select("id", "task_id", "audit_fingerprint", "audit_level")


@query("f11_audit_record_search", """
SELECT r.id, r.audit_record_id, r.created_at, k.status, k.instance_id FROM audit_records r LEFT JOIN tasks k ON k.id = r.task_id
WHERE contains(r.tags, 'tag1') AND k.status <> 'audited' AND k.instance_id IN (1, 2, 3) AND r.created_at >= TIMESTAMP '1994-01-01'""")
def _(t):
    return S.audit_record_search(
        t.audit_records, t.tasks, tag="tag1", status_not="audited", instance_ids=[1, 2, 3], created_from="1994-01-01"
    ).select("id", "audit_record_id", "created_at", "status", "instance_id")


@query("f12_report_search", "SELECT id, created_at, score FROM reports WHERE scan_plan_id = 5")
def _(t):
    return S.report_search(t.reports, 5).select("id", "created_at", "score")


@query("f12_report_sql_search", """
SELECT q.id, q.report_id, q.sql_text FROM report_sql q WHERE q.report_id IN (SELECT id FROM reports WHERE scan_plan_id = 5)""")
def _(t):
    return S.report_sql_search(t.reports, t.report_sql, 5).select("id", "report_id", "sql_text")


@query("f13_scan_plan_search", "SELECT id, name FROM scan_plans WHERE NOT is_deleted AND name ILIKE '%plan 1%' AND db_type = 'oracle'")
def _(t):
    return S.scan_plan_search(t.scan_plans, name="Plan 1", db_type="oracle").select("id", "name")


@query("f14_rules_with_all_tags", """
SELECT rule_name, db_type, level FROM rules r WHERE (SELECT COUNT(DISTINCT tag) FROM rule_tags g
  WHERE g.rule_name = r.rule_name AND g.db_type = r.db_type AND g.tag IN ('tag1', 'tag3')) = 2""")
def _(t):
    return S.rules_with_all_tags(t.rules, t.rule_tags, ["tag1", "tag3"]).select("rule_name", "db_type", "level")


@query("f15_lock_search", "SELECT id, granted_trx, waiting_trx FROM lock_waits WHERE lock_type = 'TABLE' AND object_name = 't3' AND database_name = 'db1'")
def _(t):
    return S.lock_search(t.lock_waits, "TABLE", "t3", "db1").select("id", "granted_trx", "waiting_trx")


@query("f15_lock_search_total", "SELECT COUNT(*) AS total_count FROM lock_waits WHERE lock_type = 'RECORD'")
def _(t):
    return S.total(S.lock_search(t.lock_waits, "RECORD"))


@query("f16_visible_pipelines", """
SELECT w.id, w.creator FROM workflows w WHERE w.creator = 'u3'
  OR EXISTS (SELECT 1 FROM workflow_instances i WHERE i.workflow_id = w.id AND i.instance_id IN (4, 5))
  OR NOT EXISTS (SELECT 1 FROM workflow_instances i WHERE i.workflow_id = w.id AND i.instance_id <> 0)""")
def _(t):
    nodes = t.workflow_instances.select(c("workflow_id").alias("pipeline_id"), "instance_id")
    return S.visible_pipelines(t.workflows, nodes, "u3", [4, 5]).select("id", "creator")


@query("f17_list_search", f"""
SELECT s.id, s.kind, s.content FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'sql' ELSE 'host' END AS kind,
  CONCAT('text ', o_custkey) AS content FROM orders) s WHERE kind = 'sql' AND content LIKE '%t 11%'""")
def _(t):
    entries = t.sql(
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'sql' ELSE 'host' END AS kind, CONCAT('text ', o_custkey) AS content FROM {orders}"
    )
    return S.list_search(entries, "kind", "content", "sql", "T 11")


@query("f18_rule_tips", """
SELECT DISTINCT r.db_type, r.rule_name FROM rules r WHERE EXISTS (SELECT 1 FROM sql_records s
  WHERE NOT s.is_deleted AND (s.rule_a = r.rule_name OR s.rule_b = r.rule_name) AND CASE WHEN s.source_id % 3 = 0 THEN 'oracle' ELSE 'mysql' END = r.db_type)""")
def _(t):
    typed = records(t).withColumn("db_type", F.when(c("source_id") % 3 == 0, "oracle").otherwise("mysql"))
    return S.rule_tips(typed, t.rules)
