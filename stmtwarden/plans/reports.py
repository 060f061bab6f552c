"""Queries of the report family (W)."""

from pyspark.sql import functions as F

from stmtwarden.operators import reports as R
from stmtwarden.registry import query, texts

_STATUS_COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in R.WORKFLOW_STATUSES)


@query("w1_workflow_count_by_status", f"SELECT {_STATUS_COUNTS} FROM workflows")
def _(t):
    return R.workflow_count_by_status(t.workflows)


@query("w1_workflow_count_by_status_per_project", f"SELECT project_id, {_STATUS_COUNTS} FROM workflows GROUP BY project_id")
def _(t):
    return R.workflow_count_by_status(t.workflows, "project_id")


@query("w2_workflow_daily_counts", """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, COUNT(*) AS workflow_count FROM workflows
WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1""")
def _(t):
    return R.workflow_daily_counts(t.workflows, "1995-01-01", "1996-12-31").withColumn("day", F.col("day").cast("string"))


@query("w3_workflow_range_count", """
SELECT COUNT(*) FILTER (WHERE created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31') AS range_count,
  COUNT(*) AS total_count FROM workflows""")
def _(t):
    return R.workflow_range_count(t.workflows, "1995-01-01", "1996-12-31")


@query("w4_approved_workflows", """
SELECT id, project_id, status FROM workflows WHERE status NOT IN ('wait_for_audit', 'rejected', 'canceled')""")
def _(t):
    return R.approved_workflows(t.workflows).select("id", "project_id", "status")


@query("w5_workflow_by_step_type", """
SELECT s.step_type, COUNT(*) AS workflow_count FROM step_workflows w JOIN workflow_steps s ON s.id = w.current_step_id
WHERE s.step_type IN ('sql_review') GROUP BY 1""")
def _(t):
    return R.workflow_by_step_type(t.step_workflows, t.workflow_steps, ["sql_review"])


@query("w6_audit_wait_minutes", """
SELECT CAST(SUM(TRUNC((epoch(s.operate_at) - epoch(w.created_at)) / 60)) AS BIGINT) AS wait_minutes, COUNT(*) AS step_count
FROM workflow_steps s JOIN step_workflows w ON w.id = s.workflow_id WHERE s.step_type = 'sql_review'""")
def _(t):
    return R.audit_wait_minutes(t.step_workflows, t.workflow_steps.filter("step_type = 'sql_review'"))


@query("w7_nth_last_step", """
SELECT workflow_id, id, assignee FROM (
  SELECT s.*, ROW_NUMBER() OVER (PARTITION BY workflow_id ORDER BY id DESC) AS rn FROM workflow_steps s) x
WHERE rn = 2 AND state = 'approved'""")
def _(t):
    return R.nth_last_step(t.workflow_steps, 1, "approved").select("workflow_id", "id", "assignee")


@query("w8_unfinished_workflows", """
SELECT project_id, COUNT(*) AS open_count FROM workflows WHERE status NOT IN ('exec_failed', 'finished', 'canceled') GROUP BY 1""")
def _(t):
    return R.unfinished_workflows(t.workflows)


@query("w8_waiting_instances", """
SELECT DISTINCT instance_id FROM workflow_instances i WHERE NOT is_executed AND EXISTS (
  SELECT 1 FROM workflows w WHERE w.id = i.workflow_id AND w.status IN ('wait_for_audit', 'executing'))""")
def _(t):
    return R.waiting_instances(t.workflow_instances, t.workflows, ["wait_for_audit", "executing"])


@query("w9_instance_status_counts", """
SELECT instance_id, COUNT(DISTINCT CASE WHEN w.status IN ('rejected', 'exec_failed') THEN i.workflow_id END) AS matching_count,
  COUNT(DISTINCT i.workflow_id) AS workflow_count
FROM workflow_instances i LEFT JOIN workflows w ON w.id = i.workflow_id GROUP BY 1""")
def _(t):
    return R.instance_status_counts(t.workflow_instances, t.workflows, ["rejected", "exec_failed"])


@query("w10_exec_time_stats", """
SELECT instance_id, CAST(ROUND(AVG(exec_seconds)) AS BIGINT) AS avg_seconds, MAX(exec_seconds) AS max_seconds, MIN(exec_seconds) AS min_seconds
FROM tasks WHERE status = 'exec_succeeded' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return R.exec_time_stats(t.tasks, 10)


@query("w11_exec_fail_counts", """
SELECT instance_id, f AS failed_count, n AS total_count, ROUND(100.0 * f / NULLIF(n, 0), 2) AS failed_percent FROM (
  SELECT instance_id, COUNT(*) FILTER (WHERE status = 'exec_failed') AS f,
    COUNT(*) FILTER (WHERE status NOT IN ('initialized', 'audited')) AS n FROM tasks GROUP BY 1) x""")
def _(t):
    return R.exec_fail_counts(t.tasks)


@query("w12_audited_sql_counts", """
WITH newest AS (SELECT scan_plan_id, MAX(created_at) AS created_at FROM reports GROUP BY 1),
parts AS (
  SELECT audit_level <> 'normal' AS risky FROM task_sql
  UNION ALL
  SELECT q.audit_result IS NOT NULL AS risky FROM report_sql q WHERE q.report_id IN (
    SELECT r.id FROM reports r JOIN newest n ON n.scan_plan_id = r.scan_plan_id AND n.created_at = r.created_at))
SELECT COUNT(*) AS total_count, COUNT(*) FILTER (WHERE risky) AS risk_count,
  CAST(ROUND(100.0 * COUNT(*) FILTER (WHERE risky) / COUNT(*)) AS BIGINT) AS risk_rate FROM parts""")
def _(t):
    own = t.task_sql.select((F.col("audit_level") != "normal").alias("has_result"))
    return R.audited_sql_counts(own, t.reports, t.report_sql)


@query("w13_risk_workflows", "SELECT id, project_id, status, created_at FROM workflows WHERE status IN ('rejected', 'exec_failed')")
def _(t):
    return R.risk_workflows(t.workflows).select("id", "project_id", "status", "created_at")


@query("w14_risk_scan_reports", """
SELECT r.id, r.scan_plan_id, r.score, COALESCE(q.n, 0) AS risk_sql_count FROM reports r
LEFT JOIN (SELECT report_id, COUNT(audit_result) AS n FROM report_sql GROUP BY 1) q ON q.report_id = r.id WHERE r.score < 60""")
def _(t):
    return R.risk_scan_reports(t.reports, t.report_sql)


@query("w15_scan_plans_by_type", """
SELECT p.db_type, x.plan_type, COUNT(*) AS plan_count FROM plan_types x JOIN scan_plans p ON p.id = x.plan_id
WHERE NOT x.is_deleted AND NOT p.is_deleted GROUP BY 1, 2""")
def _(t):
    return R.scan_plans_by_type(t.scan_plans, t.plan_types)


@query("w16_latest_report_score", """
SELECT db_type, instance_name, created_at, score FROM (
  SELECT r.*, RANK() OVER (PARTITION BY db_type, instance_name ORDER BY created_at DESC) AS k FROM reports r) x WHERE k = 1""")
def _(t):
    return R.latest_report_score(t.reports)


@query("w17_instance_health", """
WITH newest AS (SELECT db_type, instance_name, score FROM (
  SELECT r.*, RANK() OVER (PARTITION BY db_type, instance_name ORDER BY created_at DESC) AS k FROM reports r) x WHERE k = 1),
signals AS (
  SELECT CASE WHEN i.instance_id % 2 = 0 THEN 'mysql' ELSE 'oracle' END AS db_type, CONCAT('i', i.instance_id) AS instance_name,
    COALESCE(w.status IN ('rejected', 'exec_failed'), FALSE) AS bad
  FROM workflow_instances i LEFT JOIN workflows w ON w.id = i.workflow_id
  UNION ALL SELECT db_type, instance_name, score < 60 FROM newest),
state AS (SELECT db_type, instance_name, BOOL_OR(bad) AS bad FROM signals GROUP BY 1, 2)
SELECT db_type, instance_name, bad AS unhealthy FROM state""")
def _(t):
    runs = t.workflow_instances.join(
        t.workflows.select(F.col("id").alias("workflow_id"), "status"), "workflow_id", "left"
    ).select(
        F.when(F.col("instance_id") % 2 == 0, "mysql").otherwise("oracle").alias("db_type"),
        F.concat(F.lit("i"), F.col("instance_id")).alias("instance_name"),
        "status",
    )
    return R.instance_health(runs, R.latest_report_score(t.reports))


@query("w18_project_score", """
WITH a AS (SELECT project_id, COUNT(*) FILTER (WHERE status = 'finished') AS f,
    COUNT(*) FILTER (WHERE status IN ('finished', 'exec_failed', 'executing')) AS n FROM workflows GROUP BY 1),
b AS (SELECT project_id, COUNT(*) FILTER (WHERE score > 60) AS g, COUNT(*) AS r FROM reports GROUP BY 1)
SELECT project_id, CAST(ROUND(100 * COALESCE(CAST(0.4 AS DOUBLE) * (f / NULLIF(n, 0)) + CAST(0.6 AS DOUBLE) * (g / NULLIF(r, 0)),
  f / NULLIF(n, 0), g / NULLIF(r, 0), 1.0)) AS BIGINT) AS score
FROM a FULL JOIN b USING (project_id)""")
def _(t):
    return R.project_score(t.workflows, t.reports)


@query("w19_category_counts", """
SELECT c.category, c.tag, COUNT(c.tag) AS rule_count FROM rule_categories c LEFT JOIN rule_tags r ON r.tag = c.tag GROUP BY 1, 2""")
def _(t):
    return R.category_counts(t.rule_categories, t.rule_tags)


@query("w20_custom_rule_types", """
SELECT rule_type, COUNT(*) AS rule_count, CAST(MIN(created_on) AS VARCHAR) AS first_created FROM custom_rules GROUP BY 1""")
def _(t):
    return R.custom_rule_types(t.custom_rules).withColumn("first_created", F.col("first_created").cast("string"))


@query("w21_workflow_count_by_project", "SELECT project_id, COUNT(DISTINCT id) AS workflow_count FROM workflows GROUP BY 1")
def _(t):
    return R.workflow_count_by_project(t.workflows)


@query("w22_workflow_step_summary", """
WITH runs AS (SELECT workflow_id, instance_id, MIN(execution_assignee) AS e, BOOL_AND(is_executed) AS is_executed
  FROM workflow_instances GROUP BY 1, 2)
SELECT w.id, CAST(r.instance_id AS VARCHAR) AS instance_id, w.status, CAST(r.is_executed AS VARCHAR) AS is_executed,
  CASE WHEN w.status = 'rejected' THEN w.creator WHEN w.status = 'wait_for_execution' THEN r.e ELSE s.assignee END AS current_assignee
FROM step_workflows w LEFT JOIN workflow_steps s ON s.id = w.current_step_id LEFT JOIN runs r ON r.workflow_id = w.id""")
def _(t):
    return texts(R.workflow_step_summary(t.step_workflows, t.workflow_instances, t.workflow_steps), "instance_id", "is_executed")


@query("w23_percentages", """
SELECT creator, n AS workflow_count, ROUND(100.0 * p / n, 2) AS passed_percent, ROUND(100.0 * r / n, 2) AS rejected_percent,
  ROUND(100.0 * n / SUM(n) OVER (), 2) AS share_percent
FROM (SELECT creator, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'rejected') AS r,
  COUNT(*) FILTER (WHERE status NOT IN ('wait_for_audit', 'rejected', 'canceled')) AS p FROM workflows GROUP BY 1) x""")
def _(t):
    return R.percentages(t.workflows, "creator")


@query("w24_unsuccessful_collections", """
SELECT DISTINCT project_id, instance_id FROM scan_plans WHERE NOT is_deleted AND last_collection_status = 'abnormal'""")
def _(t):
    return R.unsuccessful_collections(t.scan_plans)


@query("w25_changed_since", "SELECT id, CAST(updated_on AS VARCHAR) AS updated_on, is_deleted FROM scan_plans WHERE updated_on > DATE '2024-02-15'")
def _(t):
    return R.changed_since(t.scan_plans, "2024-02-15").select("id", F.col("updated_on").cast("string").alias("updated_on"), "is_deleted")


@query("w26_due_workflows", """
SELECT w.id, w.status FROM step_workflows w WHERE w.status = 'wait_for_execution' AND EXISTS (
  SELECT 1 FROM workflow_instances i WHERE i.workflow_id = w.id AND NOT i.is_executed AND i.scheduled_at <= TIMESTAMP '1998-01-01')""")
def _(t):
    return R.due_workflows(t.step_workflows, t.workflow_instances, "1998-01-01").select("id", "status")
