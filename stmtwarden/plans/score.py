"""Queries of levels and scores."""

from pyspark.sql import functions as F

from stmtwarden.operators import score as S
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query

c = F.col
_RANK = "CASE {} WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'notice' THEN 1 WHEN 'normal' THEN 0 ELSE -1 END"
_NAME = "CASE {} WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' WHEN 0 THEN 'normal' ELSE '' END"


@query("l6_violation_rollup", f"""
SELECT t.id, {_NAME.format('COALESCE(v.r, 0)')} AS audit_level, v.rule_names FROM task_sql t LEFT JOIN (
  SELECT sql_id, MAX({_RANK.format('level')}) AS r, STRING_AGG(rule_name, ',' ORDER BY rule_name) AS rule_names FROM task_results GROUP BY 1) v
ON v.sql_id = t.id""")
def _(t):
    rolled = S.violation_rollup(t.task_sql.select("id"), t.task_results.withColumnRenamed("sql_id", "id"))
    return rolled.select("id", "audit_level", F.array_join("audit_results.rule_name", ",").alias("rule_names"))


_RATES = f"""SELECT task_id, ROUND(COUNT(*) FILTER (WHERE k <= 0) / COUNT(*), 4) AS p, COUNT(*) FILTER (WHERE k >= 3) / COUNT(*) AS e,
  COUNT(*) FILTER (WHERE k >= 2) / COUNT(*) AS w, COUNT(*) FILTER (WHERE k >= 1) / COUNT(*) AS n, MAX(k) AS top
FROM (SELECT task_id, {_RANK.format('audit_level')} AS k FROM task_sql) x GROUP BY 1"""


@query("l7_task_pass_rate", f"""
SELECT c.c_custkey AS task_id, COALESCE(r.p, 0) AS pass_rate, {_NAME.format('COALESCE(r.top, -1)')} AS audit_level
FROM customer c LEFT JOIN ({_RATES}) r ON r.task_id = c.c_custkey""")
def _(t):
    return S.task_pass_rate(t.tasks, t.task_sql)


@query("l8_task_score", f"""
SELECT task_id, p AS pass_rate, CAST(FLOOR(p * 30 + (1.0 - e) * 15 + (1.0 - w) * 10 + (1.0 - n) * 5
  + CASE WHEN e = 0 THEN 15 ELSE 0 END + CASE WHEN w = 0 THEN 10 ELSE 0 END + CASE WHEN n = 0 THEN 5 ELSE 0 END
  + CASE WHEN e < 0.1 THEN 5 ELSE 0 END + CASE WHEN w < 0.1 THEN 3 ELSE 0 END + CASE WHEN n < 0.1 THEN 2 ELSE 0 END) AS INTEGER) AS score
FROM ({_RATES}) r""")
def _(t):
    return S.task_score(t.task_sql)


@query("l9_unsupported_fallback", f"""
SELECT id, 'warn' AS level FROM statement_corpus WHERE NOT regexp_matches({D.masked_text('sql_text')},
  '^\\(*\\s*(SELECT|WITH|INSERT|REPLACE|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|RENAME|SET|GRANT|REVOKE|VALUES|TABLE|COMMIT|ROLLBACK|BEGIN|START|SAVEPOINT|RELEASE|USE|SHOW|EXPLAIN|DESCRIBE|DESC|CALL|DO|LOCK|UNLOCK|ANALYZE|OPTIMIZE|CHECK|CHECKSUM|REPAIR|FLUSH|KILL|LOAD|HANDLER|PREPARE|EXECUTE|DEALLOCATE|XA|COMMENT|MERGE|EXEC)\\b')""")
def _(t):
    from stmtwarden.lint.text_rules import features, is_supported

    return S.unsupported_fallback(features(t.statement_corpus), is_supported()).select("id", "level")


@query("l10_rule_gate", """
SELECT r.rule_name, r.db_type, CASE WHEN r.id % 2 = 0 THEN 'error' ELSE r.level END AS level, CONCAT('p', r.id) AS params
FROM rules r WHERE r.id % 5 <> 0 AND r.id % 3 <> 0""")
def _(t):
    rules = t.rules.select(
        "rule_name", "db_type", "level", F.concat(F.lit("p"), "id").alias("params"), (c("id") % 5 != 0).alias("allow_offline"), F.lit(False).alias("only_before_execution")
    )
    chosen = t.rules.filter("id % 3 <> 0").select(
        F.lit("default").alias("template"), "rule_name", "db_type", F.when(c("id") % 2 == 0, "error").alias("level"), F.lit(None).cast("string").alias("params")
    )
    return S.rule_gate(rules, chosen, "default", offline=True, executed=False)


_RESULTS = """SELECT sql_id, BOOL_OR(level = 'error') AS e, BOOL_OR(level = 'warn') AS w, BOOL_OR(level = 'notice') AS n, BOOL_OR(level = 'normal') AS o,
  BOOL_OR(execution_failed) AS f, BOOL_OR(NOT execution_failed) AS k FROM task_results GROUP BY 1"""
_STATES = ", ".join(f"COUNT(*) FILTER (WHERE t.exec_status = '{s}') AS {s}_count" for s in S.EXEC_STATES)


def task_statements(t):
    results = (
        t.task_results.groupBy(c("sql_id").alias("id"))
        .agg(F.collect_list(F.struct("level", "execution_failed")).alias("audit_results"))
    )
    return t.task_sql.join(results, "id", "left")


@query("l11_file_statistics", f"""
SELECT f.id, f.task_id, f.file_name, f.exec_order, {_STATES}, COUNT(*) FILTER (WHERE r.e AND r.k) AS error_count,
  COUNT(*) FILTER (WHERE r.w OR r.f) AS warning_count, COUNT(*) FILTER (WHERE r.n AND r.k) AS notice_count, COUNT(*) FILTER (WHERE r.o AND r.k) AS normal_count
FROM audit_files f JOIN task_sql t ON t.task_id = f.task_id AND t.source_file = f.file_name LEFT JOIN ({_RESULTS}) r ON r.sql_id = t.id
WHERE t.exec_status IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(t):
    return S.file_statistics(t.audit_files, task_statements(t))


@query("l12_file_exec_overview", f"""
SELECT *, CASE WHEN failed_count > 0 THEN 'failed' WHEN manually_executed_count > 0 THEN 'manually_executed'
  WHEN terminate_failed_count > 0 THEN 'terminate_failed' WHEN terminate_succeeded_count > 0 THEN 'terminate_succeeded'
  WHEN initialized_count > 0 AND doing_count = 0 AND succeeded_count = 0 THEN 'initialized' WHEN initialized_count > 0 OR doing_count > 0 THEN 'doing'
  WHEN succeeded_count > 0 THEN 'succeeded' ELSE 'initialized' END AS file_status
FROM (SELECT f.id, f.task_id, f.file_name, f.exec_order, {_STATES}
  FROM audit_files f JOIN task_sql t ON t.task_id = f.task_id AND t.source_file = f.file_name WHERE t.exec_status IS NOT NULL GROUP BY 1, 2, 3, 4) x""")
def _(t):
    return S.file_exec_overview(t.audit_files, t.task_sql)
