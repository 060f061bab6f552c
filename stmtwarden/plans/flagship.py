"""The flagship query: the most frequent statement groups with level and score."""

from pyspark.sql import functions as F

from stmtwarden.functions.statement_columns import statement_columns
from stmtwarden.lint import column_rules, text_rules
from stmtwarden.operators import governance as G
from stmtwarden.operators import score as S
from stmtwarden.plans import dialect as D
from stmtwarden.plans import lint as LP
from stmtwarden.plans import lists as PL
from stmtwarden.plans.merge import _QUEUE
from stmtwarden.registry import query
from stmtwarden.session import fresh_dir

# The block list on the plain endpoint of each row.
_OPEN = PL._BLOCKED.replace(PL._END + " AS e", "endpoint AS e").replace("CASE WHEN id % 5 = 0 THEN NULL ELSE 16777216", "CASE WHEN FALSE THEN NULL ELSE 16777216")
_WEIGHTS = " + ".join([f"p * {S.PASS_WEIGHT}"] + [f"(1.0 - {n}) * {w}" for n, w, _, _ in S.SCORE_WEIGHTS]
                      + [f"CASE WHEN {n} = 0 THEN {b} ELSE 0 END" for n, _, b, _ in S.SCORE_WEIGHTS]
                      + [f"CASE WHEN {n} < 0.1 THEN {b} ELSE 0 END" for n, _, _, b in S.SCORE_WEIGHTS])


@query("flagship_governance", f"""
WITH kept AS (SELECT id FROM ({_OPEN}) o WHERE matched_id IS NULL),
q AS (SELECT * FROM ({_QUEUE}) z WHERE id IN (SELECT id FROM kept)),
rec AS (SELECT sql_id, COUNT(*) AS counter, ARG_MAX(sql_text, id) AS sql_text, ARG_MAX(project_id, id) AS project_id FROM q GROUP BY 1),
{D.text_features('rec')}, v AS ({D.violations('f3', text_rules.RULES, 'sql_id')}),
r AS (SELECT sql_id, MAX(CASE level WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END) AS k, COUNT(*) AS n FROM v GROUP BY 1),
a AS (SELECT rec.*, COALESCE(r.k, 0) AS k, COALESCE(r.n, 0) AS result_count FROM rec LEFT JOIN r ON r.sql_id = rec.sql_id),
s AS (SELECT project_id, ROUND(AVG(CASE WHEN k <= 0 THEN 1.0 ELSE 0.0 END), 4) AS p, AVG(CASE WHEN k >= 3 THEN 1.0 ELSE 0.0 END) AS e,
  AVG(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END) AS w, AVG(CASE WHEN k >= 1 THEN 1.0 ELSE 0.0 END) AS n FROM a GROUP BY 1)
SELECT a.project_id, a.sql_id, {D.fingerprint('a.sql_text')} AS sql_fingerprint, a.counter,
  CASE a.k WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' ELSE 'normal' END AS audit_level, a.result_count,
  CAST(FLOOR({_WEIGHTS}) AS INTEGER) AS project_score
FROM (SELECT * FROM a ORDER BY counter DESC, sql_id LIMIT 50) a JOIN s ON s.project_id = a.project_id""")
def _(t):
    records = G.audit_records(G.collect_records(t.statement_log, PL.blocklist(t), "slow_log", "1"))
    # Stored once, read twice: by the top-k and by the scores.
    path = fresh_dir(t.spark, "records")
    records.write.parquet(path)
    top = G.top_statements(t.spark.read.parquet(path), 50)
    return top.select(
        "project_id", "sql_id", "sql_fingerprint", "counter", "audit_level", F.size("audit_results").cast("bigint").alias("result_count"), "project_score"
    )


_TASK_VIOLATIONS = f"""SELECT id, level FROM (WITH {LP.TEXT} {D.violations('f3', text_rules.RULES, 'id')}) l1
UNION ALL SELECT id, level FROM (WITH {LP._KNOWN} {LP.COLUMN_VIOLATIONS}) l2"""


@query("task_audit", f"""
WITH v AS ({_TASK_VIOLATIONS}),
k AS (SELECT id, MAX(CASE level WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END) AS k FROM v GROUP BY 1),
a AS (SELECT s.id % 20 AS task_id, CASE WHEN NOT regexp_matches({D.masked_text('s.sql_text')}, {D.plain(text_rules.SUPPORTED)}) THEN 2 ELSE COALESCE(k.k, 0) END AS k
  FROM statement_corpus s LEFT JOIN k ON k.id = s.id),
s AS (SELECT task_id, COUNT(*) AS statements, ROUND(AVG(CASE WHEN k <= 0 THEN 1.0 ELSE 0.0 END), 4) AS p, AVG(CASE WHEN k >= 3 THEN 1.0 ELSE 0.0 END) AS e,
  AVG(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END) AS w, AVG(CASE WHEN k >= 1 THEN 1.0 ELSE 0.0 END) AS n, MAX(k) AS top FROM a GROUP BY 1)
SELECT task_id, p AS pass_rate, CASE top WHEN 3 THEN 'error' WHEN 2 THEN 'warn' WHEN 1 THEN 'notice' ELSE 'normal' END AS audit_level,
  CAST(FLOOR({_WEIGHTS}) AS INTEGER) AS score FROM s""")
def _(t):
    statements = t.statement_corpus.withColumn("task_id", F.col("id") % 20)
    columns = column_rules.audit_columns(statement_columns(statements), t.corpus_columns, t.corpus_indexes)
    return G.audit_task(statements, [columns])[1]
