"""Queries of statement normalisation (N)."""

from pyspark.sql import functions as F

from stmtwarden.functions import keys, text
from stmtwarden.functions.scopes import scoped_columns
from stmtwarden.functions.statement_columns import statement_columns
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query, texts
from stmtwarden.shapes import SHAPE_COUNT, SHAPES

#: The shape that names its table with a schema.
SHAPED_SCHEMA = next(k for k, s in enumerate(SHAPES) if "FROM shop.orders" in s)

c = F.col


@query("n1_fingerprint", f"SELECT id, {D.fingerprint('sql_text')} AS sql_fingerprint FROM statement_corpus")
def _(t):
    return t.statement_corpus.select("id", text.fingerprint(c("sql_text")).alias("sql_fingerprint"))


@query("n1_fingerprint_upper_names", f"SELECT id, {D.fingerprint('sql_text', True)} AS sql_fingerprint FROM statement_corpus")
def _(t):
    return t.statement_corpus.select("id", text.fingerprint(c("sql_text"), upper_names=True).alias("sql_fingerprint"))


@query("n2_sql_id", "SELECT id, " + D.json_md5(ProjectId="project_id", Fingerprint=D.fingerprint("sql_text"), Schema="schema_name",
       InstID="instance_id", Source="'slow_log'", AuditPlanID="user_id") + " AS sql_id FROM (SELECT s.*, e.user_id FROM statement_log s JOIN events e ON e.event_id = s.id) x")
def _(t):
    s = t.statement_log.join(t.events.select(c("event_id").alias("id"), "user_id"), "id")
    fp = text.fingerprint(c("sql_text"))
    return s.select("id", keys.sql_id(c("project_id"), fp, c("schema_name"), c("instance_id"), F.lit("slow_log"), c("user_id")).alias("sql_id"))


@query("n3_record_key", "SELECT id, " + D.json_md5(Fingerprint=D.fingerprint("sql_text"), Schema="'db'") + " AS record_key FROM statement_corpus")
def _(t):
    return t.statement_corpus.select("id", keys.record_key(text.fingerprint(c("sql_text")), F.lit("db")).alias("record_key"))


@query("n4_schema_meta_id", "SELECT table_name, column_name, " + D.json_md5(ProjectId="'p1'", Schema="'shop'", InstName="'i1'", Source="'schema_meta'",
       AuditPlanId="'7'", MetaName="table_name", MetaType="column_name") + " AS meta_id FROM catalog_columns")
def _(t):
    lit = F.lit
    return t.catalog_columns.select(
        "table_name",
        "column_name",
        keys.schema_meta_id(lit("p1"), lit("shop"), lit("i1"), lit("schema_meta"), lit("7"), c("table_name"), c("column_name")).alias("meta_id"),
    )


@query("n5_audit_fingerprint", f"SELECT id, MD5(CONCAT('[warn]x', {D.fingerprint('sql_text')})) AS audit_fingerprint FROM statement_corpus")
def _(t):
    return t.statement_corpus.select("id", keys.audit_fingerprint(F.lit("[warn]x"), text.fingerprint(c("sql_text"))).alias("audit_fingerprint"))


@query("n6_strip_comments", """
SELECT path, trim(regexp_replace(string_split(regexp_replace(regexp_replace(content, '(?s)/\\*.*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g'), ';')[1],
  '\\s+', ' ', 'g')) AS bare FROM sql_scripts""")
def _(t):
    return t.sql_scripts.select("path", text.strip_comments(c("content")).alias("bare"))


@query("n7_sql_kind", f"SELECT id, {D.sql_kind('sql_text')} AS sql_kind FROM statement_corpus")
def _(t):
    return t.statement_corpus.select("id", text.sql_kind(c("sql_text")).alias("sql_kind"))


@query("n8_referenced_tables", f"""
SELECT DISTINCT id, CASE WHEN contains(ref, '.') THEN split_part(ref, '.', 1) ELSE 'cur' END AS schema_name,
  CASE WHEN contains(ref, '.') THEN split_part(ref, '.', 2) ELSE ref END AS table_name
FROM (SELECT id, regexp_replace(UNNEST(regexp_extract_all(regexp_replace({D.code_text('sql_text')}, {D.plain(text.STRING)}, '''''', 'g'),
  {D.plain(text.TABLE_REF)}, 1)), '[`\\s]', '', 'g') AS ref FROM statement_corpus WHERE {D.sql_kind('sql_text')} <> 'DDL') x""")
def _(t):
    s = t.statement_corpus.select("id", "sql_text", F.lit("cur").alias("schema_name"))
    return text.referenced_tables(s)


@query("n9_statement_columns", "SELECT * REPLACE (CAST(position AS VARCHAR) AS position, CAST(with_or AS VARCHAR) AS with_or) FROM statement_columns")
def _(t):
    return texts(statement_columns(t.statement_corpus), "position", "with_or")


# Levels and set members of the corpus shapes beyond the first one, written down by hand:
# shape, scope, branch, parent, table, select column, its function, where column, operator, literal kind.
_LEVELS = [
    (18, 1, 0, 0, "orders", "o_custkey", "MAX", "o_orderkey", "=", "number"),
    (19, 1, 0, 0, "orders", "o_custkey", None, "o_orderkey", ">", "number"),
    (20, 1, 0, 2, "t7", "g", None, "h", "=", "number"),
    (20, 2, 0, 3, "t6", "f", None, "g", "IN", "list"),
    (20, 3, 0, 4, "t5", "e", None, "f", "IN", "list"),
    (20, 4, 0, 5, "t4", "d", None, "e", "IN", "list"),
    (20, 5, 0, 6, "t3", "c", None, "d", "IN", "list"),
    (20, 6, 0, 0, "t2", "b", None, "c", "IN", "list"),
    (22, 0, 1, None, "supplier", "s_name", None, "s_suppkey", "=", "number"),
    (23, 0, 1, None, "supplier", "s_name", None, "s_suppkey", "=", "number"),
    (77, 1, 0, 0, "orders", None, None, "o_custkey", "=", "number"),
]


def _sql(value):
    return "NULL" if value is None else str(value) if isinstance(value, int) else f"'{value}'"


_LEVEL_VALUES = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in _LEVELS)


@query("n9_scoped_columns", f"""
WITH lv AS (SELECT o.o_orderkey AS id, v.* FROM orders o JOIN (VALUES {_LEVEL_VALUES})
    AS v(k, scope, branch, parent, table_name, chosen, called, asked, operator, kind) ON o.o_orderkey % {SHAPE_COUNT} = v.k)
SELECT id, scope, branch, CAST(parent AS VARCHAR) AS parent, schema_name, table_name, column_name, clause, CAST(position AS VARCHAR) AS position, operator,
  function, literal_kind, other_table, other_column, CAST(with_or AS VARCHAR) AS with_or FROM (
  SELECT id, 0 AS scope, 0 AS branch, NULL AS parent, CASE WHEN id % {SHAPE_COUNT} = {SHAPED_SCHEMA} THEN 'shop' END AS schema_name, table_name, column_name,
    clause, position, operator, function, literal_kind, other_table, other_column, with_or FROM statement_columns
  UNION ALL SELECT id, scope, branch, parent, NULL, table_name, NULL, 'table', 0, NULL, NULL, NULL, NULL, NULL, NULL FROM lv
  UNION ALL SELECT id, scope, branch, parent, NULL, table_name, chosen, 'select', CASE WHEN called IS NULL THEN 0 END, NULL, called, NULL, NULL, NULL, NULL
    FROM lv WHERE chosen IS NOT NULL
  UNION ALL SELECT id, scope, branch, parent, NULL, table_name, asked, 'where', 0, operator, NULL, kind, NULL, NULL, FALSE FROM lv) x""")
def _(t):
    found = scoped_columns(t.statement_corpus).drop("derived_scope", "other_schema", "other_scope")
    return texts(found, "parent", "position", "with_or")
