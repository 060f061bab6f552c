"""Queries of the lint jobs."""

from pyspark.sql import functions as F

from stmtwarden.functions.statement_columns import statement_columns
from stmtwarden.lint import catalog_rules, column_rules, ddl_rules, other_rules, plan_rules, profile_rules, text_rules
from stmtwarden.operators import profile as P
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query
from stmtwarden.session import fresh_dir

c = F.col
TEXT = D.text_features("statement_corpus")


@query("l1_audit_text", f"WITH {TEXT} " + D.violations("f3", text_rules.RULES, "id"))
def _(t):
    return text_rules.audit_text(t.statement_corpus).select("id", "rule_name", "level")


_KNOWN = """
widths AS (SELECT table_name, index_name, MAX(seq) AS w FROM corpus_indexes GROUP BY 1, 2),
ix AS (SELECT i.table_name, i.column_name, BOOL_OR(i.seq = 1) AS leads_any, BOOL_OR(i.seq = 1 AND w.w = 1) AS leads_single,
    BOOL_OR(i.seq = 1 AND w.w > 1) AS leads_composite
  FROM corpus_indexes i JOIN widths w ON w.table_name = i.table_name AND w.index_name = i.index_name GROUP BY 1, 2),
known AS (SELECT k.*, ix.table_name IS NOT NULL AS indexed, COALESCE(leads_any, FALSE) AS leads_any, COALESCE(leads_single, FALSE) AS leads_single,
  COALESCE(leads_composite, FALSE) AS leads_composite FROM corpus_columns k LEFT JOIN ix ON ix.table_name = k.table_name AND ix.column_name = k.column_name),
e AS (SELECT s.*, k.data_type, k.column_width, k.is_primary_key, k.is_auto_increment, k.charset, k.collation_name, k.indexed, k.leads_any, k.leads_single,
    k.leads_composite, o.data_type AS other_type, o.charset AS other_charset, o.collation_name AS other_collation,
    s.clause = 'where' AND s.function IS NULL AND s.operator IS NOT NULL AND (s.operator NOT IN ('LIKE', 'NOT LIKE') OR s.with_or) AS counted
  FROM statement_columns s LEFT JOIN known k ON k.table_name = s.table_name AND k.column_name = s.column_name
  LEFT JOIN known o ON o.table_name = s.other_table AND o.column_name = s.other_column),
per_column AS (SELECT id, table_name, column_name, BOOL_OR(leads_composite) AS leads_composite, COUNT(*) FILTER (WHERE counted) AS conditions,
  COUNT(*) FILTER (WHERE counted AND operator = '=') AS equalities, BOOL_OR(with_or) AS with_or FROM e WHERE clause = 'where' AND data_type IS NOT NULL GROUP BY 1, 2, 3),
per_table AS (SELECT id, table_name, COALESCE(BOOL_OR(indexed) FILTER (WHERE counted), FALSE) AS any_indexed,
  COALESCE(BOOL_OR(leads_single) FILTER (WHERE counted), FALSE) AS any_single,
  COALESCE(ARG_MIN(leads_composite, position) FILTER (WHERE counted), FALSE) AS first_leads, COUNT(*) FILTER (WHERE clause = 'table') AS uses FROM e GROUP BY 1, 2),
per_statement AS (SELECT id, COALESCE(BOOL_OR(with_or) FILTER (WHERE clause = 'where'), FALSE) AS with_or,
  COUNT(DISTINCT table_name) FILTER (WHERE clause = 'where') AS condition_tables FROM e GROUP BY 1)"""


COLUMN_VIOLATIONS = "SELECT DISTINCT id, rule_name, level FROM (" + " UNION ALL ".join([
    D.violations("e", column_rules.ROW_RULES, "id"), D.violations("per_column", column_rules.COLUMN_RULES, "id"),
    D.violations("per_table", column_rules.TABLE_RULES, "id"), D.violations("per_statement", column_rules.STATEMENT_RULES, "id")]) + ") z"


@query("l2_audit_columns", f"WITH {_KNOWN} {COLUMN_VIOLATIONS}")
def _(t):
    found = column_rules.audit_columns(statement_columns(t.statement_corpus), t.corpus_columns, t.corpus_indexes)
    return found.select("id", "rule_name", "level")


_RESERVED = ", ".join(f"'{w}'" for w in catalog_rules.RESERVED_WORDS)
_REDUNDANT = """
lists AS (SELECT table_name, index_name, LIST(column_name ORDER BY seq) AS cols, STRING_AGG(column_name, ',' ORDER BY seq) AS k, COUNT(*) AS width,
  BOOL_OR(is_unique) AS is_unique, BOOL_OR(constraint_type = 'PRIMARY KEY') AS is_primary, MAX(index_type) AS index_type FROM schema_indexes GROUP BY 1, 2),
kept AS (SELECT * FROM lists x WHERE NOT EXISTS (SELECT 1 FROM lists y WHERE y.table_name = x.table_name
  AND ((y.k = x.k AND y.index_name > x.index_name) OR starts_with(y.k, x.k || ',')))),
redundant AS (SELECT x.table_name, x.index_name, CASE WHEN r.n IS NOT NULL THEN 'repeat' ELSE 'redundant' END AS redundancy, COALESCE(r.n, p.n) AS covered_by
  FROM lists x LEFT JOIN (SELECT a.table_name, a.index_name, MAX(b.index_name) AS n FROM lists a JOIN lists b
      ON b.table_name = a.table_name AND b.k = a.k AND b.index_name > a.index_name GROUP BY 1, 2) r ON r.table_name = x.table_name AND r.index_name = x.index_name
  LEFT JOIN (SELECT a.table_name, a.index_name, ARG_MIN(b.index_name, b.k) AS n FROM lists a JOIN kept b
      ON b.table_name = a.table_name AND starts_with(b.k, a.k || ',') GROUP BY 1, 2) p ON p.table_name = x.table_name AND p.index_name = x.index_name
  WHERE COALESCE(r.n, p.n) IS NOT NULL)"""
_CATALOG = f"""{_REDUNDANT},
uses AS (SELECT table_name, column_name, COUNT(DISTINCT index_name) AS n FROM schema_indexes GROUP BY 1, 2),
col AS (SELECT k.*, 'column' AS object_type, k.column_name AS object_name, COALESCE(u.n, 0) AS index_count, u.n IS NOT NULL AS in_index,
    t.charset AS table_charset, t.collation_name AS table_collation FROM schema_columns k
  LEFT JOIN uses u ON u.table_name = k.table_name AND u.column_name = k.column_name LEFT JOIN schema_tables t ON t.table_name = k.table_name),
per_c AS (SELECT table_name, COUNT(*) AS column_count, COUNT(*) FILTER (WHERE is_primary_key) AS pk_columns,
    COUNT(*) FILTER (WHERE is_primary_key AND is_auto_increment) AS pk_auto_increment,
    COUNT(*) FILTER (WHERE is_primary_key AND data_type = 'bigint' AND is_unsigned) AS pk_bigint_unsigned,
    COUNT(*) FILTER (WHERE is_auto_increment) AS auto_increment_count,
    COUNT(*) FILTER (WHERE data_type IN ('tinytext', 'text', 'mediumtext', 'longtext')) AS text_columns,
    SUM(CASE WHEN data_type IN ('char', 'varchar') THEN column_width ELSE 0 END) AS char_length_sum,
    COALESCE(LIST(UPPER(column_name)) FILTER (WHERE default_value = 'CURRENT_TIMESTAMP'), []) AS created_columns,
    COALESCE(LIST(UPPER(column_name)) FILTER (WHERE default_value = 'CURRENT_TIMESTAMP' AND contains(LOWER(extra), 'on update current_timestamp')), []) AS updated_columns
  FROM schema_columns GROUP BY 1),
per_i AS (SELECT table_name, COUNT(DISTINCT index_name) AS index_total, COUNT(DISTINCT index_name) FILTER (WHERE constraint_type <> 'PRIMARY KEY') AS secondary_total
  FROM schema_indexes GROUP BY 1),
tab AS (SELECT t.*, 'table' AS object_type, t.table_name AS object_name, c.* EXCLUDE (table_name), COALESCE(i.index_total, 0) AS index_total,
    COALESCE(i.secondary_total, 0) AS secondary_total
  FROM schema_tables t JOIN per_c c ON c.table_name = t.table_name LEFT JOIN per_i i ON i.table_name = t.table_name),
ind AS (SELECT l.*, 'index' AS object_type, l.index_name AS object_name, r.redundancy, NOT is_unique AND NOT is_primary AS plain FROM lists l
  LEFT JOIN redundant r ON r.table_name = l.table_name AND r.index_name = l.index_name),
nam AS (SELECT *, UPPER(object_name) IN ({_RESERVED}) AS is_reserved FROM (
  SELECT table_name, 'table' AS object_type, table_name AS object_name FROM schema_tables UNION ALL
  SELECT table_name, 'column', column_name FROM schema_columns UNION ALL SELECT DISTINCT table_name, 'index', index_name FROM schema_indexes) q),
con AS (SELECT k.table_name, 'constraint' AS object_type, k.column_name AS object_name, u.n IS NOT NULL AS in_index FROM schema_columns k
  LEFT JOIN uses u ON u.table_name = k.table_name AND u.column_name = k.column_name WHERE NOT k.is_nullable)"""
_KEYS = ("object_type", "table_name", "object_name")


@query("l3_audit_catalog", f"WITH {_CATALOG} " + " UNION ALL ".join(
    D.violations(src, rules, *_KEYS).replace("array_contains(", "list_contains(").replace("endswith(", "ends_with(").replace("array_join(", "array_to_string(")
    for src, rules in (("col", catalog_rules.COLUMN_RULES), ("tab", catalog_rules.TABLE_RULES), ("ind", catalog_rules.INDEX_RULES),
                       ("nam", catalog_rules.NAME_RULES), ("con", catalog_rules.CONSTRAINT_RULES))))
def _(t):
    constraints = t.schema_columns.filter("NOT is_nullable").select("table_name", "column_name")
    found = catalog_rules.audit_catalog(t.schema_tables, t.schema_columns, t.schema_indexes, constraints)
    return found.select(*_KEYS, "rule_name", "level")


_DDL_CATALOG = """
ddl_col AS (SELECT * REPLACE (is_nullable AND NOT is_primary_key AS is_nullable) FROM schema_columns),
ddl_ix AS (SELECT * FROM schema_indexes WHERE constraint_type = 'INDEX' AND table_name IN (SELECT table_name FROM schema_tables)
  UNION ALL SELECT table_name, 'PRIMARY', ordinal + 1, column_name, TRUE, 'BTREE', 'PRIMARY KEY', 0 FROM schema_columns WHERE is_primary_key),""" + (
    _CATALOG.replace("schema_columns", "ddl_col").replace("schema_indexes", "ddl_ix"))


def ddl_texts(t):
    """One CREATE TABLE statement for each table of the catalogue."""
    word = lambda test, text: F.when(test, text).otherwise("")
    quoted = lambda name: F.concat(F.lit("`"), c(name), F.lit("`"))
    column = F.concat(
        quoted("column_name"), F.lit(" "), c("data_type"), F.lit("("), c("column_width").cast("string"), F.lit(")"), word(c("is_unsigned"), " UNSIGNED"),
        word(c("charset").isNotNull(), F.concat(F.lit(" CHARACTER SET "), c("charset"))), word(c("collation_name").isNotNull(), F.concat(F.lit(" COLLATE "), c("collation_name"))),
        word(~c("is_nullable"), " NOT NULL"), word(c("default_value").isNotNull(), F.concat(F.lit(" DEFAULT "), F.when(c("default_value") == "0", "'0'").otherwise(c("default_value")))),
        F.lit(" "), c("extra"), word(c("is_auto_increment"), " AUTO_INCREMENT"), word(c("is_primary_key"), " PRIMARY KEY"),
        word(c("column_comment") != "", F.concat(F.lit(" COMMENT '"), c("column_comment"), F.lit("'"))),
    )
    listed = lambda of: F.transform(F.sort_array(F.collect_list(of)), lambda x: x["text"])
    columns = t.schema_columns.groupBy("table_name").agg(listed(F.struct("ordinal", column.alias("text"))).alias("columns"))
    kind = F.when(F.bool_or("is_unique"), "UNIQUE KEY ").when(F.max("index_type") != "BTREE", F.concat(F.max("index_type"), F.lit(" INDEX "))).otherwise("KEY ")
    one = t.schema_indexes.filter("constraint_type = 'INDEX'").groupBy("table_name", "index_name").agg(
        F.concat(kind, quoted("index_name"), F.lit(" ("), F.array_join(listed(F.struct("seq", quoted("column_name").alias("text"))), ", "), F.lit(")")).alias("text")
    )
    indexes = one.groupBy("table_name").agg(F.sort_array(F.collect_list("text")).alias("indexes"))
    none = F.array().cast("array<string>")
    items = F.concat("columns", F.coalesce("indexes", none), F.when(c("has_foreign_key"), F.array(F.lit("FOREIGN KEY (c1) REFERENCES other (c1)"))).otherwise(none))
    text = F.concat(
        F.lit("CREATE TABLE "), c("schema_name"), F.lit("."), quoted("table_name"), F.lit(" ("), F.array_join(items, ", "), F.lit(") ENGINE="), c("engine"),
        F.lit(" AUTO_INCREMENT="), c("auto_increment_start").cast("string"), F.lit(" DEFAULT CHARSET="), c("charset"), F.lit(" COLLATE "), c("collation_name"),
        word(c("table_comment") != "", F.concat(F.lit(" COMMENT='"), c("table_comment"), F.lit("'"))), word(c("is_partitioned"), " PARTITION BY HASH (c0) PARTITIONS 4"),
    )
    return t.schema_tables.join(columns, "table_name").join(indexes, "table_name", "left").select(c("table_name").alias("id"), text.alias("sql_text"))


# The statements are written from the catalogue; the SQL judges the catalogue itself, so what is read out of the texts must give it back.
@query("l3_audit_ddl", f"WITH {_DDL_CATALOG} " + " UNION ALL ".join(
    D.violations(src, rules, *_KEYS).replace("array_contains(", "list_contains(").replace("endswith(", "ends_with(").replace("array_join(", "array_to_string(")
    for src, rules in (("col", catalog_rules.COLUMN_RULES), ("tab", catalog_rules.TABLE_RULES), ("ind", catalog_rules.INDEX_RULES), ("nam", catalog_rules.NAME_RULES))))
def _(t):
    return ddl_rules.audit_definitions(ddl_texts(t), store=fresh_dir(t.spark, "definitions")).select(*_KEYS, "rule_name", "level")


@query("l4_audit_plans", "WITH s AS (SELECT p.*, t.size_mb FROM plan_rows p LEFT JOIN schema_tables t ON t.table_name = p.table_name) "
       "SELECT DISTINCT sql_id, rule_name, level FROM (" + D.violations("s", plan_rules.ROW_RULES, "sql_id").replace("concat(',', lower(", "concat(',', lower(") + ") z")
def _(t):
    return plan_rules.audit_plans(t.plan_rows, t.schema_tables).select("sql_id", "rule_name", "level")


_PLAN_TEXTS = """SELECT o_orderkey AS sql_id, CASE WHEN o_orderkey % 6 = 0 THEN 'Cannot use index due to type or collation conversion on field a'
  WHEN o_orderkey % 6 = 1 THEN NULL ELSE 'none' END AS warnings, REPEAT('-> Filter: (a > 1)', CAST(o_orderkey % 5 AS INTEGER)) AS tree FROM {orders}"""


@query("l4_audit_plan_texts", f"WITH s AS (SELECT sql_id, COALESCE(warnings, '') AS warnings, tree FROM ({_PLAN_TEXTS.replace('{orders}', 'orders')}) q) "
       + D.violations("s", plan_rules.TEXT_RULES, "sql_id"))
def _(t):
    return plan_rules.audit_plan_texts(t.sql(_PLAN_TEXTS)).select("sql_id", "rule_name", "level")


_TARGETS = """SELECT p.sql_id AS subject, CASE p.sql_id % 4 WHEN 0 THEN 'ALTER' WHEN 1 THEN 'SELECT' WHEN 2 THEN 'CREATE' ELSE 'UPDATE' END AS kind,
  p.sql_id % 8 = 0 AS changes_type, p.sql_id % 3 = 0 AS sorts, t.size_mb, t.table_rows AS row_count
  FROM {plan_rows} p JOIN {schema_tables} t ON t.table_name = p.table_name"""
_COUNTS = """SELECT sql_id AS subject, CASE sql_id % 3 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'SELECT' ELSE 'INSERT' END AS kind,
  MAX(rows_est) AS affected_rows, BOOL_OR(access_type IN ('ALL', 'index')) AS scans FROM {plan_rows} GROUP BY sql_id"""
_INDEX_COLUMNS = ("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
_ORACLE_PROFILE = " UNION ALL ".join(
    f"SELECT '{n}' AS subject, 100.0 * COUNT(DISTINCT {n}) / COUNT(*) AS selectivity, (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY {n}) x) / COUNT(*) AS skewness, "
    f"1.0 - (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY {n}) x) / COUNT(*) AS discrimination FROM lineitem" for n in _INDEX_COLUMNS)
_USED = """SELECT p.sql_id AS subject, i.cardinality * 1.0 AS selectivity FROM {plan_rows} p JOIN {schema_indexes} i
  ON i.table_name = p.table_name AND i.index_name = p.key_used WHERE i.seq = 1"""
_USES = """SELECT o_orderkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'SUM' ELSE 'MAX' END AS function, 100 AS row_count, o_orderkey % 3 AS non_null_count,
  o_orderkey % 50 AS new_width, 25 AS max_width FROM {orders}"""
_bare = lambda s: s.replace("{", "").replace("}", "")


@query("l5_audit_profile", f"WITH a AS ({_bare(_TARGETS)}), b AS ({_bare(_COUNTS)}), i AS ({_ORACLE_PROFILE}), u AS ({_bare(_USED)}), w AS ({_bare(_USES)}) "
       "SELECT DISTINCT subject, rule_name, level FROM (" + " UNION ALL ".join(
           D.violations(f"(SELECT * REPLACE (CAST(subject AS VARCHAR) AS subject) FROM {src}) q", rules, "subject")
           for src, rules in (("a", profile_rules.TABLE_RULES), ("b", profile_rules.ROW_COUNT_RULES), ("i", profile_rules.INDEX_COLUMN_RULES),
                              ("u", profile_rules.INDEX_RULES), ("w", profile_rules.COLUMN_USE_RULES))) + ") z")
def _(t):
    prof = P.column_profile(t.lineitem, list(_INDEX_COLUMNS), "lineitem")
    keys = ["table_name", "column_name"]
    figures = P.column_selectivity(prof).join(P.column_skewness(prof), keys).join(P.column_discrimination(prof), keys)
    found = profile_rules.audit_profile(
        table_figures=t.sql(_TARGETS),
        row_counts=t.sql(_COUNTS),
        index_columns=figures.withColumn("subject", c("column_name")),
        used_indexes=t.sql(_USED),
        column_uses=t.sql(_USES),
    )
    return found.select("subject", "rule_name", "level")


@query("l13_redundant_index", f"WITH {_REDUNDANT} SELECT * FROM redundant")
def _(t):
    return catalog_rules.redundant_index(catalog_rules.indexes_with_columns(t.schema_indexes))


@query("l13_redundant_new_index", f"WITH {_REDUNDANT} SELECT * FROM redundant WHERE index_name = 'copy_of_1' OR (covered_by = 'copy_of_1' AND redundancy = 'redundant')")
def _(t):
    lists = catalog_rules.indexes_with_columns(t.schema_indexes)
    return catalog_rules.redundant_new_index(lists, lists.filter("index_name = 'copy_of_1'"))


_SELECTIVITY = "SELECT table_name, column_name, CAST(SUM(LENGTH(column_name) + seq * 7) % 97 AS DOUBLE) + LENGTH(table_name) AS selectivity FROM {schema_indexes} GROUP BY table_name, column_name"


@query("l14_index_order_advice", f"""
SELECT table_name, index_name, cols, advised FROM (
  SELECT i.table_name, i.index_name, STRING_AGG(i.column_name, ',' ORDER BY i.seq) AS cols,
    STRING_AGG(i.column_name, ',' ORDER BY s.selectivity DESC, i.seq) AS advised, COUNT(*) AS n
  FROM schema_indexes i JOIN ({_bare(_SELECTIVITY)}) s ON s.table_name = i.table_name AND s.column_name = i.column_name GROUP BY 1, 2) x
WHERE n > 1 AND cols <> advised""")
def _(t):
    advised = catalog_rules.index_order_advice(t.schema_indexes, t.sql(_SELECTIVITY))
    return advised.select("table_name", "index_name", F.array_join("cols", ",").alias("cols"), F.array_join("advised", ",").alias("advised"))


@query("l15_column_index_count", """
SELECT table_name, column_name, COUNT(DISTINCT index_name) AS index_count FROM schema_indexes GROUP BY 1, 2 HAVING COUNT(DISTINCT index_name) > 2""")
def _(t):
    return catalog_rules.column_index_count(t.schema_indexes, 2)


@query("l16_charset_mismatch", """
SELECT k.table_name, k.column_name, k.charset, t.charset AS table_charset FROM schema_columns k JOIN schema_tables t ON t.table_name = k.table_name
WHERE k.charset <> t.charset""")
def _(t):
    return catalog_rules.charset_mismatch(t.schema_columns, t.schema_tables)


@query("l17_trx_check", """
SELECT database_name, object_name, COUNT(*) AS open_count,
  COUNT(*) FILTER (WHERE FLOOR(epoch(TIMESTAMP '2024-02-01')) - FLOOR(epoch(wait_started)) > 1000000) AS long_count,
  CAST(MAX(FLOOR(epoch(TIMESTAMP '2024-02-01')) - FLOOR(epoch(wait_started))) AS BIGINT) AS longest_seconds FROM lock_waits GROUP BY 1, 2""")
def _(t):
    return catalog_rules.trx_check(t.lock_waits, "2024-02-01", 1000000)


@query("l17_audit_transactions", """
SELECT DISTINCT o_orderkey AS id, 'ddl_check_transactions_not_committed' AS rule_name, 'warn' AS level FROM orders o
WHERE EXISTS (SELECT 1 FROM lock_waits w WHERE w.database_name = CONCAT('db', o.o_orderkey % 5) AND w.object_name = CONCAT('t', o.o_custkey % 12))""")
def _(t):
    ddl = t.sql("SELECT o_orderkey AS id, CONCAT('db', o_orderkey % 5) AS database_name, CONCAT('t', o_custkey % 12) AS object_name FROM {orders}")
    found = other_rules.audit_transactions(ddl, catalog_rules.trx_check(t.lock_waits, "2024-02-01", 60))
    return found.select("id", "rule_name", "level")


@query("a11_audit_merges", """
SELECT id, rule_name, 'notice' AS level FROM (SELECT o_orderkey AS id, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS k FROM orders) x,
  (VALUES ('ddl_check_alter_table_need_merge'), ('R00011')) AS r(rule_name) WHERE k > 1""")
def _(t):
    alters = t.sql("SELECT o_orderkey AS id, o_custkey AS task_id, CONCAT('ALTER TABLE t', o_orderkey % 3, ' ADD COLUMN c INT') AS sql_text FROM {orders}")
    return other_rules.audit_merges(alters).select("id", "rule_name", "level")
