"""Queries of table profiling (P)."""

from pyspark.sql import functions as F

from stmtwarden.lint.text_rules import features
from stmtwarden.functions.statement_columns import statement_columns
from stmtwarden.operators import profile as P
from stmtwarden.plans import dialect as D
from stmtwarden.registry import query, texts
from stmtwarden.session import written

c = F.col
COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def profile(t):
    return P.column_profile(t.lineitem, COLUMNS, "lineitem")


def _each(expr: str) -> str:
    return " UNION ALL ".join(f"SELECT 'lineitem' AS table_name, '{n}' AS column_name, {expr.format(c=n)} FROM lineitem" for n in COLUMNS)


_TOP = "(SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM lineitem GROUP BY {c}) x) / COUNT(*)"


@query("p1_column_selectivity", _each("100.0 * COUNT(DISTINCT {c}) / COUNT(*) AS selectivity"))
def _(t):
    return P.column_selectivity(profile(t))


@query("p1_column_selectivity_approx", _each("COUNT(*) AS row_count, TRUE AS within_error"))
def _(t):
    error = 0.02
    near = P.approx_profile(t.lineitem, COLUMNS, "lineitem", error).withColumnRenamed("distinct_count", "guess")
    exact = profile(t).select("column_name", "distinct_count")
    within = F.abs(F.col("guess") - F.col("distinct_count")) <= 3 * error * F.col("distinct_count") + 1
    return near.join(exact, "column_name").select("table_name", "column_name", "row_count", within.alias("within_error"))


@query("p2_merged_profile", _each("COUNT(*) AS row_count, COUNT({c}) AS non_null_count, TRUE AS distinct_within, TRUE AS skewness_within"))
def _(t):
    """Monthly states, stored, against the profile of the whole."""
    states = written(P.profile_states(t.lineitem, COLUMNS, F.date_trunc("month", "l_shipdate"), "lineitem"), "profile-states")
    exact = profile(t).select("column_name", c("distinct_count").alias("d"), (c("largest_group") / c("row_count")).alias("skewness"))
    both = P.merged_profile(states).join(exact, "column_name")
    within = F.abs(c("distinct_count") - c("d")) <= 4 * 1.04 / 64 * c("d") + 1
    return both.select("table_name", "column_name", "row_count", "non_null_count", within.alias("distinct_within"), c("skewness").between(c("skewness_low"), c("skewness_high")).alias("skewness_within"))


@query("p2_column_skewness", _each(_TOP + " AS skewness"))
def _(t):
    return P.column_skewness(profile(t))


@query("p3_column_discrimination", _each(f"1.0 - {_TOP} AS discrimination, 1.0 - {_TOP} >= 0.7 AS is_enough"))
def _(t):
    return P.column_discrimination(profile(t))


@query("p4_index_selectivity", """
SELECT i.table_name, i.index_name, COALESCE(100.0 * MAX(i.cardinality) / NULLIF(ANY_VALUE(t.table_rows), 0), -1) AS selectivity
FROM schema_indexes i JOIN schema_tables t ON t.table_name = i.table_name GROUP BY 1, 2""")
def _(t):
    return P.index_selectivity(t.schema_indexes, t.schema_tables)


@query("p5_column_cardinality", _each("COUNT(DISTINCT {c}) AS cardinality"))
def _(t):
    return P.column_cardinality(profile(t))


@query("p6_max_column_width", """
SELECT 'part' AS table_name, column_name, new_width, max_width FROM (
  SELECT 'p_name' AS column_name, 8 AS new_width, (SELECT MAX(LENGTH(p_name)) FROM part) AS max_width
  UNION ALL SELECT 'p_brand', 100, (SELECT MAX(LENGTH(p_brand)) FROM part)
  UNION ALL SELECT 'p_type', 3, (SELECT MAX(LENGTH(p_type)) FROM part)) x WHERE new_width < max_width""")
def _(t):
    changes = t.spark.sql("SELECT * FROM VALUES ('part', 'p_name', 8), ('part', 'p_brand', 100), ('part', 'p_type', 3) AS v(table_name, column_name, new_width)")
    return P.max_column_width(P.column_profile(t.part, ["p_name", "p_brand", "p_type"], "part"), changes)


@query("p7_all_null_column", "SELECT 'orders' AS table_name, 'nothing' AS column_name FROM orders HAVING COUNT(*) > 0")
def _(t):
    rows = t.orders.select("o_orderstatus", F.lit(None).cast("string").alias("nothing"), F.when(c("o_orderkey") % 2 == 0, c("o_custkey")).alias("half"))
    return P.all_null_columns(P.column_profile(rows, ["o_orderstatus", "nothing", "half"], "orders"))


@query("p8_table_rows", """
SELECT 'orders' AS table_name, COUNT(*) AS row_count, COUNT(*) > 10000 AS too_large FROM orders
UNION ALL SELECT 'customer', COUNT(*), COUNT(*) > 10000 FROM customer""")
def _(t):
    return P.table_rows({"orders": t.orders, "customer": t.customer}, 1)


@query("p9_table_size", """
SELECT p.sql_id, p.table_name, s.size_mb FROM plan_rows p JOIN schema_tables s ON s.table_name = p.table_name WHERE s.size_mb > 1024""")
def _(t):
    return P.table_size(t.plan_rows.select("sql_id", "table_name"), t.schema_tables)


@query("p10_affected_rows", """
SELECT sql_id, CAST(last AS VARCHAR) AS affected_rows, CAST(s AS VARCHAR) AS total_rows, f AS full_scan FROM (
  SELECT sql_id, BOOL_OR(access_type = 'ALL') AS f, SUM(rows_est) AS s, MAX(rows_est) FILTER (WHERE select_id = m) AS last
  FROM (SELECT *, MAX(select_id) OVER (PARTITION BY sql_id) AS m FROM plan_rows) p GROUP BY 1) x""")
def _(t):
    return texts(P.affected_rows_by_plan(t.plan_rows), "affected_rows", "total_rows")


@query("p10_affected_rows_count", "SELECT COUNT(*) AS affected_rows FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'A'")
def _(t):
    return P.affected_rows_by_count(t.lineitem, "l_quantity > 40 AND l_returnflag = 'A'")


def _counted() -> list[tuple[int, str, str | None, int | None]]:
    """A hundred statements on three tables: id, table, condition, LIMIT."""
    out = []
    for i in range(100):
        table, column, step = (("lineitem", "l_quantity", 1), ("orders", "o_totalprice", 5000), ("customer", "c_acctbal", 300))[i % 3]
        out.append((i, table, None if i % 10 == 9 else f"{column} > {step * (i // 2)}", 50 if i % 4 == 3 else None))
    return out


def _count_sql(i, table, condition, limit):
    n = f"(SELECT COUNT(*) FROM {table} WHERE {condition or 'TRUE'})"
    return f"SELECT CAST({i} AS BIGINT) AS id, {n if limit is None else f'LEAST({n}, {limit})'} AS affected_rows"


@query("p10_affected_rows_shared", " UNION ALL ".join(_count_sql(*s) for s in _counted()))
def _(t):
    return P.affected_rows_shared(_counted(), {"lineitem": t.lineitem, "orders": t.orders, "customer": t.customer})


@query("p10_affected_rows_values", f"""
WITH {D.text_features('statement_corpus')} SELECT id, len(regexp_extract_all(values_list, '~')) AS affected_rows FROM f3
WHERE kind IN ('INSERT', 'REPLACE') AND contains(values_list, '~')""")
def _(t):
    return P.affected_rows_by_values(features(t.statement_corpus))


@query("p11_select_column_selectivity", """
SELECT DISTINCT s.id, s.table_name, s.column_name, v.selectivity FROM statement_columns s
JOIN corpus_selectivity v ON v.table_name = s.table_name AND v.column_name = s.column_name
WHERE s.clause IN ('where', 'select', 'order', 'group', 'join') AND v.selectivity > 0""")
def _(t):
    return P.select_column_selectivity(statement_columns(t.statement_corpus), t.corpus_selectivity)


@query("p12_table_meta", """
SELECT k.table_name, k.column_name, k.ordinal, k.data_type, k.is_nullable, k.default_value, i.index_name, CAST(i.seq AS VARCHAR) AS seq, CAST(i.is_unique AS VARCHAR) AS is_unique, CAST(i.cardinality AS VARCHAR) AS cardinality
FROM schema_columns k LEFT JOIN schema_indexes i ON i.table_name = k.table_name AND i.column_name = k.column_name""")
def _(t):
    meta = P.table_meta(t.schema_columns, t.schema_indexes)
    return texts(meta, "seq", "is_unique", "cardinality").select("table_name", "column_name", "ordinal", "data_type", "is_nullable", "default_value", "index_name", "seq", "is_unique", "cardinality")
