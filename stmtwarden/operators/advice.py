"""Index advice (I).

Input: statement columns (N9), column selectivities (P1), the catalogue and
plan rows. All columns of one statement are brought together by one shuffle on
the statement; the advice itself is array arithmetic inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most columns of an advised index, lowest selectivity of a column in it.
MAX_COLUMNS = 3
MIN_SELECTIVITY = 2.0

# Types no index should have.
UNFIT_TYPES = ("blob", "tinyblob", "mediumblob", "longblob", "text", "tinytext", "mediumtext", "longtext", "json")

_CONSTANT = ("number", "string", "null", "boolean")


def scanning_statements(plan_rows: DataFrame) -> DataFrame:
    """Statements whose plan has a full or full-index scan."""
    return plan_rows.filter(F.col("access_type").isin("ALL", "index")).select("id").distinct()


def index_lists(indexes: DataFrame) -> DataFrame:
    """Per table its indexes as arrays of columns (a table has few)."""
    per_index = indexes.groupBy("table_name", "index_name").agg(F.sort_array(F.collect_list(F.struct("seq", "column_name"))).alias("_s"))
    lists = per_index.select("table_name", "index_name", F.transform("_s", lambda s: F.lower(s["column_name"])).alias("cols"))
    return lists.groupBy(F.lower("table_name").alias("table_name")).agg(F.sort_array(F.collect_list(F.struct("index_name", "cols"))).alias("indexes"))


def _names(a: Column) -> Column:
    return F.transform(a, lambda x: x["name"])


def _covered(wanted: Column, indexes: Column) -> Column:
    """Some index starts with exactly these columns, in any order."""
    return F.exists(
        F.coalesce(indexes, F.array().cast("array<struct<index_name:string,cols:array<string>>>")),
        lambda i: (F.size(wanted) > 0)
        & (F.size(i["cols"]) >= F.size(wanted))
        & (F.size(F.array_except(F.slice(i["cols"], F.lit(1), F.greatest(F.size(wanted), F.lit(1))), wanted)) == 0),
    )


def three_star_index(
    columns: DataFrame,
    scanning: DataFrame,
    catalog: DataFrame,
    selectivity: DataFrame,
    indexes: DataFrame,
    max_columns: int = MAX_COLUMNS,
    min_selectivity: float = MIN_SELECTIVITY,
) -> DataFrame:
    """(id, table_name, columns) of one index per scanning SELECT.

    Equality columns by selectivity, then one sort column if all directions
    agree (it may replace a weaker last column), then the selected columns if
    the whole statement fits, then one range column. Nothing is advised when
    an index starts with these columns already, or under OR without a cover.
    """
    c = F.col
    low = lambda n: F.lower(c(n)).alias(n)
    known = catalog.select(low("table_name"), low("column_name"), low("data_type"), "is_primary_key").join(
        selectivity.select(low("table_name"), low("column_name"), "selectivity"), ["table_name", "column_name"]
    )
    item = F.struct(
        (-c("selectivity")).alias("rank"), c("column_name").alias("name"), c("selectivity").alias("sel"), c("data_type").isin(*UNFIT_TYPES).alias("unfit")
    )
    # One row per table: its columns (few) and its indexes.
    tables = (
        known.groupBy("table_name")
        .agg(F.collect_list(item).alias("_cols"), F.max(F.when(c("is_primary_key"), c("column_name"))).alias("pk"))
        .join(index_lists(indexes), "table_name", "left")
    )
    clause = c("clause")
    cls = (
        F.when((clause == "where") & (c("operator") == "=") & c("literal_kind").isin(*_CONSTANT), "equal")
        .when((clause == "where") & c("operator").isin("<", "<=", ">", ">=") & c("literal_kind").isin(*_CONSTANT), "range")
        .when((clause == "where") & c("operator").isin("IN", "NOT IN"), "range")
        .when(clause == "order", "order")
        .when(clause == "select", "field")
    )
    used = (
        columns.filter(clause.isin("where", "order", "select", "table"))
        .withColumns({"table_name": F.lower("table_name"), "column_name": F.lower("column_name"), "cls": F.when(c("function").isNull(), cls)})
        .join(scanning.select("id"), "id", "left_semi")
        .join(tables, "table_name", "left")
        # A star stands for all columns of its table.
        .withColumn("_item", F.explode_outer(F.when(c("column_name") == "*", c("_cols")).otherwise(F.filter("_cols", lambda x: x["name"] == c("column_name")))))
    )
    of = lambda k: F.sort_array(F.collect_set(F.when(c("cls") == k, c("_item")))).alias(k)
    per_table = used.groupBy("id", "table_name").agg(
        of("equal"),
        of("range"),
        of("order"),
        of("field"),
        F.any_value("pk").alias("pk"),
        F.any_value("indexes").alias("indexes"),
        F.min(F.when(clause == "table", c("position"))).alias("_place"),
        F.bool_or(F.when(clause == "where", c("with_or"))).alias("using_or"),
        F.count_if(clause == "order").alias("order_count"),
        F.count_if((clause == "order") & (c("operator") == "DESC")).alias("desc_count"),
        F.count_if(clause == "select").alias("select_count"),
    )
    # The driving table is the first one named; only SELECTs select columns.
    parts = ("table_name", "equal", "range", "order", "field", "pk", "indexes")
    grouped = (
        per_table.groupBy("id")
        .agg(
            F.min_by(F.struct(*parts), "_place").alias("_d"),
            F.bool_or("using_or").alias("using_or"),
            *[F.sum(n).alias(n) for n in ("order_count", "desc_count", "select_count")],
        )
        .filter("select_count > 0 AND _d.table_name IS NOT NULL")
        .select("id", "_d.*", "using_or", "order_count", "desc_count")
    )
    every = F.array_distinct(F.concat("equal", "range", "order", "field"))
    # A result in primary-key order needs no primary key in the index.
    by_key = (F.size("order") == 0) | ((F.size("order") == 1) & (F.get("order", F.lit(0))["name"] == c("pk")))
    g = grouped.withColumn(
        "possible", F.when(c("pk").isNotNull() & by_key, F.filter(every, lambda x: x["name"] != c("pk"))).otherwise(every)
    )
    weak = lambda x: (x["sel"] <= min_selectivity) | x["unfit"]
    g = g.withColumn("cover", (F.size("range") <= 1) & ~F.exists("possible", weak) & (F.size("possible") <= max_columns))
    may = (F.size("possible") > 0) & (~F.coalesce("using_or", F.lit(False)) | c("cover"))
    fit = lambda group: F.filter(
        group, lambda x: F.array_contains(c("possible"), x) & ~F.array_contains(c("range"), x) & ~weak(x)
    )
    first = lambda a, n: F.slice(a, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    g = g.withColumn("_a", first(fit("equal"), max_columns))
    same_way = (c("order_count") > 0) & ((c("desc_count") == 0) | (c("desc_count") == c("order_count")))
    taken = F.exists("order", lambda x: F.array_contains(c("_a"), x) & ~F.array_contains(c("range"), x))
    pick = F.get(F.array_except(fit("order"), "_a"), F.lit(0))
    g = g.withColumn("_o", F.when(same_way & ~taken, pick))
    last = F.element_at("_a", -1)
    g = g.withColumn(
        "_b",
        F.when(c("_o").isNull(), c("_a"))
        .when(F.size("_a") < max_columns, F.concat("_a", F.array("_o")))
        .when(last["sel"] < c("_o")["sel"], F.concat(first(c("_a"), max_columns - 1), F.array("_o")))
        .otherwise(c("_a")),
    )
    more = first(F.array_except(fit("field"), "_b"), F.lit(max_columns) - F.size("_b"))
    g = g.withColumn("_c", F.when(c("cover"), F.concat("_b", more)).otherwise(c("_b")))
    spare = F.array_except(first(c("range"), 1), c("_c"))
    g = g.withColumn("_d", F.when(F.size("_c") < max_columns, F.concat("_c", spare)).otherwise(c("_c")))
    g = g.withColumn("_advised", _names(c("_d")))
    # Rows are dropped by an empty explode: a filter would be pushed below every
    # step above and repeat all of its expressions there.
    good = may & (F.size("_advised") > 0) & ~_covered(c("_advised"), c("indexes"))
    none = F.array().cast("array<array<string>>")
    return g.select(
        "id", "table_name", F.explode(F.when(good, F.array("_advised")).otherwise(none)).alias("columns"), F.lit("three-star index").alias("reason")
    )


def _indexed(indexes: DataFrame) -> DataFrame:
    """Columns that lead an index."""
    return indexes.filter("seq = 1").select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")).distinct()


def _advice(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy("id", "table_name").agg(F.sort_array(F.collect_set("column_name")).alias("columns"), F.first(reason).alias("reason"))


def join_index(columns: DataFrame, scanning: DataFrame, indexes: DataFrame) -> DataFrame:
    """Join columns of a driven table that lead no index."""
    c = F.col
    joined = columns.filter((c("clause") == "join") & (c("literal_kind") == "column") & (F.lower("table_name") != F.lower("other_table")))
    rows = joined.join(scanning.select("id"), "id", "left_semi").select("id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    return _advice(rows.join(_indexed(indexes), ["table_name", "column_name"], "left_anti"), F.lit("join column"))


def function_index(columns: DataFrame, scanning: DataFrame, version: str) -> DataFrame:
    """Columns inside a function in a condition; what to do depends on the
    server version: virtual columns from 5.7, function indexes from 8.0.13."""
    c = F.col
    rows = columns.filter((c("clause") == "where") & c("function").rlike("^[A-Z_]") & c("table_name").isNotNull())
    rows = rows.join(scanning.select("id"), "id", "left_semi").select("id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    parts = F.transform(F.split(F.lit(version), r"\."), lambda x: x.cast("int"))
    at_least = lambda *v: parts >= F.array(*[F.lit(x) for x in v])
    how = F.when(at_least(8, 0, 13), "function index").when(at_least(5, 7, 0), "index on a virtual column").otherwise("rewrite without the function")
    return _advice(rows, how)


def extremal_index(columns: DataFrame, scanning: DataFrame, indexes: DataFrame) -> DataFrame:
    """I4: arguments of MIN and MAX that lead no index."""
    c = F.col
    rows = columns.filter((c("clause") == "select") & c("function").isin("MIN", "MAX") & c("table_name").isNotNull())
    rows = rows.join(scanning.select("id"), "id", "left_semi").select("id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    return _advice(rows.join(_indexed(indexes), ["table_name", "column_name"], "left_anti"), F.lit("argument of MIN or MAX"))


def prefix_index(columns: DataFrame, statements: DataFrame, scanning: DataFrame) -> DataFrame:
    """Columns searched with a leading wildcard (``statements``: id, sql_text)."""
    c = F.col
    # the column before each such LIKE, so that others of the statement are not advised
    named = F.regexp_extract_all("sql_text", F.lit(r"(?i)([\w$]+)[`\"]?\s+(?:NOT\s+)?LIKE\s+(?:BINARY\s+)?'[%_]"), F.lit(1))
    fuzzy = statements.select("id", F.explode(F.array_distinct(F.transform(named, F.lower))).alias("column_name"))
    rows = columns.filter((c("clause") == "where") & (c("operator") == "LIKE") & c("table_name").isNotNull())
    rows = rows.join(scanning.select("id"), "id", "left_semi").select("id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
    return _advice(rows.join(fuzzy, ["id", "column_name"], "left_semi"), F.lit("leading wildcard"))
