"""Levels of nested statements, and the columns each of them uses.

A statement's innermost parentheses are handled round by round. Those that hold
a query are cut out, get a number, and leave ``(@n)`` behind; all others only
change their brackets, so that the next round sees what was around them. What is
left of a statement is its level 0. All rounds of a statement run in its own
row, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.statement_columns import _NAME, DATA_STATEMENT, level_columns, level_tables
from stmtwarden.functions.text import STRING, code_text

OPEN, CLOSE = "\u0001", "\u0002"
QUERY = r"(?i)\(\s*(?:SELECT|WITH)\b[^()]*\)"
OTHER = r"(?i)\((?!\s*(?:SELECT|WITH)\b)([^()]*)\)"
SET_WORD = r"(?i)\b(?:UNION|INTERSECT|EXCEPT)\b(?:\s+(?:ALL|DISTINCT)\b)?"
_COMMON = rf"{_NAME}\s*(?:\([^()]*\)\s*)?AS\s*\(@[0-9]+\)"
WITH_HEAD = rf"(?i)^\s*WITH\s+(?:RECURSIVE\s+)?{_COMMON}(?:\s*,\s*{_COMMON})*"
COMMON = rf"(?i)({_NAME})\s*(?:\([^()]*\)\s*)?AS\s*\(@([0-9]+)\)"
LATERAL = r"(?i)\bLATERAL\s*\(@([0-9]+)\)"
CONSTANT_FIRST = rf"(?i)(\b(?:WHERE|AND|OR|ON|NOT|XOR)\s+|\(\s*)(''|[-+]?[0-9][0-9.]*|\?)\s*({{op}})\s*({_NAME})(?=\s|\)|$)"

# Comparison signs and what they become with their sides swapped.
MIRRORED = {"<=>": "<=>", "<>": "<>", "!=": "!=", "<=": ">=", ">=": "<=", "=": "=", "<": ">", ">": "<"}


def _depth(text: Column) -> Column:
    """How deep parentheses are nested, in one pass over them."""
    signs = F.split(F.regexp_replace(text, r"[^()]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at, sign):
        now = at["now"] + F.when(sign == "(", 1).when(sign == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(signs, start, step, lambda at: at["most"])


def _peel(at: Column, _) -> Column:
    """One round: queries in innermost parentheses are cut out, other parentheses change their brackets."""
    first = F.size(at["levels"]) + 1

    def parts(z):
        mark = lambda n: F.when(n < F.size(z["found"]), F.concat(F.lit(f"{OPEN}@"), (first + n).cast("string"), F.lit(CLOSE))).otherwise("")
        left = F.array_join(F.transform(F.split(z["text"], QUERY), lambda piece, n: F.concat(piece, mark(n))), "")
        cut = F.transform(z["found"], lambda x, n: F.struct((first + n).alias("scope"), x.alias("text")))
        return F.struct(left.alias("text"), F.concat(at["levels"], cut).alias("levels"))

    # The queries are looked for once a round, not once for each piece.
    read = F.transform(F.array(F.regexp_replace(at["text"], OTHER, f"{OPEN}$1{CLOSE}")), lambda x: F.struct(x.alias("text"), F.regexp_extract_all(x, F.lit(QUERY), F.lit(0)).alias("found")))
    return F.get(F.transform(read, parts), F.lit(0))


def _comparable(text: Column) -> Column:
    """Comparisons that name a constant first, with their sides swapped; ALL, ANY and SOME before a sub-query left out."""
    text = F.regexp_replace(text, r"(?i)\b(?:ALL|ANY|SOME)\s*(?=\(@)", "")
    swapped = text
    for sign, other in MIRRORED.items():
        swapped = F.regexp_replace(swapped, CONSTANT_FIRST.replace("{op}", rf"{sign}(?![<>=])"), f"$1$4 {other} $2")
    # One search tells the texts that have any; what is swapped starts with a name and is not found again.
    return F.when(text.rlike(CONSTANT_FIRST.replace("{op}", "[<>!=]+")), swapped).otherwise(text)


def _full(name: Column) -> Column:
    return F.replace(name, F.lit("`"), F.lit(""))


def statement_scopes(statements: DataFrame) -> DataFrame:
    """(id, scope, branch, parent, bare, tables): one row for each query in a data statement.

    ``scope`` is 0 for what is outside all sub-queries; ``branch`` counts the
    members of a UNION, INTERSECT or EXCEPT; ``parent`` is the scope around it.
    ``tables`` holds the level's own tables, then those of the levels around it
    that it may name (slot -1), nearest first. A derived or common table is
    named ``@n`` after the scope that defines it; such a scope does not see the
    tables beside it unless it is LATERAL. A statement whose parentheses do not
    match keeps what is left in level 0. Null texts have no rows.
    """
    c = F.col
    code = F.regexp_replace(F.translate(code_text(c("sql_text")), OPEN + CLOSE, "  "), STRING, "''")
    df = statements.select("id", code.alias("_code")).filter(c("_code").rlike(DATA_STATEMENT))
    rounds = F.when(F.contains("_code", F.lit("(")), F.sequence(F.lit(1), F.greatest(F.lit(1), _depth(c("_code"))))).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<struct<scope:int,text:string>>")
    df = df.withColumn("_peeled", F.aggregate(rounds, F.struct(c("_code").alias("text"), none.alias("levels")), _peel))
    plain = lambda x: F.trim(F.regexp_replace(F.translate(x, OPEN + CLOSE, "()"), r"(?i)^\s*\(\s*((?:SELECT|WITH)\b.*)\)\s*$", "$1"))
    levels = F.concat(F.array(F.struct(F.lit(0).alias("scope"), c("_peeled.text").alias("text"))), c("_peeled.levels"))
    df = df.withColumn("_levels", F.transform(levels, lambda s: F.struct(s["scope"].alias("scope"), plain(s["text"]).alias("text"))))

    def branches(s):
        names = F.regexp_extract_all(F.regexp_extract(s["text"], WITH_HEAD, 0), F.lit(COMMON), F.lit(0))
        common = F.transform(names, lambda x: F.struct(F.lower(_full(F.regexp_extract(x, COMMON, 1))).alias("name"), F.concat(F.lit("@"), F.regexp_extract(x, COMMON, 2)).alias("scope")))
        body = F.regexp_replace(s["text"], WITH_HEAD, "")
        return F.transform(
            F.split(body, SET_WORD),
            lambda x, n: F.struct(s["scope"].alias("scope"), n.cast("int").alias("branch"), F.trim(x).alias("bare"), s["text"].alias("whole"), common.alias("common"), level_tables(F.trim(x), _full).alias("tables")),
        )

    df = df.withColumn("_queries", F.flatten(F.transform("_levels", branches)))
    mark = lambda scope: F.concat(F.lit("(@"), scope.cast("string"), F.lit(")"))

    def placed(q):
        # The member of a set that names the scope, or the level whose WITH does.
        holds = F.filter("_queries", lambda p: F.contains(p["whole"], mark(q["scope"])) & (F.contains(p["bare"], mark(q["scope"])) | F.exists(p["common"], lambda w: w["scope"] == F.concat(F.lit("@"), q["scope"].cast("string")))))
        above = F.get(holds, F.lit(0))
        beside = F.exists(above["tables"], lambda t: t["name"] == F.concat(F.lit("@"), q["scope"].cast("string"))) & ~F.array_contains(
            F.regexp_extract_all(above["bare"], F.lit(LATERAL), F.lit(1)), q["scope"].cast("string")
        )
        defines = F.exists(above["common"], lambda w: w["scope"] == F.concat(F.lit("@"), q["scope"].cast("string")))
        return F.struct(q["scope"], q["branch"], q["bare"], q["common"], q["tables"], above["scope"].alias("parent"), above["branch"].alias("above"),
                        F.coalesce(beside | defines, F.lit(False)).alias("closed"))

    # Every statement has a query. Of a plain explode Spark infers that the array is not empty and checks that below
    # all columns, where each lambda would work out the levels anew.
    df = df.withColumn("_placed", F.transform("_queries", placed)).withColumn("q", F.explode_outer("_placed"))

    def climb(at, _):
        up = F.get(F.filter("_placed", lambda p: (p["scope"] == at["parent"]) & (p["branch"] == at["above"])), F.lit(0))
        outer = F.transform(up["tables"], lambda t: F.struct(t["name"].alias("name"), t["alias"].alias("alias"), F.lit(-1).alias("slot")))
        further = F.struct(
            up["parent"].alias("parent"),
            up["above"].alias("above"),
            up["closed"].alias("closed"),
            F.when(at["closed"], at["tables"]).otherwise(F.concat(at["tables"], outer)).alias("tables"),
            F.concat(at["common"], up["common"]).alias("common"),
        )
        return F.when(at["parent"].isNull(), at).otherwise(further)

    start = F.struct(*[c(f"q.{n}").alias(n) for n in ("parent", "above", "closed", "tables", "common")])
    seen = F.aggregate(F.sequence(F.lit(1), F.size("_levels")), start, climb)
    df = df.withColumn("_seen", seen)
    named = lambda t: F.coalesce(F.get(F.filter("_seen.common", lambda w: w["name"] == F.lower(t["name"])), F.lit(0))["scope"], t["name"])
    called = lambda t: F.coalesce(t["alias"], F.substring_index(t["name"], ".", -1))
    tables = F.transform("_seen.tables", lambda t: F.struct(named(t).alias("name"), called(t).alias("alias"), t["slot"].alias("slot")))
    return df.select("id", c("q.scope").alias("scope"), c("q.branch").alias("branch"), c("q.parent").alias("parent"), _comparable(c("q.bare")).alias("bare"), tables.alias("tables"))


def scoped_columns(statements: DataFrame) -> DataFrame:
    """N9 at every level: (id, scope, branch, parent, schema_name, table_name,
    derived_scope, column_name ...) and the columns of :func:`statement_columns`.

    A column without a schema in its table's name has none here. A column of a
    derived or common table has no ``table_name`` but the ``derived_scope`` that
    defines it; ``other_schema`` and ``other_scope`` say the same of the column
    it is compared with. A column named after a table of an outer level belongs
    to that table.
    """
    c = F.col
    keys = ("id", "scope", "branch", "parent")
    rows = level_columns(statement_scopes(statements), *keys)
    part = lambda n, p: F.when(~F.startswith(c(n), F.lit("@")), p)
    schema = lambda n: part(n, F.when(F.contains(n, F.lit(".")), F.substring_index(n, ".", 1)))
    table = lambda n: part(n, F.substring_index(n, ".", -1))
    scope = lambda n: F.when(F.startswith(c(n), F.lit("@")), F.substring(n, 2, 9).cast("int"))
    return rows.select(
        *keys, schema("table_name").alias("schema_name"), table("table_name").alias("table_name"), scope("table_name").alias("derived_scope"),
        "column_name", "clause", "position", "operator", "function", "literal_kind",
        schema("other_table").alias("other_schema"), table("other_table").alias("other_table"), scope("other_table").alias("other_scope"),
        "other_column", "with_or",
    )
