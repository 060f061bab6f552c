"""Columns a statement uses, and how.

Extraction is by patterns over one level of a statement. ``statement_columns``
reads the outermost level; ``scoped_columns`` in :mod:`.scopes` peels
sub-queries off and reads each as a level of its own. What the patterns cannot
see can be given to the lint and advice jobs as a table of the same shape.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.text import STRING, code_text

_NAME = r"[A-Za-z_`][A-Za-z0-9_$`]*(?:\.[A-Za-z_`][A-Za-z0-9_$`]*)*"
_OP = r"<=>|<=|>=|<>|!=|=|<|>|NOT\s+IN\b|IN\b|NOT\s+LIKE\b|LIKE\b|IS\s+NOT\s+NULL\b|IS\s+NULL\b|NOT\s+BETWEEN\b|BETWEEN\b"
_RIGHT = rf"'|[-+]?[0-9]|\(|\?|{_NAME}"
PLAIN = rf"(?i)(?:^|[\s(,])({_NAME})\s*({_OP})\s*({_RIGHT})?"
WRAPPED = rf"(?i)\b([A-Za-z_][A-Za-z0-9_]*)\s*\(\s*({_NAME})[^()]*\)(?:\s*({_OP})\s*({_RIGHT})?)?"
COMPUTED = rf"(?i)(?:^|[\s(,])({_NAME})\s*([-+*/%])\s*[A-Za-z0-9_.`]+\s*({_OP})\s*({_RIGHT})?"
SUBQUERY = r"(?i)\(\s*SELECT\b[^()]*(?:\([^()]*\)[^()]*)*\)"
_END = r"\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\bFOR\s+UPDATE\b|\bUNION\b|$"
JOINS = r"(?i),|\b(?:(?:LEFT|RIGHT|INNER|CROSS|FULL|NATURAL|OUTER)\s+)*JOIN\b|\bSTRAIGHT_JOIN\b"
TABLE_ITEM = rf"(?i)^\s*({_NAME}|@[0-9]+)(?:\s+(?:AS\s+)?([A-Za-z_][A-Za-z0-9_]*))?"
SELECT_ITEM = rf"(?i)^\s*(?:DISTINCT\s+)?({_NAME})(?:\s+(?:AS\s+)?([A-Za-z_][A-Za-z0-9_]*))?\s*$"
STAR_ITEM = rf"(?i)^\s*(?:DISTINCT\s+)?(?:{_NAME}\.)?\*\s*$"
SET_ITEM = rf"(?i)(?:^|\n)\s*({_NAME})\s*=\s*({_RIGHT})?"
TARGET = rf"(?i)^(?:INSERT|REPLACE)\b.*?\bINTO\s+({_NAME})"
DATA_STATEMENT = r"(?i)^[\s(]*(?:SELECT|WITH|INSERT|REPLACE|UPDATE|DELETE)\b"
ORDER_ITEM = rf"(?i)^\s*({_NAME})(?:\s+(ASC|DESC))?\s*$"

# Words after a table that are no alias, words before "(" that are no function.
NOT_ALIAS = ("ON", "USING", "FORCE", "USE", "IGNORE", "SET", "WHERE", "VALUES", "SELECT", "PARTITION")
NOT_FUNCTION = ("IN", "AND", "OR", "NOT", "EXISTS", "VALUES", "ON", "WHERE", "BETWEEN", "LIKE", "ANY", "ALL", "SOME", "USING")
NOT_COLUMN = ("AND", "OR", "NOT", "WHERE", "TRUE", "FALSE", "NULL", "ON", "BETWEEN", "SET", "SELECT")

SCHEMA = (
    "struct<table_name:string,column_name:string,clause:string,position:int,operator:string,function:string,"
    "literal_kind:string,other_table:string,other_column:string,with_or:boolean>"
)


def _part(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def _bare(name: Column) -> Column:
    return F.replace(F.substring_index(name, ".", -1), F.lit("`"), F.lit(""))


def _qualifier(name: Column) -> Column:
    head = F.when(F.contains(name, F.lit(".")), F.substring_index(F.substring_index(name, ".", -2), ".", 1))
    return F.replace(head, F.lit("`"), F.lit(""))


def _own(tables: Column) -> Column:
    return F.filter(tables, lambda t: t["slot"] >= 0)


def _slot(name: Column, tables: Column) -> Column:
    """Table (name, alias, slot) a column belongs to: by alias or name, else the only one of its level.

    Tables of outer levels follow those of the own one and have no slot of their own (-1).
    """
    q = F.lower(_qualifier(name))
    named = F.get(F.filter(tables, lambda t: (F.lower(t["alias"]) == q) | (F.lower(F.substring_index(t["name"], ".", -1)) == q)), F.lit(0))
    only = F.when(F.size(_own(tables)) == 1, F.get(tables, F.lit(0)))
    return F.when(F.contains(name, F.lit(".")), named).otherwise(only)


def _kind(right: Column) -> Column:
    """What a column is compared with."""
    return (
        F.when(right == "", F.lit(None))
        .when(right.startswith("'"), "string")
        .when(right.rlike("^[-+]?[0-9]"), "number")
        .when(right.startswith("("), "list")
        .when(right == "?", "parameter")
        .when(F.upper(right) == "NULL", "null")
        .when(F.upper(right).isin("TRUE", "FALSE"), "boolean")
        .otherwise("column")
    )


def _row(tables: Column, name: Column | None, clause: str, position=None, operator=None, function=None, right=None, table=None, other=None, with_or=None) -> Column:
    null = F.lit(None).cast("string")

    def row(kind, mine, theirs):
        column = null if name is None else _bare(name)
        other_table = null if right is None else F.when(kind == "column", theirs["name"])
        other_column = (null if other is None else other) if right is None else F.when(kind == "column", _bare(right))
        table_name = mine["name"]
        if right is not None:
            # Of two joined columns the one of the later, driven table is named first.
            swap = F.coalesce((kind == "column") & (theirs["slot"] > mine["slot"]), F.lit(False))
            table_name, other_table = F.when(swap, theirs["name"]).otherwise(mine["name"]), F.when(swap, mine["name"]).otherwise(other_table)
            column, other_column = F.when(swap, _bare(right)).otherwise(column), F.when(swap, column).otherwise(other_column)
        return F.struct(
            table_name.alias("table_name"),
            column.alias("column_name"),
            F.lit(clause).alias("clause"),
            (F.lit(None).cast("int") if position is None else position.cast("int")).alias("position"),
            (null if operator is None else F.nullif(F.upper(F.regexp_replace(operator, r"\s+", " ")), F.lit(""))).alias("operator"),
            (null if function is None else F.upper(function)).alias("function"),
            kind.alias("literal_kind"),
            other_table.alias("other_table"),
            other_column.alias("other_column"),
            (F.lit(None).cast("boolean") if with_or is None else with_or).alias("with_or"),
        )

    mine = _slot(name, tables) if table is None else table
    if right is None:
        return row(null, mine, None)
    # Both tables are looked up once: every use of a lambda's expression is computed for itself.
    kind = _kind(right)
    found = F.struct(kind.alias("kind"), mine.alias("mine"), F.when(kind == "column", _slot(right, tables)).alias("theirs"))
    return F.get(F.transform(F.array(found), lambda z: row(z["kind"], z["mine"], z["theirs"])), F.lit(0))


def _pieces(text: Column, pattern: str, groups: int, when: Column) -> Column:
    """Matches of a pattern as structs of their groups g1, g2 ..."""
    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda x: F.struct(*[F.regexp_extract(x, pattern, n + 1).alias(f"g{n + 1}") for n in range(groups)]))


def _predicates(text: Column, clause: str, tables: Column) -> Column:
    """Rows of the conditions in a text: plain, function-wrapped and computed."""
    some = text != ""
    plain = F.filter(_pieces(text, PLAIN, 3, some), lambda x: ~F.upper(x["g1"]).isin(*NOT_COLUMN))
    wrapped = F.filter(_pieces(text, WRAPPED, 4, F.contains(text, F.lit("("))), lambda x: ~F.upper(x["g1"]).isin(*NOT_FUNCTION))
    computed = _pieces(text, COMPUTED, 4, text.rlike("[-+*/%]"))
    either = some & text.rlike(r"(?i)\b(?:OR|XOR)\b")
    return F.concat(
        F.transform(plain, lambda x, n: _row(tables, x["g1"], clause, n, operator=x["g2"], right=x["g3"], with_or=either)),
        F.transform(wrapped, lambda x: _row(tables, x["g2"], clause, operator=x["g3"], function=x["g1"], right=x["g4"], with_or=either)),
        F.transform(computed, lambda x: _row(tables, x["g1"], clause, operator=x["g3"], function=x["g2"], right=x["g4"], with_or=either)),
    )


def _items(text: Column) -> Column:
    """Pieces of a list at its commas, with parenthesised parts folded."""
    folded = F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", "~"), r"\([^()]*\)", "~")
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(folded, ","))


def _numbered(items: str, pattern: str) -> Column:
    """Items of a list with their place and the two groups of a pattern."""
    group = lambda x, g: F.regexp_extract(x, pattern, g).alias(f"g{g}")
    return F.transform(items, lambda x, k: F.struct(k.cast("int").alias("n"), group(x, 1), group(x, 2)))


def statement_tables(statements: DataFrame) -> DataFrame:
    """Statements with ``tables``: array of (name, alias) of the outermost level."""
    c = F.col
    code = code_text(c("sql_text"))
    df = statements.withColumn("bare", F.regexp_replace(code, STRING, "''")).filter(c("bare").rlike(DATA_STATEMENT))
    # Each round folds every innermost sub-query, so as many rounds as there are sub-queries do.
    count = F.when(F.contains(c("bare"), F.lit("(")), F.regexp_count("bare", F.lit(r"(?i)\(\s*SELECT\b"))).otherwise(0)
    rounds = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("bare", F.aggregate(rounds, c("bare"), lambda text, _: F.regexp_replace(text, SUBQUERY, "(@)")))
    return df.withColumn("tables", level_tables(c("bare"), _bare))


def level_tables(bare: Column, name) -> Column:
    """Array of (name, alias, slot) of the tables a level names; ``(@n)``, a sub-query peeled off before, is the table ``@n``."""
    part = (
        F.when(bare.rlike(r"(?i)^UPDATE\b"), _part(bare, r"(?i)^UPDATE\b(.*?)\bSET\b"))
        .when(bare.rlike(r"(?i)\bFROM\b"), _part(bare, rf"(?i)\bFROM\b(.*?)(?:{_END})"))
        .otherwise(_part(bare, TARGET))
    )
    # Lists inside ON and USING are folded so that their commas cut nothing.
    peeled = F.regexp_replace(part, r"(?i)(?:\bLATERAL\s*)?\(@([0-9]+)\)", " @$1 ")
    pieces = F.split(F.regexp_replace(peeled, r"\([^()]*\)", "~"), JOINS)
    item = lambda x, g: F.regexp_extract(x, TABLE_ITEM, g)
    named = F.filter(pieces, lambda x: item(x, 1) != "")
    alias = lambda x: F.when(~F.upper(item(x, 2)).isin(*NOT_ALIAS), F.nullif(item(x, 2), F.lit("")))
    return F.transform(named, lambda x, n: F.struct(name(item(x, 1)).alias("name"), alias(x).alias("alias"), n.cast("int").alias("slot")))


def statement_columns(statements: DataFrame) -> DataFrame:
    """(id, table_name, column_name, clause, position, operator, function,
    literal_kind, other_table, other_column, with_or).

    ``clause`` is where, join, set, order, group, select, alias, insert or
    table (one row per table named, without a column); ``function`` is the
    function or arithmetic sign around the column; ``literal_kind`` tells what a
    condition compares the column with; ``with_or`` that the clause has an OR.
    """
    return level_columns(statement_tables(statements), "id")


def level_columns(df: DataFrame, *keys: str) -> DataFrame:
    """Column uses of each row's level (``bare``, with its ``tables``), beside the row's keys."""
    c = F.col
    b = c("bare")
    df = df.withColumn("_up", F.upper("bare"))
    # A clause is cut out only where its word occurs.
    cut = lambda word, pattern: F.when(F.contains(c("_up"), F.lit(word)), _part(b, pattern)).otherwise("")
    joins = F.regexp_extract_all(b, F.lit(rf"(?i)\bON\b(.*?)(?:\b(?:LEFT|RIGHT|INNER|CROSS|NATURAL|STRAIGHT_JOIN|JOIN)\b|{_END})"), F.lit(1))
    df = df.withColumns(
        {
            "_where": cut("WHERE", r"(?i)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\bFOR\s+UPDATE\b|\bUNION\b|$)"),
            "_on": F.when(F.contains(c("_up"), F.lit("JOIN")), F.array_join(joins, " AND ")).otherwise(""),
            "_set": F.when(F.startswith(c("_up"), F.lit("UPDATE")), _part(b, rf"(?i)\bSET\b(.*?)(?:{_END})")).otherwise(""),
            "_order": cut("ORDER", r"(?i)\bORDER\s+BY\b(.*?)(?:\bLIMIT\b|\bFOR\s+UPDATE\b|\bUNION\b|$)"),
            "_group": cut("GROUP", r"(?i)\bGROUP\s+BY\b(.*?)(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\bFOR\s+UPDATE\b|\bUNION\b|$)"),
            "_select": F.when(F.startswith(c("_up"), F.lit("SELECT")), _part(b, r"(?i)^\s*SELECT\b(.*?)\bFROM\b")).otherwise(""),
            "_insert": cut("INTO", rf"(?i)\bINTO\s+{_NAME}\s*\(([^()]*)\)"),
        }
    )
    # Lists and their names are cut out once, in columns of their own.
    listed = {"_order": ORDER_ITEM, "_group": ORDER_ITEM, "_select": SELECT_ITEM, "_insert": SELECT_ITEM}
    df = df.withColumns({f"{n}_items": _items(c(n)) for n in listed})
    df = df.withColumns({f"{n}_named": F.filter(_numbered(f"{n}_items", p), lambda s: s["g1"] != "") for n, p in listed.items()})
    return df.select(*keys, F.explode(_rows_of(df.sparkSession.sparkContext.applicationId)).alias("_r")).select(*keys, "_r.*")


@lru_cache(maxsize=1)
def _rows_of(application: str) -> Column:
    """Array of all rows of a statement, over the columns cut out before.

    Building the expression takes longer than planning it, so it is built once
    per Spark application.
    """
    c = F.col
    b = c("bare")
    t = c("tables")
    into = F.array(F.struct(_bare(_part(b, TARGET)).alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(0).alias("slot")))
    chosen = F.transform("_select_named", lambda s: F.lower(_bare(s["g1"])))
    starred = F.filter("_select_items", lambda x: x.rlike(STAR_ITEM))
    set_items = _pieces(F.array_join(_items(c("_set")), "\n"), SET_ITEM, 2, c("_set") != "")
    in_select = F.filter(_pieces(c("_select"), WRAPPED, 2, F.contains(c("_select"), F.lit("("))), lambda x: ~F.upper(x["g1"]).isin(*NOT_FUNCTION))
    each = lambda n, make: F.transform(f"{n}_named", make)
    aliased = F.filter("_select_named", lambda s: s["g2"] != "")
    in_star = lambda x, y: F.coalesce(F.lower(_qualifier(x)).isin("", F.lower(y["name"]), F.lower(y["alias"])), F.lit(True))
    rows = F.concat(
        _predicates(c("_where"), "where", t),
        _predicates(c("_on"), "join", t),
        F.transform(set_items, lambda x: _row(t, x["g1"], "set", right=x["g2"])),
        each("_order", lambda s: _row(t, s["g1"], "order", s["n"], operator=F.when(s["g2"] == "", "ASC").otherwise(s["g2"]))),
        each("_group", lambda s: _row(t, s["g1"], "group", s["n"])),
        each("_select", lambda s: _row(t, s["g1"], "select", s["n"])),
        F.transform(aliased, lambda s: _row(t, s["g2"], "alias", s["n"], other=F.get(F.filter(chosen, lambda x: x == F.lower(s["g2"])), F.lit(0)))),
        F.flatten(F.transform(starred, lambda x: F.transform(F.filter(_own(t), lambda y: in_star(x, y)), lambda y: _row(t, F.lit("*"), "select", table=y)))),
        F.transform(_own(t), lambda y: _row(t, None, "table", y["slot"], table=y)),
        F.transform(in_select, lambda x: _row(t, x["g2"], "select", function=x["g1"])),
        each("_insert", lambda s: _row(into, s["g1"], "insert", s["n"])),
    )
    return rows.cast(f"array<{SCHEMA}>")
