"""Rules decided by the statement text alone (L1).

Features are computed once per statement:

``masked``  upper-cased code, comments gone, string literals emptied
``code``    code with literals, in its own case
``outer``   ``masked`` with every parenthesised part as ``~``: clauses found in
            it belong to the outermost statement
``kind``    first keyword
and the clauses and counts cut out of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.text import STRING, code_text, masked_code
from stmtwarden.lint.rule import Rule, both, broken, configure, m, n, violations

_TAIL = r"\bGROUP BY\b|\bORDER BY\b|\bHAVING\b|\bLIMIT\b|\bFOR UPDATE\b|\bUNION\b"

# Name of each clause with a word it needs and the pattern that cuts it out of ``outer``.
CLAUSES = {
    "where_outer": ("WHERE", rf"\bWHERE\b(.*?)(?:{_TAIL}|$)"),
    "sel_list": ("SELECT", r"^(?:WITH .*? )?SELECT (?:DISTINCT )?(.*?)(?: FROM\b|$)"),
    "from_list": ("FROM", rf"\bFROM\b(.*?)(?:\bWHERE\b|{_TAIL}|$)"),
    "group_list": ("GROUP", r"\bGROUP BY\b(.*?)(?:\bHAVING\b|\bORDER BY\b|\bLIMIT\b|\bFOR UPDATE\b|\bUNION\b|$)"),
    "order_list": ("ORDER", r"\bORDER BY\b(.*?)(?:\bLIMIT\b|\bFOR UPDATE\b|\bUNION\b|$)"),
    "update_list": ("UPDATE", r"^UPDATE (.*?) SET\b"),
    "values_list": ("VALUE", r"\bVALUES?\b(.*?)(?:\bON DUPLICATE\b|$)"),
    "limit_text": ("LIMIT", r"\bLIMIT ([0-9]+(?: ?, ?[0-9]+| OFFSET [0-9]+)?)"),
}
KIND = r"^[( ]*([A-Z]+)"
WHERE_ALL = r"\bWHERE\b(.*)"
PARENS = r"\([^()]*\)"
DEPTH_TOKEN = r"\( ?SELECT\b|\(|\)"
TABLE = r"\b(?:FROM|JOIN|INTO|UPDATE) ([A-Z0-9_$`.]+)"
IN_LIST = r"\bIN ?\(([^()]*)\)"
INDEX_COLUMNS = r"\b(?:KEY|INDEX)(?: [A-Z0-9_$`]+)? ?\(([^()]*)\)"
INLINE_KEY = r"[(,] ?`?([A-Z0-9_$]+)`? [A-Z]+[^,]*\bPRIMARY KEY\b"
NOT_NULL = r"[(,] ?`?([A-Z0-9_$]+)`? [A-Z]+(?: ?\([^()]*\))?[^,()]*\b(?:NOT NULL|PRIMARY KEY)\b"


def _paren_depth(masked: Column) -> Column:
    """Deepest nesting of parentheses."""
    step = lambda a, t: F.struct(
        (a["cur"] + F.when(t == ")", -1).otherwise(1)).alias("cur"),
        F.greatest(a["top"], a["cur"] + F.when(t == ")", -1).otherwise(1)).alias("top"),
    )
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top"))
    return F.aggregate(F.regexp_extract_all(masked, F.lit("[()]"), F.lit(0)), start, step, lambda a: a["top"])


def _select_depth(masked: Column) -> Column:
    """Deepest nesting of sub-queries; open parentheses are kept as a string."""
    is_select = lambda t: t.endswith("SELECT")
    down = lambda a: F.when(F.substring(a["open"], 1, 1) == "S", 1).otherwise(0)
    step = lambda a, t: F.struct(
        F.when(t == ")", F.substring(a["open"], 2, 1 << 30)).when(is_select(t), F.concat(F.lit("S"), a["open"])).otherwise(F.concat(F.lit("P"), a["open"])).alias("open"),
        F.when(t == ")", a["cur"] - down(a)).when(is_select(t), a["cur"] + 1).otherwise(a["cur"]).alias("cur"),
        F.when(is_select(t), F.greatest(a["top"], a["cur"] + 1)).otherwise(a["top"]).alias("top"),
    )
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("cur"), F.lit(0).alias("top"))
    return F.aggregate(F.regexp_extract_all(masked, F.lit(DEPTH_TOKEN), F.lit(0)), start, step, lambda a: a["top"])


def _outer(masked: Column, depth: Column) -> Column:
    """Parenthesised parts folded into ``~``, as many times as they nest."""
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, masked, lambda text, _: F.regexp_replace(text, PARENS, "~"))


def _clause(word: str, pattern: str) -> Column:
    return F.when(F.contains(F.col("outer"), F.lit(word)), F.trim(F.regexp_extract("outer", pattern, 1))).otherwise("")


def _names(lists: Column) -> Column:
    """Column names of a list of comma-separated lists, bare and upper-cased."""
    parts = F.split(F.array_join(lists, ","), ",")
    bare = F.transform(parts, lambda x: F.regexp_extract(x, r"^[ `]*([A-Z0-9_$]+)", 1))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def features(statements: DataFrame) -> DataFrame:
    """Statements with the columns the text rules read."""
    c = F.col
    df = statements.withColumn("code", code_text(c("sql_text")))
    df = df.withColumn("masked", masked_code(c("code")))
    none = F.array().cast("array<string>")
    nested = F.contains(c("masked"), F.lit("("))
    # The lists below cost a pass each, so they are made only where they can hold something.
    every = lambda col, pattern, g, when: F.when(when, F.regexp_extract_all(c(col), F.lit(pattern), F.lit(g))).otherwise(none)
    creates = F.startswith(c("masked"), F.lit("CREATE"))
    lists = every("masked", IN_LIST, 1, F.contains(c("masked"), F.lit("IN (")) | F.contains(c("masked"), F.lit("IN(")))
    df = df.withColumns(
        {
            "kind": F.regexp_extract("masked", KIND, 1),
            "where_all": F.when(F.contains(c("masked"), F.lit("WHERE")), F.regexp_extract("masked", WHERE_ALL, 1)).otherwise(""),
            "paren_depth": F.when(nested, _paren_depth(c("masked"))).otherwise(0),
            "select_depth": F.when(nested & F.contains(c("masked"), F.lit("SELECT")), _select_depth(c("masked"))).otherwise(0),
            "padded_literal": F.exists(every("code", STRING, 0, F.contains(c("code"), F.lit("' ")) | F.contains(c("code"), F.lit(" '"))
                                             | F.contains(c("code"), F.lit('"'))), lambda s: s.rlike("^['\"] | ['\"]$")),
            "table_names": F.transform(every("masked", TABLE, 1, ~creates), lambda t: F.replace(t, F.lit("`"), F.lit(""))),
            "in_list_max": F.coalesce(
                F.array_max(F.transform(F.filter(lists, lambda x: ~x.rlike("^ ?SELECT ")), lambda x: F.size(F.split(x, ",")))), F.lit(0)
            ),
            "index_columns": _names(F.concat(every("masked", INDEX_COLUMNS, 1, creates), every("masked", INLINE_KEY, 1, creates))),
            "not_null_columns": _names(every("masked", NOT_NULL, 1, creates)),
        }
    )
    df = df.withColumn("outer", _outer(c("masked"), c("paren_depth")))
    df = df.withColumns({name: _clause(*spec) for name, spec in CLAUSES.items()})
    names = c("table_names")
    uses = F.transform(F.array_distinct(names), lambda t: F.size(F.filter(names, lambda x: x == t)))
    df = df.withColumns({name: F.expr(sql) for name, sql in CONDITIONS.items()})
    return df.withColumns(
        {
            "tables_part": F.when(c("kind") == "UPDATE", c("update_list")).otherwise(c("from_list")),
            "limit_offset": F.when(c("limit_text").contains(","), F.regexp_extract("limit_text", "^([0-9]+)", 1))
            .otherwise(F.regexp_extract("limit_text", "OFFSET ([0-9]+)", 1))
            .try_cast("bigint"),
            "limit_count": F.when(c("limit_text").contains(","), F.regexp_extract("limit_text", "([0-9]+)$", 1))
            .otherwise(F.regexp_extract("limit_text", "^([0-9]+)", 1))
            .try_cast("bigint"),
            "table_uses_max": F.coalesce(F.array_max(uses), F.lit(0)),
            "table_count": F.size(F.array_distinct(names)),
            "nullable_index_columns": F.size(F.array_except("index_columns", "not_null_columns")),
            "index_column_count": F.size("index_columns"),
            "bare_table": F.exists(names, lambda t: ~t.contains(".")),
        }
    )


# Conditions several rules share, each computed once per statement.
_EQUAL_NUMBERS = r"^([0-9]+) ?= ?([0-9]+)$"
_NO_NAMES = "NOT " + m(r"regexp_replace(where_outer, r'\b(TRUE|AND|OR|XOR|IS|NOT|NULL|LIKE|IN|BETWEEN)\b', '')", r"[A-Z_`~@?]")
CONDITIONS = {
    "is_union": "kind IN ('SELECT', 'WITH') AND " + m("outer", r"\bUNION\b"),
    "is_select": "kind IN ('SELECT', 'WITH') AND NOT " + m("outer", r"\bUNION\b"),
    "is_dml": "kind IN ('SELECT', 'WITH', 'INSERT', 'REPLACE', 'UPDATE', 'DELETE')",
    "is_ddl": "kind IN ('CREATE', 'ALTER', 'DROP', 'TRUNCATE', 'RENAME')",
    "is_change": "kind IN ('UPDATE', 'DELETE')",
    "has_from": m("outer", r"\bFROM\b") + " AND NOT " + m("outer", r"\bFROM DUAL\b"),
    "has_where": m("outer", r"\bWHERE\b"),
    "has_limit": m("outer", r"\bLIMIT\b"),
    "has_order": m("outer", r"\bORDER BY\b"),
    "has_group": m("outer", r"\bGROUP BY\b"),
    "count_only": m("sel_list", r"^COUNT ?~( (AS )?[A-Z0-9_`]+)?$"),
    # Always true: no name and no sub-part in the condition, and not two unlike numbers.
    "no_filter": "NOT " + m("outer", r"\bWHERE\b")
    + f" OR ({_NO_NAMES} AND regexp_extract(where_outer, r'{_EQUAL_NUMBERS}', 1) = regexp_extract(where_outer, r'{_EQUAL_NUMBERS}', 2))",
}
SELECT, UNION, DML, DDL, CHANGE = "is_select", "is_union", "is_dml", "is_ddl", "is_change"
FROM, WHERE, LIMIT, ORDER, GROUP, COUNT_ONLY, NO_FILTER = "has_from", "has_where", "has_limit", "has_order", "has_group", "count_only", "no_filter"
_ITEMS = n("order_list", ",") + " + 1"
_JOINS = f"({n('tables_part', r'(?:^|[^A-Z_])(?:STRAIGHT_)?JOIN(?:[^A-Z_]|$)')} + {n('tables_part', ',')})"
_AGGREGATES = r"\b(COUNT|SUM|AVG|MAX|MIN|GROUP_CONCAT|STD|STDDEV|VARIANCE|BIT_AND|BIT_OR|BIT_XOR|JSON_ARRAYAGG|JSON_OBJECTAGG) ?\("
_CREATE = r"^CREATE (OR REPLACE )?(AGGREGATE )?(ALGORITHM ?= ?[A-Z]+ )?(DEFINER ?= ?[^ ]+ )?(SQL SECURITY [A-Z]+ )?"
_NOT_A_COLUMN = r"\bDROP (INDEX|KEY|PRIMARY|FOREIGN|CHECK|PARTITION|CONSTRAINT|DEFAULT)\b"
_INSERT_HEAD = r"^(INSERT|REPLACE)( LOW_PRIORITY| DELAYED| HIGH_PRIORITY)?( IGNORE)?( INTO)? [A-Z0-9_$`.]+ ?~"
_INJECTION = r"\b(SLEEP|BENCHMARK|GET_LOCK|RELEASE_LOCK) ?"
_SUB = r"\( ?SELECT\b"
_DROP_COLUMN = f"{n('outer', r'\bDROP ')} > {n('outer', _NOT_A_COLUMN)}"


def _functions(param: str) -> str:
    """Alternation of the function names of a comma-separated parameter."""
    return "|".join(x.strip().rstrip("()").upper() for x in param.split(","))


# Functions the needless-function rules look for.
NEEDLESS_FIRST = "sha(),sqrt(),md5()"
NEEDLESS_SECOND = "JSON_ARRAY,GROUP_CONCAT,CONCAT_WS,FIND_IN_SET"
# Privileges a GRANT should not give.
GRANTS = "ALL,SUPER,WITH GRANT OPTION"

RULES: list[Rule] = [
    *both("no WHERE condition, or one that is always true",
          f"(({SELECT} AND {FROM} AND NOT {COUNT_ONLY}) OR {CHANGE} OR {UNION}) AND {NO_FILTER}",
          ("all_check_where_is_invalid", "error"), (1, "warn")),
    *both("too many bind variables", f"{DML} AND {n('masked', r'\?')} > {{p}}",
          ("all_check_prepare_statement_placeholders", "error", "100"), (2, "warn", "100")),
    *both("CREATE TABLE without IF NOT EXISTS",
          m("masked", r"^CREATE (TEMPORARY )?TABLE ") + " AND NOT " + m("masked", r"^CREATE (TEMPORARY )?TABLE IF NOT EXISTS "),
          ("ddl_check_table_without_if_not_exists", "error"), (61, "error")),
    *both("join without a condition",
          f"kind IN ('SELECT', 'WITH', 'UPDATE', 'DELETE') AND {_JOINS} > {n('tables_part', r'\b(ON|USING|NATURAL)\b')} AND NOT "
          + m("where_all", r"[A-Z0-9_$`]+\.[A-Z0-9_$`]+ ?(=|<|>|!)[=>]? ?[A-Z0-9_$`]+\.[A-Z0-9_$`]+"),
          ("dml_check_join_has_on", "warn"), (91, "error")),
    *both("column position given by FIRST or AFTER", "kind = 'ALTER' AND " + m("outer", r"\b(ADD|MODIFY|CHANGE)\b.*\b(FIRST|AFTER)\b"),
          ("ddl_disable_alter_field_use_first_and_after", "error"), (65, "error")),
    *both("SELECT *", f"{SELECT} AND " + m("sel_list", r"(^|, ?|\.)\*( ?,|$)"), ("dml_disable_select_all_column", "notice"), (53, "notice")),
    *both("DROP of a database or table", m("masked", r"^DROP (TEMPORARY )?(DATABASE|SCHEMA|TABLE|VIEW)\b"), ("ddl_disable_drop_statement", "error")),
    *both("DROP of anything but an index",
          m("masked", r"^DROP (TEMPORARY )?(DATABASE|SCHEMA|TABLE|VIEW|SEQUENCE|EVENT|PROCEDURE|FUNCTION|TRIGGER)\b")
          + f" OR (kind = 'ALTER' AND ({_DROP_COLUMN} OR " + m("outer", r"\bDROP (PRIMARY|FOREIGN|CHECK|PARTITION|CONSTRAINT)\b|\bMODIFY\b") + "))",
          None, (66, "error")),
    *both("DELETE or UPDATE with LIMIT", f"{CHANGE} AND {LIMIT}", ("dml_check_with_limit", "error")),
    *both("DELETE or UPDATE without LIMIT", f"{CHANGE} AND NOT {LIMIT}", ("dml_check_limit_must_exist", "warn"), (92, "warn")),
    *both("SELECT without LIMIT or with a large one",
          f"{SELECT} AND {FROM} AND NOT {COUNT_ONLY} AND (NOT {LIMIT} OR limit_count > {{p}})", ("dml_check_select_limit", "warn", "1000")),
    *both("DELETE or UPDATE with ORDER BY", f"{CHANGE} AND {ORDER}", ("dml_check_with_order_by", "error"), (102, "error")),
    *both("SELECT with ORDER BY", f"{SELECT} AND {ORDER}", ("dml_check_select_with_order_by", "warn")),
    *both("INSERT without a column list", "kind IN ('INSERT', 'REPLACE') AND NOT " + m("outer", _INSERT_HEAD),
          ("dml_check_insert_columns_exist", "notice"), (88, "notice")),
    *both("too many rows in one INSERT", f"kind IN ('INSERT', 'REPLACE') AND {n('values_list', '~')} > {{p}}",
          ("dml_check_batch_insert_lists_max", "notice", "100")),
    *both("too many values in an IN list", f"{DML} AND in_list_max > {{p}}", ("dml_check_in_query_limit", "warn", "50"), (87, "error", "500")),
    *both("negative condition", f"{DML} AND " + m("where_all", r"<>|!=|\bNOT\b|\bIS NULL\b"), ("dml_check_where_exist_not", "notice")),
    *both("negative condition", f"{DML} AND " + m("regexp_replace(where_all, r'\\bIS NOT NULL\\b', '')", r"<>|!=|<=>|\bNOT\b"), None, (113, "notice")),
    *both("IS NULL condition", f"{DML} AND " + m("where_outer", r"\bIS (NOT )?NULL\b"), ("dml_check_where_exist_null", "notice")),
    *both("scalar sub-query", f"{DML} AND " + m("where_all", r"\( ?SELECT (DISTINCT )?[^,()]*(\([^()]*\)[^,()]*)* FROM\b"),
          ("dml_check_where_exist_scalar_sub_queries", "notice")),
    *both("scalar sub-query", f"{DML} AND " + m("masked", r"(=|<|>|,|SELECT) ?\( ?SELECT (DISTINCT )?[^,()]*(\([^()]*\)[^,()]*)* FROM\b"), None, (115, "warn")),
    *both("SELECT FOR UPDATE", "kind IN ('SELECT', 'WITH') AND " + m("outer", r"\bFOR UPDATE\b"), ("dml_check_select_for_update", "notice"), (99, "notice")),
    *both("sub-queries nested too deep", f"{DML} AND select_depth > {{p}}", ("dml_check_sub_query_depth", "warn", "3"), (108, "notice", "5")),
    *both("needless function", f"{DML} AND " + m("masked", rf"\b({_functions(NEEDLESS_FIRST)}) ?\("), ("dml_check_needless_func", "notice")),
    *both("needless function", f"{DML} AND " + m("masked", rf"\b({_functions(NEEDLESS_SECOND)}) ?\("), None, (94, "notice")),
    *both("isolation level other than READ COMMITTED",
          "(" + m("masked", r"^SET (SESSION |GLOBAL |LOCAL )?TRANSACTION .*ISOLATION LEVEL ") + " AND NOT " + m("masked", r"ISOLATION LEVEL READ COMMITTED")
          + ") OR " + m("code", r"(?i)^SET .*\b(tx|transaction)_isolation *= *\x27(READ-UNCOMMITTED|REPEATABLE-READ|SERIALIZABLE)"),
          ("ddl_check_transaction_isolation_level", "notice"), (62, "notice")),
    *both("LIKE with a leading wildcard", f"{DML} AND " + m("code", r"(?i)\bLIKE \x27[%_]"), ("dml_check_fuzzy_search", "error"), (86, "error")),
    *both("too many joined tables", f"{SELECT} AND {_JOINS} + 1 > {{p}}", ("dml_check_number_of_join_tables", "notice", "3")),
    *both("too many joined tables", f"{DML} AND {_JOINS} + 1 > {{p}}", None, (96, "notice", "3")),
    *both("UNION instead of UNION ALL", f"{DML} AND {n('masked', r'\bUNION\b')} > {n('masked', r'\bUNION ALL\b')}",
          ("dml_check_is_after_union_distinct", "notice"), (90, "notice")),
    *both("paging by offset", f"{SELECT} AND limit_offset IS NOT NULL", ("ddl_check_is_exist_limit_offset", "notice")),
    *both("large paging offset", f"{SELECT} AND limit_offset > {{p}}", ("dml_check_limit_offset_num", "error", "100")),
    *both("large paging offset", "kind IN ('SELECT', 'WITH', 'INSERT', 'REPLACE') AND limit_offset > {p}", None, (45, "notice", "10000")),
    *both("view", m("masked", _CREATE + r"VIEW\b"), ("ddl_check_create_view", "error"), (31, "error")),
    *both("trigger", m("masked", _CREATE + r"TRIGGER\b"), ("ddl_check_create_trigger", "error"), (30, "error")),
    *both("function", m("masked", _CREATE + r"FUNCTION\b"), ("ddl_check_create_function", "error"), (14, "notice")),
    *both("stored procedure", m("masked", _CREATE + r"PROCEDURE\b"), ("ddl_check_create_procedure", "error"), (29, "error")),
    *both("event", m("masked", r"^(CREATE|ALTER) (DEFINER ?= ?[^ ]+ )?EVENT\b"), ("ddl_avoid_event", "error")),
    *both("change of the table's character set",
          m("outer", r"^ALTER TABLE [^ ]+ (.*, ?)?(CONVERT TO )?(DEFAULT )?(CHARACTER SET|CHARSET)\b"),
          ("ddl_hint_update_table_charset_will_not_update_field_charset", "warn"), (73, "warn")),
    *both("column dropped", f"kind = 'ALTER' AND {_DROP_COLUMN}", ("ddl_hint_drop_column", "error"), (71, "error")),
    *both("primary key dropped", "(kind = 'ALTER' AND " + m("outer", r"\bDROP PRIMARY KEY\b") + ") OR " + m("masked", r"^DROP INDEX `?PRIMARY`? "),
          ("ddl_hint_drop_primary_key", "error"), (10, "error")),
    *both("foreign key dropped", "kind = 'ALTER' AND " + m("outer", r"\bDROP FOREIGN KEY\b"), ("ddl_hint_drop_foreign_key", "error"), (72, "error")),
    *both("LIKE without a wildcard at either end", f"{DML} AND " + m("code", r"(?i)\bLIKE \x27([^%\x27]|[^%\x27][^\x27]*[^%\x27])?\x27"),
          ("dml_not_recommend_not_wildcard_like", "warn")),
    *both("NULL in an IN list", f"{DML} AND " + m("where_all", r"\bIN ?\(([^()]*, ?)?NULL ?(,[^()]*)?\)"), ("dml_hint_in_null_only_false", "error"), (120, "error")),
    *both("IN condition", f"{DML} AND " + m("where_outer", r"\bIN ?~"), ("dml_not_recommend_in", "warn")),
    *both("string that starts or ends with a space", "padded_literal", ("dml_check_spaces_around_the_string", "error")),
    *both("full-width quotation mark in a name", f"{DDL} AND " + m("masked", "[“”]"), ("ddl_check_full_width_quotation_marks", "error"), (35, "error")),
    *both("ORDER BY RAND()", f"{SELECT} AND " + m("order_list", r"^RAND ?~"), ("dml_not_recommend_order_by_rand", "warn"), (131, "warn")),
    *both("GROUP BY a constant", f"{SELECT} AND " + m("group_list", r"^[0-9]+( ?,|$| )"), ("dml_not_recommend_group_by_constant", "warn")),
    *both("GROUP BY a column number", f"{DML} AND " + m("group_list", r"(^|,) ?[0-9]+ ?(,|$)"), None, (126, "warn")),
    *both("mixed sort directions", f"{SELECT} AND {n('order_list', r'\bDESC\b')} > 0 AND {n('order_list', r'\bDESC\b')} < {_ITEMS}",
          ("dml_check_sort_direction", "warn")),
    *both("GROUP BY without ORDER BY", f"{SELECT} AND {GROUP} AND NOT {ORDER}", ("dml_hint_group_by_requires_conditions", "warn"), (119, "warn")),
    *both("ORDER BY an expression", f"{SELECT} AND " + m("order_list", r"[-+*/%]"), ("dml_not_recommend_group_by_expression", "warn")),
    *both("ORDER BY an expression or function", "kind IN ('SELECT', 'WITH') AND " + m("order_list", r"[-+*/%~]"), None, (127, "warn")),
    *both("statement too long", "octet_length(sql_text) > {p}", ("dml_check_sql_length", "notice", "1024"), (107, "notice", "1024")),
    *both("HAVING", f"{SELECT} AND " + m("outer", r"\bHAVING\b"), ("dml_not_recommend_having", "warn"), (128, "warn")),
    *both("DELETE of a whole table", f"kind = 'DELETE' AND NOT {WHERE}", ("dml_hint_use_truncate_instead_of_delete", "notice")),
    *both("DELETE of a whole table", f"kind = 'DELETE' AND {NO_FILTER}", None, (124, "notice")),
    *both("SYSDATE()", f"{DML} AND (" + m("sel_list", r"\bSYSDATE ?~") + " OR " + m("where_all", r"\bSYSDATE ?\(") + ")", ("dml_not_recommend_sysdate", "notice")),
    *both("SUM of a column", f"{SELECT} AND " + m("sel_list", r"\bSUM ?~"), ("dml_hint_sum_func_tips", "notice")),
    *both("COUNT of a column", f"{DML} AND " + m("masked", r"\bCOUNT ?\( ?[A-Z_`][A-Z0-9_$`.]* ?\)"), ("dml_hint_count_func_with_col", "error")),
    *both("LIMIT without ORDER BY", f"{SELECT} AND {LIMIT} AND NOT {ORDER}", ("dml_hint_limit_must_be_combined_with_order_by", "notice"), (121, "notice")),
    *both("TRUNCATE", "kind = 'TRUNCATE'", ("dml_hint_truncate_tips", "notice"), (123, "notice")),
    *both("back up before deleting", "kind IN ('TRUNCATE', 'DELETE') OR " + m("masked", r"^DROP (TEMPORARY )?(TABLE|VIEW)\b"), ("dml_hint_delete_tips", "notice")),
    *both("back up before dropping", "kind = 'TRUNCATE' OR " + m("masked", r"^DROP (TEMPORARY )?(TABLE|VIEW)\b"), None, (118, "notice")),
    *both("function common in injections", f"{DML} AND (" + m("sel_list", _INJECTION + "~") + " OR " + m("where_all", _INJECTION + r"\(") + ")",
          ("dml_check_sql_injection_func", "warn")),
    *both("!= instead of <>", m("sql_text", "!="), ("dml_check_not_equal_symbol", "notice")),
    *both("!= instead of <>", f"{DML} AND " + m("where_all", "!="), None, (95, "notice")),
    *both("sub-query in a condition", f"{DML} AND " + m("where_all", _SUB), ("dml_not_recommend_subquery", "notice")),
    *both("sub-query", f"{DML} AND " + m("masked", _SUB), None, (132, "notice")),
    *both("LIMIT in a sub-query", f"{DML} AND " + m("where_all", _SUB + r"[^()]*(\([^()]*\)[^()]*)*\bLIMIT\b"), ("dml_check_subquery_limit", "warn"), (109, "notice")),
    *both("renaming of a table or column",
          f"kind = 'RENAME' OR (kind = 'ALTER' AND ({m('outer', r'\bCHANGE\b')} OR {n('outer', r'\bRENAME\b')} > {n('outer', r'\bRENAME (INDEX|KEY)\b')}))",
          ("ddl_not_allow_renaming", "error"), (74, "error")),
    *both("UPDATE or DELETE without WHERE", f"{CHANGE} AND NOT {WHERE}", ("dml_check_update_or_delete_has_where", "error")),
    *both("INSERT ... SELECT", "kind IN ('INSERT', 'REPLACE') AND (" + m("outer", r"\bSELECT\b") + " OR " + m("masked", r"^[A-Z]+ [^(]*(\([^()]*\) ?)?\( ?SELECT\b") + ")",
          ("dml_check_insert_select", "warn"), (89, "warn")),
    *both("aggregate function", f"{DML} AND " + m("masked", _AGGREGATES), ("dml_check_aggregate", "warn"), (78, "error")),
    *both("comparison with NULL", f"{DML} AND " + m("where_all", r"(=|<|>) ?NULL\b|\bNULL ?(=|<|>|!)"), ("dml_avoid_where_equal_null", "error")),
    *both("indexed column without NOT NULL", "masked LIKE 'CREATE%TABLE%' AND nullable_index_columns > 0", ("ddl_check_index_not_null_constraint", "warn")),
    *both("no indexed column is NOT NULL", "masked LIKE 'CREATE%TABLE%' AND index_column_count > 0 AND nullable_index_columns = index_column_count",
          ("ddl_check_all_index_not_null_constraint", "warn")),
    *both("temporary table without its prefix",
          m("masked", r"^CREATE TEMPORARY TABLE ") + " AND NOT startswith(regexp_extract(masked, r'^CREATE TEMPORARY TABLE (?:IF NOT EXISTS )?(?:[A-Z0-9_$`]+\\.)?`?([A-Z0-9_$]+)', 1), upper('{p}'))",
          None, (42, "warn", "tmp_")),
    *both("same table used too often", f"{DML} AND table_uses_max >= {{p}}", None, (98, "error", "3")),
    *both("table without its database",
          f"({DML} AND bare_table) OR "
          + m("masked", r"^(CREATE (TEMPORARY )?TABLE( IF NOT EXISTS)?|ALTER TABLE|DROP TABLE( IF EXISTS)?|CREATE VIEW|RENAME TABLE|TRUNCATE( TABLE)?) `?[A-Z0-9_$\x{80}-\x{10FFFF}]+`?( |\(|$)"),
          None, (140, "notice")),
    *both("too many tables in one query", f"{DML} AND table_count > {{p}}", None, (141, "notice", "3")),
    *both("prohibited tablespace", m("code", r"(?i)^(CREATE|ALTER) .*\bTABLESPACE ?=? ?[\x27`]?innodb_system\b"), None, (151, "error")),
    *both("auto-increment step other than 1", m("masked", r"^SET .*AUTO_INCREMENT_INCREMENT ?:?= ?[0-9]+") + " AND NOT " + m("masked", r"AUTO_INCREMENT_INCREMENT ?:?= ?1\b"),
          None, (161, "warn")),
    *both("excessive permission", "kind = 'GRANT' AND " + m("masked", rf"\b({_functions(GRANTS)})\b"), None, (174, "warn")),
    *both("hint", f"{DML} AND (" + m("sql_text", r"/\*\+") + " OR " + m("masked", r"\b(FORCE|USE|IGNORE) (INDEX|KEY)\b|\bSTRAIGHT_JOIN\b") + ")", None, (176, "warn")),
    *both("too many sort columns", f"{DML} AND order_list <> '' AND {_ITEMS} > {{p}}", None, (177, "warn", "3")),
    *both("whole table sorted",
          f"(({SELECT} AND {FROM} AND ({ORDER} OR {GROUP} OR " + m("outer", r"^(WITH .*? )?SELECT DISTINCT\b") + f")) OR ({CHANGE} AND {ORDER})) AND {NO_FILTER}",
          None, (178, "error")),
    *both("COUNT of a whole table", f"{DML} AND NOT {WHERE} AND " + m("sel_list", r"\bCOUNT ?~") + " AND " + m("masked", r"\bCOUNT ?\( ?(\*|[0-9]+) ?\)"), None, (220, "warn")),
]

SUPPORTED = r"^\(*\s*(SELECT|WITH|INSERT|REPLACE|UPDATE|DELETE|CREATE|ALTER|DROP|TRUNCATE|RENAME|SET|GRANT|REVOKE|VALUES|TABLE|COMMIT|ROLLBACK|BEGIN|START|SAVEPOINT|RELEASE|USE|SHOW|EXPLAIN|DESCRIBE|DESC|CALL|DO|LOCK|UNLOCK|ANALYZE|OPTIMIZE|CHECK|CHECKSUM|REPAIR|FLUSH|KILL|LOAD|HANDLER|PREPARE|EXECUTE|DEALLOCATE|XA|COMMENT|MERGE|EXEC)\b"


def is_supported() -> Column:
    return F.col("masked").rlike(SUPPORTED)


def audit_text(statements: DataFrame, settings=None, custom: list[Rule] | None = None) -> DataFrame:
    """L1: violations of the text rules, and of ``custom`` ones (any predicate
    over the features), for statements with ``id`` and ``sql_text``."""
    rules = configure(RULES, settings) + list(custom or [])
    return violations(features(statements), rules, "id")


def audited(statements: DataFrame, settings=None) -> DataFrame:
    """Statements with their violations as one array column, nothing exploded.

    When all rules of a job read only the row itself no shuffle is needed to
    bring a statement's results together.
    """
    return features(statements).withColumn("violations", broken(configure(RULES, settings)))
