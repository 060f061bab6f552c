"""Rules on plan rows (L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.lint.rule import Rule, both, configure, violations, violations_by

# Access levels a plan may use.
ALLOWED_LEVELS = "range,ref,const,eq_ref,system,NULL"

ROW_RULES: list[Rule] = [
    *both("full scan of many rows", "access_type = 'ALL' AND rows_est > {p}", ("dml_check_explain_access_type_all", "warn", "10000")),
    *both("sorted outside an index", "contains(extra, 'Using filesort')", ("dml_check_explain_extra_using_filesort", "warn"), (82, "warn")),
    *both("temporary table", "contains(extra, 'Using temporary')", ("dml_check_explain_extra_using_temporary", "warn"), (84, "warn")),
    *both("full index scan", "access_type = 'index'", ("dml_check_explain_full_index_scan", "warn"), (85, "warn")),
    *both("index skip scan", "contains(extra, 'Using index for skip scan')", ("dml_check_explain_extra_using_index_for_skip_scan", "error"), (83, "error")),
    *both("condition without an index", "key_used = '' AND contains(extra, 'Using where')", ("dml_check_using_index", "warn")),
    *both("many rows scanned, in ten thousands", "rows_est > {p} * 10000", ("dml_check_scan_rows", "error", "10")),
    *both("access level too low", "NOT contains(concat(',', lower('{p}'), ','), concat(',', lower(access_type), ','))",
          ("dml_sql_explain_lowest_level", "warn", ALLOWED_LEVELS)),
    *both("index merge", "access_type = 'index_merge'", None, (175, "warn")),
    *both("full scan of a large table, in GB", "access_type = 'ALL' AND size_mb >= {p} * 1024", None, (139, "warn", "5")),
]
# A plan's warnings and its tree are texts of the statement, not of a step.
TEXT_RULES: list[Rule] = [
    *both("implicit conversion", "contains(warnings, 'due to type or collation conversion on field')", None, (179, "warn")),
    *both("too many filter steps", "regexp_count(tree, r'Filter') > {p}", None, (180, "warn", "2")),
]
RULES = ROW_RULES + TEXT_RULES


def audit_plans(plan_rows: DataFrame, tables: DataFrame, settings=None) -> DataFrame:
    """L4: violations by statement from its plan steps, each rule once.

    ``tables``: table_name, size_mb.
    """
    sized = plan_rows.join(tables.select("table_name", "size_mb"), "table_name", "left")
    return violations_by(sized, configure(ROW_RULES, settings), "sql_id")


def audit_plan_texts(plan_texts: DataFrame, settings=None) -> DataFrame:
    """L4: violations from a plan's warnings and tree (sql_id, warnings, tree)."""
    texts = plan_texts.select("sql_id", F.coalesce("warnings", F.lit("")).alias("warnings"), F.coalesce("tree", F.lit("")).alias("tree"))
    return violations(texts, configure(TEXT_RULES, settings), "sql_id")
