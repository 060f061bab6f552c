"""Rules that compare a figure of the data with a threshold.

Each source of figures is one DataFrame with a key and the figure's columns;
``audit_profile`` takes those that are at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.lint.rule import Rule, both, configure, violations

# Figures of a statement's target table: kind (first keyword), action, size_mb, row_count.
TABLE_RULES: list[Rule] = [
    *both("DDL on a large table, in MB", "kind IN ('ALTER', 'DROP', 'CREATE') AND size_mb > {p}", ("ddl_check_table_size", "warn", "1024")),
    *both("DML on a large table, in MB", "kind IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'REPLACE') AND size_mb > {p}", ("dml_check_table_size", "warn", "1024")),
    *both("column type changed on a large table, in GB", "kind = 'ALTER' AND changes_type AND size_mb > {p} * 1024", None, (59, "warn", "5")),
    *both("too many rows in a table, in ten thousands", "kind = 'CREATE' AND row_count > {p} * 10000", ("ddl_check_table_rows", "warn", "1000")),
    *both("sorting of a large table", "kind = 'SELECT' AND sorts AND size_mb > 1024", None, (101, "warn")),
]
# Figures of a statement's plan: kind, affected_rows, scans (a full or full-index scan), has_limit.
ROW_COUNT_RULES: list[Rule] = [
    *both("too many rows changed", "kind IN ('UPDATE', 'DELETE') AND affected_rows > {p}", ("dml_check_affected_rows", "warn", "10000"), (76, "warn", "10000")),
    *both("too many rows written", "kind IN ('INSERT', 'REPLACE') AND affected_rows > {p}", None, (80, "warn", "100")),
    *both("many rows read without an index, in ten thousands", "kind = 'SELECT' AND scans AND affected_rows > {p} * 10000", ("dml_check_select_rows", "warn", "10")),
    *both("too many rows returned", "kind = 'SELECT' AND affected_rows > {p}", None, (100, "error", "1000")),
]
# Figures of a column that an index is made on: selectivity, skewness, discrimination.
INDEX_COLUMN_RULES: list[Rule] = [
    *both("index column of low selectivity", "selectivity >= 0 AND selectivity < {p}", ("ddl_check_index_option", "notice", "70")),
    *both("index column with skewed data", "skewness > {p}", None, (22, "notice", "0.7")),
    *both("index column of low discrimination", "discrimination < {p}", None, (39, "notice", "0.7")),
]
# Figures of an index a plan uses.
INDEX_RULES: list[Rule] = [
    *both("index of low selectivity used", "selectivity > 0 AND selectivity < {p}", ("dml_check_index_selectivity", "error", "70")),
]
# Composite indexes with a better order.
ORDER_RULES: list[Rule] = [
    *both("composite index not ordered by selectivity", "TRUE", ("ddl_check_composite_index_distinction", "notice")),
]
# Uses of a column: aggregated in a SELECT, shortened by an ALTER.
COLUMN_USE_RULES: list[Rule] = [
    *both("SUM or COUNT of an all-null column", "function IN ('SUM', 'COUNT') AND row_count > 0 AND non_null_count = 0", None, (122, "notice")),
    *both("column made shorter than its data", "new_width < max_width", None, (170, "warn")),
]
RULES = TABLE_RULES + ROW_COUNT_RULES + INDEX_COLUMN_RULES + INDEX_RULES + ORDER_RULES + COLUMN_USE_RULES


def audit_profile(
    table_figures: DataFrame | None = None,
    row_counts: DataFrame | None = None,
    index_columns: DataFrame | None = None,
    used_indexes: DataFrame | None = None,
    reordered: DataFrame | None = None,
    column_uses: DataFrame | None = None,
    settings=None,
) -> DataFrame:
    """(subject, rule_name, level, message); ``subject`` is the statement or
    object id in each input's ``subject`` column."""
    jobs = (
        (table_figures, TABLE_RULES),
        (row_counts, ROW_COUNT_RULES),
        (index_columns, INDEX_COLUMN_RULES),
        (used_indexes, INDEX_RULES),
        (reordered, ORDER_RULES),
        (column_uses, COLUMN_USE_RULES),
    )
    found = None
    for df, rules in jobs:
        chosen = configure(rules, settings)
        if df is None or not chosen:
            continue
        part = violations(df.withColumn("subject", F.col("subject").cast("string")), chosen, "subject")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no figures given")
    return found.distinct()
