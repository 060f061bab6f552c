"""Catalogue entries that other operators decide, as violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.lint.rule import both, configure, violations
from stmtwarden.operators.merge import merge_candidates

MERGE_RULES = both("ALTERs of one table that could be one statement", "TRUE", ("ddl_check_alter_table_need_merge", "notice"), (11, "notice"))
TRX_RULES = both("open transaction on the table", "open_count > 0", ("ddl_check_transactions_not_committed", "warn"))
ADVICE_RULES = both("index advised", "TRUE", ("optimize_index_enabled", "notice"))
RULES = MERGE_RULES + TRX_RULES + ADVICE_RULES


def audit_merges(statements: DataFrame, settings=None) -> DataFrame:
    """A11 as violations of the later ALTER statements."""
    return violations(merge_candidates(statements), configure(MERGE_RULES, settings), "id")


def audit_transactions(ddl_tables: DataFrame, open_transactions: DataFrame, settings=None) -> DataFrame:
    """L17 as violations: statements (id, database_name, object_name) that alter a
    table with open transactions."""
    joined = ddl_tables.join(open_transactions, ["database_name", "object_name"])
    return violations(joined, configure(TRX_RULES, settings), "id").distinct()


def audit_advice(advice: DataFrame, settings=None) -> DataFrame:
    """I1-I5 as violations of the advised statements, the advice in the message."""
    found = violations(advice, configure(ADVICE_RULES, settings), "id", "table_name", "columns", "reason")
    text = F.concat(F.col("reason"), F.lit(" on "), F.col("table_name"), F.lit(" ("), F.array_join("columns", ", "), F.lit(")"))
    return found.select("id", "rule_name", "level", text.alias("message"), "execution_failed")
