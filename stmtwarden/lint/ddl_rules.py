"""Catalogue rules on submitted CREATE and ALTER statements (L3 on text)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stmtwarden.functions import definitions as D
from stmtwarden.lint import catalog_rules

STATEMENT = ("id", "table_name")


def audit_definitions(statements: DataFrame, reserved=catalog_rules.RESERVED_WORDS, settings=None, store: str | None = None) -> DataFrame:
    """(object_type, id, table_name, object_name, rule_name, level, message): the
    catalogue rules that each defining statement breaks by itself.

    Columns, indexes and names are judged in CREATE and ALTER statements alike,
    whole tables where they are created. A figure that a statement does not
    give (a width, an engine) breaks no rule. ``id`` must not be null. Ten
    branches read the definitions: with ``store``, a new folder, statements are
    cut once and kept there; without it each branch cuts them anew.
    """
    defined = D.definitions(statements)
    if store:
        defined.write.parquet(store)
        defined = statements.sparkSession.read.parquet(store)
    tables, columns, indexes = D.defined_tables(defined), D.defined_columns(defined), D.defined_indexes(defined)
    return catalog_rules.audit_catalog(tables, columns, indexes, reserved=reserved, settings=settings, keys=STATEMENT)
