"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stmtwarden.views import VIEWS, Tables, with_clause

_builders: dict[str, Callable[[Tables], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register a query under ``key``; view names used in ``oracle`` become CTEs."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if key in _builders:
            raise ValueError(f"query {key} registered twice")
        _builders[key] = build
        if oracle is not None:
            _oracles[key] = expand(oracle)
        return build

    return wrap


def texts(df: DataFrame, *names: str) -> DataFrame:
    """Columns that may be null as text, which both engines print alike."""
    return df.withColumns({n: df[n].cast("string") for n in names})


def expand(text: str) -> str:
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", text)]
    ctes = with_clause(names)
    if not ctes:
        return text.strip()
    head = ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ctes)
    body = text.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {key: bind(build) for key, build in _builders.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
