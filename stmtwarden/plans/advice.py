"""Queries of index advice (I). Expected advice is stated per statement shape."""

from pyspark.sql import functions as F

from stmtwarden.functions.statement_columns import statement_columns
from stmtwarden.operators import advice as A
from stmtwarden.registry import query
from stmtwarden.shapes import SHAPE_COUNT

_NAME, _NAME_KEY = "c_name", "c_name,c_custkey"
THREE_STAR = {
    6: _NAME_KEY, 7: _NAME, 10: _NAME, 11: _NAME, 12: _NAME_KEY, 13: _NAME, 14: _NAME_KEY, 15: _NAME, 16: _NAME, 17: _NAME, 18: _NAME, 19: _NAME_KEY,
    21: _NAME, 22: _NAME, 23: _NAME, 27: _NAME_KEY, 28: _NAME, 32: _NAME, 33: "c_custkey,c_name", 34: _NAME, 35: _NAME, 71: _NAME, 72: _NAME, 76: _NAME,
    77: _NAME, 78: _NAME,
}


def _oracle(expected: dict[int, tuple[str, str]], reason: str) -> str:
    rows = ", ".join(f"({k}, '{t}', '{cols}')" for k, (t, cols) in expected.items())
    return (
        f"SELECT o.o_orderkey AS id, v.table_name, v.columns, '{reason}' AS reason FROM orders o "
        f"JOIN (VALUES {rows}) AS v(k, table_name, columns) ON o.o_orderkey % {SHAPE_COUNT} = v.k WHERE o.o_orderkey % 7 <> 0"
    )


def _inputs(t):
    return statement_columns(t.statement_corpus), A.scanning_statements(t.corpus_plans)


def _shown(df):
    return df.select("id", "table_name", F.array_join("columns", ",").alias("columns"), "reason")


@query("i1_three_star_index", _oracle({k: ("customer", v) for k, v in THREE_STAR.items()}, "three-star index"))
def _(t):
    columns, scanning = _inputs(t)
    return _shown(A.three_star_index(columns, scanning, t.corpus_columns, t.corpus_selectivity, t.corpus_indexes))


@query("i2_join_index", _oracle({11: ("lineitem", "l_orderkey")}, "join column"))
def _(t):
    columns, scanning = _inputs(t)
    return _shown(A.join_index(columns, scanning, t.corpus_indexes))


@query("i3_function_index", _oracle({31: ("customer", "c_name"), 35: ("customer", "c_name")}, "function index"))
def _(t):
    columns, scanning = _inputs(t)
    return _shown(A.function_index(columns, scanning, "8.0.20"))


@query("i4_extremal_index", _oracle({74: ("orders", "o_totalprice")}, "argument of MIN or MAX"))
def _(t):
    columns, scanning = _inputs(t)
    return _shown(A.extremal_index(columns, scanning, t.corpus_indexes))


@query("i5_prefix_index", _oracle({1: ("orders", "o_orderpriority")}, "leading wildcard"))
def _(t):
    columns, scanning = _inputs(t)
    return _shown(A.prefix_index(columns, t.statement_corpus, scanning))
