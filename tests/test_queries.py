"""Every registered query against its SQL, and what the plans may not contain."""

import pytest

import __spark_entry__ as entry_module
from stmtwarden import registry
from tests.compare import check, connect

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

# At this size these have no rows to show.
MAY_BE_EMPTY = {"f15_lock_search", "p9_table_size"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, sf_dir, key):
    if key not in ORACLES:
        assert QUERIES[key](spark, sf_dir).count() > 0
        return
    why = check(spark, con, QUERIES[key], ORACLES[key], sf_dir)
    assert why is None or (why == "EMPTY" and key in MAY_BE_EMPTY), why


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert "project_score" in df.columns


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


PLANNED = [
    "f1_blocklist_match_long_list", "f9_workflow_search", "f16_visible_pipelines", "l2_audit_columns", "l3_audit_catalog", "i1_three_star_index",
    "x5_counter_rate", "x7_related_transactions", "w12_audited_sql_counts", "w23_percentages", "l13_redundant_index",
]


@pytest.mark.parametrize("key", PLANNED)
def test_no_cross_join_and_no_python(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_windows_push_their_bounds_to_the_scan(spark, sf_dir):
    plan = QUERIES["s1_slow_log_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan and "LessThan(ts," in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["w1_workflow_count_by_status"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
