"""The stored record table, expiry by day, merged profiles and shared counts."""

import datetime as dt
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from stmtwarden.operators import advice, profile, retention
from stmtwarden.streaming import jobs, records

ROLLUP = "sql_id string, counter long, sql_text string, sql_fingerprint string, project_id string, schema_name string, instance_id string, ts timestamp_ntz, id long"


def batch(spark, queue, number, rows):
    """Rows (sql_id, counter, day, id) as one batch of a queue."""
    full = [(s, n, f"select {s} from t where day = {d}", f"fp {s}", "p", "db", "i", d and dt.datetime(2024, 1, d), i) for s, n, d, i in rows]
    jobs.write_batch(spark.createDataFrame(full, ROLLUP), queue, number)


def counts(spark, path, version):
    return {r["sql_id"]: (r["counter"], r["id"]) for r in records.read(spark, path, version).collect()}


@pytest.fixture()
def places(tmp_path):
    return str(tmp_path / "queue"), str(tmp_path / "records")


def test_readers_keep_their_version_through_drains_and_cleaning(spark, places):
    queue, path = places
    assert records.drain(spark, queue, path, "2024-02-01") is None and records.audit(spark, path, "2024-02-01") is None
    batch(spark, queue, 0, [("a", 3, 2, 5), ("b", 1, 1, 2)])
    batch(spark, queue, 1, [("a", 2, 1, 9), ("c", 1, None, 7)])
    first = records.drain(spark, queue, path, "2024-02-01")
    want = {"a": (5, 5), "b": (1, 2), "c": (1, 7)}
    assert counts(spark, path, first) == want
    held = records.read(spark, path, first)

    # a batch that is written again under a drained number, and a drain without news
    batch(spark, queue, 1, [("a", 100, 1, 9)])
    assert records.drain(spark, queue, path, "2024-02-02") == first

    batch(spark, queue, 2, [("b", 4, 1, 3), ("d", 1, 3, 1), ("a", 1, 1, 99)])
    second = records.drain(spark, queue, path, "2024-02-02")
    records.clean(spark, queue, path, keep=2)
    assert jobs._complete(spark, queue, "batch_id") == []
    assert counts(spark, path, second) == {"a": (6, 5), "b": (5, 3), "c": (1, 7), "d": (1, 1)}
    assert {r["sql_id"]: (r["counter"], r["id"]) for r in held.collect()} == want
    assert records.pinned(spark, path, 0) == first and records.versions(spark, path) == [0, 1]
    records.clean(spark, queue, path, keep=1)
    assert records.versions(spark, path) == [1] and len(list(Path(path, "data").iterdir())) == 1


def test_of_two_writers_one_succeeds(spark, places):
    queue, path = places
    batch(spark, queue, 0, [("a", 1, 1, 1)])
    base = records.drain(spark, queue, path, "2024-02-01")
    rows = records.read(spark, path, base)
    won = records.commit(spark, path, rows, base, 0)
    with pytest.raises(Py4JJavaError, match="FileAlreadyExists"):
        records.commit(spark, path, rows.limit(0), base, 0)
    assert records.pinned(spark, path) == won and counts(spark, path, won) == {"a": (1, 1)}


def test_audit_touches_changed_records_only(spark, places):
    queue, path = places
    seen = []

    def judge(rows):
        seen.append(sorted(r["sql_id"] for r in rows.select("sql_id").collect()))
        audits = rows.withColumns({"audit_level": F.lit("warn"), "priority": F.lit("")})
        return audits.withColumn("audit_results", F.lit(None).cast(records.AUDIT["audit_results"]))

    batch(spark, queue, 0, [("a", 1, 1, 1), ("b", 1, 1, 2), ("c", 1, 1, 3)])
    records.drain(spark, queue, path, "2024-02-01")
    records.audit(spark, path, "2024-02-01", judge)
    batch(spark, queue, 1, [("b", 1, 5, 9), ("d", 1, 5, 8)])
    records.drain(spark, queue, path, "2024-02-02")
    last = records.audit(spark, path, "2024-02-03", judge)
    records.audit(spark, path, "2024-02-04", judge)
    assert seen == [["a", "b", "c"], ["b", "d"], []]
    got = {r["sql_id"]: (r["counter"], r["last_audit_time"].day, r["audit_level"]) for r in records.read(spark, path, last).collect()}
    assert got == {"a": (1, 1, "warn"), "b": (2, 3, "warn"), "c": (1, 1, "warn"), "d": (1, 3, "warn")}


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_expiry_drops_days_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    raw = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    retention.store_by_day(raw, path)
    before, cut = files_of(path), dt.datetime(2024, 1, 5, 9)
    removed = {r["day"].day: r["removed_count"] for r in retention.expire_days(spark, path, str(cut)).collect()}
    want = [t for _, t in rows if t and t < cut]
    assert removed == {d: sum(t.day == d for t in want) for d in {t.day for t in want}}
    left = spark.read.parquet(path)
    assert sorted(r["id"] for r in left.collect()) == [i for i, t in rows if t is None or t >= cut]
    same = {f: m for f, m in before.items() if not any(f.startswith(f"day=2024-01-0{d}") for d in range(1, 6))}
    after = files_of(path)
    assert same and {f: after.get(f) for f in same} == same
    assert not any(f.startswith(f"day=2024-01-0{d}") for f in after for d in range(1, 5))
    # again: nothing is left; a cut at midnight rewrites nothing; a day without survivors goes
    assert retention.expire_days(spark, path, str(cut)).count() == 0
    assert retention.expire_days(spark, path, "2024-01-06").count() == 1
    assert retention.expire_days(spark, path, "2024-01-06 23:59:59").count() == 1
    assert not any(f.startswith("day=2024-01-06") for f in files_of(path))


def test_merged_states_bound_the_whole(spark):
    """One value fills a third of the rows, another column is all different, one is mostly null."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("skewed"), F.col("id").alias("own"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("sparse"), F.lit(None).cast("int").alias("nothing"), (F.col("id") % 50).alias("day"),
    )
    names = ["skewed", "own", "sparse", "nothing"]
    states = profile.profile_states(rows, names, F.col("day"), "t")
    assert states.count() == 50 * 4
    got = {r["column_name"]: r for r in profile.merged_profile(states).collect()}
    for r in profile.column_profile(rows, names, "t").collect():
        g, skew = got[r["column_name"]], r["largest_group"] / r["row_count"]
        assert (g["row_count"], g["non_null_count"], g["max_width"]) == (r["row_count"], r["non_null_count"], r["max_width"])
        assert g["skewness_low"] <= skew <= g["skewness_high"] <= g["skewness_low"] + 0.0035
        assert abs(g["distinct_count"] - r["distinct_count"]) <= 4 * 1.04 / 64 * r["distinct_count"]
    part = profile.merged_profile(states.where("period < 10")).where("column_name = 'own'").first()
    assert part["row_count"] == 12_000


def test_shared_counts_read_a_table_once(spark, sf_dir):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer")}
    asked = [(i, ("orders", "customer", "elsewhere")[i % 3], f"{('o_orderkey', 'c_custkey', 'x')[i % 3]} > {i // 2}", None) for i in range(90)]
    asked += [(100, "orders", None, None), (101, "orders", None, 7), (102, "orders", "o_orderkey > 0", 0)]
    out = profile.affected_rows_shared(asked, tables)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    got = {r["id"]: r["affected_rows"] for r in out.collect()}
    every = tables["orders"].count()
    assert got.pop(100) == every and got.pop(101) == 7 and got.pop(102) == 0
    assert got == {i: tables[t].where(cond).count() for i, t, cond, _ in asked[:12] if t != "elsewhere"} | {i: got[i] for i, t, _, _ in asked[12:90] if t != "elsewhere"}


def test_only_the_column_with_a_leading_wildcard_is_advised(spark):
    columns = spark.createDataFrame([(1, "where", "LIKE", "t", "a"), (1, "where", "LIKE", "t", "B"), (2, "where", "LIKE", "t", "a"), (3, "where", "LIKE", "t", "c")], "id long, clause string, operator string, table_name string, column_name string")
    texts = [(1, "SELECT 1 FROM t WHERE a LIKE 'x%' AND t.`b` NOT LIKE '%y'"), (2, "select 1 from t where a like '\\_x'"), (3, "select 1 from t where t.C like binary '_x'")]
    statements = spark.createDataFrame(texts, "id long, sql_text string")
    got = {(r["id"], r["columns"][0]) for r in advice.prefix_index(columns, statements, statements.select("id")).collect()}
    assert got == {(1, "b"), (3, "c")}
