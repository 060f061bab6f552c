"""Open spans, overlapping spans and chains of waits, against plain versions."""

import random

from pyspark.sql import functions as F

from stmtwarden.operators import intervals, waits

SPANS = "id long, k string, b timestamp_ntz, e timestamp_ntz"


def spans(spark, rows):
    df = spark.createDataFrame([(i, k, b, e) for i, k, b, e in rows], "id long, k string, b long, e long")
    moment = lambda c: (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col(c))).cast("timestamp_ntz")
    return df.select("id", "k", moment("b").alias("b"), moment("e").alias("e")).repartition(4)


def seconds(ts):
    import datetime as dt

    return int((ts - dt.datetime(2024, 1, 1)).total_seconds())


def drawn(n, seed, long=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        b = rnd.randrange(40_000)
        rows.append((i, rnd.choice("aab"), b, b + rnd.choice([0, 1, 5, 60, 900, rnd.randrange(9000)])))
    if long:
        rows += [(n, "a", 0, 10_000_000), (n + 1, "b", 7, None), (n + 2, "a", None, 5), (n + 3, "a", 50, 40), (n + 4, None, 3, 9), (n + 5, None, 4, 9)]
    return rows


def test_active_trend_equals_counting(spark):
    rows = drawn(300, 1)
    got = {(r.k, seconds(r.ts)): r.active for r in intervals.active_trend(spans(spark, rows), "k", "b", "e", "10 minutes").collect()}
    sound = [(k, b, e) for _, k, b, e in rows if b is not None and (e is None or e >= b)]
    moments = {(k, t) for k, b, e in sound for t in (b, e) if t is not None}
    assert got == {(k, t): sum(x == k and b <= t and (e is None or t < e) for x, b, e in sound) for k, t in moments}
    assert intervals.active_trend(spans(spark, rows).limit(0), "k", "b", "e").count() == 0


def test_overlapping_equals_theta_join(spark):
    left, right = drawn(250, 2), [(1000 + i, *r) for i, *r in drawn(200, 3)]
    found = intervals.overlapping(spans(spark, left), spans(spark, right), ("id", "b", "e"), ("id", "b", "e"))
    got = [tuple(r) for r in found.collect()]
    far = 10**12

    def sound(rows):
        return [(i, b, far if e is None else e) for i, _, b, e in rows if b is not None and (e is None or e >= b)]

    want = {(i, j) for i, b, e in sound(left) for j, c, d in sound(right) if b <= d and c <= e}
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlapping(spans(spark, left).limit(0), spans(spark, right), ("id", "b", "e"), ("id", "b", "e")).count() == 0


def test_totals_equal_those_of_the_pairs(spark):
    left, right = drawn(250, 4), [(1000 + i, *r) for i, *r in drawn(200, 5)]
    # ids and rows may repeat or be null
    left, right = left + left[:20] + [(None, "a", 5, 3000), (900, "a", 10_000_000, 10_000_001)], right + right[:20] + [(None, "b", 100, 200)]
    a, b = spans(spark, left), spans(spark, right)
    s = F.col("id")
    totals = {"n": ("sum", F.lit(1)), "lo": ("min", s), "hi": ("max", s), "check": ("sum", s % 7)}
    found = intervals.overlapping(a, b, ("id", "b", "e"), ("id", "b", "e"), totals)
    pairs = intervals.overlapping(a, b, ("id", "b", "e"), ("id", "b", "e"))
    r = F.col("right_id")
    want = pairs.groupBy("left_id").agg(F.count("*").alias("n"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.sum(r % 7).alias("check"))
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert intervals.overlapping(x, y, ("id", "b", "e"), ("id", "b", "e"), totals).count() == 0


def test_totals_make_no_pairs(spark):
    # all spans share a moment: 9 million pairs
    rows = [(i, "a", i, 100_000 + i) for i in range(3000)]
    totals = {"n": ("sum", F.lit(1))}
    got = intervals.overlapping(spans(spark, rows), spans(spark, rows), ("id", "b", "e"), ("id", "b", "e"), totals)
    assert [tuple(r) for r in got.agg(F.count("*"), F.min("n"), F.max("n")).collect()] == [(3000, 3000, 3000)]
    x = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 3000).alias("z"))
    cells = x.select(F.explode(intervals._covering(F.col("a"), F.col("z"), 8)).alias("c")).groupBy("c.level").count()
    assert cells.agg(F.sum("count")).first()[0] < 3000 * 6 * 8


def test_cells_make_up_a_range(spark):
    rows = [(a, z) for a in range(40) for z in range(a - 1, 64)]
    df = spark.createDataFrame(rows, "a long, z long").select("a", "z", intervals._covering(F.col("a"), F.col("z"), 4).alias("cells"))
    for r in df.collect():
        held = [i for c in r.cells for i in range(c.cell * 4**c.level, (c.cell + 1) * 4**c.level)]
        assert sorted(held) == list(range(r.a, r.z + 1))


def test_long_spans_are_not_cut_small(spark):
    rows = intervals._levelled(spans(spark, [(1, "a", 0, 30_000_000), (2, "a", 5, 5)]), "id", "b", "e")
    cut = intervals._blocks(rows, F.array("level", F.lit(intervals.OPEN)))
    assert cut.groupBy("id", "grade").count().agg(F.max("count")).first()[0] <= 2


def chained(spark, edges):
    df = spark.createDataFrame([(w, g, f"2024-01-01 00:00:{s:02d}") for w, g, s in edges], "waiting_trx long, granted_trx long, t string")
    df = df.select("waiting_trx", "granted_trx", F.col("t").cast("timestamp_ntz").alias("wait_started"))
    return {r.trx: (r.root_trx, r.depth, r.in_cycle, r.deadlocked) for r in waits.blocking_chains(df).collect()}


def test_chains_and_deadlocks(spark):
    chain = [(n + 1, n, 1) for n in range(100, 140)]  # 140 waits for 139 ... for 100
    pair = [(11, 12, 1), (12, 13, 1)]
    circle = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 2, 1), (5, 4, 1)]
    itself = [(20, 20, 1), (21, 20, 2)]
    # 30 waited for 31 before it waited for 1; of two that began at once the smaller number counts
    several = [(30, 1, 9), (30, 31, 2), (32, 34, 5), (32, 33, 5), (None, 7, 1), (8, None, 1)]
    got = chained(spark, chain + pair + circle + itself + several + chain[:3])
    want = {n + 1: (100, n - 99, False, False) for n in range(100, 140)} | {11: (13, 2, False, False), 12: (13, 1, False, False)}
    want |= {n: (1, 0, True, True) for n in (1, 2, 3)} | {4: (1, 1, False, True), 5: (1, 2, False, True)}
    want |= {20: (20, 0, True, True), 21: (20, 1, False, True), 30: (31, 1, False, False), 32: (33, 1, False, False)}
    assert got == want
    assert chained(spark, [(1, 2, 1)]) == {1: (2, 1, False, False)}
    assert chained(spark, [(None, 1, 1)]) == {}


def test_chains_equal_walking(spark):
    rnd = random.Random(9)
    blocker = {n: rnd.randrange(130) for n in range(100)}

    def walk(n):
        seen = [n]
        while blocker[seen[-1]] in blocker and blocker[seen[-1]] not in seen:
            seen.append(blocker[seen[-1]])
        last = blocker[seen[-1]]
        if last not in blocker:
            return last, len(seen), False, False
        at = seen.index(last)
        return min(seen[at:]), at, at == 0, True

    assert chained(spark, [(n, b, 1) for n, b in blocker.items()]) == {n: walk(n) for n in blocker}
