"""Chosen-path near-dedup and the projection forest against brute force."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stmtwarden.llm import chosen_path, forest
from stmtwarden.llm.common import components
from stmtwarden.session import shared_dir
from tests.llm import brute


def prose(rnd, n):
    return " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) + str(rnd.randrange(400)) for _ in range(n))


def near(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rnd = random.Random(5)
    base = prose(rnd, 80)
    texts = [base] * 3 + [near(rnd, base, k % 9) for k in range(70)] + [prose(rnd, rnd.randrange(1, 60)) for _ in range(60)]
    texts += [None, "", " \n", "one", "One", "one two", "TWO one", "ä Ä", prose(rnd, 5000)]
    rnd.shuffle(texts)
    return texts


def test_near_duplicates(docs_of):
    texts = corpus()
    for k in (2, 5):
        want = brute.near_duplicates(list(enumerate(texts)), k, 80)
        got = chosen_path.near_duplicates(docs_of(texts), k=k).collect()
        assert len(got) == len(texts)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_large_groups_split_and_meet_in_blocks(docs_of):
    """Small bounds send the same data through pivots, blocks and further levels."""
    texts = corpus()
    want = brute.near_duplicates(list(enumerate(texts)), 2, 80)
    got = chosen_path.near_duplicates(docs_of(texts), k=2, limit=3, whole=12, trees=24).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: v[1] for d, v in want.items()}


def test_pairs_confirmed_in_parts(docs_of, monkeypatch):
    """Parts find the same links, and what earlier steps wrote is gone by then."""
    seen, texts = [], corpus()
    whole = chosen_path.confirmed

    def noted(pairs, sets, percent):
        folder = Path(shared_dir(pairs.sparkSession).removeprefix("file:"))
        seen.append({p.name.rsplit("-", 1)[0] for p in folder.iterdir()} - before)
        return whole(pairs, sets, percent)

    docs = docs_of(texts)
    before = {p.name.rsplit("-", 1)[0] for p in Path(shared_dir(docs.sparkSession).removeprefix("file:")).iterdir()}
    monkeypatch.setattr(chosen_path, "PART_PAIRS", 2)
    monkeypatch.setattr(chosen_path, "confirmed", noted)
    want = brute.near_duplicates(list(enumerate(texts)), 2, 80)
    got = chosen_path.near_duplicates(docs, k=2, limit=3, trees=24).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: v[1] for d, v in want.items()}
    assert len(seen) >= 2 * chosen_path.PARTS and not any("minwise" in s for s in seen)
    assert "active" not in seen[chosen_path.PARTS]


def test_rows_that_repeat_or_lack_ids(docs_of):
    got = chosen_path.near_duplicates(docs_of(["a b c", "a b c", "a b c", None, "z"], ids=[7, 7, None, None, 9]), k=2).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["n_shingles"] > 1) == [(-1, 7, False), (7, 7, True), (7, 7, True)]
    assert len(got) == 5 and chosen_path.near_duplicates(docs_of([]), k=2).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.classes(sorted({x for e in links if e[0] != e[1] for x in e}), [e for e in links if e[0] != e[1]])
    assert got == want


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((220, 16))
    x[100:160] = x[:60] + rng.standard_normal((60, 16)) * rng.uniform(0.02, 0.2, (60, 1))
    x[160:170] = x[0]
    x[170:175] = x[0] * np.arange(1, 6)[:, None]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, None), (904, [], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    return rows


def forest_truth(rows):
    unit = {}
    for i, e, _ in rows:
        v = np.array([np.nan if c is None else c for c in e or []], float)
        if len(v) and np.isfinite(v).all() and v.any():
            unit[i] = v / np.linalg.norm(v)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root = brute.classes([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i], root[i] == i) for i in root}


def test_forest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for more in ({}, {"limit": 20}, {"limit": 1, "leaf": 4}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.similar(df, **more).collect()}
        assert got == forest_truth(rows)
    assert forest.similar(df.limit(0)).count() == 0


def test_mass_of_near_copies_is_compared_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + rng.standard_normal((70, 8)) * 0.15
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.vstack([x, x[:5], rng.standard_normal((40, 8))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unique = forest.saved(forest.vectors_of(df).where("v is not null").withColumn("key", F.col("vec_id")).withColumn("copies", F.lit(1).cast("long")).select("key", "v", "copies"), "u")
    found = forest._links(unique, 0.95, 30, 24, 0.02, 40, block=9).collect()
    n = {}
    for r in found:
        if r["n"] is not None:
            n[r["a"]] = n.get(r["a"], 0) + r["n"]
    want = forest_truth(rows)
    assert n == {i: v[0] for i, v in want.items() if v[0]}
    assert brute.classes([r[0] for r in rows], [(r["a"], r["b"]) for r in found if r["n"] is None]) == {i: v[1] for i, v in want.items()}


def test_dense_group_of_unequal_vectors_keeps_its_links(spark):
    """A third of the rows around one direction, pairs on both sides of the threshold, with the default parameters."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(64)
    group = centre / np.linalg.norm(centre) + rng.standard_normal((900, 64)) * np.sqrt(0.045 / 0.955 / 64)
    x = np.vstack([group, rng.standard_normal((1800, 64))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in forest.similar(df).collect()}
    missed = int(want.sum()) - sum(got.values())
    assert [got[i] for i in range(len(x))] == want.tolist(), f"{missed // 2} of {want.sum() // 2} links missed"


def grouped_vectors(n, groups, seed, dims=16):
    """Vectors on their own, then groups of near copies of (members, noise)."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x = np.vstack([x, *(rng.standard_normal(dims) + rng.standard_normal((members, dims)) * noise for members, noise in groups)])
    return [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]


def test_what_leaves_hold_alike_is_compared_once(spark, monkeypatch):
    """Pairs that all trees find do not come back from each leaf, nor do the vectors without links."""
    rows = grouped_vectors(1500, [(2, 0.02)] * 100, 12, dims=64)
    kept, write = {}, forest.saved

    def noted(df, label):
        kept[label] = write(df, label)
        if label == "classes":
            kept["rows"] = kept[label].count()
        return kept[label]

    monkeypatch.setattr(forest, "saved", noted)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == forest_truth(rows)
    assert 200 <= kept["rows"] <= 2 * 200


def test_leaves_are_split_on_as_the_sample_lets_expect(spark, monkeypatch):
    """A sample of a tenth of the rows: splits expected from it, then level by level, with a mass that stays whole."""
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 120)
    rows = grouped_vectors(700, [(400, 0.02), *[(3, 0.1)] * 30, *[(5, 0.2)] * 10], 13)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in forest.similar(df, limit=10).collect()}
    assert got == forest_truth(rows)
    x = np.array([e for _, e, _ in rows[:700]])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    trees = forest.Forest(x[:120], 16, 24, 0.01, 0.95, rows=len(x) * 20, limit=40)
    names, row, _ = trees.placed(x)
    assert trees.levels.max() > 1 and set(row.tolist()) == set(range(700))
    assert max(np.unique(names, return_counts=True)[1]) < max(np.unique(trees.leaves_of(x)[0], return_counts=True)[1])


def test_pairs_that_share_an_earlier_name_are_dropped():
    """Few pairs and many names, and the other way round, against plain sets; all of one block, and two blocks."""
    rng = np.random.default_rng(14)
    for n, names, each, share in ((40, 400, 20, 0.02), (40, 30, 6, 0.9), (60, 3000, 60, 0.5), (5, 3, 2, 1.0), (5, 1, 0, 1.0)):
        of = [set(rng.integers(0, names, each).tolist()) for _ in range(n)]
        owner = np.repeat(np.arange(n), [len(o) for o in of])
        listed = np.array([x for o in of for x in sorted(o)], np.int64)
        for left, right in ((np.arange(n), np.arange(n)), (np.arange(n // 2), np.arange(n // 2, n)), (np.arange(0), np.arange(n))):
            near = rng.random((len(left), len(right))) < share
            want = [[bool(near[i, j]) and not of[a] & of[b] for j, b in enumerate(right)] for i, a in enumerate(left)]
            forest.first_here(near, left, right, owner, listed)
            assert near.tolist() == want


def test_groups_reach_over_batches():
    rng = np.random.default_rng(15)
    a, b = np.sort(rng.integers(0, 12, 200)), rng.integers(0, 3, 200)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    a[60:140], b[60:140] = 5, 1
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    whole = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(200))], names=["a", "b", "c"])
    want = sorted((int(p), int(q), int(m)) for (p, q), m in zip(*np.unique(np.stack([a, b], axis=1), axis=0, return_counts=True), strict=True) if m > 1)
    run = forest.in_groups(lambda g: [g.column(0)[:1], g.column(1)[:1], pa.array([g.num_rows])], 2, ["a", "b", "n"])
    for size in (1, 2, 7, 50, 200):
        got = [tuple(r.values()) for out in run(iter([whole.slice(at, size) for at in range(0, 200, size)])) for r in out.to_pylist()]
        assert sorted(got) == want, size


def test_pairs_at_the_threshold_meet_at_every_depth():
    """Signatures that agree in each position with probability 0.8, in the default trees down to level nine."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 32, (600, 64), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    roots = chosen_path.mix(np.arange(1, 13, dtype=np.uint64) * np.uint64(0x51ED27))
    found = []
    for sig in (a, b):
        node, row = chosen_path.descend(np.tile(roots, len(sig)), np.repeat(np.arange(len(sig)), len(roots)), sig, 3)
        node, row = chosen_path.descend(node, row, sig, 6, both=True)
        found.append(set(zip(row.tolist(), node.tolist(), strict=True)))
    assert len({row for row, _ in found[0] & found[1]}) >= 598


def test_very_long_sets_are_decided_in_integers():
    """100 times the shared count, which lies between two single floats, equals 80 times the union."""
    m = 671_089
    items = pa.ListArray.from_arrays(pa.array([0, 5 * m, 9 * m], pa.int32()), pa.array(np.concatenate([np.arange(5 * m), np.arange(4 * m)])))
    table = pa.table({"sid": [1, 2], "label": [1, 2], "side": [0, 0], "items": items})
    assert chosen_path._spanning(table, 80).num_rows == 1


def test_queries_in_threads_leave_one_another_alone(spark, docs_of):
    """Several runs at once give what each gives alone; but for the tables their results read nothing stays, in the folder or the catalogue."""
    import os
    from concurrent.futures import ThreadPoolExecutor

    from stmtwarden.llm import repeats
    from stmtwarden.llm.common import saved
    from stmtwarden.session import shared_dir

    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(60)]
    docs = saved(docs_of(base + [b + " more" for b in base[:30]] + base[:10]), "docs")
    alone = sorted(map(tuple, chosen_path.near_duplicates(docs, k=2).collect()))
    cut = sorted((r["doc_id"], r["n_removed"]) for r in repeats.repeats(docs).collect())
    before, tables = set(os.listdir(shared_dir(spark))), spark.catalog.listTables()
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(lambda: sorted(map(tuple, chosen_path.near_duplicates(docs, k=2).collect()))) for _ in range(3)]
        other = pool.submit(lambda: sorted((r["doc_id"], r["n_removed"]) for r in repeats.repeats(docs).collect()))
        assert all(j.result() == alone for j in jobs) and other.result() == cut
    left = {x.split("-")[0] for x in set(os.listdir(shared_dir(spark))) - before}
    assert left <= {"classes", "least", "blocks", "answers"}
    assert spark.catalog.listTables() == tables


def test_failed_run_leaves_nothing(spark):
    from stmtwarden.llm.common import Run, saved

    with pytest.raises(ZeroDivisionError), Run(spark) as run:
        kept = saved(spark.range(3), "kept")
        run.keep(kept)
        raise ZeroDivisionError
    with pytest.raises(Exception, match="(?i)not.exist"):
        kept.collect()
    with Run(spark) as outer:
        with Run(spark) as inner:
            one, two = saved(spark.range(3), "one"), saved(spark.range(4), "two")
            inner.keep(one)
        assert one.count() == 3 and outer.paths
    with pytest.raises(Exception, match="(?i)not.exist"):
        one.collect()
