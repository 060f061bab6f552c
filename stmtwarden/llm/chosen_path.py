"""MinHash near-dedup by a chosen-path similarity join.

A document is a set of word shingles with 64 minwise values. In each of several
independent trees a node picks one or two of the 64 positions at random (1.25 =
1 / 0.8 on average) and sends each of its documents on by the minwise value
there; documents of similarity s stay together with probability s at each
choice, so a pair at the threshold is kept alive by the branching while
dissimilar ones part. Nodes of few documents are compared exhaustively; larger
ones compare all with one pivot, so that a mass of near copies becomes one
class. Larger nodes of up to some thousand documents then compare those outside
that class with all, in blocks of full sets; still larger ones are split on, now
always along two positions, so that pairs at the threshold multiply faster than
they part. Nodes that such splits hardly make smaller are compared in blocks too.

Unequal sets only: equal sets are collapsed first. Links are confirmed on full
sets. A pair that agrees in 0.8 of the positions is missed by all twelve trees
with probability 4e-6 three levels down and below 1e-5 at any depth. Averaged
over the agreement that pairs of similarity 0.8 have in 64 positions, that is
6e-5 three levels down, 1.9e-4 six down and below 3e-4 at any depth.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import Run, components, forget, free, ids_filter, in_filter, map_arrow, mix, saved, saved_by, shingle_set, small_batches

POSITIONS = 64
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
#: Of 64 one-bit estimates, pairs at similarity 0.8 differ in 6.4 on average with deviation 2.4; more than this many rule a pair out.
FAR_BITS = 22
#: The last level at which nodes are split; what is larger there is compared by a join with no limit.
LAST_LEVEL = 40
#: Three levels along two positions make eight nodes of one; above this share of its size each, they hold as many pairs as it has.
HARDLY = 0.35
#: More pairs than these are confirmed in parts, one after the other, so that only one part's sets lie in shuffle files at a time.
PART_PAIRS, PARTS = 50_000, 4


def minwise(values: np.ndarray) -> np.ndarray:
    """The smallest of the set's values under each of 64 scrambles, 32 bits each."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = (values[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n (set size), sid (64-bit hash of the sorted set, null for an empty one), sig (64 minwise values)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sid, sig = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, k)
            n.append(len(s))
            sid.append(int(xxhash.xxh3_128_intdigest(s.tobytes()) & ((1 << 63) - 1)) if len(s) else None)
            sig.append(minwise(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "sid", "sig"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, sid long, sig binary")


def descend(node: np.ndarray, row: np.ndarray, sig: np.ndarray, levels: int, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sends (node, row) pairs down some levels, along one or two positions or always ``both``; the choice depends on the node alone."""
    for _ in range(levels):
        u = mix(node)
        p1 = (u & np.uint64(63)).astype(np.int64)
        two = np.full(len(u), True) if both else (u >> np.uint64(6)) & np.uint64(3) == 0
        p2 = (p1 + 1 + ((u >> np.uint64(8)) % np.uint64(63)).astype(np.int64)) % POSITIONS
        at = np.concatenate([p1, p2[two]])
        row = np.concatenate([row, row[two]])
        parent = np.concatenate([u, u[two]])
        node = mix(parent + mix(sig[row, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(40))))
    return node, row


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POSITIONS)


def first_nodes(sets: DataFrame, trees: int, levels: int) -> DataFrame:
    """Nodes (node, sid, n, sketch) of each set in all trees."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x51ED27))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = _signatures(batch.column(2))
        m = len(sig)
        bits = np.packbits((mix(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)[:, 0]
        node, row = descend(np.tile(roots, m), np.repeat(np.arange(m), trees), sig, levels)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(node.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(bits[row])], names=["node", "sid", "n", "sketch"]
        )

    return map_arrow(sets.select("sid", "n", "sig"), run, "node long, sid long, n long, sketch long")


def next_nodes(rows: DataFrame, levels: int) -> DataFrame:
    """The same rows (with ``sig``) some levels further down, and the ``size`` of the nodes they come from."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = _signatures(batch.column(4))
        node, row = descend(batch.column(0).to_numpy().view(np.uint64), np.arange(len(sig)), sig, levels, both=True)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[batch.column(i).take(take) for i in (1, 2, 3, 5)]], names=["node", "sid", "n", "sketch", "was"])

    return map_arrow(rows.select("node", "sid", "n", "sketch", "sig", "size"), run, "node long, sid long, n long, sketch long, was long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(sid, items) of the sets named in ``ids``, one row each, computed from the texts again.

    ``ids`` has (doc_id, sid) with one row of ``docs`` for each sid.
    """
    bits = ids_filter(ids, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = np.flatnonzero(in_filter(bits.value, batch.column(2).to_numpy(zero_copy_only=False)))
        texts = batch.column(1).take(pa.array(some)).to_pylist()
        sets = [shingle_set(t, k) for t in texts]
        sid = [int(xxhash.xxh3_128_intdigest(s.tobytes()) & ((1 << 63) - 1)) if len(s) else None for s in sets]
        items = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(sid, pa.int64()), items], names=["doc_id", "sid", "items"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40)).alias("h"))
    found = map_arrow(rows, run, "doc_id long, sid long, items array<long>")
    # the difference keeps the join on sid alone, so that rows come out dealt by sid
    same = F.coalesce("doc_id", F.lit(-1)) - F.coalesce("_d", F.lit(-1)) == 0
    return found.join(ids.select(F.col("doc_id").alias("_d"), "sid"), "sid").where(same).select("sid", "items")


def confirmed(pairs: DataFrame, sets: tuple[DataFrame, DataFrame], percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity. ``a`` may be a pivot of many pairs."""
    bucketed, plain = sets
    plain = plain.join(pairs.select(F.col("a").alias("sid")).distinct(), "sid", "left_semi")
    both = pairs.join(bucketed.select(F.col("sid").alias("b"), F.col("items").alias("bi")), "b").join(plain.select(F.col("sid").alias("a"), F.col("items").alias("ai")), "a")
    inter = F.size(F.array_intersect("ai", "bi"))
    union = F.size("ai") + F.size("bi") - inter
    return both.where(100 * inter >= percent * union).select("a", "b")


def confirmed_in_parts(pairs: DataFrame, sets: tuple[DataFrame, DataFrame], percent: int) -> list[DataFrame]:
    """:func:`confirmed` pairs, stored. Pairs with one ``a`` stay in one part."""
    parts, out = PARTS if pairs.count() > PART_PAIRS else 1, []
    bucketed, plain = sets
    for n in range(parts):
        def mine(rows: DataFrame, key: str, n: int = n) -> DataFrame:
            return rows.where(F.pmod(F.xxhash64(key, F.lit(2)), F.lit(parts)) == n) if parts > 1 else rows

        out.append(saved(confirmed(mine(pairs, "a"), (bucketed, mine(plain, "sid")), percent), "links"))
        free(pairs.sparkSession)
    return out


def _spanning(table: pa.Table, percent: int) -> pa.Table:
    """Confirmed links between the two sides of a pair of blocks (or within one block), one for each union of classes they make."""
    sid, label = table["sid"].to_numpy(), table["label"].to_numpy()
    items, side = table["items"].combine_chunks(), table["side"].to_numpy()
    cut = items.offsets.to_numpy()
    flat, size = items.flatten().to_numpy(), np.diff(cut)
    owner = np.repeat(np.arange(len(sid)), size)
    left, right = np.flatnonzero(side <= 1), np.flatnonzero((side == 0) | (side == 2))
    place = np.zeros((2, len(sid)), np.int64)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.empty(0, bool)
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1 if len(flat) else fresh
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    inter = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, 2048):
        some = (number >= at) & (number < at + 2048)
        o, v = owner[some], number[some] - at
        a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        la, rb = side[o] <= 1, side[o] != 1
        a[place[0, o[la]], v[la]] = 1
        b[place[1, o[rb]], v[rb]] = 1
        inter += a @ b.T
    inter = inter.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - inter
    i, j = np.nonzero((100 * inter >= percent * union) & (label[left][:, None] != label[right][None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        p, q = find(int(label[x])), find(int(label[y]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(sid[x]), int(sid[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def spanning(percent: int):
    return lambda rows: _spanning(rows, percent)


def within_groups(group: DataFrame, items: DataFrame, percent: int, block: int = 400) -> DataFrame:
    """Links between sets of different classes in a group (main, sid, label), confirmed on full sets.

    The sets outside the main class are cut into blocks, and so is the main
    class; each block of others meets each block in a task of its own, with the
    sets of two blocks in memory. Members of the main class do not meet.
    """
    other = F.col("label") != F.col("main")
    sizes = group.groupBy("main").agg(F.ceil(F.sum(F.when(other, 1).otherwise(0)) / block).alias("others"), F.ceil(F.sum(F.when(other, 0).otherwise(1)) / block).alias("rest"))
    g = group.join(saved(sizes, "blocks"), "main")
    nth = F.when(other, F.pmod(F.xxhash64("sid"), F.col("others"))).otherwise(F.col("others") + F.pmod(F.xxhash64("sid", F.lit(1)), F.greatest("rest", F.lit(1))))
    last = F.when(other, F.col("others") + F.col("rest") - 1).otherwise(F.col("others") - 1)
    g = g.withColumn("nth", nth).where("others > 0").withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    side = F.when(F.col("nth") == F.col("meets"), 0).when(F.col("nth") < F.col("meets"), 1).otherwise(2)
    g = g.select(F.concat_ws(",", "main", F.least("nth", "meets").cast("string"), F.greatest("nth", "meets").cast("string")).alias("pair"), "sid", "label", side.alias("side"))
    rows = g.join(items.dropDuplicates(["sid"]), "sid")
    return rows.groupBy("pair").applyInArrow(spanning(percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, trees: int = 12, first: int = 3, step: int = 3, limit: int = 24, whole: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id of the near-duplicate class, and
    ``kept`` marks the rows with that id. Null and empty texts have no
    shingles, are linked with nothing and kept. A null doc_id is a document
    like others and never the smallest; in a class without any id
    ``component_id`` is null. Rows that share a doc_id share no more than
    their texts make them. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Run(spark) as run:
        rows = saved(describe(docs, k), "minwise")
        sets = saved(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sig").alias("sig")), "sets")
        found = saved(rows.select("doc_id", F.col("n").alias("n_shingles"), "sid"), "found")
        # the signatures are read from ``sets`` now
        forget(rows)
        free(spark)
        labels = _classes(docs, sets, k, percent, trees, first, step, limit, whole)
        at = found.join(labels.select(F.col("v").alias("sid"), "root"), "sid", "left")
        at = saved(at.withColumn("root", F.coalesce("root", "sid")), "classes")
        least = saved(at.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
        run.keep(at, least)
    out = at.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(docs: DataFrame, sets: DataFrame, k: int, percent: int, trees: int, first: int, step: int, limit: int, whole: int) -> DataFrame:
    """(v, root) of the sets that have links. Each level deletes its own tables but for links, classes and the nodes of the next one."""
    spark, level, links, labels, items = docs.sparkSession, first, None, None, None
    nodes = saved(first_nodes(sets, trees, first).withColumn("was", F.lit(None).cast("long")), "nodes")
    while nodes is not None:
        with Run(spark) as run:
            stats = nodes.groupBy("node").agg(F.count("*").alias("size"))
            stats = saved(stats.where("size > 1"), "stats")
            active = nodes.join(stats, "node")
            if labels is not None:
                active = active.join(labels.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")
            else:
                active = active.withColumn("label", F.col("sid"))
            active = saved(active, "active")
            forget(nodes)
            free(spark)
            pivot = F.min(F.struct(F.xxhash64("node", "sid").alias("h"), "sid"))
            # of repeated (node, sid) rows any may be the pivot
            pivots = saved(active.where(F.col("size") > limit).groupBy("node").agg(pivot.alias("m")).select("node", F.col("m.sid").alias("pivot")), "pivots")
            if items is None:
                ids = saved(sets.join(active.select("sid").distinct(), "sid").select("doc_id", "sid"), "needed")
                items = saved_by(full_sets(docs, ids, k), "items", "sid")
                run.keep(*items)
                free(spark)
            top = level >= LAST_LEVEL
            group = active if top else active.where(F.col("size") <= limit)
            a, b = (group.select("node", F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("label").alias(f"l{x}")) for x in "ab")
            near = (F.col("la") != F.col("lb")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= FAR_BITS) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            dist = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))).alias("dist")
            found = a.join(b, "node").where((F.col("a") < F.col("b")) & near).select("a", "b", dist)
            if not top:
                p = active.where(F.col("size") > limit).select("node", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("label").alias("lb")).join(pivots, "node")
                q = p.where(F.col("b") == F.col("pivot")).select("node", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("sb").alias("sa"), F.col("lb").alias("la")).distinct()
                star = p.join(saved(q, "pivot"), "node").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), dist)
                found = found.union(star)
            pairs = saved(found.groupBy("a", "b").agg(F.min("dist").alias("dist")), "pairs")
            # first each set's most promising partner, then what is still apart
            best = saved(pairs.groupBy("b").agg(F.min(F.struct("dist", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "best")
            free(spark)
            sure = confirmed_in_parts(best, items, percent)
            run.keep(*sure)
            links = reduce(DataFrame.union, sure if links is None else [links, *sure])
            labels = components(links)
            la, lb = (labels.select(F.col("v").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
            apart = pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
            apart = saved(apart.join(best, ["a", "b"], "left_anti"), "apart")
            deeper = None
            if not top:
                # of a large node only members of different classes still matter; the pivot stands for the main class
                wide = active.where(F.col("size") > limit).join(labels.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("label", F.coalesce("root", "sid"))
                wide = all_wide = saved(wide.select("node", "size", "was", "sid", "n", "sketch", "label").join(pivots, "node"), "wide")
                main = wide.where(F.col("sid") == F.col("pivot")).select("node", F.col("label").alias("main")).distinct()
                mixed = wide.where("sid <> pivot").join(main, "node").groupBy("node").agg(F.first("main").alias("main"), F.max(F.col("label") != F.col("main")).alias("mixed")).where("mixed").select("node", "main")
                wide = saved(wide.join(saved(mixed, "mixed"), "node"), "wide")
                forget(all_wide)
                split = (F.col("size") > whole) & ~F.coalesce(F.col("size") > HARDLY * F.col("was"), F.lit(False))
                group = wide.where(~split).groupBy("main", "sid").agg(F.first("label").alias("label"))
                deeper = wide.where(split)
            forget(active)
            free(spark)
            more = confirmed_in_parts(apart, items, percent)
            if not top:
                more.append(saved(within_groups(saved(group, "group"), items[0], percent), "links"))
                free(spark)
            run.keep(*more)
            more = reduce(DataFrame.union, more)
            if not more.isEmpty():
                links = links.union(more)
                labels = components(links)
            run.keep(labels)
            nodes = None
            if deeper is not None and not deeper.isEmpty():
                nodes = saved(next_nodes(deeper.join(sets.select("sid", "sig"), "sid"), step), "nodes")
                run.keep(nodes)
                level += step
    return labels
