"""Prefix trie of conversations, rolled up by centroid decomposition.

Turns are ordered by a range exchange and numbered with totals carried from
partition to partition, so that a conversation may span tasks. A node is known
by the exclusive or of 128-bit hashes of its turns with their places, which is a
running aggregate of the same kind.

Sums over subtrees come from a decomposition of the forest of parent edges. A
component is a connected part of it with one top node. Its centroid is the
deepest node with more than half of the component's weight below it, where a
node weighs as many conversations as pass through it: these weights are
positive, and their sums over subtrees are known beforehand (the turns that
members still have to go). Without its centroid a component falls apart into the
parts below the centroid's children and the part above, none of more than half
the weight. The total of the centroid and the parts below is added along the
path from the centroid to the component's top; the path's weights lose what was
cut off. So each round halves all components, however long their chains are,
and a node's result is the sum of what was added to it.

Components of up to ``small`` nodes are finished within a task by the same
recursion; larger ones take rounds of joins. Ancestors are looked up in the table
of memberships (conversation, depth) by blocks of depths, so that no long
conversation is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtwarden.llm.common import Run, joined_small, saved, small_batches, trim

#: Turns taken over from the conversation that others start from are fewer than this.
HEADS = 6
DEPTHS = 1024
BELOW = ["n_leaves", "saved_tokens"]


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, key: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running aggregates per key in the given order, row by row.

    Rows are dealt by ranges of (key, order); aggregates are taken within each
    range and those of a key's earlier ranges added. ``sums`` maps names to
    columns that are combined by exclusive or (names that start with ``x``) or sum.
    """
    dealt = saved(rows.repartitionByRange(parts_of(rows), key, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    fold = {n: F.bit_xor if n.startswith("x") else F.sum for n in sums}
    ends = dealt.groupBy(key, "_part").agg(*[fold[n](c).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = saved(ends.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), *[F.coalesce(fold[n](n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]), "carry")
    here = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[fold[n](c).over(here).alias(n) for n, c in sums.items()]).join(carry, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")))
    for n in sums:
        total = F.col(n).bitwiseXOR(F.col(f"_{n}")) if n.startswith("x") else F.col(n) + F.col(f"_{n}")
        out = out.withColumn(n, total)
    return out.drop("_part", "_key", "_at", *[f"_{n}" for n in sums])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, chars, h1, h2) of rebuilt conversations and the conversations (conv, size).

    Conversation c starts with the first h turns of conversation c - c % 100,
    h = crc32(c) % 6, and goes on with its own turns after its first h.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv IS NOT NULL")
    rows = rows.select("conv", "turn", F.length("text").cast("long").alias("chars"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"), F.xxhash64("role", "text").alias("tie1"), F.xxhash64("text", "role").alias("tie2"))
    # equal turn numbers: by a hash of role and text, so that equal rows alone are left in any order
    order = [F.col("turn").asc_nulls_first(), "tie1", "tie2"]
    rows = saved(running(rows, "conv", order, {"nth": F.lit(1)}).select("conv", (F.col("nth") - 1).alias("nth"), "chars", "said"), "turns")
    convs = saved(rows.groupBy("conv").agg(F.count("*").alias("own")), "convs")
    base = F.col("conv") - F.col("conv") % 100
    heads = F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % HEADS
    named = convs.select("conv", "own", base.alias("base"), heads.alias("heads"))
    first = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    named = named.join(first, "base", "left").withColumn("taken", F.least("heads", F.coalesce("base_own", F.lit(0))))
    named = saved(named.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))), "named")
    opening = rows.where(F.col("nth") < HEADS).withColumnRenamed("conv", "base")
    lent = named.select("conv", "base", "heads").join(opening, "base").where(F.col("nth") < F.col("heads")).select("conv", F.col("nth").alias("at"), "chars", "said")
    rest = rows.join(named.select("conv", "heads", "taken"), "conv").where(F.col("nth") >= F.col("heads")).select("conv", (F.col("nth") - F.col("heads") + F.col("taken")).alias("at"), "chars", "said")
    both = lent.union(rest).select("conv", (F.col("at") + 1).alias("depth"), "chars", *[F.xxhash64(F.lit(n), "at", "said").alias(f"h{n}") for n in (1, 2)])
    return both, named.select("conv", "size")


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv): the sorted numbers of a node pass one at a time through its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if (k1, k2) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield batch_of(out)
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    def batch_of(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in enumerate(kinds)], names=["k1", "k2", "ends_sha256"])

    dealt = ends.select("k1", "k2", "conv").repartition(parts_of(ends), "k1", "k2").sortWithinPartitions("k1", "k2", "conv")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def decompose(parent: list[int], weight: list[int], sums: list[list[int]]) -> list[list[int]]:
    """Sums over subtrees of a component whose node 0 is the top and parents come before children; ``weight`` holds subtree weights and is used up."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for v in range(1, n):
        children[parent[v]].append(v)
    gone, out = [False] * n, [[0] * n for _ in sums]
    todo = [0]
    while todo:
        top = todo.pop()
        whole, z = weight[top], top
        while heavy := [c for c in children[z] if not gone[c] and 2 * weight[c] > whole]:
            z = heavy[0]
        gone[z] = True
        parts = [c for c in children[z] if not gone[c]]
        todo += parts
        totals, walk = [s[z] for s in sums], list(parts)
        for v in walk:  # grows while it is read
            for k, s in enumerate(sums):
                totals[k] += s[v]
            walk += [c for c in children[v] if not gone[c]]
        cut, v = weight[z], z
        while True:
            for k, t in enumerate(totals):
                out[k][v] += t
            weight[v] -= cut
            if v == top:
                break
            v = parent[v]
        if z != top:
            todo.append(top)
    return out


def finish_small(nodes: DataFrame) -> DataFrame:
    """(k1, k2, *BELOW) of components small enough for a task, by the same recursion."""
    names = ["k1", "k2", *BELOW]
    cols = ["c1", "c2", "k1", "k2", "p1", "p2", "below", *[f"add_{c}" for c in BELOW], *[f"own_{c}" for c in BELOW]]

    def solved(rows: list[tuple]) -> list[tuple]:
        place = {r[2:4]: n for n, r in enumerate(rows)}
        parent = [0, *(place[r[4:6]] for r in rows[1:])]
        got = decompose(parent, [r[6] for r in rows], [[r[9] for r in rows], [r[10] for r in rows]])
        return [(*r[2:4], r[7] + a, r[8] + b) for r, a, b in zip(rows, *got, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[:2] != rows[0][:2]:
                    out += solved(rows)
                    rows = []
                rows.append(r)
            yield batch_of(out)
        if rows:
            yield batch_of(solved(rows))
        trim()

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.int64()) for n in range(4)], names=names)

    dealt = nodes.repartition(parts_of(nodes), "c1", "c2").sortWithinPartitions("c1", "c2", "depth").select(*cols)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def rolled_up(nodes: DataFrame, members: DataFrame, small: int) -> DataFrame:
    """(k1, k2, *BELOW): sums of own_* over subtrees.

    ``nodes`` has (k1, k2, p1, p2, conv, depth, below, own_*) with ``below``
    the weight of the subtree, ``members`` (conv, depth, k1, k2) one row for
    each node on the way of each conversation. A component (c1, c2) is named by
    its top.
    """
    comp = ["c1", "c2"]
    block = F.floor(F.col("depth") / DEPTHS).cast("long")
    ways = members.select(F.col("conv").alias("m_conv"), F.col("depth").alias("m_depth"), block.alias("m_block"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    zero = F.lit(0).cast("long")
    live = saved(nodes.select("*", zero.alias("c1"), zero.alias("c2"), *[zero.alias(f"add_{c}") for c in BELOW]), "live")
    ready, done = [], []
    while True:
        stats = saved(live.groupBy(*comp).agg(F.count("*").alias("nodes"), F.max("below").alias("whole"), F.min("depth").alias("top")), "components")
        sized = joined_small(live, stats, comp, "inner")
        ready.append(sized.where(F.col("nodes") <= small).select(live.columns))
        if stats.where(F.col("nodes") > small).isEmpty():
            break
        middle = F.max_by(F.struct("k1", "k2", "depth", "conv", "below"), "depth")
        z = sized.where((F.col("nodes") > small) & (2 * F.col("below") > F.col("whole"))).groupBy(*comp, "top").agg(middle.alias("z"))
        z = saved(z.select(*comp, "top", *[F.col(f"z.{a}").alias(b) for a, b in zip(("k1", "k2", "depth", "conv", "below"), ("z1", "z2", "z_depth", "z_conv", "z_below"), strict=True)]), "centroids")
        near = joined_small(live, z, comp, "inner")
        # which child of the centroid a deeper node hangs under: one look-up for each block of a conversation in a component
        deeper = near.where(F.col("depth") > F.col("z_depth")).select(*comp, "conv", block.alias("block"), (F.col("z_depth") + 1).alias("at")).distinct()
        under = deeper.join(ways, (F.col("conv") == F.col("m_conv")) & (F.col("at") == F.col("m_depth")))
        heads = near.where((F.col("p1") == F.col("z1")) & (F.col("p2") == F.col("z2"))).select(F.col("c1").alias("u1"), F.col("c2").alias("u2"), F.col("k1").alias("h1"), F.col("k2").alias("h2"))
        under = under.join(heads, (F.col("c1") == F.col("u1")) & (F.col("c2") == F.col("u2")) & (F.col("a1") == F.col("h1")) & (F.col("a2") == F.col("h2")))
        under = under.select("u1", "u2", F.col("conv").alias("u_conv"), F.col("block").alias("u_block"), "h1", "h2")
        # the way up from the centroid, by blocks of depths
        blocks = F.explode(F.sequence(F.floor(F.col("top") / DEPTHS).cast("long"), F.floor(F.col("z_depth") / DEPTHS).cast("long"))).alias("w_block")
        way = z.select(*comp, "top", "z_depth", "z_conv", blocks).join(ways, (F.col("z_conv") == F.col("m_conv")) & (F.col("w_block") == F.col("m_block")))
        way = way.where("m_depth BETWEEN top AND z_depth").select(F.col("a1").alias("w1"), F.col("a2").alias("w2"))
        same = (F.col("c1") == F.col("u1")) & (F.col("c2") == F.col("u2")) & (F.col("conv") == F.col("u_conv")) & (F.col("block") == F.col("u_block")) & (F.col("depth") > F.col("z_depth"))
        placed = near.withColumn("block", block).join(under, same, "left").join(way, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left")
        centre = (F.col("k1") == F.col("z1")) & (F.col("k2") == F.col("z2"))
        placed = saved(placed.select(*live.columns, "z_below", centre.alias("centre"), F.col("w1").isNotNull().alias("on_way"), "h1", "h2"), "placed")
        totals = placed.where(F.col("centre") | F.col("h1").isNotNull()).groupBy(*comp).agg(*[F.sum(f"own_{c}").alias(f"t_{c}") for c in BELOW])
        placed = joined_small(placed, saved(totals, "totals"), comp, "inner")
        added = {f"add_{c}": F.col(f"add_{c}") + F.when(F.col("on_way"), F.col(f"t_{c}")).otherwise(0) for c in BELOW}
        done.append(placed.where("centre").select("k1", "k2", *[added[f"add_{c}"].alias(c) for c in BELOW]))
        weight = F.when(F.col("on_way"), F.col("below") - F.col("z_below")).otherwise(F.col("below"))
        fresh = {"c1": F.coalesce("h1", "c1"), "c2": F.coalesce("h2", "c2"), "below": weight, **added}
        live = saved(placed.where("NOT centre").select(*[fresh.get(c, F.col(c)).alias(c) for c in live.columns]), "live")
    out = finish_small(reduce(DataFrame.union, ready))
    return reduce(DataFrame.union, done, out)


def prefix_trie(turns: DataFrame, *, small: int = 20_000) -> DataFrame:
    """Per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text; other columns are not read,
    whatever their names. Turns are ordered by number, null first, those of
    equal number by a hash of role and text; a null role or text is empty. Rows
    without a conv_id belong to no conversation. Repeated rows are turns like
    others. A conversation left without turns is a member of the root alone.
    Texts of any length enter by their hash and number of code points. An
    empty table has no conversation and gives no rows. The digest of a node's
    ends is one pass over their sorted numbers, held by no task whole.
    """
    small_batches(turns.sparkSession)
    with Run(turns.sparkSession) as run:
        nodes, sums, ends = _tables(turns, small)
        run.keep(nodes, sums, ends)
    up = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left").join(up, (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")), "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *BELOW, digest)


def _tables(turns: DataFrame, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved nodes, sums over their subtrees and digests of their ends."""
    said, convs = rebuilt(turns)
    said = saved(running(said, "conv", ["depth"], {"x1": F.col("h1"), "x2": F.col("h2")}), "said")
    ways = said.join(convs, "conv").select("conv", "depth", "chars", F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), (F.col("size") - F.col("depth") + 1).alias("left"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("chars"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), (F.col("size") + 1).alias("left"))
    ways = saved(ways.union(root), "ways")
    some = lambda c: F.min(c).alias(c)
    nodes = ways.groupBy("k1", "k2").agg(F.min("conv").alias("conv"), some("depth"), some("chars"), some("p1"), some("p2"), F.count("*").alias("n_convs"), F.sum("left").alias("below"))
    nodes = saved(nodes, "nodes")
    born = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(born, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").drop("c1", "c2").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = saved(nodes.withColumn("own_n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("own_saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    sums = saved(rolled_up(nodes.select("k1", "k2", "p1", "p2", "conv", "depth", "below", *[f"own_{c}" for c in BELOW]), ways, small), "sums")
    return nodes, sums, saved(digests(ways.where(F.col("left") == 1)), "ends")
