"""Ranked lexical search through a document FP-tree.

Only terms that some item asks for matter. A document's restricted vector holds
them with their counts, ordered by falling document frequency, so that documents
share the first part of their paths in a trie. A block of documents sorted by
these paths is the trie in depth-first order: a node is a run of documents with
a common path, and it is split by the next term until few documents are left.
Neighbouring small subtrees make one leaf.

Each node keeps for every term the largest count below it and the smallest
length norm ``m``. With them the score formula gives a bound for each item, and
each item walks the tree depth first, the most promising child first, leaving
out what cannot enter its best. A task carries an item's best from block to
block; at the end it gives them out, and the best of all tasks are ranked.

Vectors are written once, since document frequencies must be known before the
first score. Nothing is sent to tasks but the terms of a block of items, which
has a bound of its own; further items take further passes over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtwarden.llm.common import Run, map_arrow, saved, small_batches, text_bytes, trim

#: ASCII digits and letters and all bytes of other characters; equal to the terms of the decoded text.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Terms, counted once per item, that one pass over the documents looks for; documents and postings of one tree; documents of a leaf.
ITEM_TERMS, TREE_DOCS, TREE_TERMS, LEAF_DOCS = 50_000, 16_384, 4_000_000, 192
#: Splits below this many others make leaves at once.
DEEP = 400
K1, B = 1000, 75
SCALE = 1_000_000_000


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text_bytes(text).lower())


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, rep) of the items; rows that share an item_id, or have none, make up one item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, t, c) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, c in Counter(terms_of(text)).items()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "rep"])

    found = map_arrow(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, "item_id long, term binary, rep long")
    return found.groupBy("item_id", "term").agg(F.sum("rep").alias("rep"))


def item_blocks(terms: DataFrame) -> Iterator[list]:
    """Rows (item_id, term, rep) of whole items, about ``ITEM_TERMS`` of them in a block and never less than one item."""
    block: list = []
    for row in terms.orderBy("item_id").toLocalIterator():
        if len(block) >= ITEM_TERMS and row["item_id"] != block[-1]["item_id"]:
            yield block
            block = []
        block.append(row)
    if block:
        yield block


def vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Per row of ``docs``: doc_id, n (all its terms), terms (numbers of those among ``words``), tf."""
    sent = docs.sparkSession.sparkContext.broadcast({w: n for n, w in enumerate(words)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, n, cut, terms, tf = sent.value, [], [0], [], []
        for text in batch.column(1).to_pylist():
            found = terms_of(text)
            n.append(len(found))
            for word, c in Counter(found).items():
                at = number.get(word)
                if at is not None:
                    terms.append(at)
                    tf.append(c)
            cut.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, terms array<int>, tf array<int>")


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms, exact beyond 64 bits too."""
    if len(n) and int(n.max()) * B * docs >= 1 << 63:
        return np.array([100 - B + B * x * docs // total for x in n.tolist()], np.int64)
    return 100 - B + B * n * docs // total


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds to a score."""
    return SCALE * tf // (K1 * tf + 8 * m)


class Queries:
    """The items of a block: their terms as ranks by falling document frequency, with weights times repeats."""

    def __init__(self, block: list, words: list[bytes], df: dict[int, int], docs: int):
        number = {w: n for n, w in enumerate(words)}
        order = sorted(range(len(words)), key=lambda n: (-df.get(n, 0), n))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(n, 0) + 1))) for n in range(len(words))]
        self.ids = list(dict.fromkeys(r["item_id"] for r in block))
        at = {i: n for n, i in enumerate(self.ids)}
        rows = sorted((at[r["item_id"]], int(self.rank[number[bytes(r["term"])]]), weight[number[bytes(r["term"])]] * r["rep"]) for r in block)
        self.item, self.term, self.weight = (np.array([r[n] for r in rows], np.int64) for n in range(3))
        self.first = np.flatnonzero(np.append(True, self.item[1:] != self.item[:-1]))
        self.size = len(words)


class Tree:
    """The FP-tree of a block of documents, its bounds for all items, and the gains of its postings."""

    def __init__(self, queries: Queries, ids: list, m: np.ndarray, cut: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        paths = rank.astype(">u4")
        keys = [paths[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, self.m = [ids[n] for n in order], m[order]
        size = np.diff(cut)[order]
        self.cut = np.append(0, np.cumsum(size))
        take = np.repeat(cut[:-1][order] - self.cut[:-1], size) + np.arange(self.cut[-1])
        self.rank, self.tf, self.size = rank[take], tf[take], size
        self.gain = gain(self.tf, np.repeat(self.m, size))
        self.children: list[list[int]] = []
        self.runs: list[tuple[int, int]] = []
        most: list[np.ndarray] = []
        self.top = self._node(0, len(order), 0, most, queries.size)
        low = np.array([self.m[a:b].min() for a, b in self.runs])
        self.bounds = np.stack([np.add.reduceat(queries.weight * gain(x[queries.term], np.full(len(queries.term), l)), queries.first) for x, l in zip(most, low, strict=True)])

    def _leaf(self, a: int, b: int, most: list[np.ndarray], width: int) -> int:
        top = np.zeros(width, np.int64)
        np.maximum.at(top, self.rank[self.cut[a] : self.cut[b]], self.tf[self.cut[a] : self.cut[b]])
        return self._add(a, b, [], top, most)

    def _add(self, a: int, b: int, children: list[int], top: np.ndarray, most: list[np.ndarray]) -> int:
        self.runs.append((a, b))
        self.children.append(children)
        most.append(top)
        return len(self.runs) - 1

    def _node(self, a: int, b: int, depth: int, most: list[np.ndarray], width: int, above: int = 0) -> int:
        """Node of documents a..b, which share the first ``depth`` terms."""
        while True:
            if b - a <= LEAF_DOCS:
                return self._leaf(a, b, most, width)
            on = self.size[a:b] > depth
            step = np.where(on, self.rank[np.minimum(self.cut[a:b] + depth, len(self.rank) - 1)], -1)
            edge = a + np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            if len(edge) > 1 or step[0] < 0:
                break
            depth += 1
        children, edges, at = [], [*edge.tolist(), b], a
        split = above < DEEP
        ended = int(a + np.count_nonzero(~on))
        while at < ended:  # equal vectors: no further term tells them apart
            children.append(self._leaf(at, min(at + LEAF_DOCS, ended), most, width))
            at = min(at + LEAF_DOCS, ended)
        for begin, end in zip(edges, edges[1:], strict=False):
            if end - at > LEAF_DOCS:
                if begin > at:
                    children.append(self._leaf(at, begin, most, width))
                    at = begin
                if split and end - at > LEAF_DOCS:
                    children.append(self._node(at, end, depth + 1, most, width, above + 1))
                    at = end
                while end - at > LEAF_DOCS:
                    children.append(self._leaf(at, at + LEAF_DOCS, most, width))
                    at += LEAF_DOCS
        if at < b:
            children.append(self._leaf(at, b, most, width))
        return self._add(a, b, children, np.max([most[c] for c in children], axis=0), most)


def order_of(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def search_tree(tree: Tree, queries: Queries, best: list[list[tuple]], top: int) -> None:
    """Merges the best documents of a tree into the best of each item, as (-score, order of doc_id)."""
    weight = np.zeros(queries.size, np.int64)
    ends = np.append(queries.first[1:], len(queries.item))
    for item, (a, b) in enumerate(zip(queries.first, ends, strict=True)):
        weight[queries.term[a:b]] = queries.weight[a:b]
        bound, mine = tree.bounds[:, item], best[item]
        stack = [tree.top]
        while stack:
            node = stack.pop()
            least = -mine[-1][0] if len(mine) == top else 1
            if bound[node] < least:
                continue
            if tree.children[node]:
                stack += sorted(tree.children[node], key=bound.__getitem__)
                continue
            lo, hi = tree.runs[node]
            p, q = tree.cut[lo], tree.cut[hi]
            score = np.add.reduceat(weight[tree.rank[p:q]] * tree.gain[p:q], tree.cut[lo:hi] - p)
            some = np.flatnonzero(score >= max(least, 1))
            if len(some):
                mine += [(-int(score[n]), order_of(tree.ids[lo + n])) for n in some]
                mine.sort()
                del mine[top:]
        weight[queries.term[a:b]] = 0


def best_of_tasks(rows: DataFrame, sent, top: int) -> DataFrame:
    """Each task's best documents of each item: (item_id, doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, docs, total = sent.value
        best: list[list[tuple]] = [[] for _ in queries.ids]
        held, count, load = [], 0, 0

        def settle() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, tf = (table[c].combine_chunks() for c in ("terms", "tf"))
            cut = terms.offsets.to_numpy().astype(np.int64)
            rank, times = queries.rank[terms.flatten().to_numpy()], tf.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            order = np.lexsort((rank, row))
            m = norms(table["n"].to_numpy(), docs, total)
            search_tree(Tree(queries, table["doc_id"].to_pylist(), m, cut - cut[0], rank[order], times[order]), queries, best, top)
            held.clear()

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            load += len(batch.column("tf").flatten())
            if count >= TREE_DOCS or load >= TREE_TERMS:
                settle()
                count = load = 0
        if held:
            settle()
        out = [(queries.ids[n], None if null else doc_id, -score) for n, found in enumerate(best) for score, (null, doc_id) in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.int64()) for n in range(3)], names=["item_id", "doc_id", "score"])
        trim()

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, top: int = 10) -> DataFrame:
    """Per item its ``top`` documents with the highest scores above 0: item_id, rank (from 1), doc_id, score.

    Equal scores rank by ascending doc_id, null last; every row of ``docs`` is
    a document, also those that repeat a doc_id or a text. Null and empty texts
    have no terms: such a document is not counted and never found, such an item
    finds nothing. Rows of ``items`` with equal item_ids are one item, those
    with a null item_id too. Texts are read whole. Columns besides doc_id,
    item_id and text are not read, whatever their names. Without documents or
    items there are no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = saved(item_terms(items), "asked")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in item_blocks(asked):
        words = sorted({bytes(r["term"]) for r in block})
        with Run(spark) as run:
            rows = saved(vectors(docs, words), "vectors")
            size = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
            if not size[0]:
                break
            df = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
            sent = spark.sparkContext.broadcast((Queries(block, words, df, size[0]), size[0], size[1]))
            best = saved(best_of_tasks(rows.where(F.size("terms") > 0), sent, top), "best")
            run.keep(best)
        found = found.union(best)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
