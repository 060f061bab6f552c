"""Removal of repeated passages by a distributed difference-cover suffix sort.

A byte is removed if a string of ``width`` bytes that covers it also starts
anywhere else. With a difference cover D modulo v (any shift between two
positions is matched by two members of D), equal strings of ``width`` bytes
hold sampled positions at equal distance, wherever they stand. So:

1. Sample: the tuples of ``width - v + 1`` bytes at sampled positions are
   named, and the suffixes whose name no other one has drop out.
2. Merge: for each suffix left, the names of its surroundings (all ``v``
   windows that hold it at once, ``width + v - 1`` bytes) are compared within
   its name; equal surroundings settle the windows inside a long repeat.
3. Where surroundings differ (the ends of repeats) the remaining suffixes, that
   is every single window there, are named and compared.

Names are equal for equal strings and, being 64-bit hashes, different for
others but for about n^2 / 2^65 of n; step 1 sends 32 bits, which only lets
some suffixes on to step 2. Names are sorted and compared in buckets by hash
value; a block of texts sends each name once, so that a passage in a third of
all rows adds one name per block. Answers come back as bits per block, and
blocks lie in a table bucketed by block, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import mix, saved, saved_by, small_batches, text_bytes, trim

#: A perfect difference set modulo 133 (every shift occurs once).
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
BLOCK_BYTES = 1 << 19
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, n.bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Windows:
    """Hashes of any strings of a buffer in constant time each."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * _power(_BASE, len(buf)), out=self.sums[1:])
        self.back = _power(pow(_BASE, -1, 1 << 64), len(buf) + 1)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


class Block:
    """A run of texts: bytes, where they start and end, and what a step names."""

    def __init__(self, data: bytes, lengths: bytes):
        self.buf = np.frombuffer(data, np.uint8)
        self.length = np.frombuffer(lengths, np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.windows = Windows(self.buf)

    def sampled(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions whose tuple lies within one text, the tuples' names, and the text's limits."""
        n = len(self.buf)
        p = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
        p = p[p < n]
        text = np.searchsorted(self.end, p, side="right")
        lo, hi = self.start[text], self.end[text]
        ok = (p + width - PERIOD + 1 <= hi) & (hi - lo >= width)
        p, lo, hi = p[ok], lo[ok], hi[ok]
        return p, self.windows.names(p, p + width - PERIOD + 1), lo, hi


def unique(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the place of each name among them, and which occur more than once."""
    u, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
    return u, inverse, count > 1


def deal(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and where each bucket starts in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bits_of(replies: list | None, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Answers put back into the order of the names they are about."""
    out = np.zeros(len(order), bool)
    for r in replies or []:
        lo, hi = edges[r["bucket"]], edges[r["bucket"] + 1]
        out[order[lo:hi]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


class State:
    """What is known of a block, step by step, from its texts and the answers so far."""

    def __init__(self, block: Block, width: int, buckets: int):
        self.block, self.width, self.buckets = block, width, buckets

    def spread(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return deal(((names >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64), self.buckets)

    def first(self) -> list[tuple[int, bytes]]:
        self.p, names, self.lo, self.hi = self.block.sampled(self.width)
        self.names = names
        self.u1, self.of1, self.twice1 = unique(names)
        self.order1, self.edges1 = self.spread(self.u1)
        low = (self.u1[self.order1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [(b, low[i:j].tobytes()) for b, (i, j) in enumerate(zip(self.edges1[:-1], self.edges1[1:], strict=True)) if j > i]

    def second(self, replies: list | None) -> list[tuple[int, bytes]]:
        """Pairs (tuple name, surroundings' name) of the suffixes that are left; the last byte tells whether the block has the pair twice."""
        left = (self.twice1 | bits_of(replies, self.order1, self.edges1))[self.of1]
        self.p, self.names, self.lo, self.hi = (x[left] for x in (self.p, self.names, self.lo, self.hi))
        self.lo, self.hi = np.maximum(self.lo, self.p - PERIOD + 1), np.minimum(self.hi, self.p + self.width)
        around = self.block.windows.names(self.lo, self.hi) + mix(((self.p - self.lo) * 4096 + self.hi - self.p).astype(np.uint64))
        pairs = np.empty(len(self.p), [("core", "<u8"), ("around", "<u8")])
        pairs["core"], pairs["around"] = self.names, around
        u, first, inverse, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True) if len(pairs) else (pairs, np.empty(0, int), np.empty(0, int), np.empty(0, int))
        self.of2, self.first2, self.twice2 = inverse, first, count > 1
        self.order2, self.edges2 = self.spread(u["core"])
        rows = np.empty(len(u), [("core", "<u8"), ("around", "<u8"), ("twice", "u1")])
        rows["core"], rows["around"], rows["twice"] = u["core"], u["around"], self.twice2
        rows = rows[self.order2]
        return [(b, rows[i:j].tobytes()) for b, (i, j) in enumerate(zip(self.edges2[:-1], self.edges2[1:], strict=True)) if j > i]

    def third(self, replies: list | None) -> list[tuple[int, bytes]]:
        """Names of the single windows around suffixes whose surroundings did not settle them or are wanted for comparison."""
        same = self.twice2 | bits_of([{"bucket": r["bucket"], "bits": r["same"]} for r in replies or []], self.order2, self.edges2)
        wanted = bits_of([{"bucket": r["bucket"], "bits": r["wanted"]} for r in replies or []], self.order2, self.edges2)
        last = np.minimum(self.p, self.hi - self.width)
        n = len(self.block.buf)

        def starts(some: np.ndarray) -> np.ndarray:
            some = some[last[some] >= self.lo[some]]
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, self.lo[some], 1)
            np.add.at(edge, last[some] + 1, -1)
            return np.cumsum(edge[:n]) > 0

        self.repeated = starts(np.flatnonzero(same[self.of2])) if len(self.of2) else np.zeros(n, bool)
        self.open = np.flatnonzero(starts(self.first2[wanted])) if len(self.of2) else np.empty(0, np.int64)
        names = self.block.windows.names(self.open, self.open + self.width)
        u3, self.of3, self.twice3 = unique(names)
        self.order3, self.edges3 = self.spread(u3)
        rows = u3[self.order3]
        return [(b, rows[i:j].tobytes()) for b, (i, j) in enumerate(zip(self.edges3[:-1], self.edges3[1:], strict=True)) if j > i]

    def covered(self, replies: list | None) -> np.ndarray:
        """Which bytes lie in a repeated window."""
        if len(self.open):
            self.repeated[self.open[(self.twice3 | bits_of(replies, self.order3, self.edges3))[self.of3]]] = True
        edge = np.zeros(len(self.block.buf) + self.width + 1, np.int32)
        at = np.flatnonzero(self.repeated)
        edge[at] += 1
        edge[at + self.width] -= 1
        return np.cumsum(edge)[: len(self.block.buf)] > 0


def _seen_twice(names: np.ndarray) -> np.ndarray:
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    out = np.zeros(len(names), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def answer(table: pa.Table, kind: str) -> pa.Table:
    """Compares all names of one bucket."""
    block, data = table["block"].to_pylist(), table["names"].to_pylist()
    dtype = {"first": np.dtype("<u4"), "third": np.dtype("<u8"), "second": np.dtype([("core", "<u8"), ("around", "<u8"), ("twice", "u1")])}[kind]
    parts = [np.frombuffer(x, dtype) for x in data]
    cut = np.cumsum([0, *map(len, parts)])
    rows = np.concatenate(parts)
    if kind != "second":
        flags = {"bits": _seen_twice(rows)}
    else:
        order = np.lexsort((rows["around"], rows["core"]))
        r = rows[order]
        new_core = np.append(True, r["core"][1:] != r["core"][:-1])
        new_pair = new_core | np.append(True, r["around"][1:] != r["around"][:-1])
        pair, core = np.cumsum(new_pair) - 1, np.cumsum(new_core) - 1
        many = np.bincount(pair) > 1
        settled = (many | (np.bincount(pair, weights=r["twice"]) > 0))[pair]
        variants = np.bincount(core[new_pair])[core]
        unsettled = (np.bincount(core, weights=~settled) > 0)[core]
        # one of each set of equal surroundings stands for all of them
        wanted = (variants > 1) & unsettled & new_pair
        flags = {k: np.zeros(len(rows), bool) for k in ("same", "wanted")}
        flags["same"][order], flags["wanted"][order] = settled, wanted
    some = [i for i in range(len(parts)) if any(f[cut[i] : cut[i + 1]].any() for f in flags.values())]
    columns = {"block": pa.array([block[i] for i in some], pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(some), pa.int32())}
    for k, f in flags.items():
        columns[k] = pa.array([np.packbits(f[cut[i] : cut[i + 1]]).tobytes() for i in some], pa.binary())
    return pa.table(columns)


def answering(kind: str):
    return lambda rows: answer(rows, kind)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows (data, lengths, rest): texts of about BLOCK_BYTES together, and their rows' other columns as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(kept):
            table = pa.Table.from_batches([b.slice(i, n) for b, _, i, n in kept])
            data = [x for _, texts, i, n in kept for x in texts[i : i + n]]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pydict({"data": [b"".join(data)], "lengths": [np.array([len(x) for x in data], np.int64).tobytes()], "rest": [sink.getvalue().to_pybytes()]})

        kept, size = [], 0
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            texts = [text_bytes(t) for t in batch.column(at).to_pylist()]
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [batch.column(at).is_null()], names=[f"c{i}" for i in range(batch.num_columns)])
            first = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_BYTES or i + 1 - first >= 10_000:
                    kept.append((rest, texts, first, i + 1 - first))
                    yield packed(kept)
                    kept, size, first = [], 0, i + 1
            if first < len(texts):
                kept.append((rest, texts, first, len(texts) - first))
        if kept:
            yield packed(kept)
        trim()

    return docs.mapInArrow(run, "data binary, lengths binary, rest binary")


def repeats(docs: DataFrame, *, width: int = 200, text_out: bool = False) -> DataFrame:
    """The rows of ``docs`` with their other columns and n_bytes, n_removed, n_spans, kept (remaining bytes), spans (start, end).

    With ``text_out`` the rows have the columns of ``docs`` alone, ``text``
    holding what remains; bytes of a character that was cut in two go with it.
    Null texts count as empty and stay null. Repeated rows are repeats of one
    another like any other texts. Result columns replace those of ``docs`` with
    the same names. ``width`` is at least 150.
    """
    if width < PERIOD + 17:
        raise ValueError(f"width must be at least {PERIOD + 17}")
    spark = docs.sparkSession
    small_batches(spark, 200)
    own = [f for f in docs.schema.fields if f.name != "text"]
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)], F.col("text").cast("string").alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks_of(inner).withColumn("block", F.monotonically_increasing_id())
    blocks, _ = saved_by(rows, "blocks", "block", parquet_block_size=16 << 20)
    small_batches(spark, 4)
    total = blocks.select(F.sum(F.length("data"))).first()[0] or 0
    # names of a bucket fit in memory many times over, at any size of the corpus
    buckets = max(2 * parts, int(total * len(COVER) / PERIOD * 4 / (4 << 20)) + 1)

    def stepped(data: bytes, lengths: bytes, *replies) -> State | list:
        state = State(Block(data, lengths), width, buckets)
        out = state.first()
        for step, r in zip((state.second, state.third), replies, strict=False):
            out = step(r)
        return out if len(replies) < 3 else (state, state.covered(replies[2]))

    answers: list[DataFrame] = []

    def joined() -> DataFrame:
        out = blocks
        for i, a in enumerate(answers):
            out = out.join(a.withColumnRenamed("replies", f"r{i}"), "block", "left")
        return out

    for kind in ("first", "second", "third"):
        given = [f"r{i}" for i in range(len(answers))]

        def emit(batches: Iterator[pa.RecordBatch], n: int = len(given)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block, data, lengths, *replies = (batch.column(c)[i].as_py() for c in range(3 + n))
                    found = stepped(data, lengths, *replies)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["block", "bucket", "names"])
            trim()

        names = joined().select("block", "data", "lengths", *given).mapInArrow(emit, "block long, bucket int, names binary")
        shape = "block long, bucket int, " + ("same binary, wanted binary" if kind == "second" else "bits binary")
        flags = names.groupBy("bucket").applyInArrow(answering(kind), shape)
        fields = [c for c in flags.columns if c != "block"]
        answers.append(saved(flags.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("replies")), f"answers-{kind}"))

    others = [(i, f) for i, f in enumerate(own) if text_out or f.name not in ("n_bytes", "n_removed", "n_spans", "kept", "spans")]
    more = "text string" if text_out else "n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"
    shape = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in others] + [more])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, lengths, rest, *replies = (batch.column(c)[i].as_py() for c in range(6))
                state, cover = stepped(data, lengths, *replies)
                table = pa.ipc.open_stream(rest).read_all().combine_chunks()
                block = state.block
                out = {f"c{k}": table[f"c{k}"] for k, _ in others}
                null = table[table.column_names[-1]].to_pylist()
                left = [block.buf[a:b][~cover[a:b]].tobytes() for a, b in zip(block.start, block.end, strict=True)]
                if text_out:
                    out["text"] = pa.array([None if no else x.decode("utf-8", "ignore") for no, x in zip(null, left, strict=True)], pa.string())
                else:
                    spans = []
                    for a, b in zip(block.start, block.end, strict=True):
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], cover[a:b].astype(np.int8), [0]])))
                        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    out["n_bytes"] = pa.array(block.length)
                    out["n_removed"] = pa.array(block.length - np.array([len(x) for x in left], np.int64))
                    out["n_spans"] = pa.array([len(s) for s in spans], pa.int64())
                    out["kept"] = pa.array(left, pa.binary())
                    out["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield from pa.table(out).combine_chunks().to_batches(500)
        trim()

    out = joined().select("data", "lengths", "rest", "r0", "r1", "r2").mapInArrow(finish, shape)
    out = out.select(*[F.col(f"c{i}").alias(f.name) for i, f in others], *[c for c in out.columns if not c[1:].isdigit()])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns]) if text_out else out
