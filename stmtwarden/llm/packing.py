"""Packing of documents into fixed windows by minimum bin slack.

Documents are cut into full windows and one remainder each. The remainders'
lengths are counted (at most ``capacity`` numbers, whatever the corpus), and a
plan is made on the counts: the longest remaining length opens a window, and a
bitset subset-sum over the other remaining lengths finds the multiset that
fills it closest to capacity; backtracking gives the counts, and the pattern is
used as often as the counts allow. Pieces then look up their place by their
rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from stmtwarden.llm.common import Run, map_arrow, saved, small_batches
from stmtwarden.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to ``room`` from below.

    Bit s of ``reach`` says that some multiset sums to s; a length available c
    times is taken in portions of 1, 2, 4 ... so that log2(c) shifts cover it.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, portion = min(counts[length], room // length), 1
        while left:
            take = min(portion, left)
            grown = reach | (reach << (take * length)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, portion = left - take, portion * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> count) with the number of windows that use each; together they use every length as often as counted."""
    left, patterns = dict(counts), []
    for length in sorted(left, reverse=True):
        while left[length]:
            left[length] -= 1
            pattern = fill(left, capacity - length)
            left[length] += 1
            pattern[length] = pattern.get(length, 0) + 1
            times = min(left[x] // c for x, c in pattern.items())
            for x, c in pattern.items():
                left[x] -= times * c
            patterns.append((pattern, times))
    return patterns


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Full windows and remainders of the documents' ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, end, out = encoder(tokenizer), int(end_id).to_bytes(4, "little"), []
        step = 4 * capacity
        for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
            ids += end
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                out.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if with_ids else None))
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=[x.split()[0] for x in PIECE.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECE)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (little-endian 32-bit).

    A null or empty text is the end id alone. Null and repeated doc_ids are
    documents like others. Sequence ids run from 0 without gaps. Columns of
    ``docs`` besides doc_id and text are not read. Pieces of one length are
    ranked in as many separate groups as there are shuffle partitions, so a
    length that many documents share is not one task's work.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Run(spark) as run:
        ranked, counts = _ranked(pieces(docs, tokenizer, capacity, end_id, with_ids), run)

    keys, first_of, each, base, sequence = [], [], [], [], 0
    seen = dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, capacity):
        at = 0
        for length, c in sorted(pattern.items(), reverse=True):
            keys.append((length << 44) + seen[length])
            first_of.append(sequence)
            each.append(c)
            base.append(at)
            seen[length] += times * c
            at += length * c
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    places = spark.sparkContext.broadcast([np.array(x, np.int64)[order] for x in (keys, first_of, each, base)])

    @arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, first_of, each, base = places.value
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(keys, (n << 44) + r, side="right") - 1
        nth = (n << 44) + r - keys[i]
        return pa.StructArray.from_arrays([pa.array(first_of[i] + nth // each[i]), pa.array(base[i] + nth % each[i] * n)], names=["sequence_id", "offset"])

    out = ranked.withColumn("at", place("length", "rank"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("at.sequence_id"), F.col("at.offset")]
    return out.select(*cols, *(["ids"] if with_ids else []))


def _ranked(found: DataFrame, run: Run) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among those of equal length, and the number of pieces of each length."""
    spark, stored = found.sparkSession, saved(found, "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = saved(rows.groupBy("length", "salt").agg(F.count("*").alias("c")), "sizes")
    counts = {r["length"]: r["c"] for r in sizes.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    before = F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")
    firsts = saved(sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("before")), "firsts")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(firsts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("before") + F.col("r"))
    run.keep(stored, firsts)
    return ranked, counts
