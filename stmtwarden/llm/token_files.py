"""Files of token ids under the context-mixing range coder, in ascending order of documents.

Documents are sorted by a range exchange; each task encodes its run of them to
segments (a number of whole documents, a few million ids), and Spark's text
writer stores the segments' bytes, one row each with a line feed after it. A
segment is

    "CMX5" (or "CMX6", where ids of 65536 and more occur and the low halves of
    all ids are followed by the high ones), then little-endian: part u32, number in part u32, documents u32,
    ids u64, blocks u32, distinct ids u32, length of the rest u64, crc32 of the lists u32; the
    lists: per document doc_id i64, null flag u8, ids u32; per distinct id the
    id u16 and its count u32 (scaled, see ``mixing.Counts``); per block bytes u16, crc32 u32; the blocks.

Blocks of 1024 ids are coded and checked independently of each other, under the
counts of their segment: many short blocks side by side cost less than few long ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtwarden.llm import mixing
from stmtwarden.llm.common import Run, saved, small_batches
from stmtwarden.llm.tokens import encoder

HEAD = struct.Struct("<4sIIIQIIQI")
SHARES = np.dtype([("id", "<u2"), ("share", "<u4")])
BLOCK_IDS = 1024
SEGMENT_IDS = 8_000_000
MAX_DOCS = 1 << 20
FILE_SEGMENTS = 16


def segment(part: int, number: int, docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    halves = (np.concatenate([ids & 0xFFFF, ids >> 16]) if wide else ids).astype(np.int64)
    counts = mixing.Counts.of(halves)
    blocks = mixing.encode(halves, BLOCK_IDS, counts)
    shares = np.empty(len(counts.ids), SHARES)
    shares["id"], shares["share"] = counts.ids, counts.shares
    lists = [struct.pack("<qBI", doc_id or 0, doc_id is None, n) for doc_id, n in docs] + [shares.tobytes()]
    lists = b"".join(lists + [struct.pack("<HI", len(b), zlib.crc32(b)) for b in blocks])
    body = b"".join([lists, *blocks])
    return HEAD.pack(b"CMX6" if wide else b"CMX5", part, number, len(docs), len(ids), len(blocks), len(shares), len(body), zlib.crc32(lists)) + body


def read_segments(content: bytes) -> Iterator[tuple[int, int, list[tuple[int | None, int]], np.ndarray]]:
    """(part, number, documents, ids) of each segment of a file; a damaged block raises."""
    at = 0
    while at < len(content):
        magic, part, number, n_docs, n_ids, n_blocks, n_shares, size, check = HEAD.unpack_from(content, at)
        if magic not in (b"CMX5", b"CMX6"):
            raise ValueError("not a token file")
        at += HEAD.size
        ends = np.cumsum([at, 13 * n_docs, SHARES.itemsize * n_shares, 6 * n_blocks]).tolist()
        if zlib.crc32(content[at : ends[3]]) != check:
            raise ValueError(f"lists of segment {number} in part {part} are damaged")
        docs = [(None if null else doc_id, n) for doc_id, null, n in struct.iter_unpack("<qBI", content[at : ends[1]])]
        shares = np.frombuffer(content[ends[1] : ends[2]], SHARES)
        index = list(struct.iter_unpack("<HI", content[ends[2] : ends[3]]))
        place, blocks = ends[3], []
        for length, crc in index:
            block = content[place : place + length]
            if zlib.crc32(block) != crc:
                raise ValueError(f"block {len(blocks)} of segment {number} in part {part} is damaged")
            blocks.append(block)
            place += length
        counts = mixing.Counts(shares["id"], shares["share"])
        ids = mixing.decode(blocks, n_ids * (2 if magic == b"CMX6" else 1), BLOCK_IDS, counts)
        yield part, number, docs, ids if magic == b"CMX5" else ids[:n_ids].astype(np.int64) | ids[n_ids:].astype(np.int64) << 16
        at += size
        if content[at : at + 1] != b"\n":
            raise ValueError("segment does not end where it should")
        at += 1


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of doc_id (null first).

    Rows that share a doc_id follow in the order of a hash of their texts: the
    exchange samples its sort keys through the driver, so texts are none. A
    null or empty text is the end id alone. A file holds ``FILE_SEGMENTS``
    segments at most, so that it can be read as one value. Columns besides
    doc_id and text are not read, whatever their names; an empty table gives
    files without segments.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part, number = encoder(tokenizer), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        docs, data, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1).to_pylist()), strict=True):
                docs.append((doc_id, len(ids) // 4 + 1))
                data.append(np.frombuffer(ids + end, "<u4"))
                size += len(data[-1])
                if size >= SEGMENT_IDS or len(docs) == MAX_DOCS:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([segment(part, number, docs, np.concatenate(data))], pa.binary())})
                    docs, data, size, number = [], [], 0, number + 1
        if docs:
            yield pa.RecordBatch.from_pydict({"value": pa.array([segment(part, number, docs, np.concatenate(data))], pa.binary())})

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    small_batches(spark, 16)
    shape = "part long, number long, nth long, doc_id long, n_tokens long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for part, number, docs, ids in read_segments(batch.column(0)[i].as_py()):
                    lengths = np.array([n for _, n in docs], np.int64)
                    wide, cut = ids.astype("<u4"), np.concatenate([[0], np.cumsum(lengths)])
                    parts = [wide[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                    for at in range(0, len(docs), 20_000):
                        some = slice(at, at + 20_000)
                        n = len(docs[some])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([d for d, _ in docs[some]], pa.int64()),
                                pa.array(lengths[some]), pa.array([zlib.crc32(p) for p in parts[some]], pa.int64()), pa.array(parts[some] if with_ids else [None] * n, pa.binary()),
                            ],
                            names=[x.split()[0] for x in shape.split(", ")],
                        )

    with Run(spark) as run_:
        rows, firsts = _starts(spark, path, run, shape)
        run_.keep(rows, firsts)
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "number").orderBy("nth")) - F.col("n_tokens")
    out = rows.withColumn("inside", inside).join(firsts, (F.col("part") == F.col("p")) & (F.col("number") == F.col("s")))
    cols = ["doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*cols, *(["ids"] if with_ids else []))


def _starts(spark: SparkSession, path: str, run, shape: str) -> tuple[DataFrame, DataFrame]:
    """The documents of the files, and the number of ids before each segment."""
    rows = saved(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, shape), "token-rows")
    # a row per segment, that is per some million ids
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    before = (F.sum("size").over(Window.orderBy("part", "number")) - F.col("size")).alias("before")
    return rows, saved(sizes.select(F.col("part").alias("p"), F.col("number").alias("s"), before), "starts")
