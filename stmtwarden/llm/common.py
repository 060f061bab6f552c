"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.session import fresh_dir

MASK = (1 << 64) - 1
#: A table may be sent to every task when it has at most this many rows.
SMALL_ROWS = 20_000
BLOOM_BITS = 1 << 25
_sent: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Run:
    """The tables written while it is entered; what is not kept is deleted when it ends.

    Each query enters a run of its own, so that queries in other threads are
    not touched. A run inside another hands what it keeps to the outer one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Run:
        self.token = _run.set(self)
        self.outer = self.token.old_value if isinstance(self.token.old_value, Run) else None
        self.kept: set[str] = set()
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Tables, as :func:`saved` gave them, that are still read after the run."""
        for t in tables:
            self.kept.update(paths_of(t))

    def __exit__(self, kind, *_) -> None:
        _run.reset(self.token)
        kept = self.kept if kind is None else set()
        if self.outer:
            self.outer.paths += [p for p in self.paths if p in kept]
        _delete(self.spark, [p for p in self.paths if p not in kept])
        free(self.spark)


def free(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver has forgotten the plans that wrote them: lets it forget those of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


_run: contextvars.ContextVar[Run | None] = contextvars.ContextVar("run", default=None)


def paths_of(df: DataFrame) -> list[str]:
    return getattr(df, "_paths", [])


def forget(df: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more."""
    _delete(df.sparkSession, paths_of(df))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _noted(df: DataFrame, path: str) -> DataFrame:
    df._paths = [path]
    if run := _run.get():
        run.paths.append(path)
    return df


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path), path)


def saved_by(df: DataFrame, label: str, key: str, parts: int | None = None, **options: int) -> tuple[DataFrame, DataFrame]:
    """The saved rows twice: bucketed by ``key`` for joins that need no exchange of them, and plain for joins whose hot keys Spark is to split."""
    spark = df.sparkSession
    path, name = fresh_dir(spark, label), f"{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).option("compression", "zstd")
    for option, value in options.items():
        writer = writer.option(option.replace("_", "."), value)
    writer.saveAsTable(name)
    bucketed = spark.table(name)
    # the relation is resolved, and the files stay: the catalogue need not keep the name
    spark.sql(f"DROP TABLE {name}")
    return _noted(bucketed, path), _noted(spark.read.schema(df.schema).parquet(path), path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Makes the session ready for Python tasks: the package is sent to the executors, and long texts go in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        package = Path(__file__).resolve().parent.parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


def joined_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Null-safe join with a saved table that is broadcast only if its row count is within ``SMALL_ROWS``; else a shuffled join."""
    side = small.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in small.columns])
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        side = F.broadcast(side)
    cond = None
    for c in on:
        one = big[c].eqNullSafe(side[f"_r_{c}"])
        cond = one if cond is None else cond & one
    return big.join(side, cond, how).drop(*[f"_r_{c}" for c in on])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that does not clash with those of ``df``, whatever their letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` neighbours of ``h``."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = mix(h[:m])
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; a shorter text is one shingle, one without words has none."""
    words = text_bytes(text).lower().split()
    h = word_hashes(words)
    if 0 < len(h) < k:
        return window_hashes(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(window_hashes(h, k))


def trim() -> None:
    """Gives memory that a finished task used back to the machine; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def ids_filter(ids: DataFrame, column: str):
    """A Bloom filter over the 64-bit values of a column, of fixed size (4 MB) whatever the number of values.

    It only spares work: what it lets through wrongly must be dropped by a join.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(BLOOM_BITS)) + 1
    rows = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for n, part in rows:
        bits[(n - 1) * 4096 : n * 4096] = np.frombuffer(part, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def in_filter(bits, hashed: np.ndarray) -> np.ndarray:
    b = hashed % BLOOM_BITS
    return (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of undirected links (a, b): one row (v, root) per linked value, root the smallest reachable.

    Each round points every value at its smallest neighbour, shortens the
    pointers until they reach roots, and contracts the links to roots. Every
    round at least halves what is left; nothing is collected.
    """
    spark, roots = edges.sparkSession, None
    with Run(spark) as run:
        edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        while not edges.isEmpty():
            both = edges.select("a", "b").union(edges.select("b", "a"))
            parent = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p")), label)
            while True:
                up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
                jumped = saved(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), label)
                parent = jumped.select("v", "p")
                if jumped.where("moved").isEmpty():
                    break
            if roots is None:
                roots = parent.select("v", F.col("p").alias("root"))
                roots._paths = paths_of(jumped)
            else:
                up = parent.select(F.col("v").alias("root"), "p")
                roots = saved(roots.join(up, "root", "left").select("v", F.coalesce("p", "root").alias("root")), label)
            a = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
            b = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
            left = edges.join(a, "a").join(b, "b").where("pa <> pb")
            edges = saved(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), label)
        if roots is not None:
            run.keep(roots)
    return roots if roots is not None else spark.createDataFrame([], "v long, root long")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
