"""Streaming forms of collection and audit.

Each micro-batch is reduced before it is written, and is written under its
batch id in overwrite mode, so a batch that runs twice leaves one result. What
is stored merges by the same aggregation (``fingerprint_rollup`` of rollups,
sums of counts), so the state is a set of small appended tables instead of a
table rewritten for every batch. ``compact`` folds them now and then: the fold
is written under the last batch id it holds, and once it is complete readers
leave those batches out, whether they are deleted yet or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stmtwarden.operators import governance, lists, merge
from stmtwarden.session import file_system

CARRY = ("sql_fingerprint", "project_id", "schema_name", "instance_id")


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``path`` may also name one file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(file) and not fs.getFileStatus(file).isDirectory():
        return reader.option("pathGlobFilter", file.getName()).parquet(file.getParent().toString())
    return reader.parquet(path)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start ``work`` on each micro-batch: every so often, or until the input is used up."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished tables ``name=number`` in a folder, ascending."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))
    return [n for n in found if fs.exists(file_system(spark, f"{path}/{name}={n}/_SUCCESS")[1])]


def read_batches(spark: SparkSession, path: str, but: int | None = None) -> DataFrame | None:
    """All that is stored: the newest fold and the batches after it, without batch ``but``; None if there is nothing."""
    folds = _complete(spark, path, "folded")
    upto = folds[-1] if folds else -1
    batches = [n for n in _complete(spark, path, "batch_id") if n > upto and n != but]
    parts = [f"{path}/folded={upto}"] * bool(folds) + [f"{path}/batch_id={n}" for n in batches]
    return spark.read.parquet(*parts) if parts else None


def compact(spark: SparkSession, path: str, merge_rows: Callable[[DataFrame], DataFrame]) -> None:
    """Folds what is stored into one table and deletes what it holds.

    Runs beside the stream: batches that end meanwhile have larger numbers.
    A run that is cut off leaves either the old tables or the complete fold.
    """
    batches, folds = _complete(spark, path, "batch_id"), _complete(spark, path, "folded")
    newer = [n for n in batches if not folds or n > folds[-1]]
    if newer:
        rows = spark.read.parquet(*[f"{path}/folded={n}" for n in folds[-1:]], *[f"{path}/batch_id={n}" for n in newer])
        merge_rows(rows).write.mode("overwrite").parquet(f"{path}/folded={newer[-1]}")
    upto = newer[-1] if newer else (folds[-1] if folds else -1)
    old = [f"{path}/batch_id={n}" for n in batches if n <= upto] + [f"{path}/folded={n}" for n in folds if n < upto]
    for one in old:
        fs, where = file_system(spark, one)
        fs.delete(where, True)


def stream_rollup(log: DataFrame, out: str, checkpoint: str, source: str = "slow_log", plan_id: str = "1", every: str | None = None):
    """Per batch, rows rolled up by statement and stored."""

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = governance.queue_rows(batch, source, plan_id)
        write_batch(merge.fingerprint_rollup(rows, CARRY), out, batch_id)

    return run_batches(log, work, checkpoint, every)


def current_records(spark: SparkSession, out: str) -> DataFrame:
    """The records all stored batches add up to."""
    return rolled_up(read_batches(spark, out))


def rolled_up(rows: DataFrame) -> DataFrame:
    return merge.fingerprint_rollup(rows, CARRY)


def stream_audit(log: DataFrame, out: str, checkpoint: str, source: str = "slow_log", plan_id: str = "1", settings=None, every: str | None = None):
    """Per batch, its statements audited and stored with level and priority.

    A statement's audit depends on its text only, so auditing each batch's
    newest text gives the same as auditing the changed records.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        records = merge.fingerprint_rollup(governance.queue_rows(batch, source, plan_id), CARRY)
        audited = governance.audit_records(records, settings=settings)
        write_batch(audited.select("sql_id", "sql_text", "ts", "id", "audit_level", "priority", "audit_results"), out, batch_id)

    return run_batches(log, work, checkpoint, every)


def newest_audits(spark: SparkSession, out: str) -> DataFrame:
    """Per statement the audit of its newest text."""
    rows = read_batches(spark, out)
    newest = F.max_by(F.struct("sql_text", "audit_level", "priority", "audit_results"), F.struct("ts", "id")).alias("_n")
    return rows.groupBy("sql_id").agg(newest).select("sql_id", "_n.*")


def stream_blocklist(statements: DataFrame, blocklist: DataFrame, kept: str, counts: str, checkpoint: str, every: str | None = None):
    """Rows no entry blocks are stored, and how often each entry matched.

    The list is read anew for each batch, so changes to it take effect.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        matched = lists.blocklist_match(batch, blocklist).persist()
        try:
            write_batch(lists.blocklist_survivors(matched), kept, batch_id)
            hits = matched.filter("matched_id IS NOT NULL").groupBy("matched_id").agg(F.count("*").alias("matched"), F.max("ts").alias("last_match"))
            write_batch(hits, counts, batch_id)
        finally:
            matched.unpersist()

    return run_batches(statements, work, checkpoint, every)


def blocklist_counts(spark: SparkSession, counts: str) -> DataFrame:
    """Matches of each entry over all batches."""
    return read_batches(spark, counts).groupBy(F.col("matched_id").alias("id")).agg(
        F.sum("matched").alias("matched_count"), F.max("last_match").alias("last_match_time")
    )


def stream_high_water(log: DataFrame, out: str, checkpoint: str, every: str | None = None):
    """T4: rows once each, however late they come and however often.

    The checkpoint remembers what was read. Rows that a source sends again are
    found among the stored ones by id; equal ids have equal times, so only
    what is stored from the batch's oldest time on is read. Rows without an id
    are told apart by nothing; each of them is stored.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh, stored = batch.where("id IS NOT NULL").dropDuplicates(["id"]), read_batches(spark, out, but=batch_id)
        oldest = batch.agg(F.min("ts")).first()[0]
        if stored is not None:
            since = F.col("ts").isNull()
            if oldest is not None:
                since = since | (F.col("ts") >= F.lit(oldest).cast("timestamp_ntz"))
            fresh = fresh.join(stored.where(since).select("id"), "id", "left_anti")
        write_batch(fresh.unionByName(batch.where("id IS NULL")), out, batch_id)

    return run_batches(log, work, checkpoint, every)


def stream_window_counts(queue: DataFrame, out: str, checkpoint: str, width: str = "1 hour", every: str | None = None):
    """T5: per batch, rows per statement and tumbling window; windows fill up as batches come, late ones included."""

    def work(batch: DataFrame, batch_id: int) -> None:
        start = F.window("ts", width)["start"].cast("timestamp_ntz").alias("window_start")
        write_batch(batch.groupBy(start, "sql_id").agg(F.count("*").alias("statement_count")), out, batch_id)

    return run_batches(queue, work, checkpoint, every)


def summed_windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "sql_id").agg(F.sum("statement_count").alias("statement_count"))


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    """T5: the counts all stored batches add up to."""
    return summed_windows(read_batches(spark, out))


def _once_within(log: DataFrame, delay: str) -> DataFrame:
    """Rows with a time and an id, once each, as long as the watermark lets them in; the state holds the ids of the last ``delay`` only."""
    timed = log.where("ts IS NOT NULL AND id IS NOT NULL").withColumn("_at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["id"])


def stream_within_watermark(log: DataFrame, out: str, checkpoint: str, delay: str = "2 hours", every: str | None = None):
    """T4: rows once each that are not more than ``delay`` older than the newest row some batches ago.

    Spark sets the watermark after each batch and takes rows as late by the
    one that the batch before had, so rows have a batch more time.
    Unlike :func:`stream_high_water` nothing stored is read again: ids wait in
    the state store until the watermark has passed them. What comes too late
    is told by :func:`late_rows`. Rows without a time or an id are told apart
    by nothing the state could hold and are left to that function as well.
    """
    return run_batches(_once_within(log, delay).drop("_at"), lambda batch, batch_id: write_batch(batch, out, batch_id), checkpoint, every)


def late_rows(spark: SparkSession, log: DataFrame, out: str) -> DataFrame:
    """T4: the side output: rows of the log that the watermark shut out, repeated ids once, and all rows without id or time."""
    stored = read_batches(spark, out)
    keyed = log.where("ts IS NOT NULL AND id IS NOT NULL")
    late = keyed.dropDuplicates(["id"])
    if stored is not None:
        late = late.join(stored.select("id"), "id", "left_anti").select(log.columns)
    return late.unionByName(log.where("ts IS NULL OR id IS NULL"))


def stream_closed_windows(queue: DataFrame, out: str, checkpoint: str, width: str = "1 hour", delay: str = "2 hours", every: str | None = None):
    """T5 in append mode: each window's counts are given out once, when the watermark has passed its end.

    Repeated ids count once. The state holds ids of the last ``delay`` and the
    windows not yet closed.
    """
    counts = _once_within(queue, delay).groupBy(F.window("_at", width).alias("_w"), "sql_id").agg(F.count("*").alias("statement_count"))
    closed = counts.select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "sql_id", "statement_count")
    return run_batches(closed, lambda batch, batch_id: write_batch(batch, out, batch_id), checkpoint, every)
