"""Streams in several batches, run again, and with late rows."""

import pytest
from pyspark.sql import functions as F

from stmtwarden.streaming import jobs
from stmtwarden.views import VIEWS


@pytest.fixture()
def log(spark, sf_dir, tmp_path):
    """The events table cut into files of ascending time, as a folder."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "events")
    for n in range(4):
        events.filter(F.col("event_id") % 4 == n).coalesce(1).write.mode("append").parquet(path)
    return path, events


def as_log(spark, events):
    return spark.sql(VIEWS["statement_log"], events=events)


def stream(spark, path, events):
    return as_log(spark, jobs.read_stream(spark, path, events.schema, files_per_trigger=1))


def test_rollup_over_batches_equals_batch(spark, log, tmp_path):
    path, events = log
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.stream_rollup(stream(spark, path, events), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4
    got = {(r.sql_id, r.counter, r.sql_text) for r in jobs.current_records(spark, out).collect()}

    from stmtwarden.operators import governance, merge

    rows = governance.queue_rows(as_log(spark, events), "slow_log", "1")
    want = {(r.sql_id, r.counter, r.sql_text) for r in merge.fingerprint_rollup(rows, jobs.CARRY).collect()}
    assert got == want

    # A batch written twice counts once.
    again = spark.read.parquet(f"{out}/batch_id=2")
    rows = again.collect()
    jobs.write_batch(spark.createDataFrame(rows, again.schema), out, 2)
    assert {(r.sql_id, r.counter, r.sql_text) for r in jobs.current_records(spark, out).collect()} == want

    # Nothing is read twice after a restart, and compaction changes nothing.
    jobs.stream_rollup(stream(spark, path, events), out, checkpoint).awaitTermination()
    for _ in range(2):
        jobs.compact(spark, out, jobs.rolled_up)
        assert {(r.sql_id, r.counter, r.sql_text) for r in jobs.current_records(spark, out).collect()} == want
    assert jobs._complete(spark, out, "batch_id") == [] and jobs._complete(spark, out, "folded") == [3]

    # Batches after a fold add to it; one that the fold holds already does not, even if it is still there.
    for n in (2, 4):
        jobs.write_batch(spark.createDataFrame(rows, again.schema), out, n)
    more = {r.sql_id: r.counter for r in spark.createDataFrame(rows, again.schema).collect()}
    assert {r.sql_id: r.counter for r in jobs.current_records(spark, out).collect()} == {i: c + more.get(i, 0) for i, c, _ in want}


def test_late_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in [[(1, "2024-01-10 00:00:00")], [(2, "2024-01-09 23:30:00"), (1, "2024-01-10 00:00:00")], [(3, "2024-01-01 00:00:00")], [(3, "2024-01-01 00:00:00"), (4, None), (4, None)], [(4, None)]]:
        df = spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out, windows = str(tmp_path / "out"), str(tmp_path / "windows")
    read = lambda: jobs.read_stream(spark, path, schema, files_per_trigger=1)
    jobs.stream_high_water(read(), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in jobs.read_batches(spark, out).collect()) == [1, 2, 3, 4]

    queue = read().where("ts IS NOT NULL").withColumn("sql_id", F.lit("s"))
    jobs.stream_window_counts(queue, windows, str(tmp_path / "cp2")).awaitTermination()
    assert sorted((str(r.window_start), r.statement_count) for r in jobs.window_counts(spark, windows).collect()) == [
        ("2024-01-01 00:00:00", 2), ("2024-01-09 23:00:00", 1), ("2024-01-10 00:00:00", 2),
    ]


def test_rows_without_id_all_stay(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in [[(None, "a"), (None, "b"), (1, "c"), (1, "c")], [(None, "d"), (None, "a"), (1, "c")]]:
        df = spark.createDataFrame(rows, "id long, sql_text string").withColumn("ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
    read = jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    jobs.stream_high_water(read, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.sql_text for r in jobs.read_batches(spark, out).collect()) == ["a", "a", "b", "c", "d"]


def test_watermark_shuts_out_and_closes(spark, tmp_path):
    """Four uneven batches with late and repeated rows: closed windows, open ones and the late rows add up to the batch twin, and the state shrinks."""
    path, out, windows = (str(tmp_path / x) for x in ("in", "out", "windows"))
    hour = lambda n, m=0: f"2024-01-10 {n:02d}:{m:02d}:00"
    first = [(n, hour(n % 3, n % 60)) for n in range(40)]
    second = [(3, hour(0, 3)), (100, hour(2, 30)), *[(200 + n, hour(12, n)) for n in range(5)]]
    # rows are late by the watermark of the batch before: 10:04, after the newest row at 12:04
    third, fourth = [(250, hour(12, 30))], [(300, hour(9)), (301, hour(11)), (5, hour(2, 5)), (200, hour(12)), (302, hour(9)), (302, hour(9)), (303, hour(13)), (None, hour(13)), (304, None)]
    for rows in (first, second, third, fourth):
        df = spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("ts")).withColumn("sql_id", F.lit("s"))
        df.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    read = lambda: jobs.read_stream(spark, path, schema, files_per_trigger=1)
    query = jobs.stream_within_watermark(read(), out, str(tmp_path / "cp"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 40 and held[-1] <= 9
    stored = jobs.read_batches(spark, out)
    assert sorted(r.id for r in stored.collect()) == sorted([*range(40), 100, *range(200, 205), 250, 301, 303])
    late = jobs.late_rows(spark, spark.read.parquet(path), out)
    assert sorted((r.id or 0, r.ts is None) for r in late.collect()) == [(0, False), (300, False), (302, False), (304, True)]

    jobs.stream_closed_windows(read(), windows, str(tmp_path / "cp2")).awaitTermination()
    closed = {r.window_start.hour: r.statement_count for r in jobs.read_batches(spark, windows).collect()}
    assert closed == {0: 14, 1: 13, 2: 14}
    by_hour = lambda df: {r["h"]: r["n"] for r in df.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n")).collect()}
    twin = by_hour(spark.read.parquet(path).where("id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["id"]))
    still_open = {h: n for h, n in by_hour(stored).items() if h not in closed}
    shut_out = by_hour(late.where("id IS NOT NULL AND ts IS NOT NULL"))
    assert {h: closed.get(h, 0) + still_open.get(h, 0) + shut_out.get(h, 0) for h in twin} == twin

    # a restart neither reads nor gives out anything twice
    jobs.stream_closed_windows(read(), windows, str(tmp_path / "cp2")).awaitTermination()
    assert {r.window_start.hour: r.statement_count for r in jobs.read_batches(spark, windows).collect()} == closed
