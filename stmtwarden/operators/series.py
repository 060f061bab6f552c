"""Metric time series and workload insight (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtwarden.functions.text import sql_kind


def _between(column: str, begin: str, end: str):
    return F.col(column).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def metric_range(metrics: DataFrame, plan_rows: DataFrame, sql_id: str, begin: str, end: str) -> DataFrame:
    """Metric values of a statement in a time range, with their plan rows."""
    wanted = metrics.filter((F.col("sql_id") == sql_id) & _between("record_begin_at", begin, end))
    return wanted.join(plan_rows, "record_id", "left")


def metric_peak(metrics: DataFrame, metric: str, begin: str, end: str) -> DataFrame:
    """Per statement the record with the largest value of a metric."""
    order = F.struct("metric_value", "record_id")
    wanted = metrics.filter((F.col("metric_name") == metric) & _between("record_begin_at", begin, end))
    top = F.max_by(F.struct("record_id", "record_begin_at", "metric_value"), order).alias("_top")
    return wanted.groupBy("sql_id").agg(top).select("sql_id", "_top.*")


def cost_records(queue: DataFrame, costs: DataFrame, plan_rows: DataFrame, snapshot_sources=("schema_meta",)):
    """Metric records, cost values and plan rows of collected queries.

    Only queries have a cost, and schema snapshots are no queries. Returns
    three DataFrames that share the statement's record id.
    """
    queries = queue.filter(~F.col("source").isin(*snapshot_sources) & (sql_kind(F.col("sql_text")) == "DQL"))
    base = queries.select(F.col("id").alias("record_id"), "sql_id", "ts")
    records = base.select(
        "record_id", "sql_id", F.lit(1).alias("execution_count"), F.col("ts").alias("record_begin_at"), F.col("ts").alias("record_end_at")
    )
    values = base.join(costs, "record_id").select(
        "record_id", F.lit("explain_cost").alias("metric_name"), F.col("cost").cast("decimal(20,4)").alias("metric_value")
    )
    return records, values, plan_rows.join(base.select("record_id"), "record_id", "left_semi")


def cost_trend(metrics: DataFrame, sql_id: str, begin: str, end: str, latest_only: bool = False) -> DataFrame:
    """Cost of one statement over time, or its latest point."""
    points = metrics.filter((F.col("sql_id") == sql_id) & (F.col("metric_name") == "explain_cost") & _between("record_begin_at", begin, end))
    points = points.select("record_id", F.col("record_begin_at").alias("ts"), F.col("metric_value").alias("cost"))
    return points.orderBy(F.desc("ts"), F.desc("record_id")).limit(1) if latest_only else points.orderBy("ts", "record_id")


def workload_insight(samples: DataFrame, begin: str, end: str, width: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Samples of a time range per window: how many, mean and peak duration."""
    return (
        samples.filter(_between("ts", begin, end))
        .groupBy(F.window("ts", width).alias("_w"), *by)
        .agg(F.count("*").alias("statement_count"), F.avg("query_time").alias("avg_time"), F.max("query_time").alias("max_time"))
        .select(F.col("_w.start").alias("window_start"), *by, "statement_count", "avg_time", "max_time")
    )


def counter_rate(samples: DataFrame, key: str, counter: str, width: str = "1 hour") -> DataFrame:
    """Growth of a counter per second between neighbouring samples (QPS).

    A key's samples are cut into time windows so that a busy key is worked on
    by many tasks; each window is given the last sample of the window before
    it, which makes the result the same as one pass over the whole key.
    """
    cut = samples.select(key, "ts", "id", counter, F.window("ts", width)["start"].alias("_w"))
    last = cut.groupBy(key, "_w").agg(F.max_by(F.struct("ts", "id", counter), F.struct("ts", "id")).alias("_last"))
    windows = Window.partitionBy(key).orderBy("_w")
    carried = (
        last.withColumn("_prev", F.lag("_last").over(windows))
        .filter("_prev IS NOT NULL")
        .select(key, F.col("_prev.ts").alias("ts"), F.col("_prev.id").alias("id"), F.col(f"_prev.{counter}").alias(counter), "_w", F.lit(True).alias("_carried"))
    )
    rows = cut.withColumn("_carried", F.lit(False)).unionByName(carried)
    w = Window.partitionBy(key, "_w").orderBy("ts", "id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1000000
    grown = F.col(counter) - F.lag(counter).over(w)
    return (
        rows.withColumn("rate", grown / F.nullif(seconds, F.lit(0)))
        .filter("NOT _carried")
        .select(key, "id", "ts", "rate")
    )


def related_statements(statements: DataFrame, moment: str, seconds: int) -> DataFrame:
    """Statements within ``seconds`` of a moment as (time, duration) points."""
    at = F.lit(moment).cast("timestamp_ntz")
    span = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return statements.filter(F.col("ts").between(at - span, at + span)).select("id", "sql_text", "ts", "query_time")


def related_transactions(locks: DataFrame) -> DataFrame:
    """Who blocks whom, once per pair, with the start of the wait.

    ``blocker_waits`` tells that the blocker is itself blocked. Waits are
    reduced to distinct pairs first, and the blocker is looked up in the set of
    waiting transactions, so nothing multiplies.
    """
    edges = locks.groupBy("granted_trx", "waiting_trx").agg(
        F.count("*").alias("wait_count"), F.min("wait_started").alias("first_wait"), F.max("wait_started").alias("last_wait")
    )
    waiting = locks.select(F.col("waiting_trx").alias("granted_trx")).distinct().withColumn("_waits", F.lit(True))
    return edges.join(waiting, "granted_trx", "left").withColumn("blocker_waits", F.coalesce("_waits", F.lit(False))).drop("_waits")
