"""Pulled sources: log windows, sessions, statement statistics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: look-back of a first run in hours.
FIRST_HOURS = 24

# Schemas whose sessions are the server's own.
SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "mysql", "sys")

# Metrics a top-statement pull ranks by.
TOP_METRICS = ("elapsed_time", "cpu_time", "disk_reads", "buffer_gets")


def pull_start(now: datetime, last_end: datetime | None, first_hours: int = FIRST_HOURS) -> datetime:
    """Where a pull begins: at the last end, or some hours back on a first run."""
    if last_end is not None:
        return last_end
    return now - timedelta(hours=first_hours or FIRST_HOURS)


def log_window(
    log: DataFrame,
    now: datetime,
    last_end: datetime | None = None,
    first_hours: int = FIRST_HOURS,
    mapping: dict[str, str] | None = None,
    refilter: bool = True,
    time_column: str = "ts",
) -> DataFrame:
    """Entries of a slow or full log from the last end to now.

    ``mapping`` renames a vendor's fields. With ``refilter`` an entry at the
    very start, already taken by the last pull, is dropped. The bounds are
    literals, so they reach the scan as pushed filters.
    """
    if mapping:
        log = log.select(*[F.col(theirs).alias(ours) for ours, theirs in mapping.items()])
    lo, hi = F.lit(pull_start(now, last_end, first_hours)).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")
    t = F.col(time_column)
    return log.filter((t > lo if refilter else t >= lo) & (t < hi))


def processlist_filter(sessions: DataFrame, min_seconds: int = 0, own_id: int | None = None) -> DataFrame:
    """Sessions worth keeping."""
    kept = sessions.filter((F.col("sql_text") != "") & ~F.coalesce("schema_name", F.lit("")).isin(*SYSTEM_SCHEMAS))
    if min_seconds > 0:
        kept = kept.filter(F.col("seconds_in_call") >= min_seconds)
    return kept if own_id is None else kept.filter(F.col("sid") != own_id)


def schema_snapshot(columns: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """One row per table, and per view if given, with its DDL.

    ``columns``: table_name, ordinal, column_name, data_type, column_width,
    is_nullable. The number of columns of a table is bounded by the database.
    """
    line = F.concat_ws(
        " ",
        F.concat(F.lit("`"), F.col("column_name"), F.lit("`")),
        F.concat(F.col("data_type"), F.lit("("), F.col("column_width"), F.lit(")")),
        F.when(~F.col("is_nullable"), "NOT NULL"),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda s: s["line"]), ", ")
    tables = columns.groupBy("table_name").agg(lines.alias("_lines")).select(
        F.col("table_name").alias("meta_name"),
        F.lit("table").alias("meta_type"),
        F.concat(F.lit("CREATE TABLE `"), F.col("table_name"), F.lit("` ("), F.col("_lines"), F.lit(")")).alias("sql_text"),
    )
    if views is None:
        return tables
    return tables.unionByName(
        views.select(
            F.col("view_name").alias("meta_name"),
            F.lit("view").alias("meta_type"),
            F.concat(F.lit("CREATE VIEW `"), F.col("view_name"), F.lit("` AS "), F.col("definition")).alias("sql_text"),
        )
    )


def read_catalog(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A catalogue table of a live server over JDBC."""
    return spark.read.jdbc(url, table, properties=properties or {})


def _active(stats: DataFrame, users: DataFrame, now: str, minutes: int, excluded_users: list[str]) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    known = users.filter(~F.col("username").isin(excluded_users)) if excluded_users else users
    recent = stats.filter((F.col("last_active_time") >= since) & (F.col("executions") > 0))
    return recent.join(known.select("user_id", "username"), "user_id")


def top_sql_by_metric(
    stats: DataFrame,
    users: DataFrame,
    now: str,
    minutes: int,
    excluded_users: list[str] | None = None,
    top_n: int = 10,
    metrics: tuple[str, ...] = TOP_METRICS,
) -> DataFrame:
    """The first statements by each metric, duplicates between metrics kept.

    Each metric is its own top-k, which keeps ``top_n`` rows per task.
    """
    active = _active(stats, users, now, minutes, excluded_users or [])
    parts = [active.orderBy(F.desc(m), "sql_id").limit(top_n).withColumn("metric", F.lit(m)) for m in metrics]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def slow_sql_by_avg(
    stats: DataFrame, users: DataFrame, now: str, minutes: int, threshold: float, excluded_users: list[str] | None = None, top_n: int = 100
) -> DataFrame:
    """Statements whose elapsed time per execution is over a threshold."""
    active = _active(stats, users, now, minutes, excluded_users or [])
    return (
        active.withColumn("elapsed_avg", F.col("elapsed_time") / F.col("executions"))
        .filter(F.col("elapsed_avg") > threshold)
        .orderBy(F.desc("elapsed_avg"), "sql_id")
        .limit(top_n)
    )


def active_sessions(sessions: DataFrame, statements: DataFrame, own_id: int | None = None, min_seconds: int = 0) -> DataFrame:
    """Active user sessions with the text they run, if it is still known."""
    c = F.col
    live = sessions.filter(
        (c("session_type") == "USER") & (c("status") == "ACTIVE") & c("sql_id").isNotNull() & c("username").isNotNull()
    )
    if own_id is not None:
        live = live.filter(c("sid") != own_id)
    if min_seconds > 0:
        live = live.filter(c("seconds_in_call") >= min_seconds)
    texts = statements.select("sql_id", "child_number", c("sql_text").alias("full_text"))
    return live.join(texts, ["sql_id", "child_number"], "left")


def log_user_schema_filter(
    log: DataFrame,
    include_users: list[str] | None = None,
    exclude_users: list[str] | None = None,
    include_schemas: list[str] | None = None,
    exclude_schemas: list[str] | None = None,
) -> DataFrame:
    """Include and exclude lists; an empty include list means all."""
    for column, include, exclude in (("db_user", include_users, exclude_users), ("schema_name", include_schemas, exclude_schemas)):
        if include:
            log = log.filter(F.col(column).isin(include))
        if exclude:
            log = log.filter(~F.col(column).isin(exclude))
    return log
