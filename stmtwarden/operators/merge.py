"""Grouping and merging of collected statements (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions.text import code_text


def fingerprint_rollup(queue: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A1: per sql_id the counters summed, text and time of the newest arrival.

    Counters and newest rows are combined map-side, so a statement that makes
    up a third of the log leaves each task as one row. Rolling up rollups gives
    the rollup of the whole, which is what streaming relies on.
    """
    counter = F.sum("counter") if "counter" in queue.columns else F.count("*")
    # One comparison per row finds the newest arrival with all that is kept of it.
    kept = ("sql_text", *carry, "ts", "id")
    newest = F.max_by(F.struct(*kept), F.struct("ts", "id")).alias("_newest")
    return queue.groupBy("sql_id").agg(counter.alias("counter"), newest).select("sql_id", "counter", "_newest.*")


def last_snapshot_wins(snapshots: DataFrame, values: list[str]) -> DataFrame:
    """A2: per sql_id all totals as in the newest snapshot (they are cumulative)."""
    picked = F.max_by(F.struct(*values), F.struct("ts", "id")).alias("_last")
    return snapshots.groupBy("sql_id").agg(picked, F.max("ts").alias("ts")).select("sql_id", "_last.*", "ts")


def average_parts(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A3: mergeable state of an average and a maximum."""
    return observations.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))


def incremental_avg_max(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A3: two states of disjoint observations merged: exact average, maximum."""
    merged = old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
    return merged.select(*keys, "n", (F.col("total") / F.col("n")).alias("average"), F.col("top").alias("maximum"))


def schema_snapshot_merge(stored: DataFrame, seen: DataFrame, key: str = "meta_id") -> DataFrame:
    """A4: what changes in the stored objects after a new snapshot.

    Live objects not seen become deleted, seen ones live with the new DDL;
    objects already deleted show up only when seen again.
    """
    live = stored.filter(~F.col("deleted")).select(key, F.col("sql_text").alias("_old"))
    now = seen.select(key, F.col("sql_text").alias("_new"), F.lit(True).alias("_seen"))
    return live.join(now, key, "full").select(
        key, F.coalesce("_new", "_old").alias("sql_text"), F.col("_seen").isNull().alias("deleted")
    )


def record_upsert(stored: DataFrame, incoming: DataFrame, key: str = "sql_id", newest_by: str | None = None) -> DataFrame:
    """A5: stored records with incoming ones put in, replacing equal keys.

    The result has one row per incoming key: of several, the one with the
    greatest ``newest_by``, or any one if no column is named.
    """
    if newest_by is None:
        once = incoming.dropDuplicates([key])
    else:
        once = incoming.groupBy(key).agg(F.max_by(F.struct(*incoming.columns), newest_by).alias("_n")).select("_n.*")
    return stored.join(once.select(key), key, "left_anti").unionByName(once)


def process_insert_if_absent(states: DataFrame, records: DataFrame) -> DataFrame:
    """States plus a first one for each record that has none."""
    fresh = records.join(states.select(F.col("record_id").alias("id")), "id", "left_anti").select(
        F.col("id").alias("record_id"), F.lit("unhandled").alias("status")
    )
    return states.unionByName(fresh)


def scrape_high_water(records: DataFrame, field: str = "start_time_of_last_scraped_sql") -> DataFrame:
    """Newest scraped start time per source, as time and as text."""
    text = F.get_json_object("info", f"$.{field}")
    return records.groupBy("source_id", "source").agg(
        F.max(text.try_cast("timestamp_ntz")).alias("last_start_time"), F.max(text).alias("last_start_text")
    )


def records_to_audit(records: DataFrame, plans: DataFrame, batch: int | None = None) -> DataFrame:
    """Records of existing plans changed since their audit or never audited.

    The reference's batch size is a trigger setting here: None takes all.
    """
    stale = records.filter(F.col("last_audit_time").isNull() | (F.col("updated_at") > F.col("last_audit_time")))
    live = plans.filter(~F.col("is_deleted")).select(F.col("id").alias("source_id"))
    due = stale.filter(~F.col("is_deleted")).join(live, "source_id", "left_semi")
    return due.orderBy("id").limit(batch) if batch else due


def distinct_values(records: DataFrame, column: str, source_id: int | None = None) -> DataFrame:
    """A10: distinct values of a column, nulls left out."""
    rows = records if source_id is None else records.filter(F.col("source_id") == source_id)
    return rows.filter(F.col(column).isNotNull()).select(column).distinct()


ALTERED_TABLE = r"(?i)^ALTER\s+TABLE\s+((?:`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*)(?:\.(?:`[^`]*`|[A-Za-z_$][A-Za-z0-9_$]*))?)"


def merge_candidates(statements: DataFrame) -> DataFrame:
    """ALTER statements after the first on the same table in a task.

    The first id per table is aggregated map-side and joined back, so no task
    has to sort all ALTERs of a table.
    """
    table = F.lower(F.regexp_replace(F.regexp_extract(code_text(F.col("sql_text")), ALTERED_TABLE, 1), "`", ""))
    alters = statements.select("id", "task_id", table.alias("table_name")).filter("table_name <> ''")
    first = alters.groupBy("task_id", "table_name").agg(F.min("id").alias("first_id"), F.count("*").alias("alter_count"))
    return alters.join(first.filter("alter_count > 1"), ["task_id", "table_name"]).filter(F.col("id") > F.col("first_id"))


def plans_with_records(plans: DataFrame, records: DataFrame) -> DataFrame:
    """Plans that have at least one live record."""
    held = records.filter(~F.col("is_deleted")).select(F.col("source_id").alias("id"))
    return plans.join(held, "id", "left_semi")


def type_enabled(plans: DataFrame, plan_types: DataFrame, plan_type: str) -> DataFrame:
    """Instances on which a plan type is enabled."""
    live = plan_types.filter(~F.col("is_deleted") & (F.col("plan_type") == plan_type)).select(F.col("plan_id").alias("id"))
    active = plans.filter(~F.col("is_deleted") & (F.col("active_status") == "normal"))
    return active.join(live, "id", "left_semi").select("instance_id").distinct()


