"""What may be dropped (R): each is a filter or an anti join on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.operators.reports import CLOSED_STATUSES
from stmtwarden.session import file_system, written


def _before(column: str, moment: str):
    return F.col(column) < F.lit(moment).cast("timestamp_ntz")


def expired_workflows(workflows: DataFrame, before: str) -> DataFrame:
    """Created before a time and closed, or without a record."""
    return workflows.filter(_before("created_at", before) & (F.col("status").isin(*CLOSED_STATUSES) | F.col("status").isNull()))


def expired_tasks(tasks: DataFrame, workflow_tasks: DataFrame, record_tasks: DataFrame, before: str) -> DataFrame:
    """R2: created before a time and used by neither a workflow nor an ad-hoc record."""
    used = workflow_tasks.select(F.col("task_id").alias("id")).unionByName(record_tasks.select(F.col("task_id").alias("id")))
    return tasks.filter(_before("created_at", before)).join(used, "id", "left_anti")


def expired_raw(raw: DataFrame, before: str, time_column: str = "ts") -> DataFrame:
    """Number of raw statements executed before a time, per day.

    The raw log is partitioned by day, so what is removed is whole partitions
    and one cut one.
    """
    return raw.filter(_before(time_column, before)).groupBy(F.to_date(time_column).alias("day")).agg(F.count("*").alias("removed_count"))


def kept_raw(raw: DataFrame, before: str, time_column: str = "ts") -> DataFrame:
    """What stays."""
    return raw.filter(~_before(time_column, before))


def store_by_day(raw: DataFrame, path: str, time_column: str = "ts") -> None:
    """Raw statements appended to a folder per day; those without a time go to a folder of their own and never expire."""
    raw.withColumn("day", F.to_date(time_column)).write.mode("append").partitionBy("day").parquet(path)


def expire_days(spark: SparkSession, path: str, before: str, time_column: str = "ts") -> DataFrame:
    """Rows before a time removed from what :func:`store_by_day` stored; returns removed rows per day.

    Days wholly before the time are counted from file footers and deleted as
    folders. Only the day the time cuts is read and written again, by way of a
    saved copy. Files of later days stay untouched. A run that was cut off can
    be repeated; it returns what was left to remove.
    """
    cut = F.to_date(F.lit(before).cast("timestamp_ntz"))
    table = spark.read.option("basePath", path).parquet(path)
    whole = table.where(F.col("day") < cut).groupBy("day").agg(F.count("*").alias("removed_count"))
    gone = _before(time_column, before)
    edge = table.where((F.col("day") == cut) & gone).groupBy("day").agg(F.count("*").alias("removed_count"))
    removed = written(whole.unionByName(edge), "expired")
    days = [d for (d,) in removed.select("day").collect()]  # one row per expired day
    last = spark.range(1).select(cut).first()[0]
    fs, _ = file_system(spark, path)
    drop = [d for d in days if d != last]
    if last in days:
        stay = written(table.where((F.col("day") == cut) & ~gone), "kept")
        if stay.isEmpty():
            drop.append(last)
        else:
            stay.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in drop:
        fs.delete(file_system(spark, f"{path}/day={day}")[1], True)
    return removed


def expired_files(files: DataFrame, workflow_tasks: DataFrame, now: str) -> DataFrame:
    """Older than 24 hours and in no workflow, or older than 7 days."""
    moment = F.lit(now).cast("timestamp_ntz")
    day_old = files.filter(F.col("created_at") < moment - F.expr("INTERVAL 24 HOURS"))
    held = workflow_tasks.select("task_id").distinct().withColumn("_held", F.lit(True))
    week_old = F.col("created_at") < moment - F.expr("INTERVAL 7 DAYS")
    return day_old.join(held, "task_id", "left").filter(F.col("_held").isNull() | week_old).drop("_held")


def orphan_cleanup(records: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Records with ``deleted_at`` set where their source is gone; an earlier time of deletion stays."""
    live = sources.filter(~F.col("is_deleted")).select(F.col("id").alias("source_id")).distinct().withColumn("_live", F.lit(True))
    gone = F.when(F.col("_live").isNull(), F.lit(now).cast("timestamp_ntz"))
    before = F.col("deleted_at") if "deleted_at" in records.columns else F.lit(None)
    return records.join(live, "source_id", "left").withColumn("deleted_at", F.coalesce(before.cast("timestamp_ntz"), gone)).drop("_live")
