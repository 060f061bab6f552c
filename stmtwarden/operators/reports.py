"""Workload reports over workflow, task, report and rule tables (W).

Every report is a partial-aggregated ``groupBy`` or a filter, so it shuffles
one row per group and map task at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status vocabulary of workflows.
WORKFLOW_STATUSES = (
    "wait_for_audit",
    "wait_for_execution",
    "rejected",
    "canceled",
    "executing",
    "exec_failed",
    "finished",
)
CLOSED_STATUSES = ("exec_failed", "finished", "canceled")
UNAPPROVED_STATUSES = ("wait_for_audit", "rejected", "canceled")
RISK_STATUSES = ("rejected", "exec_failed")


def workflow_count_by_status(workflows: DataFrame, *by: str) -> DataFrame:
    """One column per status, zeros kept; overall, or per ``by`` columns."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in WORKFLOW_STATUSES]
    return workflows.groupBy(*by).agg(*counts)


def workflow_daily_counts(workflows: DataFrame, begin: str, end: str) -> DataFrame:
    """Workflows created per calendar day; days without any stay absent."""
    return (
        workflows.filter(F.col("created_at").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("workflow_count"))
    )


def workflow_range_count(workflows: DataFrame, begin: str, end: str) -> DataFrame:
    """Workflows created in a range (both ends in) next to the total."""
    inside = F.col("created_at").between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return workflows.agg(F.count_if(inside).alias("range_count"), F.count("*").alias("total_count"))


def approved_workflows(workflows: DataFrame) -> DataFrame:
    """Workflows past approval; a missing record (null status) is not one."""
    return workflows.filter(~F.col("status").isin(*UNAPPROVED_STATUSES))


def workflow_by_step_type(workflows: DataFrame, steps: DataFrame, step_types: list[str]) -> DataFrame:
    """Workflows whose current step is of the given types."""
    current = steps.filter(F.col("step_type").isin(step_types)).select(F.col("id").alias("current_step_id"), "step_type")
    return workflows.join(current, "current_step_id").groupBy("step_type").agg(F.count("*").alias("workflow_count"))


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two times, cut towards zero."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.when(seconds >= 0, F.floor(seconds / 60)).otherwise(F.ceil(seconds / 60)).cast("bigint")


def audit_wait_minutes(workflows: DataFrame, steps: DataFrame) -> DataFrame:
    """Whole minutes from creation to each given step, summed."""
    joined = steps.select("workflow_id", "operate_at").join(
        workflows.select(F.col("id").alias("workflow_id"), "created_at"), "workflow_id"
    )
    return joined.agg(
        F.sum(whole_minutes(F.col("created_at"), F.col("operate_at"))).alias("wait_minutes"), F.count("*").alias("step_count")
    )


def nth_last_step(steps: DataFrame, offset: int, state: str) -> DataFrame:
    """Step at ``offset`` from the end of each workflow, if in ``state``.

    Ranks at most ``offset + 1`` per workflow leave each map task, so one huge
    workflow does not gather its steps in a single task.
    """
    w = Window.partitionBy("workflow_id").orderBy(F.col("id").desc())
    return (
        steps.withColumn("_rank", F.row_number().over(w))
        .filter((F.col("_rank") == offset + 1) & (F.col("state") == state))
        .drop("_rank")
    )


def unfinished_workflows(workflows: DataFrame, by: str = "project_id") -> DataFrame:
    """Groups that still have an open workflow."""
    return workflows.filter(~F.col("status").isin(*CLOSED_STATUSES)).groupBy(by).agg(F.count("*").alias("open_count"))


def waiting_instances(instances: DataFrame, workflows: DataFrame, statuses: list[str]) -> DataFrame:
    """Instances with a workflow in one of ``statuses`` not yet run on them."""
    wanted = workflows.filter(F.col("status").isin(statuses)).select(F.col("id").alias("workflow_id"))
    return instances.filter(~F.col("is_executed")).join(wanted, "workflow_id", "left_semi").select("instance_id").distinct()


def instance_status_counts(instances: DataFrame, workflows: DataFrame, statuses: list[str]) -> DataFrame:
    """Per instance, its workflows in ``statuses`` (zero kept) and in all.

    A workflow may list an instance twice; it counts once.
    """
    pairs = instances.select("workflow_id", "instance_id").distinct()
    known = workflows.select(F.col("id").alias("workflow_id"), F.col("status").isin(statuses).alias("_hit"))
    return (
        pairs.join(known, "workflow_id", "left")
        .groupBy("instance_id")
        .agg(F.count_if("_hit").alias("matching_count"), F.count("*").alias("workflow_count"))
    )


def exec_time_stats(tasks: DataFrame, top_n: int) -> DataFrame:
    """Per instance the rounded mean, max and min seconds of succeeded tasks."""
    return (
        tasks.filter(F.col("status") == "exec_succeeded")
        .groupBy("instance_id")
        .agg(
            F.round(F.avg("exec_seconds")).cast("bigint").alias("avg_seconds"),
            F.max("exec_seconds").alias("max_seconds"),
            F.min("exec_seconds").alias("min_seconds"),
        )
        .orderBy(F.desc("avg_seconds"), "instance_id")
        .limit(top_n)
    )


def exec_fail_counts(tasks: DataFrame) -> DataFrame:
    """Failed and started tasks per instance, and their ratio in percent."""
    failed = F.count_if((F.col("status") == "exec_failed") & F.col("exec_start_at").isNotNull() & F.col("exec_seconds").isNotNull())
    total = F.count_if(~F.col("status").isin("initialized", "audited"))
    return (
        tasks.groupBy("instance_id")
        .agg(failed.alias("failed_count"), total.alias("total_count"))
        .withColumn("failed_percent", F.round(F.lit(100.0) * F.col("failed_count") / F.nullif(F.col("total_count"), F.lit(0)), 2))
    )


def latest_per(df: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """Newest rows of each key, ties kept.

    The newest time per key is aggregated map-side and joined back, so a key
    that holds most rows is reduced before any shuffle.
    """
    newest = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(newest, [*keys, order], "left_semi")


def audited_sql_counts(statements: DataFrame, reports: DataFrame, report_sql: DataFrame) -> DataFrame:
    """Statements and risky ones, from workflows and the latest reports."""
    own = statements.select(F.lit(1).alias("n"), F.coalesce(F.col("has_result"), F.lit(False)).alias("risky"))
    newest = latest_per(reports, ["scan_plan_id"]).select(F.col("id").alias("report_id"))
    scanned = report_sql.join(newest, "report_id", "left_semi").select(
        F.lit(1).alias("n"), F.col("audit_result").isNotNull().alias("risky")
    )
    return (
        own.unionByName(scanned)
        .agg(F.count("*").alias("total_count"), F.count_if("risky").alias("risk_count"))
        .withColumn("risk_rate", F.round(F.lit(100.0) * F.col("risk_count") / F.nullif(F.col("total_count"), F.lit(0))).cast("bigint"))
    )


def risk_workflows(workflows: DataFrame) -> DataFrame:
    """Rejected or failed workflows, newest first."""
    return workflows.filter(F.col("status").isin(*RISK_STATUSES)).orderBy(F.desc("created_at"), "id")


def risk_scan_reports(reports: DataFrame, report_sql: DataFrame, below: int = 60) -> DataFrame:
    """Reports scored under ``below`` and their statements with results."""
    risky = report_sql.groupBy("report_id").agg(F.count("audit_result").alias("risk_sql_count"))
    low = reports.filter(F.col("score") < below)
    return low.join(risky, low["id"] == risky["report_id"], "left").select(
        low["id"], "scan_plan_id", "score", F.coalesce("risk_sql_count", F.lit(0)).alias("risk_sql_count")
    )


def scan_plans_by_type(plans: DataFrame, plan_types: DataFrame) -> DataFrame:
    """Plan entries per database type and plan type."""
    live = plans.filter(~F.col("is_deleted")).select(F.col("id").alias("plan_id"), "db_type")
    return (
        plan_types.filter(~F.col("is_deleted")).join(live, "plan_id").groupBy("db_type", "plan_type").agg(F.count("*").alias("plan_count"))
    )


def latest_report_score(reports: DataFrame) -> DataFrame:
    """Score of the newest report per database type and instance."""
    return latest_per(reports, ["db_type", "instance_name"]).select("db_type", "instance_name", "created_at", "score")


def instance_health(instances: DataFrame, latest_scores: DataFrame, below: int = 60) -> DataFrame:
    """Per database type and instance whether it is unhealthy.

    ``instances`` has one row per workflow and instance with its status. One
    failed workflow or a low newest score makes an instance unhealthy.
    """
    bad = F.coalesce(F.col("status").isin(*RISK_STATUSES), F.lit(False))
    signals = instances.select("db_type", "instance_name", bad.alias("bad")).unionByName(
        latest_scores.select("db_type", "instance_name", (F.col("score") < below).alias("bad"))
    )
    return signals.groupBy("db_type", "instance_name").agg(F.bool_or("bad").alias("unhealthy"))


def project_score(workflows: DataFrame, reports: DataFrame) -> DataFrame:
    """0.4 of the finish rate and 0.6 of the good-report rate, per project."""
    done = workflows.groupBy("project_id").agg(
        F.count_if(F.col("status") == "finished").alias("_f"),
        F.count_if(F.col("status").isin("finished", "exec_failed", "executing")).alias("_t"),
    )
    good = reports.groupBy("project_id").agg(F.count_if(F.col("score") > 60).alias("_g"), F.count("*").alias("_r"))
    flow = F.col("_f") / F.nullif(F.col("_t"), F.lit(0))
    scan = F.col("_g") / F.nullif(F.col("_r"), F.lit(0))
    both = F.coalesce(F.lit(0.4) * flow + F.lit(0.6) * scan, flow, scan, F.lit(1.0))
    return done.join(good, "project_id", "full").select("project_id", F.round(both * 100).cast("bigint").alias("score"))


def category_counts(categories: DataFrame, rule_tags: DataFrame) -> DataFrame:
    """Rules per category and tag; the tag itself is counted after a left
    join, so a tag without rules shows 1."""
    return (
        categories.join(rule_tags.select("tag", "rule_name", "db_type"), "tag", "left")
        .groupBy("category", "tag")
        .agg(F.count("tag").alias("rule_count"))
    )


def custom_rule_types(custom_rules: DataFrame) -> DataFrame:
    """Custom rules per type, first created type first."""
    return (
        custom_rules.groupBy("rule_type")
        .agg(F.count("*").alias("rule_count"), F.min("created_on").alias("first_created"))
        .orderBy("first_created", "rule_type")
    )


def workflow_count_by_project(workflows: DataFrame) -> DataFrame:
    """Distinct workflows per project."""
    return workflows.groupBy("project_id").agg(F.countDistinct("id").alias("workflow_count"))


def workflow_step_summary(workflows: DataFrame, instances: DataFrame, steps: DataFrame) -> DataFrame:
    """Tasks of each workflow with who acts next.

    A rejected workflow is its creator's, one waiting for execution the
    instance's execution assignee's, any other the current step's.
    """
    now = steps.select(F.col("id").alias("current_step_id"), F.col("assignee").alias("_step_assignee"))
    runs = instances.groupBy("workflow_id", "instance_id").agg(
        F.min("execution_assignee").alias("_exec_assignee"), F.bool_and("is_executed").alias("is_executed")
    )
    who = (
        F.when(F.col("status") == "rejected", F.col("creator"))
        .when(F.col("status") == "wait_for_execution", F.col("_exec_assignee"))
        .otherwise(F.col("_step_assignee"))
    )
    return (
        workflows.join(now, "current_step_id", "left")
        .join(runs, workflows["id"] == runs["workflow_id"], "left")
        .select(workflows["id"], "instance_id", "status", "is_executed", who.alias("current_assignee"))
    )


def percentages(workflows: DataFrame, by: str) -> DataFrame:
    """Share of passed and of rejected workflows within each group, and
    the group's share of all."""
    grouped = workflows.groupBy(by).agg(
        F.count("*").alias("workflow_count"),
        F.count_if(F.col("status") == "rejected").alias("_rejected"),
        F.count_if(~F.col("status").isin(*UNAPPROVED_STATUSES)).alias("_passed"),
    )
    total = workflows.agg(F.count("*")).scalar()
    return grouped.select(
        by,
        "workflow_count",
        F.round(F.lit(100.0) * F.col("_passed") / F.col("workflow_count"), 2).alias("passed_percent"),
        F.round(F.lit(100.0) * F.col("_rejected") / F.col("workflow_count"), 2).alias("rejected_percent"),
        F.round(F.lit(100.0) * F.col("workflow_count") / total, 2).alias("share_percent"),
    )


def unsuccessful_collections(plans: DataFrame, status: str = "abnormal") -> DataFrame:
    """Instances with a live plan whose last collection ended in ``status``."""
    return (
        plans.filter(~F.col("is_deleted") & (F.col("last_collection_status") == status)).select("project_id", "instance_id").distinct()
    )


def changed_since(plans: DataFrame, since: str) -> DataFrame:
    """Plans, deleted ones too, updated after a date, oldest change first."""
    return plans.filter(F.col("updated_on") > F.lit(since).cast("date")).orderBy("updated_on", "id")


def due_workflows(workflows: DataFrame, instances: DataFrame, now: str) -> DataFrame:
    """Waiting for execution, scheduled at or before ``now``, not executed."""
    due = instances.filter(~F.col("is_executed") & (F.col("scheduled_at") <= F.lit(now).cast("timestamp_ntz"))).select("workflow_id")
    waiting = workflows.filter(F.col("status") == "wait_for_execution")
    return waiting.join(due, waiting["id"] == due["workflow_id"], "left_semi")
