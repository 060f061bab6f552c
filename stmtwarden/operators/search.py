"""List queries over governed statements, plans, workflows and lists.

Filters that are not given are left out of the plan. Pages are taken by
``orderBy().offset().limit()``, which Spark runs as a top-k and never as a
full sort of the table; totals are separate counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics a record list may be ordered by.
ORDERABLE_METRICS = (
    "counter",
    "query_time_total",
    "cpu_time_total",
    "disk_read_total",
    "buffer_read_total",
    "user_io_wait_time_total",
    "last_receive_timestamp",
    "query_time_avg",
    "query_time_max",
    "row_examined_avg",
    "cpu_time_avg",
    "lock_wait_time_total",
    "lock_wait_counter",
    "act_wait_time_total",
    "act_time_total",
    "last_query_at",
    "first_query_at",
    "disk_read_avg",
    "buffer_read_avg",
    "user_io_wait_time_avg",
    "phy_read_page_total",
    "logic_read_page_total",
)


def apply(df: DataFrame, conditions) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def given(value, make) -> Column | None:
    """The condition, or None when its filter is not set."""
    return None if value is None or value == "" else make(value)


def contains_text(column: str):
    """Case-insensitive LIKE '%value%' with the value taken literally."""
    return lambda v: F.contains(F.lower(F.col(column)), F.lit(v.lower()))


def page(df: DataFrame, order, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_count"))


def record_matches(
    records: DataFrame,
    plans: DataFrame,
    plan_types: DataFrame,
    plan_type_id: int | None = None,
    schema_name: str | None = None,
    received_from: str | None = None,
    received_to: str | None = None,
    rule_name: str | None = None,
    db_user: str | None = None,
    schema_meta_name: str | None = None,
    sql: str | None = None,
    counter: int | None = None,
    query_time_avg: float | None = None,
    row_examined_avg: float | None = None,
    priority: str | None = None,
) -> DataFrame:
    """live records of live plans under the given filters, unordered.

    ``records.audit_results`` is an array of structs with ``rule_name``; a
    record that has none yet is being audited.
    """
    c = F.col
    types = plan_types.select(c("plan_id").alias("source_id"), c("plan_type").alias("source"), c("id").alias("plan_type_id"))
    if plan_type_id is not None:
        types = types.filter(c("plan_type_id") == plan_type_id)
    live = plans.filter(~c("is_deleted")).select(c("id").alias("source_id"))
    found = apply(
        records.filter(~c("is_deleted")),
        [
            given(schema_name, lambda v: c("schema_name") == v),
            given(received_from, lambda v: c("last_receive_timestamp") >= F.lit(v).cast("timestamp_ntz")),
            given(received_to, lambda v: c("last_receive_timestamp") <= F.lit(v).cast("timestamp_ntz")),
            given(rule_name, lambda v: F.exists("audit_results", lambda r: r["rule_name"] == v)),
            given(db_user, lambda v: c("db_user") == v),
            given(schema_meta_name, lambda v: c("schema_meta_name") == v),
            given(sql, contains_text("sql_fingerprint")),
            given(counter, lambda v: c("counter") >= v),
            given(query_time_avg, lambda v: c("query_time_avg") >= v),
            given(row_examined_avg, lambda v: c("row_examined_avg") >= v),
            given(priority, lambda v: c("priority") == v),
        ],
    )
    return (
        found.join(types, ["source_id", "source"])
        .join(live, "source_id", "left_semi")
        .withColumn("audit_status", F.when(c("audit_results").isNull(), "being_audited").otherwise(""))
    )


def record_search(found: DataFrame, order_by: str | None = None, ascending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """one page; an unknown order column falls back to the id."""
    if order_by in ORDERABLE_METRICS and order_by in found.columns:
        key = F.col(order_by)
        return page(found, [key.asc() if ascending else key.desc(), "id"], limit, offset)
    return page(found, ["id"], limit, offset)


def plan_search(
    plans: DataFrame,
    plan_types: DataFrame,
    user_id: int | None = None,
    accessible_instances: list[str] | None = None,
    env_instances: list[str] | None = None,
    db_type: str | None = None,
    plan_type: str | None = None,
    instance_id: str | None = None,
    project_id: str | None = None,
    active_status: str | None = None,
) -> DataFrame:
    """live instance plans with the ids and types of their entries.

    Without ``user_id`` the caller sees all plans, else own ones and those on
    accessible instances.
    """
    c = F.col
    mine = None
    if user_id is not None:
        mine = c("create_user_id") == user_id
        if accessible_instances:
            mine = mine | c("instance_id").isin(accessible_instances)
    wanted = apply(
        plans.filter(~c("is_deleted")),
        [
            mine,
            given(env_instances, lambda v: c("instance_id").isin(v)),
            given(db_type, lambda v: c("db_type") == v),
            given(instance_id, lambda v: c("instance_id") == v),
            given(project_id, lambda v: c("project_id") == v),
            given(active_status, lambda v: c("active_status") == v),
        ],
    )
    live = plan_types.filter(~c("is_deleted"))
    # Entries are narrowed to the wanted plans before their lists are built.
    entries = (
        live.join(wanted.select(c("id").alias("plan_id")), "plan_id", "left_semi")
        .groupBy("plan_id")
        .agg(F.sort_array(F.collect_list("id")).alias("plan_type_ids"), F.sort_array(F.collect_list("plan_type")).alias("types"))
    )
    joined = wanted.join(entries, wanted["id"] == entries["plan_id"], "left").drop("plan_id")
    return apply(joined, [given(plan_type, lambda v: F.array_contains("types", v))])


def manage_matches(
    records: DataFrame,
    project_id: str | None = None,
    assignee: str | None = None,
    source: str | None = None,
    audit_level: str | None = None,
    audited_from: str | None = None,
    audited_to: str | None = None,
    status: str | None = None,
    rule_name: str | None = None,
    instance_id: str | None = None,
    priority: str | None = None,
    endpoint: str | None = None,
    schema_name: str | None = None,
    sql: str | None = None,
) -> DataFrame:
    """F8: governed statements under the given filters."""
    c = F.col
    return apply(
        records.filter(~c("is_deleted")),
        [
            given(project_id, lambda v: c("project_id") == v),
            given(assignee, lambda v: c("assignee") == v),
            given(source, lambda v: c("source") == v),
            given(audit_level, lambda v: c("audit_level") == v),
            given(audited_from, lambda v: c("last_audit_time") >= F.lit(v).cast("timestamp_ntz")),
            given(audited_to, lambda v: c("last_audit_time") <= F.lit(v).cast("timestamp_ntz")),
            given(status, lambda v: c("status") == v),
            given(rule_name, lambda v: F.exists("audit_results", lambda r: r["rule_name"] == v)),
            given(instance_id, lambda v: c("instance_id") == v),
            given(priority, lambda v: c("priority") == v),
            given(endpoint, contains_text("endpoint")),
            given(schema_name, lambda v: c("schema_name") == v),
            given(sql, contains_text("sql_fingerprint")),
        ],
    )


MANAGE_ORDERS = {"first_appear_time": "first_appeared_at", "last_appear_time": "last_receive_timestamp", "counter": "counter"}


def manage_search(found: DataFrame, order_by: str = "last_appear_time", ascending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """F8: one page, by first seen, last seen or count."""
    key = F.col(MANAGE_ORDERS[order_by])
    return page(found, [key.asc() if ascending else key.desc(), "id"], limit, offset)


def workflow_matches(
    workflows: DataFrame,
    instances: DataFrame,
    steps: DataFrame,
    project_id: str | None = None,
    subject: str | None = None,
    status: list[str] | None = None,
    creator: str | None = None,
    assignee: str | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
    instance_id: int | None = None,
) -> DataFrame:
    """workflows with the distinct instances and versions they touch.

    Who acts next is the creator when rejected, else the newest step's
    assignee, else the workflow's own.
    """
    c = F.col
    wanted = apply(
        workflows,
        [
            given(project_id, lambda v: c("project_id") == v),
            given(subject, contains_text("subject")),
            given(status, lambda v: c("status").isin(v)),
            given(creator, lambda v: c("creator") == v),
            given(created_from, lambda v: c("created_at") >= F.lit(v).cast("timestamp_ntz")),
            given(created_to, lambda v: c("created_at") <= F.lit(v).cast("timestamp_ntz")),
        ],
    )
    ids = wanted.select(c("id").alias("workflow_id"))
    touched = (
        instances.join(ids, "workflow_id", "left_semi")
        .groupBy("workflow_id")
        .agg(F.sort_array(F.collect_set("instance_id")).alias("instance_ids"), F.sort_array(F.collect_set("version")).alias("versions"))
    )
    acting = steps.join(ids, "workflow_id", "left_semi").groupBy("workflow_id").agg(F.max_by("assignee", "id").alias("_step_assignee"))
    joined = (
        wanted.join(touched, wanted["id"] == touched["workflow_id"], "left")
        .drop("workflow_id")
        .join(acting, wanted["id"] == acting["workflow_id"], "left")
        .drop("workflow_id")
        .withColumn("current_assignee", F.when(c("status") == "rejected", c("creator")).otherwise(F.coalesce("_step_assignee", "assignee")))
        .drop("_step_assignee")
    )
    return apply(
        joined,
        [given(assignee, lambda v: c("current_assignee") == v), given(instance_id, lambda v: F.array_contains("instance_ids", F.lit(v).cast("bigint")))],
    )


def task_sql_search(
    statements: DataFrame,
    task_id: int | None = None,
    exec_status: str | None = None,
    audit_level: str | None = None,
    source_file: str | None = None,
    no_duplicate: bool = False,
) -> DataFrame:
    """statements of a task; ``no_duplicate`` keeps the first of each audit
    fingerprint within a task, and every one without a fingerprint."""
    c = F.col
    found = apply(
        statements,
        [
            given(task_id, lambda v: c("task_id") == v),
            given(exec_status, lambda v: c("exec_status") == v),
            given(audit_level, lambda v: c("audit_level") == v),
            given(source_file, lambda v: c("source_file") == v),
        ],
    )
    if not no_duplicate:
        return found
    group = F.when(c("audit_fingerprint").isNull(), c("id"))
    others = [n for n in found.columns if n not in ("task_id", "audit_fingerprint")]
    return (
        found.groupBy("task_id", "audit_fingerprint", group.alias("_own"))
        .agg(F.min_by(F.struct(*others), "id").alias("_row"))
        .select("task_id", "audit_fingerprint", "_row.*")
    )


def audit_record_search(
    records: DataFrame,
    tasks: DataFrame,
    project_id: str | None = None,
    tag: str | None = None,
    status: str | None = None,
    status_not: str | None = None,
    instance_ids: list[int] | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """ad-hoc audit records with their task, newest first."""
    c = F.col
    wanted = apply(
        records,
        [
            given(project_id, lambda v: c("project_id") == v),
            given(tag, contains_text("tags")),
            given(created_from, lambda v: c("created_at") >= F.lit(v).cast("timestamp_ntz")),
            given(created_to, lambda v: c("created_at") <= F.lit(v).cast("timestamp_ntz")),
        ],
    )
    task = tasks.select(c("id").alias("task_id"), "status", "instance_id")
    return apply(
        wanted.join(task, "task_id", "left"),
        [
            given(status, lambda v: c("status") == v),
            given(status_not, lambda v: c("status") != v),
            given(instance_ids, lambda v: c("instance_id").isin(v)),
        ],
    ).orderBy(F.desc("created_at"), F.desc("id"))


def report_search(reports: DataFrame, scan_plan_id: int) -> DataFrame:
    """reports of one plan, newest first."""
    return reports.filter(F.col("scan_plan_id") == scan_plan_id).orderBy(F.desc("created_at"), F.desc("id"))


def report_sql_search(reports: DataFrame, report_sql: DataFrame, scan_plan_id: int) -> DataFrame:
    """statements of one plan's reports."""
    mine = reports.filter(F.col("scan_plan_id") == scan_plan_id).select(F.col("id").alias("report_id"))
    return report_sql.join(mine, "report_id", "left_semi").orderBy("report_id", "id")


def scan_plan_search(plans: DataFrame, name: str | None = None, db_type: str | None = None, instance_id: str | None = None) -> DataFrame:
    """live scan plans by name, type or instance."""
    c = F.col
    return apply(
        plans.filter(~c("is_deleted")),
        [
            given(name, contains_text("name")),
            given(db_type, lambda v: c("db_type") == v),
            given(instance_id, lambda v: c("instance_id") == v),
        ],
    ).orderBy("id")


def rules_with_all_tags(rules: DataFrame, rule_tags: DataFrame, tags: list[str]) -> DataFrame:
    """rules that carry every one of ``tags``."""
    wanted = sorted(set(tags))
    carrying = (
        rule_tags.filter(F.col("tag").isin(wanted))
        .groupBy("rule_name", "db_type")
        .agg(F.countDistinct("tag").alias("_n"))
        .filter(F.col("_n") == len(wanted))
    )
    return rules.join(carrying, ["rule_name", "db_type"], "left_semi")


def lock_search(locks: DataFrame, lock_type: str | None = None, object_name: str | None = None, database_name: str | None = None) -> DataFrame:
    """lock waits by type, object and database."""
    c = F.col
    return apply(
        locks,
        [
            given(lock_type, lambda v: c("lock_type") == v),
            given(object_name, lambda v: c("object_name") == v),
            given(database_name, lambda v: c("database_name") == v),
        ],
    )


def visible_pipelines(pipelines: DataFrame, nodes: DataFrame, user: str, instance_ids: list[int]) -> DataFrame:
    """F16: own pipelines, those with a node on a given instance, and those
    without any node bound to an instance. Each shows once."""
    c = F.col
    state = nodes.groupBy("pipeline_id").agg(
        F.bool_or(c("instance_id").isin(instance_ids)).alias("_reachable"), F.bool_or(c("instance_id") != 0).alias("_bound")
    )
    seen = (c("creator") == user) | F.coalesce("_reachable", F.lit(False)) | ~F.coalesce("_bound", F.lit(False))
    return pipelines.join(state, pipelines["id"] == state["pipeline_id"], "left").filter(seen).drop("pipeline_id", "_reachable", "_bound")


def list_search(entries: DataFrame, kind_column: str, text_column: str, kind: str | None = None, text: str | None = None) -> DataFrame:
    """block-list or allow-list entries by type and text, newest first."""
    c = F.col
    return apply(
        entries, [given(kind, lambda v: c(kind_column) == v), given(text, contains_text(text_column))]
    ).orderBy(F.desc("id"))


def rule_tips(records: DataFrame, rules: DataFrame) -> DataFrame:
    """rules that some live record's results name, once each.

    The rule names of all results are made distinct map-side, so what is
    joined is at most the catalogue.
    """
    named = records.filter(~F.col("is_deleted")).select("db_type", F.explode("audit_results.rule_name").alias("rule_name")).distinct()
    return rules.join(named, ["db_type", "rule_name"], "left_semi").select("db_type", "rule_name").distinct()
