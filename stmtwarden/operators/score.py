"""From rule violations to statement levels and task scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtwarden.operators.lists import level_name, level_rank

UNSUPPORTED_MESSAGE = "statement cannot be parsed or is not supported"


def violation_rollup(statements: DataFrame, violations: DataFrame, key: str = "id") -> DataFrame:
    """Per statement its results and its highest level.

    ``violations``: key, rule_name, level, message, execution_failed. A
    statement has at most one result per rule, which bounds the list.
    """
    rolled = violations.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rule_name", "level", "message", "execution_failed"))).alias("audit_results"),
        F.max(level_rank(F.col("level"))).alias("level_rank"),
    )
    return statements.join(rolled, key, "left").withColumn(
        "audit_level", level_name(F.coalesce("level_rank", F.lit(0)))
    ).drop("level_rank")


def _rate(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*")


def task_pass_rate(tasks: DataFrame, statements: DataFrame, digits: int = 4) -> DataFrame:
    """Share of statements at level normal or below, and the task's level.

    A task without statements has rate 0 and no level.
    """
    rank = level_rank(F.col("audit_level"))
    rated = statements.groupBy("task_id").agg(F.round(_rate(rank <= 0), digits).alias("pass_rate"), F.max(rank).alias("_rank"))
    ids = tasks.select(F.col("id").alias("task_id"))
    return ids.join(rated, "task_id", "left").select(
        "task_id", F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"), level_name(F.coalesce("_rank", F.lit(-1))).alias("audit_level")
    )


# Weights of the score. Each line is (rate, weight of one minus
# the rate, bonus when the rate is 0, bonus when it is under 0.1).
PASS_WEIGHT = 30
SCORE_WEIGHTS = (("e", 15, 15, 5), ("w", 10, 10, 3), ("n", 5, 5, 2))


def score_of(rates: dict[str, Column], pass_rate: Column) -> Column:
    total = pass_rate * PASS_WEIGHT
    for name, weight, _, _ in SCORE_WEIGHTS:
        total = total + (F.lit(1.0) - rates[name]) * weight
    for name, _, bonus, _ in SCORE_WEIGHTS:
        total = total + F.when(rates[name] == 0, bonus).otherwise(0)
    for name, _, _, bonus in SCORE_WEIGHTS:
        total = total + F.when(rates[name] < 0.1, bonus).otherwise(0)
    return F.floor(total).cast("int")


def task_score(statements: DataFrame) -> DataFrame:
    """Score per task from cumulative rates: warn counts errors too, notice
    counts warnings and errors."""
    rank = level_rank(F.col("audit_level"))
    rates = statements.groupBy("task_id").agg(
        F.round(_rate(rank <= 0), 4).alias("pass_rate"),
        _rate(rank >= 3).alias("e"),
        _rate(rank >= 2).alias("w"),
        _rate(rank >= 1).alias("n"),
    )
    score = score_of({k: F.col(k) for k in ("e", "w", "n")}, F.col("pass_rate"))
    return rates.select("task_id", "pass_rate", score.alias("score"))


def unsupported_fallback(statements: DataFrame, supported: Column) -> DataFrame:
    """A statement no rule can be asked about gets one warning."""
    return statements.filter(~supported).select(
        "id",
        F.lit("").alias("rule_name"),
        F.lit("warn").alias("level"),
        F.lit(UNSUPPORTED_MESSAGE).alias("message"),
        F.lit(False).alias("execution_failed"),
    )


def rule_gate(rules: DataFrame, template_rules: DataFrame, template: str, offline: bool, executed: bool) -> DataFrame:
    """Rules of a template that apply, with the template's level and params.

    Offline audits skip rules that need a live database; statements already
    executed skip rules that only make sense before.
    """
    ours = template_rules.filter(F.col("template") == template).select(
        "rule_name", "db_type", F.col("level").alias("_level"), F.col("params").alias("_params")
    )
    kept = rules
    if offline:
        kept = kept.filter("allow_offline")
    if executed:
        kept = kept.filter("NOT only_before_execution")
    return kept.join(ours, ["rule_name", "db_type"]).select(
        "rule_name", "db_type", F.coalesce("_level", "level").alias("level"), F.coalesce("_params", "params").alias("params")
    )


# Execution states of a statement.
EXEC_STATES = ("failed", "succeeded", "initialized", "doing", "manually_executed", "terminate_succeeded", "terminate_failed")


def _exec_counts() -> list[Column]:
    return [F.count_if(F.col("exec_status") == s).alias(f"{s}_count") for s in EXEC_STATES]


def file_statistics(files: DataFrame, statements: DataFrame) -> DataFrame:
    """Per file the execution states and result levels of its statements.

    A level counts a statement that has it in some result and has some result
    that did not fail; a warning counts any warning or any failed result, so
    one statement may count under several levels.
    """
    results = F.coalesce("audit_results", F.array().cast("array<struct<level:string,execution_failed:boolean>>"))
    has = lambda level: F.exists(results, lambda r: r["level"] == level)
    failed = F.exists(results, lambda r: r["execution_failed"])
    worked = F.exists(results, lambda r: ~r["execution_failed"])
    levels = [F.count_if(has(lv) & worked).alias(f"{lv}_count") for lv in ("error", "notice", "normal")]
    per_file = (
        statements.filter(F.col("exec_status").isNotNull())
        .groupBy("task_id", F.col("source_file").alias("file_name"))
        .agg(*_exec_counts(), *levels, F.count_if(has("warn") | failed).alias("warning_count"))
    )
    return files.select("id", "task_id", "file_name", "exec_order").join(per_file, ["task_id", "file_name"])


def file_exec_overview(files: DataFrame, statements: DataFrame) -> DataFrame:
    """Per file its execution states and the status they add up to."""
    c = lambda s: F.col(f"{s}_count")
    status = (
        F.when(c("failed") > 0, "failed")
        .when(c("manually_executed") > 0, "manually_executed")
        .when(c("terminate_failed") > 0, "terminate_failed")
        .when(c("terminate_succeeded") > 0, "terminate_succeeded")
        .when((c("initialized") > 0) & (c("doing") == 0) & (c("succeeded") == 0), "initialized")
        .when((c("initialized") > 0) | (c("doing") > 0), "doing")
        .when(c("succeeded") > 0, "succeeded")
        .otherwise("initialized")
    )
    counts = (
        statements.filter(F.col("exec_status").isNotNull())
        .groupBy("task_id", F.col("source_file").alias("file_name"))
        .agg(*_exec_counts())
        .withColumn("file_status", status)
    )
    return files.select("id", "task_id", "file_name", "exec_order").join(counts, ["task_id", "file_name"])
