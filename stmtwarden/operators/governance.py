"""From a statement log to governed, audited records: the operators in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.functions import keys
from stmtwarden.functions.text import fingerprint
from stmtwarden.lint.text_rules import audited, is_supported
from stmtwarden.operators import lists, merge, score


def queue_rows(log: DataFrame, source: str, plan_id: str) -> DataFrame:
    """Log rows with fingerprint and statement id, as queue rows."""
    c = F.col
    with_fp = log.withColumn("sql_fingerprint", fingerprint(c("sql_text")))
    return with_fp.withColumn(
        "sql_id", keys.sql_id(c("project_id"), c("sql_fingerprint"), c("schema_name"), c("instance_id"), F.lit(source), F.lit(plan_id))
    ).withColumn("source", F.lit(source))


def collect_records(log: DataFrame, blocklist: DataFrame, source: str, plan_id: str) -> DataFrame:
    """One record per statement that no entry blocks."""
    queue = queue_rows(log, source, plan_id).withColumn("endpoints", F.array("endpoint"))
    open_rows = lists.blocklist_survivors(lists.blocklist_match(queue, blocklist))
    return merge.fingerprint_rollup(open_rows, carry=("sql_fingerprint", "project_id", "schema_name", "instance_id"))


def audit_records(records: DataFrame, allowlist: DataFrame | None = None, settings=None, found: Sequence[DataFrame] = (), key: str = "sql_id") -> DataFrame:
    """F4, L1, L6, L9, F5 on records: results, level and priority.

    All text rules read the record itself, so their results come together in
    the row. ``found`` brings what the other lint jobs say of the same records
    (L2-L5 and index advice, as key, rule_name, level, message); a record has
    at most one result per rule of a job, which bounds its list.
    """
    c = F.col
    rows = records if allowlist is None else lists.allowlist_match(records, allowlist)
    if allowlist is None:
        rows = rows.withColumn("allowed_by", F.lit(None).cast("bigint"))
    checked = audited(rows, settings)
    entry = lambda level, message: F.array(
        F.struct(F.lit("").alias("rule_name"), F.lit(level).alias("level"), F.lit(message).alias("message"))
    )
    said = c("violations")
    if found:
        every = reduce(DataFrame.unionByName, [f.select(key, "rule_name", "level", "message") for f in found])
        more = every.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("rule_name", "level", "message"))).alias("_more"))
        checked = checked.join(more, key, "left")
        said = F.when(c("_more").isNull(), said).otherwise(F.concat(said, "_more"))
    results = (
        F.when(c("allowed_by").isNotNull(), entry("normal", "excluded by the allow list"))
        .when(~is_supported(), entry("warn", score.UNSUPPORTED_MESSAGE))
        .otherwise(said)
    )
    with_results = checked.select(*rows.columns, results.alias("audit_results"))
    top = F.coalesce(F.array_max(F.transform("audit_results", lambda r: lists.level_rank(r["level"]))), F.lit(0))
    leveled = with_results.withColumn("audit_level", lists.level_name(top))
    return lists.high_priority(leveled)


def audit_task(statements: DataFrame, found: Sequence[DataFrame] = (), settings=None) -> tuple[DataFrame, DataFrame]:
    """L1-L9 for submitted statements (id, task_id, sql_text): each with its results, and per task pass rate and score."""
    rows = statements if "counter" in statements.columns else statements.withColumn("counter", F.lit(1).cast("bigint"))
    done = audit_records(rows, settings=settings, found=found, key="id")
    rates = score.task_pass_rate(done.select(F.col("task_id").alias("id")).distinct(), done)
    return done, rates.join(score.task_score(done.select("task_id", "audit_level")).select("task_id", "score"), "task_id", "left")


def top_statements(audited_records: DataFrame, top_n: int) -> DataFrame:
    """L8 and a top-k: the most frequent records with the score of their project.

    Both sides read the stored records; the scores are one row per project.
    """
    scores = score.task_score(audited_records.select(F.col("project_id").alias("task_id"), "audit_level")).select(
        F.col("task_id").alias("project_id"), F.col("score").alias("project_score")
    )
    top = audited_records.orderBy(F.desc("counter"), "sql_id").limit(top_n)
    return top.join(scores, "project_id", "left")
