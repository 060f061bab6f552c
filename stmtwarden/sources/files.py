"""File sources and sinks: scripts, mappers, lock waits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_MARK, _END = "\x01", "\x02"
LINE_END = r";[ \t\r]*(?:\n|$)"


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of all files under a folder; one row per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(
        F.input_file_name().alias("path"), F.col("value").alias("content")
    )


def sql_file_scan(files: DataFrame) -> DataFrame:
    """Statements of script files, in order, with their first line.

    A statement ends at a ``;`` that ends a line. Lines are numbered before
    the text is cut, so each piece carries its own position and nothing is
    shuffled.
    """
    lines = F.split("content", "\n")
    numbered = F.array_join(
        F.transform(lines, lambda line, i: F.concat(F.lit(_MARK), (i + 1).cast("string"), F.lit(_END), line)), "\n"
    )
    pieces = files.select("path", F.posexplode(F.split(numbered, LINE_END)).alias("_pos", "_piece"))
    start = F.regexp_extract("_piece", f"{_MARK}([0-9]+){_END}[ \\t\\r]*[^\\s{_MARK}]", 1)
    text = F.regexp_replace(F.regexp_replace("_piece", f"{_MARK}[0-9]+{_END}", ""), r"^\s+|[\s;]+$", "")
    return pieces.select("path", F.col("_pos"), text.alias("sql_text"), start.try_cast("bigint").alias("start_line")).filter(
        "sql_text <> ''"
    ).withColumnRenamed("_pos", "position")


# Statement tags of a mapper file.
MAPPER_TAGS = ("select", "insert", "update", "delete")


def _mapper_text(body: Column) -> Column:
    text = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", " ")
    text = F.regexp_replace(text, r"(?i)<where\b[^>]*>", " WHERE ")
    text = F.regexp_replace(text, r"(?i)<set\b[^>]*>", " SET ")
    text = F.regexp_replace(text, r"</?[A-Za-z][^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[#$]\{[^}]*\}", "?")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def mapper_xml_scan(files: DataFrame) -> DataFrame:
    """Statements of mapper XML files by tag, dynamic tags flattened."""
    found = [_tagged(tag) for tag in MAPPER_TAGS]
    return files.select("path", F.explode(F.concat(*found)).alias("_s")).select(
        "path", F.col("_s.tag").alias("tag"), _mapper_text(F.col("_s.body")).alias("sql_text")
    )


def _tagged(tag: str) -> Column:
    bodies = F.regexp_extract_all("content", F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(bodies, lambda body: F.struct(F.lit(tag).alias("tag"), body.alias("body")))


def write_lock_waits(locks: DataFrame, path: str, key: str = "scan_plan_id") -> None:
    """Replace the stored lock waits of each plan in ``locks``.

    One partition per plan; only the partitions written are overwritten. The
    rebalance splits a plan that holds most rows over several files.
    """
    (
        locks.hint("rebalance", key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def lock_wait_load(bags: DataFrame) -> DataFrame:
    """Lock-wait rows out of metric bags (``info`` is a JSON object)."""
    schema = (
        "granted_lock_id string, waiting_lock_id string, granted_trx bigint, waiting_trx bigint, granted_sql string, waiting_sql string, "
        "lock_type string, lock_mode string, object_name string, database_name string, trx_wait_started timestamp_ntz"
    )
    return bags.select("id", "scan_plan_id", F.from_json("info", schema).alias("_b")).select("id", "scan_plan_id", "_b.*")


def export_report(rows: DataFrame) -> DataFrame:
    """The columns that hold something in at least one row, as text.

    One aggregate looks at all columns; without rows the full header stays.
    """
    texts = rows.select(*[F.col(n).cast("string").alias(n) for n in rows.columns])
    filled = [F.coalesce(F.bool_or(F.trim(F.col(n)) != ""), F.lit(False)).alias(n) for n in rows.columns]
    seen = texts.agg(F.count("*").alias("_rows"), *filled).first()
    kept = [n for n in rows.columns if seen["_rows"] == 0 or seen[n]]
    return texts.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in kept])


def write_export(rows: DataFrame, path: str) -> None:
    export_report(rows).write.mode("overwrite").option("header", True).csv(path)
