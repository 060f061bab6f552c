"""A corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.llm import chosen_path, packing, pii, quality, repeats
from stmtwarden.llm.common import free_name, saved, table
from stmtwarden.llm.queries import tokenizer_file


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and very short texts fail the rules. Equal rows get equal
    verdicts. Null languages and sources are groups like others. An empty
    table stays empty; other columns pass through whatever their names.
    """
    return quality.quality_filter(docs)


def _row_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a key that only rows equal in doc_id and text share.

    It is the doc_id wherever that tells a row's text; rows without a doc_id,
    and of rows that share one but differ in text all but one text's, get a
    hash of both above 2^62, so that they come after the others.
    """
    doc_id, lo, shared = docs["doc_id"].cast("long"), f"{key}_lo", f"{key}_id"
    text = F.xxhash64("text")
    per = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias(shared)).agg(F.min(text).alias(lo), F.max(text).alias("hi"))
    several = saved(per.where(F.col(lo) != F.col("hi")).drop("hi"), "shared")
    other = doc_id.isNull() | (F.col(lo).isNotNull() & (text != F.col(lo)))
    hashed = F.xxhash64(doc_id, docs["text"]).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return docs.join(several, doc_id == F.col(shared), "left").select(*[docs[c] for c in docs.columns], F.when(other, hashed).otherwise(doc_id).alias(key))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, or any one if none has an id.

    Rows that share a doc_id or lack one are judged by their own texts; of
    rows equal in both one stays. Null and empty texts are no one's copies.
    An empty table stays empty; other columns pass through whatever their
    names.
    """
    key = free_name(docs, "row_key")
    keyed = _row_keys(docs, key)
    found = chosen_path.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80)
    rows = saved(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")), "ids")
    gone = saved(rows.where("NOT kept").select(F.col("doc_id").alias("_gone")), "gone")
    more = saved(rows.where("kept AND rows > 1").select(F.col("doc_id").alias("_more")), "more")
    kept = keyed.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    # rows that share a key are few or none; of equal ones one stays
    once = kept.join(more, F.col(key) == F.col("_more"), "left_anti")
    twice = kept.join(more, F.col(key) == F.col("_more"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice).drop(key)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages of 200 bytes that occur elsewhere; every document stays.

    Null texts become empty. Of equal rows none is spared: each is the other's
    copy. An empty table stays empty; other columns pass through.
    """
    return repeats.repeats(docs, width=200, text_out=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data.

    Null and empty texts stay as they are. Equal values get equal pseudonyms,
    so equal rows stay equal. Other columns pass through.
    """
    return pii.pseudonymised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of 2048.

    A null or empty text is its end id alone; a long text is cut into several
    pieces. Equal rows are packed each. An empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("personal data", personal_data), ("packing", packed)]

#: SQL cannot express the stages' methods; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
