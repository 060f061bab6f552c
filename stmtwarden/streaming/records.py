"""The stored record table that drained batches are merged into.

A version is a folder of Parquet files nothing changes any more, named by a
manifest ``manifest/N``, which also says up to which batch the version holds
the queue. A manifest appears by a rename that fails if the number is taken,
so of two writers that start from one version only one succeeds, and a reader
that has picked a version reads it to the end whatever is written meanwhile.

The table has one row per statement, not per arrival; draining writes it anew,
at whatever interval suits its size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.operators import governance
from stmtwarden.session import file_system
from stmtwarden.streaming import jobs

NEWEST = ("ts", "id", "sql_text", *jobs.CARRY)
AUDIT = {"audit_level": "string", "priority": "string", "audit_results": "array<struct<rule_name:string,level:string,message:string>>"}


class Version(NamedTuple):
    number: int
    data: str
    #: Largest batch id of the queue that is merged in.
    drained: int


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = file_system(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def pinned(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version of the table, the newest if none is named; None if there is none yet."""
    if number is None:
        known = versions(spark, path)
        if not known:
            return None
        number = known[-1]
    fs, where = file_system(spark, f"{path}/manifest/{number}")
    stream = fs.open(where)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(number, said["data"], said["drained"])


def read(spark: SparkSession, path: str, version: Version) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{version.data}")


def commit(spark: SparkSession, path: str, rows: DataFrame, base: Version | None, drained: int) -> Version:
    """``rows`` as the version after ``base``; an error if another writer was faster, and then nothing has changed."""
    new = Version(base.number + 1 if base else 0, uuid.uuid4().hex, drained)
    rows.write.parquet(f"{path}/data/{new.data}")
    fs, draft = file_system(spark, f"{path}/draft/{new.data}")
    out = fs.create(draft)
    out.write(json.dumps({"data": new.data, "drained": drained}).encode())
    out.close()
    _, final = file_system(spark, f"{path}/manifest/{new.number}")
    fs.mkdirs(final.getParent())
    jvm = spark._jvm
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(draft), files.makeQualified(final), no_options)
    return new


def merged(stored: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """Stored records with a rollup of new arrivals: counters added, text of the newest arrival; what is touched is stamped ``now``."""
    s, i = stored.alias("s"), incoming.withColumn("_new", F.lit(True)).alias("i")
    newest = F.greatest(*[F.struct(*[F.col(f"{side}.{c}").alias(c) for c in NEWEST]) for side in "si"]).alias("_n")
    counter = (F.coalesce("s.counter", F.lit(0)) + F.coalesce("i.counter", F.lit(0))).alias("counter")
    stamp = F.when(F.col("_new"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("s.updated_at")).alias("updated_at")
    rows = s.join(i, "sql_id", "full").select("sql_id", counter, newest, stamp, "s.last_audit_time", *[f"s.{c}" for c in AUDIT])
    return rows.select("sql_id", "counter", *[f"_n.{c}" for c in NEWEST], "updated_at", "last_audit_time", *AUDIT)


def drain(spark: SparkSession, queue: str, path: str, now: str) -> Version | None:
    """The batches stored since the last drain merged into the record table.

    A batch counts once: the manifest that brings its rows also marks it as
    drained, and a batch written again under a drained number is passed over.
    Without new batches the newest version stays.
    """
    base = pinned(spark, path)
    done = base.drained if base else -1
    fresh = [n for n in jobs._complete(spark, queue, "batch_id") if n > done]
    if not fresh:
        return base
    incoming = jobs.rolled_up(spark.read.parquet(*[f"{queue}/batch_id={n}" for n in fresh]))
    if base:
        rows = merged(read(spark, path, base), incoming, now)
    else:
        rows = incoming.select("sql_id", "counter", *NEWEST, F.lit(now).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("last_audit_time"), *[F.lit(None).cast(t).alias(c) for c, t in AUDIT.items()])
    return commit(spark, path, rows, base, fresh[-1])


def due(records: DataFrame) -> DataFrame:
    """Records never audited, or changed since."""
    return records.where("last_audit_time IS NULL OR updated_at > last_audit_time")


def audit(spark: SparkSession, path: str, now: str, judge: Callable[[DataFrame], DataFrame] = governance.audit_records) -> Version | None:
    """Records changed since their audit are audited and stamped; the others pass as they are."""
    base = pinned(spark, path)
    if base is None:
        return None
    rows = read(spark, path, base)
    plain = [c for c in rows.columns if c not in AUDIT]
    done = judge(due(rows).select(plain)).withColumn("last_audit_time", F.lit(now).cast("timestamp_ntz"))
    rest = rows.where("last_audit_time IS NOT NULL AND (updated_at IS NULL OR updated_at <= last_audit_time)")
    return commit(spark, path, rest.unionByName(done.select(rows.columns)), base, base.drained)


def clean(spark: SparkSession, queue: str, path: str, keep: int = 3) -> None:
    """Deletes drained batches and all versions but the newest ``keep``, which readers may still hold."""
    known = versions(spark, path)
    if not known:
        return
    last = pinned(spark, path, known[-1])
    gone = [f"{queue}/batch_id={n}" for n in jobs._complete(spark, queue, "batch_id") if n <= last.drained]
    for number in known[:-keep]:
        gone += [f"{path}/manifest/{number}", f"{path}/data/{pinned(spark, path, number).data}"]
    for one in gone:
        fs, where = file_system(spark, one)
        fs.delete(where, True)
