"""Session settings the library relies on, read from the session itself."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR_CONF = "spark.checkpoint.dir"

def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A session on one machine that has no such setting gets a temporary folder,
    recorded in the session; on a cluster a missing setting is an error, since
    executors would each write to a disk of their own.
    """
    base = spark.conf.get(CHECKPOINT_DIR_CONF, "") or spark.sparkContext.getConf().get(CHECKPOINT_DIR_CONF, "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stmtwarden-")
        spark.conf.set(CHECKPOINT_DIR_CONF, base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows stored in the shared folder and read again, which cuts lineage."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
