"""Cutting lineage: relations that many branches of a plan read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, whose executors are threads of the driver, may name none (as in tests) and gets a folder of its
    own; on a cluster every machine would have another one, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_root:
        _own_root[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tarnhold-")
    return _own_root[context.applicationId]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there, removed when the JVM ends."""
    path = f"{root(spark)}/tarnhold/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: worked out once, kept by all executors, and a leaf of the plans above it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of columns in the shared folder: smaller than a checkpoint, and a branch reads only what it names."""
    path = shared_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
