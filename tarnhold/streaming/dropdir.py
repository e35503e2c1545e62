"""A folder that archives are dropped into, as a stream: each archive is read, listed or audited once, on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import api
from ..functions.limits import DEFAULT_LIMITS, Limits
from ..sources import readers

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


_TABLE = "archive_id string, archive_size bigint, content binary"


def archives(spark: SparkSession, folder: str, per_trigger: int = 100, table: bool = False) -> DataFrame:
    """Arriving archives: files of their own, or (``table``) rows of arriving Parquet files, as a job writes many small ones."""
    if table:
        return spark.readStream.schema(_TABLE).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.col("path").alias("archive_id"), F.col("length").alias("archive_size"), "content")


def entries(spark: SparkSession, folder: str, limits: Limits = DEFAULT_LIMITS, with_body: bool = False) -> DataFrame:
    """Stream of the records of arriving archives (``readers.RECORDS``); stateless, so a restart repeats a batch at most."""
    return readers.parse(archives(spark, folder), limits, with_body)


def audit_to(spark: SparkSession, folder: str, output: str, checkpoint: str, limits: Limits = DEFAULT_LIMITS, available_now: bool = True, table: bool = False) -> StreamingQuery:
    """Appends the report of each arriving archive to a Parquet table, one folder per batch, so a repeated batch replaces its own."""

    def batch(files: DataFrame, number: int) -> None:
        parsed = readers.parse(files, limits)
        api.audit_relations(files, parsed, limits).report.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = archives(spark, folder, table=table).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
