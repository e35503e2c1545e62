"""The listing: entries as they are, with warnings for unsafe paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.limits import DEFAULT_LIMITS, Limits
from ..functions.modes import sanitize_mode
from ..functions.paths import path_error_code


def list_entries(entries: DataFrame, umask: int = 0o022) -> DataFrame:
    """Every entry: nothing is stripped, filtered or merged, and paths stay as they are."""
    mtime = F.col("mtime") if "mtime" in entries.columns else F.lit(None).cast("timestamp")
    return entries.select(
        "archive_id", "entry_index", "path", "type", sanitize_mode(F.col("mode"), F.col("type"), False, umask).alias("mode"), mtime.alias("mtime"), "link_target",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "source_format", F.col("path").alias("raw_path"), F.coalesce("mode", F.lit(0)).alias("raw_mode"), F.lit("extracted").alias("disposition"),
    )


def list_warnings(entries: DataFrame, limits: Limits = DEFAULT_LIMITS, platform: str = "posix") -> DataFrame:
    code = path_error_code(F.col("path"), limits, platform)
    rows = entries.select("archive_id", "entry_index", F.lit("unsafe_path").alias("code"), F.col("path").alias("entry_path"), code.alias("error_code"))
    return rows.where("error_code IS NOT NULL")
