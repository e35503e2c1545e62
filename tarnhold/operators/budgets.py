"""Budgets: sums of declared sizes in archive order against the limits.

A running sum over a whole archive would be one window group, and one archive may hold a large part of all
entries.  So sums run in two steps: within stretches of ``STRETCH`` entries, which are written, and over the
stretches of those archives that have several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import written
from ..functions.limits import DEFAULT_LIMITS, MAX_SAFE, Limits

STRETCH = 4096


def running_total(entries: DataFrame, value: Column | None = None, out: str = "running_size", archives: DataFrame | None = None) -> DataFrame:
    """Adds the sum of ``value`` (declared size, null as 0) up to each entry, exact beyond 64 bits, and archive_size of ``archives``.

    Entries that lie by archive are not shuffled again for it.  What is broadcast has a row for each stretch of an archive of
    several, so one for about ``STRETCH`` entries.
    """
    value = F.coalesce(F.col("size") if value is None else value, F.lit(0)).cast("decimal(38,0)")
    stretch = F.floor(F.col("entry_index") / STRETCH)
    within = Window.partitionBy("archive_id", "__stretch").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("__stretch", stretch).withColumn("__within", F.sum(value).over(within).cast("decimal(38,0)")).drop("__stretch")
    names = [*entries.columns]
    if archives is not None:
        sizes = archives.select(F.col("archive_id").alias("__id"), "archive_size")
        rows = rows.join(sizes, F.col("archive_id") == F.col("__id"), "left").drop("__id")
        names.append("archive_size")
    rows = written(rows)  # so that long archives are found by a column of it
    several = rows.where(F.col("entry_index") >= STRETCH).select(F.col("archive_id").alias("__archive")).distinct()
    long = rows.join(F.broadcast(several), F.col("archive_id").eqNullSafe(F.col("__archive")), "left_semi")
    sums = long.groupBy(F.col("archive_id").alias("__archive"), stretch.alias("__of")).agg(F.sum(value).cast("decimal(38,0)").alias("__sum"))
    before = Window.partitionBy("__archive").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.sum("__sum").over(before).cast("decimal(38,0)")).drop("__sum")
    rows = rows.join(F.broadcast(sums), F.col("archive_id").eqNullSafe(F.col("__archive")) & (stretch == F.col("__of")), "left")
    return rows.withColumn(out, (F.col("__within") + F.coalesce("__before", F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")).select(*names, out)


def declared_budget(entries: DataFrame, archives: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """archive_id, entry_index, running_size, ratio and the code of the first limit that the entry breaks."""
    rows = running_total(entries.select("archive_id", "entry_index", "size"), archives=archives)
    ratio = F.when(F.col("archive_size") > 0, F.col("running_size").cast("double") / F.col("archive_size")).otherwise(F.lit(0.0))
    return rows.select("archive_id", "entry_index", "running_size", ratio.alias("ratio"), budget_code(limits, ratio).alias("error_code"))


def budget_code(limits: Limits, ratio: Column) -> Column:
    declared = F.col("size").isNotNull()
    return (
        F.when(F.col("entry_index") >= limits.max_files, F.lit("LIMIT_FILE_COUNT"))
        .when(declared & (F.col("size") > limits.max_entry_size), F.lit("LIMIT_ENTRY_SIZE"))
        .when(declared & (F.col("running_size") > min(limits.max_total_size, MAX_SAFE)), F.lit("LIMIT_TOTAL_SIZE"))
        .when(declared & (ratio > limits.max_compression_ratio), F.lit("LIMIT_COMPRESSION_RATIO"))
    )


def actual_budget(entries: DataFrame, archives: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The same limits over the bytes that the reader saw; readers stop an entry at its ceiling by themselves."""
    measured = entries.select("archive_id", "entry_index", F.col("actual_bytes").alias("size"))
    return declared_budget(measured, archives, limits)
