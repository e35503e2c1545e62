"""Duplicate paths and paths that differ in case alone, in archive order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cuts import written
from ..functions.paths import fold_case


def mark(entries: DataFrame) -> DataFrame:
    """Adds duplicate and case_collision to entries with ``normalized``; rows without it take part in neither.

    A path is a duplicate if the same one stands earlier, a collision if the first spelling of the same letters differs.
    Most paths are the only one of their letters.  Counts per hash tell which are not, and those alone get their first places,
    which are minima, summed up before they are shuffled: a path that a large part of all entries has is no hot window.  A
    join with the written places, which is a broadcast where they are few, brings them back.
    """
    there = entries.where("normalized IS NOT NULL").select(F.col("archive_id").alias("__id"), F.col("normalized").alias("__path"), "entry_index")
    there = there.withColumn("__letters", F.xxhash64(F.col("__id"), fold_case(F.col("__path"))))
    shared = written(there.groupBy("__letters").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__letters"))
    first = there.join(shared, "__letters", "left_semi").groupBy("__id", "__path").agg(F.min("entry_index").alias("__first"), F.count(F.lit(1)).alias("__n"))
    first = first.withColumn("__folded", fold_case(F.col("__path")))
    spelled = first.groupBy("__id", "__folded").agg(F.min(F.struct("__first", "__path"))["__path"].alias("__spelled"))
    first = first.join(spelled.select(F.col("__id").alias("__sid"), F.col("__folded").alias("__as"), "__spelled"), F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__folded") == F.col("__as")))
    first = written(first.where("__n > 1 OR __spelled <> __path").select("__id", "__path", "__first", "__spelled"))
    rows = entries.join(first, F.col("archive_id").eqNullSafe(F.col("__id")) & (F.col("normalized") == F.col("__path")), "left")
    no = F.lit(False)
    rows = rows.withColumns({"duplicate": F.coalesce(F.col("entry_index") > F.col("__first"), no), "case_collision": F.coalesce(F.col("__spelled") != F.col("normalized"), no)})
    return rows.select(*entries.columns, "duplicate", "case_collision")


def duplicate_paths(entries: DataFrame) -> DataFrame:
    return mark(entries).where("duplicate").select("archive_id", "entry_index", "normalized")


def case_collisions(entries: DataFrame) -> DataFrame:
    return mark(entries).where("case_collision").select("archive_id", "entry_index", "normalized")


def keep_first(entries: DataFrame) -> DataFrame:
    """Under ``skip``: what stays when later equal paths go."""
    return mark(entries).where("NOT duplicate").drop("duplicate", "case_collision")


def keep_last(entries: DataFrame, value: str) -> DataFrame:
    """Under ``overwrite``: the value that is left on disk for each path, that of the last entry."""
    rows = entries.where("normalized IS NOT NULL").groupBy("archive_id", "normalized")
    return rows.agg(F.max("entry_index").alias("entry_index"), F.max_by(value, "entry_index").alias(value))
