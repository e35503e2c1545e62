"""Structural rules of entries and of mapped rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.limits import MAX_SAFE

TYPES = ("file", "directory", "symlink", "hardlink")


def _first(rules: list[tuple[Column, str]]) -> Column:
    return reduce(lambda rest, x: F.when(F.coalesce(x[0], F.lit(False)), F.lit(x[1])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def _missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def structural_error(columns: list[str]) -> Column:
    """What is wrong with an entry's record, the first rule that fails; null if nothing is."""
    link = F.col("type").isin("symlink", "hardlink")
    return _first([
        (_missing("path"), "path"),
        (_missing("source_format"), "source_format") if "source_format" in columns else (F.lit(False), ""),
        (F.col("type").isNull() | ~F.col("type").isin(*TYPES), "type"),
        ((F.col("size") < 0) | (F.col("size") > MAX_SAFE), "size"),
        ((F.col("mode") < 0) | (F.col("mode") > 0o17777), "mode"),
        (link & _missing("link_target"), "link_target"),
    ])


def mapped_error() -> Column:
    """The rules that a mapped row must keep: size and mode are there, a link may lack its target."""
    return _first([
        (_missing("path"), "path"),
        (F.col("type").isNull() | ~F.col("type").isin(*TYPES), "type"),
        (F.col("size").isNull() | (F.col("size") < 0) | (F.col("size") > MAX_SAFE), "size"),
        (F.col("mode").isNull() | (F.col("mode") < 0) | (F.col("mode") > 0o17777), "mode"),
    ])


def structural_violations(entries: DataFrame) -> DataFrame:
    """archive_id, entry_index, reason of the entries whose record is invalid."""
    return entries.select("archive_id", "entry_index", structural_error(entries.columns).alias("reason")).where("reason IS NOT NULL")
