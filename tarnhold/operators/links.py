"""Links: refusal, escape, missing targets, order, and entries below links.

All joins have the archive and a path as their key, so no archive is a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cuts import cut, written
from ..functions.paths import link_escapes, normalize_path


def escapes(entries: DataFrame) -> DataFrame:
    """archive_id, entry_index, type, escapes of every link."""
    links = entries.where(F.col("type").isin("symlink", "hardlink"))
    return links.select("archive_id", "entry_index", "type", link_escapes(F.col("path"), F.col("link_target"), F.col("type")).alias("escapes"))


def _hardlinks(entries: DataFrame) -> DataFrame:
    return entries.where("type = 'hardlink'").select("archive_id", "entry_index", "normalized", normalize_path(F.col("link_target")).alias("target"))


def hardlink_missing(entries: DataFrame) -> DataFrame:
    """Hardlinks whose target is no entry of their archive, itself aside."""
    there = entries.where("normalized IS NOT NULL").select("archive_id", F.col("normalized").alias("target"), F.col("entry_index").alias("other"))
    links = _hardlinks(entries)
    found = links.join(there, ["archive_id", "target"]).where("entry_index <> other").select("archive_id", "entry_index").distinct()
    return links.join(found, ["archive_id", "entry_index"], "left_anti").select("archive_id", "entry_index", "target")


def hardlink_order(entries: DataFrame) -> DataFrame:
    """archive_id, entry_index, depth: the pass in which each hardlink can be made, 1 if its target is no hardlink.

    Links on a cycle or behind a missing target have no depth.  Each pass joins what is pending with what the last
    one resolved; passes are checkpointed, as many as the longest chain has links.
    """
    links = cut(_hardlinks(entries))
    solid = entries.where("type <> 'hardlink' AND normalized IS NOT NULL").select("archive_id", F.col("normalized").alias("target")).distinct()
    depth = 1
    step = cut(links.join(solid, ["archive_id", "target"], "left_semi").withColumn("depth", F.lit(1)))
    done, pending = step, cut(links.join(step, ["archive_id", "entry_index"], "left_anti"))
    while not step.isEmpty() and not pending.isEmpty():
        depth += 1
        fresh = step.select("archive_id", F.col("normalized").alias("target"))
        step = cut(pending.join(fresh, ["archive_id", "target"], "left_semi").withColumn("depth", F.lit(depth)))
        pending = cut(pending.join(step, ["archive_id", "entry_index"], "left_anti"))
        done = done.unionByName(step)
    return done.unionByName(pending.withColumn("depth", F.lit(None).cast("int"))).select("archive_id", "entry_index", "depth")


def _ancestors(entries: DataFrame) -> DataFrame:
    parts = F.split("normalized", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = entries.where("instr(normalized, '/') > 0")
    return rows.select("archive_id", "entry_index", F.explode(above).alias("ancestor"))


def _hash() -> Column:
    return F.xxhash64("archive_id", "ancestor")


def met(entries: DataFrame) -> DataFrame:
    """Hashes of the paths that are those of a file or symlink and ancestors of another entry's: few, but for a hash by chance."""
    own = entries.where(F.col("type").isin("file", "symlink") & F.col("normalized").isNotNull()).select("archive_id", F.col("normalized").alias("ancestor"))
    sides = own.select(_hash().alias("__met"), F.lit(1).alias("own"), F.lit(0).alias("above")).union(_ancestors(entries).select(_hash(), F.lit(0), F.lit(1)))
    return written(sides.groupBy("__met").agg(F.max("own").alias("own"), F.max("above").alias("above")).where("own = 1 AND above = 1").select("__met"))


def below(entries: DataFrame, kind: str, among: DataFrame | None = None) -> DataFrame:
    """Entries with an earlier entry of ``kind`` as an ancestor of their path: the first such ancestor in archive order.

    Only paths that ``met`` names (``among``, if it was worked out before) are joined.
    """
    among = met(entries) if among is None else among
    those = lambda df: df.withColumn("__met", _hash()).join(among, "__met", "left_semi").drop("__met")
    of = entries.where((F.col("type") == kind) & F.col("normalized").isNotNull()).select("archive_id", F.col("normalized").alias("ancestor"), F.col("entry_index").alias("at"))
    found = those(_ancestors(entries)).join(those(of), ["archive_id", "ancestor"]).where("at < entry_index")
    return found.groupBy("archive_id", "entry_index").agg(F.min(F.struct("at", "ancestor"))["ancestor"].alias("ancestor"))


def write_through_symlink(entries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    return below(entries, "symlink", among)


def not_a_directory(entries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    return below(entries, "file", among)
