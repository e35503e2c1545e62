"""The extraction plan: what would be written, what was left out with a warning, and the first violation per archive.

The stages of one row have an order that says which violation wins; across rows the lowest entry_index does.  Violations
are a relation: a caller looks at them before any sink runs, so a failing archive leaves no output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import errors as E
from ..cuts import written
from ..functions.limits import DEFAULT_LIMITS, MAX_SAFE, Limits
from ..functions.modes import sanitize_mode
from ..functions.scalar import validate_mapped_entry
from ..functions.paths import link_escapes, normalize_path, path_error_code, plain, strip_dot_segments, strip_segments, with_nfc
from . import budgets, dedup, links
from .validation import mapped_error, structural_error

STAGES = {"record": 0, "files": 1, "entry_size": 2, "overflow": 3, "total": 4, "ratio": 5, "raw_path": 6, "user": 7, "mapped": 8, "mapped_path": 9, "normalize": 10, "duplicate": 11, "case": 12, "refused": 13, "through": 14, "not_directory": 15, "escape": 16, "target": 17}


_MAPPED = ("path", "type", "size", "mode", "link_target")


@dataclass(frozen=True)
class Options:
    """Options of an extraction.

    ``filter`` is a column, or a function from an entry (dict) to whether it stays.  ``map`` has columns that replace those
    of the entry (path, type, size, mode, link_target), or is a function from an entry to the entry it becomes.  Functions
    run in Python workers, so columns are the faster way; one that raises is the violation ``USER_FUNCTION_ERROR``.
    """

    limits: Limits = DEFAULT_LIMITS
    strip: int = 0
    filter: Column | Callable[[dict], bool] | None = None
    map: dict[str, Column] | Callable[[dict], dict] = field(default_factory=dict)
    duplicates: str = "error"
    case_insensitive: bool = False
    allow_symlinks: bool = False
    allow_hardlinks: bool = False
    preserve_permissions: bool = False
    umask: int = 0o022
    platform: str = "posix"
    ascii_only: bool = False
    concurrency: int = 8

    def __post_init__(self) -> None:
        if isinstance(self.strip, bool) or not isinstance(self.strip, int) or self.strip < 0:
            raise E.InvalidInputError("strip must be a whole number of at least 0")
        if isinstance(self.concurrency, bool) or not isinstance(self.concurrency, int) or not 1 <= self.concurrency <= 32:
            raise E.InvalidInputError("concurrency must be 1 to 32")
        if self.duplicates not in ("error", "skip", "overwrite"):
            raise E.InvalidInputError("duplicates must be error, skip or overwrite")
        if self.platform not in ("posix", "windows"):
            raise E.InvalidInputError("platform must be posix or windows")
        if not isinstance(self.map, dict):
            if not callable(self.map):
                raise E.InvalidInputError("map must be columns or a function")
        elif unknown := set(self.map) - set(_MAPPED):
            raise E.InvalidInputError(f"map of unknown columns: {sorted(unknown)}")
        if self.filter is not None and not isinstance(self.filter, Column) and not callable(self.filter):
            raise E.InvalidInputError("filter must be a column or a function")


@dataclass
class Plan:
    entries: DataFrame  # the rows that are written, with what was reported of them
    warnings: DataFrame
    violations: DataFrame


def _row_checks(entries: DataFrame, archives: DataFrame, o: Options) -> DataFrame:
    """Stages 0 to 6 as ``__first``: the first one that a raw row breaks; and whether its path is ``__plain``."""
    limits = o.limits
    rows = budgets.running_total(entries.withColumn("__plain", plain(F.col("path"), limits.max_depth)), archives=archives)
    declared, total = F.col("size").isNotNull(), F.col("running_size")
    ratio = total.cast("double") / F.col("archive_size")
    raw = F.when(~F.col("__plain"), path_error_code(F.col("path"), limits, o.platform))
    said = lambda stage, code: F.struct(F.lit(STAGES[stage]).alias("stage"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
    first = (
        F.when(structural_error(entries.columns).isNotNull(), said("record", "PLUGIN_INVALID_ENTRY"))
        .when(F.col("entry_index") >= limits.max_files, said("files", "LIMIT_FILE_COUNT"))
        .when(declared & (F.col("size") > limits.max_entry_size), said("entry_size", "LIMIT_ENTRY_SIZE"))
        .when(declared & (total > MAX_SAFE), said("overflow", "LIMIT_TOTAL_SIZE"))
        .when(declared & (total > limits.max_total_size), said("total", "LIMIT_TOTAL_SIZE"))
        .when(declared & (F.col("archive_size") > 0) & (ratio > limits.max_compression_ratio), said("ratio", "LIMIT_COMPRESSION_RATIO"))
        .when(raw.isNotNull(), said("raw_path", raw))
    )
    return rows.withColumn("__first", first).drop("running_size", "archive_size")


#: What a caller's functions see of an entry.
_SHOWN = ("path", "type", "mode", "mtime", "link_target", "size", "source_format", "raw_path", "raw_mode", "disposition")


def _called(rows: DataFrame, keep: Callable[[dict], bool] | None, change: Callable[[dict], dict] | None) -> DataFrame:
    """``rows`` after a caller's functions: without what ``keep`` refuses; ``__user`` says what raised, ``__mapped`` what
    is wrong with a record that ``change`` gave."""
    names = rows.columns
    fields = [(f.name, f.dataType) for f in rows.schema] + [("__user", StringType()), ("__mapped", StringType())]
    schema = StructType([StructField(name, kind, True) for name, kind in fields])

    def one(r: dict) -> dict | None:
        entry = {k: r[k] for k in _SHOWN if k in r} | {"disposition": "extracted"}
        said = {"__user": None, "__mapped": None}
        try:
            if keep is not None and not keep(entry):
                return None
            made = entry if change is None else change(dict(entry))
        except Exception as e:  # whatever a caller's function raises
            return r | said | {"__user": f"{type(e).__name__}: {e}"[:500]}
        if change is None:
            return r | said
        try:
            validate_mapped_entry(made)
            return r | {k: made.get(k) for k in _MAPPED} | said
        except E.PluginInvalidEntryError as e:
            return r | said | {"__mapped": str(e)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for x in map(one, batch.to_pylist()) if x is not None]
            types = {n: t for n, t in zip(batch.schema.names, batch.schema.types)} | {"__user": pa.string(), "__mapped": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in got], types[n]) for n in types], names=list(types))

    return rows.select(*names).mapInArrow(run, schema)


def plan(entries: DataFrame, archives: DataFrame, options: Options | None = None) -> Plan:
    """The relations of an extraction of ``entries`` (``schema.CORE`` and whatever else; bodies are better joined to the result)."""
    o = options or Options()
    # running_total has written what this reads; the checks on a row are worked out again for each of both branches
    checked = _row_checks(entries, archives, o)
    good = checked.where("__first IS NULL").drop("__first")
    violations = checked.where("__first IS NOT NULL").select("archive_id", "entry_index", "__first.stage", F.col("__first.code").alias("error_code"))

    stripped = good.withColumns({"raw_path": F.col("path"), "raw_mode": F.coalesce("mode", F.lit(0)), "__stripped": strip_segments(F.when(F.col("__plain"), F.col("path")).otherwise(strip_dot_segments(F.col("path"))), o.strip)})
    warnings = [stripped.where("__stripped = ''").select("archive_id", "entry_index", F.lit("path_strip_collapsed").alias("code"), F.col("raw_path").alias("entry_path"))]
    rows = stripped.where("__stripped <> ''")
    rows = rows.withColumns({"path": F.col("__stripped"), "size": F.coalesce("size", F.lit(0)).cast("bigint"), "mode": sanitize_mode(F.col("mode"), F.col("type"), o.preserve_permissions, o.umask)})
    keep = None if o.filter is None or isinstance(o.filter, Column) else o.filter
    change = None if isinstance(o.map, dict) else o.map
    if isinstance(o.filter, Column):
        rows = rows.where(F.coalesce(o.filter, F.lit(False)))
    wrong = F.lit(None).cast("string")
    if keep or change:
        rows = _called(rows, keep, change)
        wrong = F.col("__mapped")
    else:
        rows = rows.withColumn("__user", F.lit(None).cast("string"))
    if isinstance(o.map, dict) and o.map:
        rows = rows.withColumns({k: v.cast(rows.schema[k].dataType) for k, v in o.map.items()})
        wrong = F.coalesce(wrong, mapped_error())
    rows = rows.withColumn("__wrong", wrong).drop("__mapped")
    # a path that is what it was broke no rule before, and a plain one lands where it says
    same = F.coalesce(F.col("path") == F.col("raw_path"), F.lit(False))
    simple = same & F.col("__plain")
    rows = rows.withColumn("__nfc", F.col("path")) if o.ascii_only else with_nfc(rows, "path", "__nfc", simple)
    rows = rows.withColumn("normalized", F.when(simple, F.col("path")).otherwise(normalize_path(F.col("__nfc")))).drop("__nfc")
    code = F.when(~same, path_error_code(F.col("path"), o.limits, o.platform))
    said = lambda stage, c: F.struct(F.lit(STAGES[stage]).alias("stage"), (F.lit(c) if isinstance(c, str) else c).alias("code"))
    late = F.when(F.col("__user").isNotNull(), said("user", "USER_FUNCTION_ERROR")).when(F.col("__wrong").isNotNull(), said("mapped", "PLUGIN_INVALID_ENTRY")).when(code.isNotNull(), said("mapped_path", code)).when(F.col("normalized").isNull(), said("normalize", "PATH_TRAVERSAL"))
    rows = rows.withColumns({"__late": late, "disposition": F.when(F.col("path") == F.col("__stripped"), "extracted").otherwise("renamed")}).drop("__stripped", "__plain", "__wrong", "__user")
    rows = written(rows)  # many branches below read it
    violations = violations.unionByName(rows.where("__late IS NOT NULL").select("archive_id", "entry_index", "__late.stage", F.col("__late.code").alias("error_code")))
    rows = dedup.mark(rows.where("__late IS NULL").drop("__late"))
    if not o.case_insensitive:
        rows = rows.withColumn("case_collision", F.lit(False))
    clash = F.when(F.col("duplicate"), said("duplicate", "DUPLICATE_PATH")).when(F.col("case_collision"), said("case", "CASE_COLLISION"))
    if o.duplicates == "error":
        violations = violations.unionByName(rows.withColumn("__c", clash).where("__c IS NOT NULL").select("archive_id", "entry_index", "__c.stage", F.col("__c.code").alias("error_code")))
        rows = rows.where("NOT duplicate AND NOT case_collision")
    elif o.duplicates == "skip":
        name = F.when(F.col("duplicate"), "duplicate_skipped").otherwise("case_collision_skipped")
        warnings.append(rows.where("duplicate OR case_collision").select("archive_id", "entry_index", name.alias("code"), F.col("raw_path").alias("entry_path")))
        rows = rows.where("NOT duplicate AND NOT case_collision")
    rows = rows.drop("duplicate", "case_collision")

    refused = F.when((F.col("type") == "symlink") & F.lit(not o.allow_symlinks), said("refused", "LINK_SYMLINK_REFUSED")).when((F.col("type") == "hardlink") & F.lit(not o.allow_hardlinks), said("refused", "LINK_HARDLINK_REFUSED"))
    leaving = F.when(link_escapes(F.col("path"), F.col("link_target"), F.col("type")), said("escape", "LINK_ESCAPE"))
    broken = rows.where(F.col("type").isin("symlink", "hardlink")).select("archive_id", "entry_index", F.explode(F.array_compact(F.array(refused, leaving))).alias("v"))
    violations = violations.unionByName(broken.select("archive_id", "entry_index", "v.stage", F.col("v.code").alias("error_code")))
    at = lambda df, stage, c: df.select("archive_id", "entry_index", F.lit(STAGES[stage]).alias("stage"), F.lit(c).alias("error_code"))
    slim = rows.select("archive_id", "entry_index", "type", "normalized", "link_target")
    among = links.met(slim)
    violations = violations.unionByName(at(links.write_through_symlink(slim, among), "through", "LINK_THROUGH_SYMLINK")).unionByName(at(links.not_a_directory(slim, among), "not_directory", "NOT_A_DIRECTORY"))
    if o.allow_hardlinks:
        violations = violations.unionByName(at(links.hardlink_missing(slim), "target", "HARDLINK_TARGET_MISSING"))
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    return Plan(rows, out, violations)


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation with which an extraction of each archive fails."""
    first = F.min(F.struct("entry_index", "stage", "error_code")).alias("v")
    return violations.groupBy("archive_id").agg(first).select("archive_id", "v.entry_index", "v.stage", "v.error_code")


def reported(rows: DataFrame) -> DataFrame:
    """What a caller sees of written rows: links have mode 0, only files have bytes."""
    link = F.col("type").isin("symlink", "hardlink")
    size = F.col("actual_bytes") if "actual_bytes" in rows.columns else F.col("size")
    mtime = F.col("mtime") if "mtime" in rows.columns else F.lit(None).cast("timestamp")
    return rows.select(
        "archive_id", "entry_index", "path", "type", F.when(link, 0).otherwise(F.col("mode")).alias("mode"), mtime.alias("mtime"), "link_target",
        F.when(F.col("type") == "file", F.coalesce(size, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("size"), "source_format", "raw_path", "raw_mode", "disposition", "normalized",
    )
