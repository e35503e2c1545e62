"""The three calls: ``list_archive``, ``audit_archive``, ``extract``; one archive or as many as a path has."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from . import sinks
from .cuts import cut
from .functions.limits import Limits, resolve_limits
from .operators import audit, extraction, listing
from .sources import readers
from .sources.plugins import Plugin

_LIMITS = ("max_archive_size", "max_files", "max_total_size", "max_entry_size", "max_depth", "max_compression_ratio")


def _spooled(stream: Iterable[bytes], limits: Limits) -> bytes:
    """A one-shot stream, held against the ceiling as it comes."""
    read = getattr(stream, "read", None)
    pieces = iter(lambda: read(65536), b"") if read else iter(stream)
    with tempfile.SpooledTemporaryFile(max_size=16 << 20) as out:
        total = 0
        for piece in pieces:
            total += len(piece)
            if total > limits.max_archive_size:
                raise E.ArchiveSizeExceededError(f"archive has over {limits.max_archive_size} bytes")
            out.write(piece)
        out.seek(0)
        return out.read()


def load(spark: SparkSession, given, limits: Limits) -> DataFrame:
    """Archives of a path or pattern (a folder is neither), of bytes, or of a stream of bytes."""
    if isinstance(given, (bytes, bytearray, memoryview)):
        return readers.of_bytes(spark, [("bytes", bytes(given))])
    if isinstance(given, (str, os.PathLike)):
        path = os.fspath(given)
        if "://" not in path and not any(c in path for c in "*?[{"):
            if not os.path.exists(path):
                raise E.ArchiveNotFoundError(f"no such archive: {path}")
            if not os.path.isfile(path):
                raise E.InvalidInputError(f"not a file: {path}")
        return readers.archives(spark, path if "://" in path else os.path.abspath(path))
    if hasattr(given, "read") or hasattr(given, "__iter__") and not isinstance(given, (dict, set)):
        return readers.of_bytes(spark, [("stream", _spooled(given, limits))])
    raise E.InvalidInputError(f"not an archive: {type(given).__name__}")


def _split(options: dict) -> tuple[Limits, dict]:
    return resolve_limits(**{k: options.pop(k) for k in _LIMITS if k in options}), options


def _parsed(spark, given, limits: Limits, with_body: bool, plugins, legacy) -> tuple[DataFrame, DataFrame]:
    files = load(spark, given, limits)
    return files, readers.parse(files, limits, with_body, plugins, legacy)


def _raise_first(violations: DataFrame) -> None:
    got = violations.orderBy("archive_id", "entry_index", "stage", "error_code").limit(1).collect()
    if got:
        r = got[0]
        raise E.from_code(r.error_code, f"{r.archive_id}: entry {r.entry_index}: {r.error_code}", entry_index=r.entry_index)


@contextlib.contextmanager
def abortable(spark: SparkSession, signal: threading.Event | None) -> Iterator[Callable[[], None]]:
    """Ends the Spark jobs of this block when ``signal`` is set, and raises ``AbortError``; gives a check to call between jobs."""

    def check() -> None:
        if signal is not None and signal.is_set():
            raise E.AbortError("aborted")

    check()
    if signal is None:
        yield check
        return
    tag, over = f"tarnhold-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not over.is_set():
            if signal.wait(0.1) and not over.wait(0.1):  # a job may start between the look and the call
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield check
    except Exception as e:
        if signal.is_set() and not isinstance(e, E.AbortError):
            raise E.AbortError("aborted") from e
        raise
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)


def list_archive(spark: SparkSession, given, *, plugins: list[Plugin] | None = None, legacy_plugins: bool = False, on_warning: Callable[[dict], None] | None = None, signal: threading.Event | None = None, **options) -> DataFrame:
    """The entries of an archive as they are; too many, or a broken archive, raise."""
    limits, rest = _split(options)
    if rest:
        raise E.InvalidInputError(f"unknown options: {sorted(rest)}")
    with abortable(spark, signal):
        return _listed(spark, given, limits, plugins, legacy_plugins, on_warning)


def _listed(spark: SparkSession, given, limits: Limits, plugins, legacy_plugins: bool, on_warning) -> DataFrame:
    _, parsed = _parsed(spark, given, limits, False, plugins, legacy_plugins)
    parsed = cut(parsed.drop("body"))
    rows = readers.entries(parsed)
    over = rows.where(F.col("entry_index") >= limits.max_files).select("archive_id", "entry_index", F.lit(1).alias("stage"), F.lit("LIMIT_FILE_COUNT").alias("error_code"))
    _raise_first(readers.failures(parsed).unionByName(over))
    if on_warning:
        for w in listing.list_warnings(rows, limits).orderBy("archive_id", "entry_index").toLocalIterator():
            on_warning(w.asDict())
    return listing.list_entries(rows)


@dataclass
class AuditReport:
    """One row per archive in ``report``; ``findings`` in order."""

    report: DataFrame
    findings: DataFrame
    entries: DataFrame

    def as_dicts(self) -> list[dict]:
        """Reports with their findings and entries, for a bounded number of archives."""
        found, kept = {}, {}
        for f in self.findings.orderBy("archive_id", F.col("entry_index").asc_nulls_last(), "finding_index").toLocalIterator():
            found.setdefault(f.archive_id, []).append({k: v for k, v in f.asDict().items() if v is not None and k not in ("archive_id", "finding_index", "entry_index")})
        for e in self.entries.orderBy("archive_id", "entry_index").toLocalIterator():
            kept.setdefault(e.archive_id, []).append({k: v for k, v in e.asDict().items() if v is not None and k not in ("archive_id", "entry_index")})
        return [{**r.asDict(), "findings": found.get(r.archive_id, []), "entries": kept.get(r.archive_id, [])} for r in self.report.orderBy("archive_id").collect()]


def audit_relations(files: DataFrame, parsed: DataFrame, limits: Limits, allow_symlinks: bool = False, allow_hardlinks: bool = False) -> AuditReport:
    rows = readers.entries(parsed)
    sizes = readers.sizes(files)
    sums = audit.totals(rows, sizes.select("archive_id", "archive_size"), limits)
    seen = rows.where(F.col("entry_index") < limits.max_files)  # readers stop behind them too
    found = audit.entry_findings(audit.normalized(seen.drop("body")), limits, allow_symlinks, allow_hardlinks)
    said = readers.reader_warnings(parsed).select("archive_id", F.lit(None).cast("bigint").alias("entry_index"), F.lit(-1).alias("finding_index"), "code", F.lit("low").alias("severity"), "message", F.lit(None).cast("string").alias("path"), F.lit(None).cast("map<string,string>").alias("details"))
    found = found.unionByName(audit.archive_findings(sums, limits)).unionByName(said)
    return AuditReport(audit.report(sums, found, sizes), found, seen.select("archive_id", "entry_index", "path", "type", "size", "mode", "link_target", "source_format"))


def audit_archive(spark: SparkSession, given, *, allow_symlinks: bool = False, allow_hardlinks: bool = False, plugins: list[Plugin] | None = None, legacy_plugins: bool = False, signal: threading.Event | None = None, **options) -> AuditReport:
    """Findings and risk; unsafe entries are findings, an unreadable archive raises."""
    limits, rest = _split(options)
    if rest:
        raise E.InvalidInputError(f"unknown options: {sorted(rest)}")
    with abortable(spark, signal):
        files, parsed = _parsed(spark, given, limits, False, plugins, legacy_plugins)
        parsed = cut(parsed)
        _raise_first(readers.failures(parsed))
    return audit_relations(files, parsed, limits, allow_symlinks, allow_hardlinks)


@dataclass
class ExtractResult:
    entries: DataFrame
    warnings: list[dict]
    output: str | None
    total_bytes: int
    detected_formats: list[str]
    duration_ms: int
    violations: list[dict] = field(default_factory=list)


def extract_rows(spark: SparkSession, given, *, with_body: bool = True, keep_bodies: bool = False, plugins: list[Plugin] | None = None, legacy_plugins: bool = False, filter=None, map=None, **options) -> tuple[DataFrame, extraction.Plan]:
    """The rows that an extraction of an archive writes, after all its checks; the first violation raises.

    Bodies are read again for the rows that stay; ``keep_bodies`` reads them once and keeps those of all rows meanwhile.
    """
    limits, rest = _split(options)
    opts = extraction.Options(limits=limits, filter=filter, map=map or {}, **rest)
    files, parsed = _parsed(spark, given, limits, with_body, plugins, legacy_plugins)
    if keep_bodies:
        parsed = cut(parsed)
    slim = parsed.drop("body") if keep_bodies else cut(parsed.drop("body"))
    plan = extraction.plan(readers.entries(slim), files.select("archive_id", "archive_size"), opts)
    _raise_first(readers.failures(slim).unionByName(plan.violations))
    rows = plan.entries
    if with_body:
        bodies = readers.entries(parsed).select(F.col("archive_id").alias("__id"), F.col("entry_index").alias("__at"), "body")
        rows = rows.join(bodies, (F.col("archive_id") == F.col("__id")) & (F.col("entry_index") == F.col("__at")), "left").drop("__id", "__at")
    return rows, plan


def extract(spark: SparkSession, given, output: str | None = None, *, overwrite: bool = False, symlink_fallback: str = "error", on_warning=None, on_entry=None, on_progress=None, signal: threading.Event | None = None, **options) -> ExtractResult:
    """Extracts one archive below ``output``: all of it or, after any violation or when ``signal`` is set, nothing.

    ``on_entry`` gets each entry that was written, ``on_progress`` the entries and bytes so far and their number.
    """
    began = time.time()
    if output is not None:
        sinks.check_output(output, overwrite)
    with abortable(spark, signal) as check:
        rows, plan = extract_rows(spark, given, **options)
        shown = extraction.reported(plan.entries)
        fallen: list[dict] = []
        if output is not None:
            if rows.select("archive_id").distinct().limit(2).count() > 1:
                raise E.InvalidInputError("a tree is written from one archive")
            fallen = sinks.write_tree(rows, output, overwrite, options.get("concurrency", 8), symlink_fallback, check)
    warnings = [w.asDict() for w in plan.warnings.orderBy("archive_id", "entry_index").toLocalIterator()] + fallen
    for w in warnings:
        on_warning and on_warning(w)
    summed = shown.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("source_format")).alias("formats")).first()
    if on_entry or on_progress:
        written = 0
        for n, e in enumerate(shown.orderBy("archive_id", "entry_index").toLocalIterator(), 1):
            written += e["size"]
            on_entry and on_entry(e.asDict())
            on_progress and on_progress({"entries_processed": n, "entries_total": summed.n, "bytes_processed": written})
    return ExtractResult(shown.drop("normalized"), warnings, output, summed.bytes or 0, summed.formats, int((time.time() - began) * 1000))
