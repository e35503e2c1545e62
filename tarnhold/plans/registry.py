"""All registered queries over derived entries, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import modes, paths
from ..functions.limits import DEFAULT_LIMITS, Limits
from ..cuts import cut, shared_folder, written
from ..operators import audit, budgets, dedup, extraction, links, listing, validation
from ..sources import detect, plugins, readers, writers
from . import derived, oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIGHT = Limits(max_files=oracles.TIGHT["files"], max_entry_size=oracles.TIGHT["entry"], max_total_size=oracles.TIGHT["total"], max_compression_ratio=oracles.TIGHT["ratio"])


def query(final: str | None = None, relation: str = "doc_entries", extra: dict[str, str] | None = None, recursive: bool = False):
    """Registers a query; ``final`` is the last SELECT of its oracle over the relations of ``oracles``."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if final:
            text = oracles.relation(relation, extra) + final
            ORACLES[fn.__name__] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn

    return put


def _docs(spark: SparkSession, sf_dir: str, name: str = "doc_entries") -> DataFrame:
    return derived.entries(spark, sf_dir, name)


def _landed(spark: SparkSession, sf_dir: str, name: str = "doc_entries") -> DataFrame:
    return audit.normalized(_docs(spark, sf_dir, name))


# --- sources and paths -------------------------------------------------------------------

_PEEKS = ["504B0304", "504B0306", "504B0506", "504B0708", "504B0102", "1F8B0800", "425A6839", "28B52FFD", "00", "7F454C46"]


@query()
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magic bytes of given prefixes and of a TAR header, and document texts as archives: the bytes the operator looks at, and all bytes as the size."""
    given = spark.createDataFrame([(p, 100) for p in _PEEKS] + [("00" * 257 + "7573746172", 1024), ("00" * 512, 1024), ("00" * 512, 1000)], "peek string, size bigint")
    data = F.encode("text", "UTF-8")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring(data, 1, detect.PEEK).alias("peek"), F.octet_length(data).cast("bigint").alias("size"))
    rows = given.select(F.lit(None).cast("bigint").alias("doc_id"), F.unhex("peek").alias("peek"), "size").union(texts)
    return rows.select("doc_id", F.hex("peek").alias("peek"), "size", detect.detected(F.col("peek"), F.col("size")).alias("detected"))


ORACLES["detect_format"] = (
    "WITH p AS (SELECT CAST(NULL AS BIGINT) AS doc_id, unnest([" + ", ".join(f"'{p}'" for p in _PEEKS) + "]) AS peek, CAST(100 AS BIGINT) AS size UNION ALL SELECT NULL, concat(repeat('00', 257), '7573746172'), 1024 UNION ALL SELECT NULL, repeat('00', 512), 1024 UNION ALL SELECT NULL, repeat('00', 512), 1000"
    f" UNION ALL SELECT doc_id, hex(encode(text))[1:{2 * detect.PEEK}], octet_length(encode(text)) FROM documents)"
    " SELECT doc_id, peek, size, CASE WHEN length(peek) < 8 THEN NULL WHEN peek[1:4] = '504B' AND peek[5:6] IN ('03', '05', '07') AND peek[7:8] IN ('04', '06', '08') THEN 'zip' WHEN peek[1:4] = '1F8B' THEN 'tar.gz' WHEN peek[1:6] = '425A68' THEN 'tar.bz2'"
    f" WHEN peek[1:8] = '28B52FFD' THEN 'tar.zst' WHEN peek[515:524] = '7573746172' THEN 'tar' WHEN size >= 1024 AND size % 512 = 0 AND peek = repeat('00', {detect.PEEK}) THEN 'tar' END AS detected FROM p"
)


@query(f"SELECT archive_id, entry_index, {oracles.STRUCTURE} AS reason FROM broken WHERE {oracles.STRUCTURE} IS NOT NULL", extra={"broken": "SELECT archive_id, entry_index, source_format, " + ", ".join(f"{v} AS {k}" for k, v in oracles.BROKEN.items()) + " FROM entries"})
def structural_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir)
    return validation.structural_violations(rows.selectExpr("archive_id", "entry_index", "source_format", *[f"{v} AS {k}" for k, v in oracles.BROKEN.items()]))


@query(f"SELECT archive_id, entry_index, {oracles.stripped('path')} AS stripped FROM entries")
def strip_dot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("archive_id", "entry_index", paths.strip_dot_segments(F.col("path")).alias("stripped"))


@query("SELECT archive_id, entry_index, normalized FROM norm")
def normalize_path_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.normalized(_docs(spark, sf_dir), ascii_only=True).select("archive_id", "entry_index", "normalized")


@query(f"SELECT doc_id, {oracles.normalized('p')} AS normalized FROM (SELECT doc_id, replace(text, chr(10), '/') AS p FROM documents)")
def normalize_path_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as paths.  Those beyond ASCII alone go through Arrow."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.translate("text", "\n", "/").alias("path"))
    return audit.normalized(rows).select("doc_id", "normalized")


@query("SELECT archive_id, entry_index, error_code FROM norm")
def path_error_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("archive_id", "entry_index", paths.path_error_code(F.col("path")).alias("error_code"))


@query("SELECT archive_id, entry_index, path, error_code FROM norm", "url_entries")
def url_path_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "url_entries").select("archive_id", "entry_index", "path", paths.path_error_code(F.col("path")).alias("error_code"))


@query(f"SELECT archive_id, entry_index, array_to_string({oracles.segments('path')}[2:], '/') AS stripped, len({oracles.segments('path')}) AS depth FROM entries")
def strip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _docs(spark, sf_dir).select("archive_id", "entry_index", paths.strip_segments(p, 1).alias("stripped"), paths.path_depth(p).cast("bigint").alias("depth"))


@query("SELECT archive_id, entry_index, normalized IS NOT NULL AND (normalized = 'docs' OR starts_with(normalized, 'docs/')) AS inside FROM norm")
def inside_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("archive_id", "entry_index", paths.is_inside(F.col("path"), F.lit("docs")).alias("inside"))


# --- modes ---------------------------------------------------------------------------------


@query(f"SELECT archive_id, entry_index, {oracles.sanitized('mode', 'type')} AS mode FROM entries")
def sanitize_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("archive_id", "entry_index", modes.sanitize_mode(F.col("mode"), F.col("type")).alias("mode"))


@query("SELECT archive_id, entry_index, '0o' || printf('%o', mode) AS octal FROM entries WHERE mode IS NOT NULL")
def mode_octal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("mode IS NOT NULL").select("archive_id", "entry_index", modes.octal(F.col("mode")).alias("octal"))


# --- budgets -------------------------------------------------------------------------------

_BUDGET = oracles.LIMITED.format(**oracles.TIGHT)


@query(f"SELECT archive_id, entry_index, CAST(running_size AS BIGINT) AS running_size, CASE WHEN archive_size > 0 THEN CAST(running_size AS DOUBLE) / archive_size ELSE 0.0 END AS ratio, {_BUDGET} AS error_code FROM running", "line_entries")
def declared_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "line_entries")
    return budgets.declared_budget(rows, derived.archives(rows), TIGHT).withColumn("running_size", F.col("running_size").cast("bigint"))


@query(f"SELECT archive_id, min(entry_index) AS entry_index, arg_min(code, entry_index) AS error_code FROM (SELECT *, {_BUDGET} AS code FROM running) WHERE code IS NOT NULL GROUP BY archive_id", "line_entries")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "line_entries")
    plan = extraction.plan(rows, derived.archives(rows), extraction.Options(limits=TIGHT, duplicates="skip"))
    return extraction.first_violation(plan.violations).select("archive_id", "entry_index", "error_code")


# --- duplicates ----------------------------------------------------------------------------


@query("SELECT archive_id, entry_index, normalized FROM marked WHERE duplicate", "part_entries")
def duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_paths(_landed(spark, sf_dir, "part_entries"))


@query("SELECT archive_id, entry_index, normalized FROM marked WHERE case_collision", "part_entries")
def case_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.case_collisions(_landed(spark, sf_dir, "part_entries"))


@query("SELECT archive_id, entry_index, normalized FROM marked WHERE NOT duplicate", "part_entries")
def dup_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(_landed(spark, sf_dir, "part_entries")).select("archive_id", "entry_index", "normalized")


@query("SELECT archive_id, normalized, max(entry_index) AS entry_index, arg_max(body, entry_index) AS body FROM norm WHERE normalized IS NOT NULL GROUP BY archive_id, normalized", "event_entries")
def dup_overwrite_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_last(_landed(spark, sf_dir, "event_entries"), "body")


# --- links ---------------------------------------------------------------------------------


@query(f"SELECT archive_id, entry_index, type, {oracles.escapes('path', 'link_target', 'type')} AS escapes FROM entries WHERE type IN ('symlink', 'hardlink')")
def link_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.escapes(_docs(spark, sf_dir))


@query("SELECT archive_id, entry_index, target FROM hard h WHERE NOT EXISTS (SELECT 1 FROM norm n WHERE n.archive_id = h.archive_id AND n.normalized = h.target AND n.entry_index <> h.entry_index)", extra=oracles.LINKED, recursive=True)
def hardlink_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.hardlink_missing(_landed(spark, sf_dir))


@query("SELECT h.archive_id, h.entry_index, CAST(min(c.depth) AS INTEGER) AS depth FROM hard h LEFT JOIN chain c ON c.archive_id = h.archive_id AND c.entry_index = h.entry_index GROUP BY h.archive_id, h.entry_index", extra=oracles.LINKED, recursive=True)
def hardlink_fixpoint_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.hardlink_order(_landed(spark, sf_dir))


@query("SELECT * FROM (" + oracles._below("symlink") + ")", extra=oracles.LINKED, recursive=True)
def write_through_symlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.write_through_symlink(_landed(spark, sf_dir))


@query("SELECT * FROM (" + oracles._below("file") + ")", extra=oracles.LINKED, recursive=True)
def not_a_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.not_a_directory(_landed(spark, sf_dir))


# --- audit ---------------------------------------------------------------------------------


@query("SELECT * FROM findings", extra=oracles.FINDINGS)
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.entry_findings(_landed(spark, sf_dir)).select("archive_id", "entry_index", "finding_index", "code", "severity", "path")


@query("SELECT code, severity, count(*) AS n FROM findings GROUP BY code, severity", extra=oracles.FINDINGS)
def audit_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.entry_findings(_landed(spark, sf_dir)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def _report(rows: DataFrame) -> DataFrame:
    rows = written(rows.select("archive_id", "entry_index", "path", "type", "size", "mode", "link_target"))  # many branches read it
    archives = derived.archives(rows)
    sums = audit.totals(rows, archives)
    found = audit.entry_findings(audit.normalized(rows)).select("archive_id", "severity")
    return audit.report(sums, found.unionByName(audit.archive_findings(sums).select("archive_id", "severity")))


@query(oracles.REPORT, extra=oracles.FINDINGS | oracles.SUMS)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_docs(spark, sf_dir))


@query("SELECT archive_id, risk_level FROM (" + oracles.REPORT + ")", "event_entries", oracles.FINDINGS | oracles.SUMS)
def event_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_docs(spark, sf_dir, "event_entries")).select("archive_id", "risk_level")


@query("SELECT archive_id, risk_level, entry_count, total_size, n_findings FROM (" + oracles.REPORT + ")", extra=oracles.FINDINGS | oracles.SUMS)
def risk_by_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_docs(spark, sf_dir)).select("archive_id", "risk_level", "entry_count", "total_size", "n_findings")


@query("SELECT archive_id, code, severity FROM whole", "line_entries", oracles.sums(TIGHT.max_files, TIGHT.max_total_size, TIGHT.max_compression_ratio))
def archive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "line_entries")
    return audit.archive_findings(audit.totals(rows, derived.archives(rows), TIGHT), TIGHT).select("archive_id", "code", "severity")


# --- listing and extraction ----------------------------------------------------------------


@query(f"SELECT archive_id, entry_index, path, type, {oracles.sanitized('mode', 'type')} AS mode, link_target, coalesce(size, 0) AS size, source_format, path AS raw_path, coalesce(mode, 0) AS raw_mode, 'extracted' AS disposition FROM entries")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_entries(_docs(spark, sf_dir)).drop("mtime")


@query("SELECT archive_id, entry_index, 'unsafe_path' AS code, path AS entry_path, error_code FROM norm WHERE error_code IS NOT NULL")
def list_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_warnings(_docs(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str, **more) -> extraction.Plan:
    rows = cut(_docs(spark, sf_dir))
    return extraction.plan(rows, derived.archives(rows), extraction.Options(duplicates="skip", limits=DEFAULT_LIMITS, **more))


@query(f"SELECT archive_id, entry_index, landing AS path, type, CASE WHEN type IN ('symlink', 'hardlink') THEN 0 ELSE {oracles.sanitized('mode', 'type')} END AS mode, link_target, CASE WHEN type = 'file' THEN coalesce(size, 0) ELSE 0 END AS size, source_format, path AS raw_path, coalesce(mode, 0) AS raw_mode, 'extracted' AS disposition FROM written", extra=oracles.EXTRACT)
def extract_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.reported(_plan(spark, sf_dir).entries).drop("mtime", "normalized")


@query("SELECT archive_id, entry_index, 'duplicate_skipped' AS code, path AS entry_path FROM firsts WHERE rn > 1", extra=oracles.EXTRACT)
def extract_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).warnings


_STRIP = {**oracles.EXTRACT, "cut": f"SELECT *, array_to_string({oracles.segments('landing')}[2:], '/') AS short FROM landed"}


@query("SELECT archive_id, entry_index, 'path_strip_collapsed' AS code, path AS entry_path FROM cut WHERE short = ''", extra=_STRIP)
def strip_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, strip=1).warnings.where("code = 'path_strip_collapsed'")


_MAP = {**oracles.EXTRACT, "mapped": "SELECT *, concat('out/', landing) AS moved FROM landed WHERE type = 'file' AND size > 1000", "kept": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, normalized ORDER BY entry_index) AS r FROM mapped) WHERE r = 1"}


@query("SELECT archive_id, entry_index, moved AS path, size, path AS raw_path, 'renamed' AS disposition FROM kept", extra=_MAP)
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's filter and map as columns."""
    plan = _plan(spark, sf_dir, filter=(F.col("type") == "file") & (F.col("size") > 1000), map={"path": F.concat(F.lit("out/"), F.col("path"))})
    return plan.entries.select("archive_id", "entry_index", "path", "size", "raw_path", "disposition")


@query("SELECT archive_id, entry_index, moved AS path, size, path AS raw_path, 'renamed' AS disposition FROM kept", extra=_MAP)
def filter_map_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter and map as a caller's functions."""
    plan = _plan(spark, sf_dir, filter=lambda e: e["type"] == "file" and e["size"] > 1000, map=lambda e: {**e, "path": "out/" + e["path"]})
    return plan.entries.select("archive_id", "entry_index", "path", "size", "raw_path", "disposition")


@query(f"SELECT archive_id, entry_index, landing AS path, type, CASE WHEN type IN ('symlink', 'hardlink') THEN 0 ELSE {oracles.sanitized('mode', 'type')} END AS mode, CASE WHEN type = 'file' THEN coalesce(size, 0) ELSE 0 END AS size, link_target AS linkname FROM written", extra=oracles.EXTRACT)
def compat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import compat

    return compat.legacy_rows(extraction.reported(_plan(spark, sf_dir).entries)).drop("mtime", "data")


# --- readers: archives are packed from documents and read back ------------------------------

_BUNDLE = "CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR(99))"


def _packed(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return writers.pack_groups(docs.selectExpr(f"{_BUNDLE} AS archive_id", "doc_id % 50 AS entry_index", "concat(lang, '/', doc_id, '.txt') AS path", "text AS body"), fmt)


def _read_back(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = readers.entries(readers.parse(_packed(spark, sf_dir, fmt), with_body=True))
        return rows.select("archive_id", "entry_index", "path", "type", "size", "mode", "actual_bytes", "source_format", F.sha2("body", 256).alias("sha256"))

    return run


for _fmt in writers.FORMATS:
    _name = f"parse_{_fmt.replace('.', '')}"
    QUERIES[_name] = _read_back(_fmt)
    ORACLES[_name] = f"SELECT {_BUNDLE} AS archive_id, row_number() OVER (PARTITION BY {_BUNDLE} ORDER BY doc_id) - 1 AS entry_index, concat(lang, '/', doc_id, '.txt') AS path, 'file' AS type, octet_length(encode(text)) AS size, 420 AS mode, octet_length(encode(text)) AS actual_bytes, '{_fmt}' AS source_format, sha256(text) AS sha256 FROM documents"


def _audited(files: DataFrame):
    """The audit of archives, which are packed once and read once: many branches of it read their entries."""
    from .. import api

    files = written(files)
    return api.audit_relations(files, written(readers.parse(files).drop("body")), DEFAULT_LIMITS)


def archive_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers, audit and report over packed archives, whole."""
    return _audited(_packed(spark, sf_dir, "tar.gz")).report.select("archive_id", "risk_level", "total_size", "entry_count", "n_findings", "detected_format")


QUERIES["archive_audit"] = archive_audit
ORACLES["archive_audit"] = f"SELECT {_BUNDLE} AS archive_id, 'low' AS risk_level, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, count(*) AS entry_count, 0 AS n_findings, 'tar.gz' AS detected_format FROM documents GROUP BY 1"


def plugin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's source: documents as archives of their lines."""

    def lines(data: bytes, warn) -> list[dict]:
        return [{"path": f"line/{i}", "type": "file", "size": len(x), "mode": 0o644, "source_format": "lines", "body": x} for i, x in enumerate(data.split(b"\n"))]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("archive_id"), F.octet_length("text").cast("bigint").alias("archive_size"), F.encode("text", "UTF-8").alias("content"))
    rows = readers.entries(readers.parse(docs, plugins=[plugins.Plugin("lines", lines)]))
    return rows.select("archive_id", "entry_index", "path", "size", "source_format")


QUERIES["plugin_source"] = plugin_source
ORACLES["plugin_source"] = "SELECT archive_id, k - 1 AS entry_index, concat('line/', k - 1) AS path, octet_length(encode(ls[k])) AS size, 'lines' AS source_format FROM (SELECT archive_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS archive_id, string_split(text, chr(10)) AS ls FROM documents))"


def drop_dir_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over archives that executors drop into the shared folder, run until it has seen all that are there."""
    from ..streaming import dropdir

    folder = shared_folder(spark, "drop")
    _packed(spark, sf_dir, "zip").write.parquet(f"{folder}/in")
    dropdir.audit_to(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", table=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("archive_id", "risk_level", "entry_count", "total_size", "detected_format")


QUERIES["drop_dir_stream"] = drop_dir_stream
ORACLES["drop_dir_stream"] = f"SELECT {_BUNDLE} AS archive_id, 'low' AS risk_level, count(*) AS entry_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, 'zip' AS detected_format FROM documents GROUP BY 1"


@query()
def actual_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits over the bytes that really came out of archives."""
    rows = readers.entries(readers.parse(_packed(spark, sf_dir, "tar.zst"), with_body=True)).select("archive_id", "entry_index", "actual_bytes")
    rows = written(rows)  # else each branch packs again
    archives = rows.select("archive_id").distinct().withColumn("archive_size", F.lit(_CLAIMED).cast("bigint"))
    return budgets.actual_budget(rows, archives, _SMALL).select("archive_id", "entry_index", F.col("running_size").cast("bigint").alias("running_size"), "ratio", "error_code")


_CLAIMED, _SMALL = 1000, Limits(max_files=45, max_entry_size=20_000, max_total_size=150_000, max_compression_ratio=120)
ORACLES["actual_budget"] = (
    f"WITH e AS (SELECT {_BUNDLE} AS archive_id, row_number() OVER (PARTITION BY {_BUNDLE} ORDER BY doc_id) - 1 AS entry_index, octet_length(encode(text)) AS size FROM documents),"
    " r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY archive_id ORDER BY entry_index) AS BIGINT) AS running_size FROM e)"
    f" SELECT archive_id, entry_index, running_size, CAST(running_size AS DOUBLE) / {_CLAIMED} AS ratio, CASE WHEN entry_index >= 45 THEN 'LIMIT_FILE_COUNT' WHEN size > 20000 THEN 'LIMIT_ENTRY_SIZE' WHEN running_size > 150000 THEN 'LIMIT_TOTAL_SIZE' WHEN CAST(running_size AS DOUBLE) / {_CLAIMED} > 120 THEN 'LIMIT_COMPRESSION_RATIO' END AS error_code FROM r"
)


# --- damaged and hostile archives ----------------------------------------------------------

#: Kinds of damage, dealt to archives by number: how it is read, and whether all its entries come before that.
_DAMAGED = {0: (None, True), 1: ("CORRUPT_ARCHIVE", True), 2: ("TRUNCATED_ARCHIVE", True), 3: ("TRUNCATED_ARCHIVE", True), 4: ("CORRUPT_ARCHIVE", False), 5: (None, True), 6: ("CORRUPT_ARCHIVE", False), 7: ("UNKNOWN_FORMAT", False), 8: ("CORRUPT_ARCHIVE", True), 9: ("TRUNCATED_ARCHIVE", True)}


def damaged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with a wrong checksum, without a trailer, cut off, encrypted, with entries behind a block of zeros, of unknown types and with junk at their ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_BUNDLE} AS archive_id", "doc_id % 50 AS entry_index", "concat(lang, '/', doc_id, '.txt') AS path", "text AS body")
    files = writers.pack_damaged(docs, len(_DAMAGED))
    parsed = readers.parse(files)
    told = parsed.groupBy("archive_id").agg(F.count(F.when(F.col("kind") == "entry", 1)).alias("n"), F.max(F.when(F.col("kind") == "error", F.col("error_code"))).alias("error_code"))
    whole = [k for k, (_, all_) in _DAMAGED.items() if all_]
    return told.select("archive_id", "error_code", F.when((F.col("archive_id").cast("bigint") % len(_DAMAGED)).isin(whole), F.col("n")).alias("n_entries"))


QUERIES["damaged_archives"] = damaged_archives
ORACLES["damaged_archives"] = (
    f"SELECT archive_id, CASE k {' '.join(f'WHEN {k} THEN ' + repr(c) for k, (c, _) in _DAMAGED.items() if c)} END AS error_code, CASE WHEN k IN ({', '.join(str(k) for k, (_, all_) in _DAMAGED.items() if all_)}) THEN n END AS n_entries"
    f" FROM (SELECT {_BUNDLE} AS archive_id, CAST(floor(any_value(doc_id) / 50) AS BIGINT) % {len(_DAMAGED)} AS k, count(*) AS n FROM documents GROUP BY 1)"
)

#: What documents become by their number: columns of the entry, and the findings it brings.
_HOSTILE = {
    0: ("'symlink'", "511", "concat('link_', doc_id)", "'../../x'", [("symlink_present", "medium"), ("symlink_escape", "critical")]),
    1: ("'hardlink'", "420", "concat('hard_', doc_id)", "'/etc/passwd'", [("hardlink_present", "medium"), ("hardlink_escape", "critical")]),
    2: ("'file'", "2541", "concat('bin/tool_', doc_id)", "NULL", [("setuid_bit", "high")]),
    3: ("'file'", "420", "concat('../evil_', doc_id)", "NULL", [("path_traversal", "critical")]),
    4: ("'file'", "420", "concat('a_', doc_id, '.txt:x')", "NULL", [("windows_ads_path", "high")]),
    5: ("'directory'", "1021", "concat('dir_', doc_id)", "NULL", [("sticky_bit", "medium")]),
    6: ("'symlink'", "511", "concat('ok_', doc_id)", "'target'", [("symlink_present", "medium")]),
    7: ("'file'", "420", "concat(chr(67), ':', doc_id)", "NULL", [("absolute_path", "critical"), ("windows_drive_absolute", "critical"), ("windows_ads_path", "high")]),
    8: ("'file'", "420", "concat('plain_', doc_id)", "NULL", []),
}


def hostile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over archives of links, modes and paths that readers have to bring through."""
    of = lambda i: "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _HOSTILE.items()) + " END"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"{_BUNDLE} AS archive_id", "doc_id % 50 AS entry_index", f"{of(2)} AS path", "text AS body", f"{of(0)} AS type", f"CAST({of(1)} AS INT) AS mode", f"CAST({of(3)} AS STRING) AS link_target")
    found = _audited(writers.pack_groups(rows, "tar")).findings
    return found.groupBy("archive_id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


QUERIES["hostile_audit"] = hostile_audit
_brings = ", ".join(f"({k}, '{c}', '{s}')" for k, v in _HOSTILE.items() for c, s in v[4])
ORACLES["hostile_audit"] = f"SELECT {_BUNDLE} AS archive_id, code, severity, count(*) AS n FROM documents JOIN (VALUES {_brings}) AS f(k, code, severity) ON doc_id % 9 = k GROUP BY ALL"
