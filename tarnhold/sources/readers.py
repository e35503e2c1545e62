"""Readers: archives as bytes into rows of entries, one archive after the other within a task, in Arrow batches.

A broken archive gives a row of kind ``error`` with a code and the rows before it; it never fails the job.  Readers stop
at ceilings by themselves, so a bomb is not unpacked first and judged later.
"""

from __future__ import annotations

import bz2
import datetime
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.limits import DEFAULT_LIMITS, Limits
from ..functions.scalar import entry_error
from ..schema import ENTRIES
from .detect import PEEK, detect_bytes, detected
from .plugins import Plugin, pick

RECORDS = "kind string, error_code string, message string, " + ENTRIES
_TYPES = {"kind": pa.string(), "error_code": pa.string(), "message": pa.string(), "archive_id": pa.string(), "entry_index": pa.int64(), "path": pa.string(), "type": pa.string(), "size": pa.int64(), "mode": pa.int32(), "mtime": pa.timestamp("us", "UTC"), "link_target": pa.string(), "source_format": pa.string(), "compressed_size": pa.int64(), "actual_bytes": pa.int64(), "body": pa.binary()}
LINK_TARGET_MAX, _BATCH_ROWS, _BATCH_BYTES = 16 * 1024, 2000, 8 << 20
_CUT = re.compile(r"end of data|truncated|premature|unexpected end|end-of-stream|incomplete", re.I)


class _Stop(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _text(name: str) -> str:
    """Names that are not UTF-8 have the replacement character where they are not."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class _Budget:
    """Bytes that came out of an archive against its ceilings, as they come."""

    def __init__(self, limits: Limits, archive_size: int) -> None:
        self.limits, self.archive_size, self.total = limits, archive_size, 0

    def pass_over(self, n: int) -> None:
        """Counts bytes that belong to no entry."""
        self.total += n
        if self.total > self.limits.max_total_size:
            raise _Stop("LIMIT_TOTAL_SIZE", f"archive has over {self.limits.max_total_size} bytes")

    def read(self, stream, size: int | None, keep: bool) -> tuple[int, bytes | None]:
        parts, n = [], 0
        while size is None or n < size:
            piece = stream.read(65536 if size is None else min(65536, size - n))
            if not piece:
                break
            n += len(piece)
            self.total += len(piece)
            if n > self.limits.max_entry_size:
                raise _Stop("LIMIT_ENTRY_SIZE", f"entry has over {self.limits.max_entry_size} bytes")
            if self.total > self.limits.max_total_size:
                raise _Stop("LIMIT_TOTAL_SIZE", f"archive has over {self.limits.max_total_size} bytes")
            if self.archive_size > 0 and self.total / self.archive_size > self.limits.max_compression_ratio:
                raise _Stop("LIMIT_COMPRESSION_RATIO", f"archive is over {self.limits.max_compression_ratio} times its size")
            if keep:
                parts.append(piece)
        return n, b"".join(parts) if keep else None


def read_zip(data: bytes, limits: Limits, with_body: bool) -> Iterator[dict]:
    budget = _Budget(limits, len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.flag_bits & 1:
                raise _Stop("CORRUPT_ARCHIVE", f"encrypted entry {info.orig_filename!r}")
            attributes = info.external_attr >> 16
            name, bits = info.orig_filename, attributes & 0o170000
            kind = {0o120000: "symlink", 0o100000: "file", 0o040000: "directory", 0: "directory" if name.endswith("/") else "file"}.get(bits)
            if kind is None:
                raise _Stop("CORRUPT_ARCHIVE", f"entry {name!r} is of an unknown type")
            row = {"path": name.rstrip("/") if name.endswith("/") and len(name) > 1 else name, "type": kind, "mode": attributes & 0o7777 if attributes else (0o755 if kind == "directory" else 0o644), "size": 0 if kind == "directory" else info.file_size, "compressed_size": info.compress_size, "mtime": _zip_time(info), "source_format": "zip"}
            if kind == "symlink":
                if info.file_size > LINK_TARGET_MAX:
                    raise _Stop("CORRUPT_ARCHIVE", f"target of link {name!r} is too long")
                row["link_target"] = z.read(info).decode("utf-8", "replace")
            elif kind == "file" and with_body:
                with z.open(info) as f:
                    row["actual_bytes"], row["body"] = budget.read(f, None, True)
            yield row


def _zip_time(info: zipfile.ZipInfo) -> datetime.datetime | None:
    try:
        return datetime.datetime(*info.date_time, tzinfo=datetime.timezone.utc)
    except ValueError:
        return None


_TAR_TYPES = {b"0": "file", b"\0": "file", b"7": "file", b"5": "directory", b"2": "symlink", b"1": "hardlink"}


def _pax(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        n, _, _ = data[at:].partition(b" ")
        if not n.isdigit() or not 0 < int(n) <= len(data) - at:
            raise _Stop("CORRUPT_ARCHIVE", "bad extended header")
        key, _, value = data[at + len(n) + 1 : at + int(n) - 1].partition(b"=")
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "surrogateescape")
        at += int(n)
    return out


_ZEROS = bytes(512)


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n) if n else b""
    while len(data) < n:
        more = stream.read(n - len(data))
        if not more:
            raise _Stop("TRUNCATED_ARCHIVE", "unexpected end of data")
        data += more
    return data


def read_tar(stream, fmt: str, archive_size: int, limits: Limits, with_body: bool) -> Iterator[dict]:
    """Headers in order; each body is read to its end before the next header.

    The stream is read to its very end: blocks of zeros are passed over wherever they stand, so what hides behind them is
    seen, and so is damage at the end of a compressed stream.  An archive may end after any whole entry.
    """
    budget = _Budget(limits, archive_size)
    shared: dict[str, str] = {}
    own: dict[str, str] = {}
    while True:
        block = stream.read(512)
        if not block:
            if own:
                raise _Stop("TRUNCATED_ARCHIVE", "unexpected end of data")
            return
        block += _exactly(stream, 512 - len(block))
        if block == _ZEROS:
            budget.pass_over(512)
            continue
        info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        if info.type in (b"x", b"g", b"L", b"K"):
            if info.size > 1 << 20:
                raise _Stop("CORRUPT_ARCHIVE", "header is too large")
            data = _exactly(stream, -(-info.size // 512) * 512)[: info.size]
            if info.type in (b"x", b"g"):
                (own if info.type == b"x" else shared).update(_pax(data))
            else:
                own["path" if info.type == b"L" else "linkpath"] = data.split(b"\0")[0].decode("utf-8", "surrogateescape")
            continue
        more = shared | own
        own = {}
        name, target, size = more.get("path", info.name), more.get("linkpath", info.linkname), info.size
        if more.get("size", "0").isdigit() and "size" in more:
            size = int(more["size"])
        kind = _TAR_TYPES.get(info.type)
        if kind is None:
            raise _Stop("CORRUPT_ARCHIVE", f"entry {name!r} is of an unknown type")
        if kind == "file" and info.type == b"\0" and name.endswith("/"):
            kind = "directory"
        name = name[:-1] if name.endswith("/") and len(name) > 1 else name
        try:
            mtime = datetime.datetime.fromtimestamp(float(more.get("mtime", info.mtime)), datetime.timezone.utc)
        except (ValueError, OverflowError, OSError):
            mtime = None
        row = {"path": _text(name), "type": kind, "size": 0 if kind == "directory" else size, "mode": info.mode & 0o7777, "mtime": mtime, "source_format": fmt, "link_target": _text(target) if kind in ("symlink", "hardlink") else None}
        if kind == "file":
            if with_body:
                row["actual_bytes"], row["body"] = budget.read(stream, size, True)
                if row["actual_bytes"] < size:
                    raise _Stop("TRUNCATED_ARCHIVE", "unexpected end of data")
                _exactly(stream, -size % 512)
                yield row
                continue
            yield row
            left = -(-size // 512) * 512
            while left:
                left -= len(_exactly(stream, min(left, 65536)))
        else:
            yield row


class _Members:
    """A gzip stream; what follows its last member and is no member is left aside."""

    def __init__(self, data: bytes) -> None:
        self.file, self.any = gzip.GzipFile(fileobj=io.BytesIO(data)), False

    def read(self, n: int) -> bytes:
        try:
            got = self.file.read(n)
        except gzip.BadGzipFile as e:
            if self.any and str(e).startswith("Not a gzipped file"):
                return b""
            raise
        self.any |= bool(got)
        return got


class _Frames:
    """A stream of zstd frames; its library takes a cut frame for whole, so the frames are walked through at the end."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        self.data, self.file = data, zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)

    def read(self, n: int) -> bytes:
        got = self.file.read(n)
        if not got and n:
            _whole_frames(self.data)
        return got


def _whole_frames(data: bytes) -> None:
    """Raises where the last frame is cut off or no frame starts."""
    at, cut = 0, "unexpected end of zstd data"
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic != 0xFD2FB528:
            raise ValueError("no zstd frame")
        else:
            if len(data) < at + 6:
                raise EOFError(cut)
            about = data[at + 4]
            single = about >> 5 & 1
            at += 5 + (not single) + (0, 1, 2, 4)[about & 3] + (single, 2, 4, 8)[about >> 6]
            last = False
            while not last:
                if len(data) < at + 3:
                    raise EOFError(cut)
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind = bool(head & 1), head >> 1 & 3
                at += 3 + (1 if kind == 1 else head >> 3)
            at += 4 * (about >> 2 & 1)
        if at > len(data):
            raise EOFError(cut)


def _stream(data: bytes, fmt: str):
    if fmt == "tar.gz":
        return _Members(data)
    if fmt == "tar.bz2":
        return bz2.BZ2File(io.BytesIO(data))
    if fmt == "tar.zst":
        return _Frames(data)
    return io.BytesIO(data)


def read_known(data: bytes, fmt: str, limits: Limits, with_body: bool) -> Iterator[dict]:
    if fmt == "zip":
        return read_zip(data, limits, with_body)
    return read_tar(_stream(data, fmt), fmt, len(data), limits, with_body)


def _failure(e: Exception) -> tuple[str, str]:
    if isinstance(e, _Stop):
        return e.code, str(e)
    if isinstance(e, E.ArchiveError):
        return e.code, str(e)
    return ("TRUNCATED_ARCHIVE" if isinstance(e, EOFError) or _CUT.search(str(e)) else "CORRUPT_ARCHIVE"), f"{type(e).__name__}: {e}"


def records(archive_id: str, data: bytes, limits: Limits, with_body: bool, plugins: list[Plugin], legacy: bool = False) -> Iterator[dict]:
    """The records of one archive: entries, warnings of plugins, and at most one error at the end."""
    index = 0
    warned: list[dict] = []
    try:
        if len(data) > limits.max_archive_size:
            raise _Stop("LIMIT_ARCHIVE_SIZE", f"archive has {len(data)} bytes, {limits.max_archive_size} allowed")
        fmt = detect_bytes(data[:PEEK], len(data))
        plugin = pick(plugins, fmt, data[:PEEK], legacy)
        if plugin is None and (fmt is None or plugins):  # plugins that do not fit never fall back on the known readers
            raise _Stop("UNKNOWN_FORMAT", "the format of the archive is not known")
        rows: Iterable[dict] = plugin.parse(data, lambda code, message: warned.append({"code": code, "message": message})) if plugin else read_known(data, fmt, limits, with_body)
        for row in rows:
            if what := entry_error(row):
                raise _Stop("PLUGIN_INVALID_ENTRY", f"entry {index}: {what}")
            body = row.get("body")
            body = body() if callable(body) else body
            yield {**{k: v for k, v in row.items() if k in _TYPES}, "kind": "entry", "archive_id": archive_id, "entry_index": index, "body": bytes(body) if body is not None and with_body else None, "actual_bytes": row.get("actual_bytes", len(body) if body is not None else None)}
            index += 1
            if index > limits.max_files:
                break
    except (_Stop, E.ArchiveError, zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError, _zstd_error()) as e:
        code, message = _failure(e)
        yield {"kind": "error", "archive_id": archive_id, "entry_index": index, "error_code": code, "message": message}
    for w in warned:
        yield {"kind": "warning", "archive_id": archive_id, "error_code": w["code"], "message": w["message"]}


def _zstd_error() -> type[Exception]:
    try:
        import zstandard
    except ImportError:
        return EOFError
    return zstandard.ZstdError


def archives(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The files of a path or pattern: archive_id, archive_size, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return reader.load(path).select(F.col("path").alias("archive_id"), F.col("length").alias("archive_size"), "content")


def of_bytes(spark: SparkSession, given: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(i, len(b), bytearray(b)) for i, b in given], "archive_id string, archive_size bigint, content binary")


def sizes(files: DataFrame) -> DataFrame:
    """archive_id, archive_size and the detected format.  Files beyond a size are never read for it if filtered before."""
    return files.select("archive_id", "archive_size", detected(F.substring("content", 1, PEEK), F.col("archive_size")).alias("detected"))


def parse(files: DataFrame, limits: Limits = DEFAULT_LIMITS, with_body: bool = False, plugins: list[Plugin] | None = None, legacy: bool = False) -> DataFrame:
    """``RECORDS`` of archives (archive_id, archive_size, content).

    Files over ``max_archive_size`` become error rows from their size alone.  Bodies are read only if asked for.
    """
    known = list(plugins or [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in _TYPES.items()], names=list(_TYPES))

        for batch in batches:
            for i in range(batch.num_rows):
                for r in records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", limits, with_body, known, legacy):
                    out.append(r)
                    held += len(r.get("body") or b"")
                    if len(out) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    order = ["kind", "error_code", "message", *[c.split()[0] for c in ENTRIES.split(", ")]]
    fitting = files.where(F.col("archive_size") <= limits.max_archive_size)
    over = files.where(F.col("archive_size") > limits.max_archive_size)
    made = fitting.select("archive_id", "content").mapInArrow(run, ", ".join(f"{k} {_SPARK[k]}" for k in _TYPES)).select(*order)
    empty = {k: F.lit(None).cast(_SPARK[k]).alias(k) for k in order}
    row = {**empty, "kind": F.lit("error").alias("kind"), "error_code": F.lit("LIMIT_ARCHIVE_SIZE").alias("error_code"), "message": F.lit("archive is too large").alias("message"), "archive_id": F.col("archive_id"), "entry_index": F.lit(0).cast("bigint").alias("entry_index")}
    return made.unionByName(over.select(*row.values()))


_SPARK = {"kind": "string", "error_code": "string", "message": "string"} | dict(c.split() for c in ENTRIES.split(", "))


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'entry'").drop("kind", "error_code", "message")


def failures(parsed: DataFrame) -> DataFrame:
    """archive_id, entry_index, stage, error_code: what a reader could not read, as violations."""
    return parsed.where("kind = 'error'").select("archive_id", "entry_index", F.lit(0).alias("stage"), "error_code")


def reader_warnings(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'warning'").select("archive_id", F.col("error_code").alias("code"), "message")


Reader = Callable[[bytes], Iterable[dict]]
