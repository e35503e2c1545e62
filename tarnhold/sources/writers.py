"""Archives from records: test inputs, and queries that read back what they packed."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("zip", "tar", "tar.gz", "tar.bz2", "tar.zst")
_KINDS = {"file": tarfile.REGTYPE, "directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE, "fifo": tarfile.FIFOTYPE, "contiguous": tarfile.CONTTYPE}
_BITS = {"file": 0o100000, "directory": 0o040000, "symlink": 0o120000}


def pack(rows: list[dict], fmt: str) -> bytes:
    """An archive of records: path, and type, mode, link_target, body, mtime (seconds) where given.  Paths are taken as they are."""
    out = io.BytesIO()
    if fmt == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                kind = r.get("type", "file")
                info = zipfile.ZipInfo("x", (2026, 1, 1, 0, 0, 0))
                info.filename = info.orig_filename = r["path"] + ("/" if kind == "directory" and not r["path"].endswith("/") else "")
                if r.get("mode", 0o644) is not None:
                    info.external_attr = (_BITS[kind] | r.get("mode", 0o644)) << 16
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, (r.get("link_target") or "").encode() if kind == "symlink" else r.get("body") or b"")
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for r in rows:
            info = tarfile.TarInfo(r["path"])
            info.type = _KINDS[r.get("type", "file")]
            info.mode, info.mtime, info.linkname = r.get("mode", 0o644), r.get("mtime", 1767225600), r.get("link_target") or ""
            body = r.get("body") or b""
            info.size = len(body) if info.isreg() else 0
            t.addfile(info, io.BytesIO(body))
    data = out.getvalue()
    if fmt == "tar.gz":
        return gzip.compress(data, mtime=0)
    if fmt == "tar.bz2":
        return bz2.compress(data)
    if fmt == "tar.zst":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return data


def _built(rows: DataFrame, build) -> DataFrame:
    """archive_id, archive_size, content of small archives, each made by one task from its rows in order."""
    more = [c for c in ("type", "mode", "link_target") if c in rows.columns]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_index")
        given = [{"path": r.path, "body": bytes(r.body or b""), **{c: getattr(r, c) for c in more}} for r in pdf.itertuples()]
        data = build(pdf.archive_id.iloc[0], given)
        return pd.DataFrame({"archive_id": [pdf.archive_id.iloc[0]], "archive_size": [len(data)], "content": [data]})

    cut = rows.select("archive_id", "entry_index", "path", F.col("body").cast("binary").alias("body"), *more)
    return cut.groupBy("archive_id").applyInPandas(one, "archive_id string, archive_size bigint, content binary")


def pack_groups(rows: DataFrame, fmt: str) -> DataFrame:
    """archive_id, archive_size, content from rows (archive_id, entry_index, path, body, and type, mode, link_target if there) of small archives."""
    return _built(rows, lambda name, given: pack(given, fmt))


def damage(kind: int, rows: list[dict]) -> bytes:
    """An archive of records that is broken, or looks so, in one of ten ways."""
    tar, gz = pack(rows, "tar"), pack(rows, "tar.gz")
    body = tar.rstrip(bytes(1))
    body += bytes(-len(body) % 512)  # the entries without the blocks of zeros at the end
    if kind == 1:  # the checksum is wrong
        return gz[:-8] + bytes(x ^ 255 for x in gz[-8:-4]) + gz[-4:]
    if kind == 2:  # no trailer
        return gz[:-8]
    if kind == 3:
        return pack(rows, "tar.bz2")[:-5]
    if kind == 4:  # flagged as encrypted
        z = bytearray(pack(rows, "zip"))
        at = z.find(b"PK\x01\x02")
        z[at + 8] |= 1
        return bytes(z)
    if kind == 5:  # entries on both sides of a block of zeros
        half = len(rows) // 2
        first = pack(rows[:half], "tar").rstrip(bytes(1))
        return first + bytes(-len(first) % 512) + bytes(512) + pack(rows[half:], "tar")
    if kind == 6:
        return pack([{"path": "pipe", "type": "fifo"}], "tar")
    if kind == 7:
        return b"no archive" * 100
    if kind == 8:  # junk behind the end
        return tar + b"junk" * 128
    if kind == 9:  # the last block is cut
        return body + bytes(100)
    return gz


def pack_damaged(rows: DataFrame, kinds: int) -> DataFrame:
    """The same with archive n damaged in way n modulo ``kinds``."""
    return _built(rows, lambda name, given: damage(int(name) % kinds, given))
