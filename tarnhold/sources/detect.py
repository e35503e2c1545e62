"""Archive formats by their first bytes, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEEK = 512


def detected(peek: Column, size: Column) -> Column:
    """Name of the format, null if unknown.  An empty TAR is blocks of zeros: the first one is looked at."""
    h = F.hex(F.substring(peek, 1, 4))
    tar = F.hex(F.substring(peek, 258, 5)) == "7573746172"
    empty = (size >= 1024) & (size % 512 == 0) & (F.hex(F.substring(peek, 1, PEEK)) == "00" * PEEK)
    return (
        F.when(F.length(peek) < 4, F.lit(None).cast("string"))
        .when(h.rlike(r"\A504B(03|05|07)(04|06|08)\z"), "zip")
        .when(h.startswith("1F8B"), "tar.gz")
        .when(h.startswith("425A68"), "tar.bz2")
        .when(h == "28B52FFD", "tar.zst")
        .when(tar | empty, "tar")
    )


def detect_bytes(data: bytes, size: int | None = None) -> str | None:
    """The same for one value."""
    size = len(data) if size is None else size
    if len(data) < 4:
        return None
    if data[:2] == b"PK" and data[2] in (3, 5, 7) and data[3] in (4, 6, 8):
        return "zip"
    for magic, name in ((b"\x1f\x8b", "tar.gz"), (b"BZh", "tar.bz2"), (b"\x28\xb5\x2f\xfd", "tar.zst")):
        if data.startswith(magic):
            return name
    if data[257:262] == b"ustar" or size >= 1024 and size % 512 == 0 and data[:PEEK] == bytes(PEEK):
        return "tar"
    return None
