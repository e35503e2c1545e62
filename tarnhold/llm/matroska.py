"""Media columns: Matroska.

``write_pcm`` stores bytes as 8-bit mono PCM in a Matroska file (clusters,
simple blocks with lacing, cues); ``parse`` reads any Matroska file into tables of
tracks, packets and cues.  The parser knows variable-length element ids and sizes,
unknown sizes of segments and clusters, simple blocks and block groups, and all four
kinds of lacing.  A file that breaks these rules raises ``MatroskaError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, text_of

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 30


class MatroskaError(ValueError):
    """The bytes are not a well-formed Matroska file."""


# --- writing ---------------------------------------------------------------------------


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _vint(n: int, width: int = 0) -> bytes:
    """``n`` as a data size; all ones of a width mean "unknown", so they are left out."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return _id(ident) + _vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_vint(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < (1 << 7 * width - 1):
        width += 1
    return _vint(n + (1 << 7 * width - 1) - 1, width)


def _block(frames: list[bytes], relative: int) -> bytes:
    head = _vint(1) + struct.pack(">h", relative)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:  # fixed lacing
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    laced = _vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"\x86" + bytes([len(frames) - 1]) + laced + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file with one audio track whose packets are ``payload`` in order."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    millis = FRAME * 1000 // SAMPLE_RATE
    head = _element(
        EBML,
        _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2),
    )
    info = _element(
        INFO,
        _uint(0x2AD7B1, 1_000_000) + _element(0x4489, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + _element(0x4D80, b"tarnhold") + _element(0x5741, b"tarnhold"),
    )
    audio = _element(0xE1, _element(0xB5, struct.pack(">d", SAMPLE_RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8))
    tracks = _element(TRACKS, _element(0xAE, _uint(0xD7, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(0x9C, 1) + _element(0x86, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), LACED * BLOCKS):
        time = c * millis
        group = frames[c : c + LACED * BLOCKS]
        blocks = b"".join(_element(0xA3, _block(group[i : i + LACED], i * millis)) for i in range(0, len(group), LACED))
        cluster = _element(CLUSTER, _uint(0xE7, time) + blocks)
        cues.append(_element(0xBB, _uint(0xB3, time) + _element(0xB7, _uint(0xF7, 1) + _uint(0xF1, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(body))


# --- reading ---------------------------------------------------------------------------


def _read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise MatroskaError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise MatroskaError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_vint(data: bytes, at: int, end: int) -> tuple[int | None, int, int]:
    """Value (None: unknown), next byte, width."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"size cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width, width


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, first byte of the body, end); an unknown size ends with the parent."""
    while at < end:
        ident, body = _read_id(data, at, end)
        size, body, _ = _read_vint(data, body, end)
        stop = end if size is None else body + size
        if stop > end:
            raise MatroskaError(f"element {ident:X} at byte {at} is cut off")
        if size is None and ident == CLUSTER:
            stop = body
            while stop < end:
                child, inner = _read_id(data, stop, end)
                if child in TOP_LEVEL:
                    break
                n, inner, _ = _read_vint(data, inner, end)
                if n is None or inner + n > end:
                    raise MatroskaError(f"element {child:X} at byte {stop} is cut off")
                stop = inner + n
        yield ident, at, body, stop
        at = stop


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MatroskaError("bad float")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    lace: int


@dataclass
class Media:
    timestamp_scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[Packet] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    clusters: int = 0


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block."""
    if not kind:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError("block without lacing head")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("fixed lacing does not divide the block")
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("lacing is cut off")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at, _ = _read_vint(data, at, end)
        sizes.append(size or 0)
        for _ in range(n - 2):
            raw, at, width = _read_vint(data, at, end)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("laced frames are larger than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _track(data: bytes, a: int, b: int) -> dict:
    track: dict = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "default_ns": 0}
    for ident, _, x, y in _elements(data, a, b):
        if ident == 0xD7:
            track["number"] = _int(data, x, y)
        elif ident == 0x83:
            track["type"] = _int(data, x, y)
        elif ident == 0x86:
            track["codec"] = data[x:y].decode("latin-1")
        elif ident == 0x23E383:
            track["default_ns"] = _int(data, x, y)
        elif ident == 0xE1:
            for inner, _, p, q in _elements(data, x, y):
                if inner == 0xB5:
                    track["rate"] = _float(data, p, q)
                elif inner == 0x9F:
                    track["channels"] = _int(data, p, q)
                elif inner == 0x6264:
                    track["bits"] = _int(data, p, q)
    return track


def _add_block(media: Media, data: bytes, a: int, b: int, time: int, key: bool | None) -> None:
    number, at, _ = _read_vint(data, a, b)
    if number is None or at + 3 > b:
        raise MatroskaError("block head is cut off")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    step = next((_frame_ns(t) for t in media.tracks if t["number"] == number), None)
    stamp = (time + relative) * media.timestamp_scale
    for i, (offset, size) in enumerate(_laces(data, at + 3, b, flags >> 1 & 3)):
        media.packets.append(Packet(number, stamp, offset, size, bool(flags & 0x80) if key is None else key, media.clusters - 1, i))
        stamp += step(size) if step else 0


def _frame_ns(track: dict):
    if track["default_ns"]:
        return lambda _: track["default_ns"]
    wide = track["channels"] * track["bits"] // 8
    if track["codec"].startswith("A_PCM") and wide and track["rate"]:
        return lambda size: round(size // wide * 1e9 / track["rate"])
    return lambda _: 0


def parse(data: bytes) -> Media:
    """Tracks, packets (timestamp, track, byte range) and cues of a Matroska file."""
    media = Media()
    top = list(_elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MatroskaError("no EBML head")
    segment = next((x for x in top if x[0] == SEGMENT), None)
    if segment is None:
        raise MatroskaError("no segment")
    for ident, _, a, b in _elements(data, segment[2], segment[3]):
        if ident == INFO:
            for inner, _, x, y in _elements(data, a, b):
                if inner == 0x2AD7B1:
                    media.timestamp_scale = _int(data, x, y)
                elif inner == 0x4489:
                    media.duration = _float(data, x, y)
        elif ident == TRACKS:
            media.tracks += [_track(data, x, y) for inner, _, x, y in _elements(data, a, b) if inner == 0xAE]
        elif ident == CLUSTER:
            media.clusters += 1
            time = 0
            for inner, _, x, y in _elements(data, a, b):
                if inner == 0xE7:
                    time = _int(data, x, y)
                elif inner == 0xA3:
                    _add_block(media, data, x, y, time, None)
                elif inner == 0xA0:
                    parts = list(_elements(data, x, y))
                    for kind, _, p, q in parts:
                        if kind == 0xA1:
                            _add_block(media, data, p, q, time, all(k != 0xFB for k, *_ in parts))
        elif ident == CUES:
            for inner, _, x, y in _elements(data, a, b):
                if inner == 0xBB:
                    cue = {"time": 0, "track": 0, "cluster": 0}
                    for kind, _, p, q in _elements(data, x, y):
                        if kind == 0xB3:
                            cue["time"] = _int(data, p, q)
                        elif kind == 0xB7:
                            for k, _, r, s in _elements(data, p, q):
                                cue["track" if k == 0xF7 else "cluster" if k == 0xF1 else "other"] = _int(data, r, s)
                    cue["cluster"] += segment[2]
                    media.cues.append(cue)
    return media


# --- Spark -----------------------------------------------------------------------------


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))


def feature(media: Media, samples: np.ndarray) -> str:
    x = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.int32), dtype=np.float64)))
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};dur_ms={media.duration:.3f};mean={samples.mean(dtype=np.float64):.4f};rms={rms:.4f};zero_crossings={crossings};peak={int(np.abs(x).max())}"


PACKETS = "media_id bigint, track bigint, timestamp_ns bigint, offset bigint, size bigint, keyframe boolean, cluster int, lace int, error string"


def packet_table(files: DataFrame, id_col: str = "media_id", content: str = "content") -> DataFrame:
    """One row per packet of each file; a broken or null file gives one row with ``error``.

    The packets of one file are made one file at a time, so memory is bounded by the largest file.
    """

    def run(piece: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n.split()[0]: [] for n in PACKETS.split(", ")}
        for ident, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            try:
                rows = [(p.track, p.timestamp_ns, p.offset, p.size, p.keyframe, p.cluster, p.lace, None) for p in parse(data or b"").packets]
            except MatroskaError as e:
                rows = [(None,) * 7 + (str(e),)]
            for row in rows:
                for name, v in zip(out, (ident, *row)):
                    out[name].append(v)
        return out

    return by_chunk(files.select(F.col(id_col).alias("media_id"), F.col(content).alias("content")), run, PACKETS, "content")


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as Matroska audio, read it back and describe what was read.

    Null and empty texts are 64 zero bytes.  Equal texts give equal rows but for the id;
    repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(piece: pa.RecordBatch) -> dict:
        rows = []
        for ident, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            raw = text.encode("utf-8")
            stored = write_pcm(padded(raw))
            media = parse(stored)
            payload = b"".join([stored[p.offset : p.offset + p.size] for p in media.packets])
            rows.append((ident, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, np.frombuffer(payload, np.uint8))))
        return dict(zip([n.split()[0] for n in DIGEST.split(", ")], zip(*rows)))

    return by_chunk(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), run, DIGEST)
