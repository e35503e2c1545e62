"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities.

Documents are packed where they lie: a task takes those of its partition in stretches of
``DOCS_PER_SHARD`` documents or ``TOKENS_PER_SHARD`` tokens, whatever comes first.  Nothing is
shuffled and no key decides where a row goes, so no document or id, however often it is repeated,
makes a task larger; memory is bounded by a stretch and one text, and a lost executor repeats a
partition, whose rows come out together or not at all.

A document longer than ``LENGTH`` tokens is split into full rows and a rest, so nothing is lost.
Pieces go in descending order of size into the fullest row that still holds them: a segment tree
over remaining capacities, each leaf the number of open rows with that capacity, finds the
smallest sufficient capacity in O(log LENGTH).

A packed row is a row of the id matrix: its ids (padded to ``LENGTH`` in files), cumulative
segment lengths (from 0 on) and, for each segment, the document and the place in the document
where it starts; positions reset at every segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_of

LENGTH, DOCS_PER_SHARD, TOKENS_PER_SHARD, PAD = 2048, 512, 1 << 20, 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("tarnhold", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text; decoding them gives the text again."""
    ids = tokenizer(path).encode_ordinary(text)
    return np.array(ids, np.uint16)


class CapacityTree:
    """Open rows by remaining capacity; the smallest capacity of at least ``size`` in O(log n)."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << max(1, length.bit_length())
        self.counts = [0] * (2 * self.leaves)
        self.rows: dict[int, deque[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, deque()).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.counts[i] += by
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and gives (capacity, row) of the best fit, the row that came to this capacity first among equals."""
        i = size + self.leaves
        while not self.counts[i]:
            # up to the first right neighbour with rows, then down to its leftmost leaf
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if self.counts[i]:
                while i < self.leaves:
                    i = 2 * i + (not self.counts[2 * i])
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].popleft()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes of ``sizes`` (each 1 to ``length``); ties go by index."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        if got is None:
            got = length, len(rows)
            rows.append([])
        capacity, row = got
        rows[row].append(i)
        if capacity > sizes[i]:
            tree.add(capacity - sizes[i], row)
    return rows


ROWS = "shard bigint, pack bigint, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, ids binary, ids_sha256 string, positions binary"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.string(), pa.binary()]


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a row of ``length``: from 0 on in every segment, 0 in the padding."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def _packed(shard: int, docs: list[tuple[int | None, np.ndarray]], length: int) -> Iterator[pa.RecordBatch]:
    """The packed rows of one stretch of documents."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1].tobytes()))
    pieces = [(d, at, min(length, len(ids) - at)) for d, (_, ids) in enumerate(docs) for at in range(0, len(ids), length)]
    packed = best_fit_decreasing([n for _, _, n in pieces], length)
    for begin in range(0, len(packed), 256):
        out = []
        for number, row in enumerate(packed[begin : begin + 256], begin):
            parts = [pieces[i] for i in row]
            ids = np.concatenate([docs[d][1][at : at + n] for d, at, n in parts]).astype("<u2").tobytes()
            ends = np.cumsum([0] + [n for _, _, n in parts]).tolist()
            positions = position_ids(ends, ends[-1]).astype("<u2").tobytes()
            out.append((shard, number, ends[-1], [docs[d][0] for d, _, _ in parts], [at for _, at, _ in parts], ends, ids, hashlib.sha256(ids).hexdigest(), positions))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)


def pack(docs: DataFrame, length: int = LENGTH, docs_per_shard: int = DOCS_PER_SHARD, path: str = VOCABULARY) -> DataFrame:
    """``ROWS``: one row per packed row.  ids, and positions that begin anew at every segment, are little-endian 16-bit
    numbers without padding; ``length`` is at most 65,536.

    Null and empty texts have no tokens and are in no row.  A null id is a null in ``doc_ids``.
    Repeated rows are packed as often as they occur.  An empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's stretches are numbered within it
        shard, held, tokens = TaskContext.get().partitionId() << 32, [], 0
        for piece in chunks(batches, "text"):
            for ident, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                held.append((ident, encode(text, path)))
                tokens += len(held[-1][1])
                if len(held) >= docs_per_shard or tokens >= TOKENS_PER_SHARD:
                    yield from _packed(shard, held, length)
                    shard, held, tokens = shard + 1, [], 0
        yield from _packed(shard, held, length)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).where("text <> ''")
    return rows.mapInArrow(run, ROWS)


def write_matrices(packed: DataFrame, folder: str, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """Writes the rows as files of bytes in a folder all executors share, one row of the table per shard.

    A shard's record has its padded id matrix, its position matrix and its cumulative segment
    lengths as ``.npy`` bytes; Spark's commit protocol makes the write all or nothing.
    """
    import io

    def npy(a: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pack")
        ids = np.full((t.num_rows, length), pad, np.uint16)
        positions = np.zeros((t.num_rows, length), np.int32)
        cu = t.column("cu_seqlens").to_pylist()
        for i, row in enumerate(t.column("ids").to_pylist()):
            own = np.frombuffer(row, "<u2")
            ids[i, : len(own)] = own
            positions[i] = position_ids(cu[i], length)
        flat = np.array([x for row in cu for x in row], np.int32)
        index = np.cumsum([0] + [len(row) for row in cu]).astype(np.int64)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "ids": [npy(ids)], "positions": [npy(positions)], "cu_seqlens": [npy(flat)], "cu_index": [npy(index)]})

    made = packed.groupBy("shard").applyInArrow(run, "shard bigint, ids binary, positions binary, cu_seqlens binary, cu_index binary")
    made.write.parquet(folder)
    return packed.sparkSession.read.parquet(folder)
