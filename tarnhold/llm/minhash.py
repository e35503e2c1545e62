"""Document fingerprints: MinHash over word shingles in vectorised numpy.

A fingerprint is the minimum of each of ``PERMUTATIONS`` universal hashes (a * x + b, high bits)
over the text's shingles of five words, kept as 16 bits; the share of equal positions estimates
the Jaccard similarity.  ``near`` cuts fingerprints into bands, joins them in Spark and verifies the
Jaccard similarity on full sets.

``digest`` compares each text with the next one in descending order of doc_id without a global
window: rows are range partitioned and sorted once, each task streams its rows with one row of
look-ahead, and only the rows at the borders of partitions (two a partition) are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_chunk, chunks, materialize, text_of
from . import neardup
from .shingles import shingles

PERMUTATIONS, WIDTH, BAND = 64, 5, 4
_rng = np.random.default_rng(20240)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint as 16-bit numbers; all ones for an empty set."""
    out = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1024):
        hashes = _MUL * shingles[i : i + 1024]
        hashes += _ADD
        np.minimum(out, hashes.min(axis=1), out=out)
    # the low bits of the minimum are as good as random; the high ones are all near 0
    return (out >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    """Repeated shingles change no minimum, so they are not sorted out first."""
    return minima(shingles(text, WIDTH))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a non-empty set."""
    keys = np.ascontiguousarray(minima(shingles)).view(np.uint64)
    return keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(keys), dtype=np.uint64)


def hopeless(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """True where the likeness lies ``neardup.SLACK`` standard errors under the threshold or the sizes alone rule a link out."""
    limit = neardup.PERCENT / 100
    low = limit - neardup.SLACK * np.sqrt(limit * (1 - limit) / PERMUTATIONS)
    return ((a == b).mean(axis=-1) < low) | (100 * np.minimum(n, m) < neardup.PERCENT * np.maximum(n, m))


#: Fingerprints link texts by bands of ``BAND`` minima; they are all that is kept of a text besides its hash and size.
SIGNATURE = neardup.Signature(minima, PERMUTATIONS // BAND, BAND, hopeless)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and linked (whether another text is in its component) of every row.

    Signature bands are joined in Spark, and the pairs that share one are verified: texts are linked if the Jaccard similarity
    of their full sets of shingles is 0.8 or more.  A pair of that similarity shares one of 16 bands of 4 with a chance of
    0.9998.  Rows without words link with nothing, null ids are in no component.
    """
    rows = neardup.link(docs, WIDTH, signature=SIGNATURE)
    classes = rows.where("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg((F.count(F.lit(1)) > 1).alias("linked"))
    out = rows.join(classes, F.col("component") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("linked", F.lit(False)).alias("linked"))


COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_EDGES = COLUMNS + ", edge int, part int, text string"


def _hex(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def _row(ident: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    new = edited(text, following)
    other = fingerprint(new)
    return ident, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), _hex(own), _hex(other), likeness(own, other), likeness(own, after)


def _stream(batches):
    """Digests of all rows but the last; the first row (edge 1) and the last (edge 2) as they are."""
    part, before = TaskContext.get().partitionId(), None
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [*_NAMES, "edge", "part", "text"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def edge(ident, text, kind):
        return (ident, *[None] * 6, kind, part, text)

    for piece in chunks(batches, "text"):
        out = []
        for ident, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
            own = fingerprint(text)
            if before is None:
                out.append(edge(ident, text, 1))
            else:
                out.append((*_row(*before, text, own), 0, part, None))
            before = ident, text, own
        if out:
            yield batch(out)
    if before is not None:
        yield batch([edge(before[0], before[1], 2)])


def digest(docs: DataFrame) -> DataFrame:
    """``COLUMNS`` for every row; null texts are empty.

    The next row is the one with the next smaller doc_id (null ids last, ties by a hash of the
    text, so repeated rows follow each other); after the last comes the first.  A lone row
    follows itself.  Texts without words have equal fingerprints.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("hash")
    made = materialize(ranged.mapInArrow(_stream, _EDGES))
    heads = made.where("edge = 1").select(F.col("part").alias("head"), F.col("text").alias("following"))
    # one row per partition
    after = F.coalesce(F.lead("head").over(Window.orderBy("head")), F.min("head").over(Window.partitionBy()))
    steps = heads.select(F.col("head").alias("part"), after.alias("head"))
    tails = made.where("edge = 2").select("doc_id", "text", "part").join(steps, "part").join(heads.hint("merge"), "head")  # heads hold whole texts

    def run(piece: pa.RecordBatch) -> dict:
        got = [_row(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in zip(*[piece.column(k).to_pylist() for k in range(3)])]
        return dict(zip(_NAMES, zip(*got)))

    return made.where("edge = 0").select(*_NAMES).unionByName(by_chunk(tails.select("doc_id", "text", "following"), run, COLUMNS))
