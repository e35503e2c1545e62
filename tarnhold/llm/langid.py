"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte 2- and 3-grams, followed by a
linear layer and a softmax, trained by stochastic gradient descent in numpy.  As mean and
layer are both linear, a trained model is folded into one table of logits per hashed gram,
so that scoring a text is one histogram and one small product.

A temperature, fitted on a part of the sample that the descent does not see, calibrates the
probabilities; a text is *rejected* if its calibrated probability is under a threshold that
nearly all of that part passes, if it has no letter, or if it is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, remainder

BINS, DIM = 4096, 16
_SPACED = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))
_PIECE = 1 << 20


def histogram(text: str) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of the text's bytes, words apart from each other."""
    data = b" " + b" ".join(text.encode("utf-8").lower().translate(_SPACED).split()) + b" "
    out = np.zeros(BINS, np.float64)
    for at in range(0, len(data), _PIECE):  # pieces overlap by what a gram reaches over
        a = np.frombuffer(data, np.uint8, min(_PIECE + 2, len(data) - at), at).astype(np.uint32)
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
        if at + _PIECE < len(data):
            two = two[:_PIECE]
        for h in (two, three[:_PIECE]):
            out += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=BINS)
    return out


def has_letter(text: str) -> bool:
    """True if a character is of a Unicode letter category (digits, also raised ones, and marks are not)."""
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BINS, langs): embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, hist: np.ndarray) -> np.ndarray:
        return hist @ self.table / max(1.0, hist.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, rejected."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        p = softmax(self.logits(histogram(text)) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(hists: np.ndarray, langs: list[str], epochs: int = 25, rate: float = 4.0, seed: int = 7) -> Model:
    """Train on histograms (one row per text); a fifth of them is kept for the calibration."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BINS, 0)), np.zeros(0))
    y = np.searchsorted(names, langs)
    rng = np.random.default_rng(seed)
    x = (hists / np.maximum(1, hists.sum(axis=1, keepdims=True))).astype(np.float32)
    order = rng.permutation(len(y))
    held, seen = order[: len(y) // 5], order[len(y) // 5 :]
    emb = rng.normal(0, 1, (BINS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        lr = np.float32(rate * (1 - epoch / epochs))
        rng.shuffle(seen)
        for i in range(0, len(seen), 32):
            k = seen[i : i + 32]
            mean = x[k] @ emb
            grad = softmax(mean @ layer + bias)
            grad[np.arange(len(k)), y[k]] -= 1
            grad /= len(k)
            back = grad @ layer.T
            layer -= lr * (mean.T @ grad)
            bias -= lr * np.float32(0.1) * grad.sum(axis=0)
            emb -= lr * np.float32(20) * (x[k].T @ back)
    model = Model(names, (emb @ layer).astype(np.float64), bias.astype(np.float64))
    if len(held):
        z = x[held].astype(np.float64) @ model.table + model.bias
        true = (np.arange(len(held)), y[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[true] + 1e-12).mean()))
        model.threshold = float(min(0.5, np.quantile(softmax(z / model.temperature).max(axis=1), 0.002)))
    return model


def train(labelled: DataFrame, sample: int = 3000, seed: int = 7) -> Model:
    """Fit on a bounded sample: the ``sample`` rows of ``labelled`` with the smallest seeded hash of their id
    (rows that share an id: by the hash of their text, then by language).

    ``labelled`` has doc_id, text and a non-null lang.  The texts become histograms on the
    executors, and the driver gets their bins that are not empty: ``sample`` rows of at most ``BINS``
    entries, however long the texts are.
    """
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), F.xxhash64("text").alias("t"), F.col("lang")]
    last = labelled.select(*order).orderBy("h", "t", "lang").limit(sample).agg(F.max(F.struct("h", "t", "lang"))).first()[0]
    if last is None:
        return fit(np.zeros((0, BINS)), [])

    def run(piece: pa.RecordBatch) -> dict:
        hists = [histogram(t or "") for t in piece.column(3).to_pylist()]
        bins = [np.flatnonzero(x) for x in hists]
        return {"h": piece.column(0), "t": piece.column(1), "lang": piece.column(2), "bins": [b.astype("<u2").tobytes() for b in bins], "counts": [x[b].astype("<f4").tobytes() for x, b in zip(hists, bins)]}

    upto = F.struct(*order) <= F.struct(F.lit(last.h).alias("h"), F.lit(last.t).cast("bigint").alias("t"), F.lit(last.lang).alias("lang"))
    made = by_chunk(labelled.where(upto).select(*order, "text"), run, "h bigint, t bigint, lang string, bins binary, counts binary")
    rows = made.orderBy("h", "t", "lang").limit(sample).collect()  # rows beyond the bound are copies of the last one
    hists = np.zeros((len(rows), BINS), np.float32)
    for i, r in enumerate(rows):
        hists[i, np.frombuffer(r.bins, "<u2")] = np.frombuffer(r.counts, "<f4")
    return fit(hists, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row; ``und`` for null texts and texts without a letter.

    Repeated rows give repeated rows, an empty table an empty one.
    """
    held = (F.coalesce(remainder(3), F.lit(0)) == 1).alias("held_out")

    def run(piece: pa.RecordBatch) -> dict:
        got = [model.predict(t) for t in piece.column(2).to_pylist()]
        return {"doc_id": piece.column(0), "held_out": piece.column(1), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    return by_chunk(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def trainable(docs: DataFrame) -> DataFrame:
    """The rows whose language may be learned: lang known, crc32 of the id not 1 modulo 3."""
    return docs.where(F.col("lang").isNotNull() & (F.coalesce(remainder(3), F.lit(1)) != 1)).select("doc_id", "text", "lang")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, but those whose language is rejected."""
    at = docs.columns.index("text")

    def run(batches):
        from .common import chunks

        for piece in chunks(batches, "text"):
            keep = [not model.predict(t)[2] for t in piece.column(at).to_pylist()]
            yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
