"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of character classes, word statistics and whether the text said the
line before; the field also sees those of the lines before and after it.  Only texts are labelled,
so training is in two rounds: first every line has its text's label, then a line of a bad text
counts as good where the first field finds it so.  Forward-backward gives each line's marginal;
their mean, weighted by the lines' lengths, and the least good tenth of the text go through a
logistic curve, fitted on the same sample, that makes them a score.

Forward-backward runs over many texts at once; texts are ordered by their number of lines so that
each step works on those that still have one.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, remainder, text_of

THRESHOLD = 0.7
_CLASS = np.full(256, 9, np.uint8)  # 9: other bytes, as of letters beyond ASCII
for _k, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"-()?", b"!", b"|", b"#$%&*@^~", b"<>{}[]\\/_=+`"]):
    _CLASS[np.frombuffer(_set, np.uint8)] = _k
_CLASSES, OWN = 10, 19


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (one row per line of all texts), lengths of the lines, lines per text."""
    lines: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    extra: list[tuple] = []
    for i, text in enumerate(texts):
        own, seen = text.split("\n"), set()
        counts[i] = len(own)
        lines += own
        for line in own:
            words = line.split()
            n = len(words)
            extra.append((n, len(set(words)), line in seen and n > 0, max(map(len, words), default=0), sum(map(str.isupper, words)), sum(map(eq, words, words[1:]))))
            seen.add(line)
    data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    owner = np.cumsum(data == 10) - (data == 10)
    table = np.bincount(owner * _CLASSES + _CLASS[data], minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES).astype(np.float64)
    size = np.maximum(1, table.sum(axis=1) - 1)  # without the line's end
    table[:, 9] -= 1
    e = np.asarray(extra, np.float64).reshape(-1, 6)
    n = np.maximum(1, e[:, 0])
    marks = table[:, 5:9].sum(axis=1)
    features = np.column_stack([
        np.sqrt(table / size[:, None]),
        np.log1p(size) / 8, np.minimum(size / n, 30) / 10, e[:, 1] / n, e[:, 2], np.minimum(e[:, 3], 60) / 20, e[:, 4] / n, np.minimum(marks / n, 3), e[:, 0] == 0, np.sqrt(e[:, 5] / n),
    ])
    return features, size, counts


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros beyond the text), a constant and marks of both ends."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    ends = np.cumsum(counts)
    first, last = np.zeros(len(features)), np.zeros(len(features))
    first[ends - counts], last[ends - 1] = 1, 1
    before[first == 1] = 0
    after[last == 1] = 0
    return np.column_stack([features, before, after, first, last, np.ones(len(features))])


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(scores: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) per line, expected transitions (2 x 2, summed), log of the partition sum per text.

    ``scores`` is the score of "good" against "bad" of each line.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more than t lines
    bad, good = np.zeros(len(scores)), np.zeros(len(scores))
    for t in range(steps):
        at = starts[: active[t]] + t
        if t:
            b, g = bad[at - 1], good[at - 1]
            bad[at] = _lse(b + trans[0, 0], g + trans[1, 0])
            good[at] = _lse(b + trans[0, 1], g + trans[1, 1]) + scores[at]
        else:
            good[at] = scores[at]
    ends = np.cumsum(counts) - 1
    logz = _lse(bad[ends], good[ends])
    owner = np.repeat(np.arange(len(counts)), counts)
    after_bad, after_good = np.zeros(len(scores)), np.zeros(len(scores))
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b, g = after_bad[at + 1], after_good[at + 1] + scores[at + 1]
        after_bad[at] = _lse(trans[0, 0] + b, trans[0, 1] + g)
        after_good[at] = _lse(trans[1, 0] + b, trans[1, 1] + g)
    marginal = np.exp(good + after_good - logz[owner])
    inner = np.ones(len(scores), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for i, x in enumerate((bad, good)):
        for j, y in enumerate((after_bad, after_good + scores)):
            pairs[i, j] = np.exp(x[at] + trans[i, j] + y[at + 1] - logz[owner[at]]).sum()
    return marginal, pairs, logz


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    curve: np.ndarray  # of (1, logit of the mean, logit of the worst tenth)

    def lines(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward_backward(with_neighbours(features, counts) @ self.weights, counts, self.trans)[0]

    def evidence(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = np.clip(self.lines(features, counts), 1e-4, 1 - 1e-4)
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(size, starts)
        mean = np.add.reduceat(good * size, starts) / total
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((good, owner))
        upto = np.cumsum(size[order])
        upto -= (upto[starts] - size[order][starts])[owner]
        tenth = np.clip(0.1 * total[owner] - (upto - size[order]), 0, size[order])
        worst = np.add.reduceat(tenth * good[order], starts) / (0.1 * total)
        logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))
        return np.column_stack([np.ones(len(counts)), logit(mean), logit(worst)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.evidence(*line_features(texts)) @ self.curve))


def _adam(params: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, steps + 1):
        g = gradient(params)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - rate * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return params


def _field(x: np.ndarray, y: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """Weights and transitions that make the labels ``y`` of the lines likeliest (with a small penalty)."""
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    k, n = x.shape[1], len(y)

    def gradient(p: np.ndarray) -> np.ndarray:
        marginal, pairs, _ = forward_backward(x @ p[:k], counts, p[k:].reshape(2, 2))
        return np.concatenate([x.T @ (marginal - y) / n + 1e-4 * p[:k], ((pairs - seen) / n).ravel() + 1e-3 * p[k:]])

    return _adam(start, gradient, steps, 0.1)


def fit(features: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = 120) -> Model:
    """Train on the lines of labelled texts; without texts of both labels every score is their share (0.5 without any)."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(3 * OWN + 3), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    x = with_neighbours(features, counts)
    y = np.repeat(labels.astype(np.float64), counts)
    p = _field(x, y, counts, np.zeros(x.shape[1] + 4), steps)
    k = x.shape[1]
    good = forward_backward(x @ p[:k], counts, p[k:].reshape(2, 2))[0]
    p = _field(x, np.where((y == 0) & (good > 0.7), 1.0, y), counts, p, steps)
    model = Model(p[:k], p[k:].reshape(2, 2), np.zeros(3))
    e = model.evidence(features, size, counts)

    def gradient(c: np.ndarray) -> np.ndarray:
        g = e.T @ (1 / (1 + np.exp(-e @ c)) - labels) / len(labels) + 1e-4 * c
        return g

    model.curve = _adam(np.array([0.0, 1.0, 0.0]), gradient, 400, 0.05)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, lines: int = 400_000, seed: int = 11) -> Model:
    """Fit on a bounded sample: of ``labels`` (doc_id, quality) the ``sample`` rows with the smallest seeded hash.

    Features are made on the executors; the driver gets those of ``lines`` lines at most (19 numbers of 4 bytes each), so its
    memory has a bound.  In the order of that hash, a text whose lines do not fit in what is left is passed over, and the
    next ones still count.  Rows that share an id are different texts; repeated rows count once.
    """
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality"), order.alias("h")).orderBy("h", "quality").limit(sample)
    # at most ``sample`` rows of 20 bytes
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    rows = rows.select("h", F.xxhash64("text").alias("t"), "quality", "text")
    counted = rows.select("h", "t", "quality", (F.regexp_count("text", F.lit("\n")) + 1).alias("n")).distinct().orderBy("h", "t", "quality").limit(sample).collect()
    taken, left = [], lines
    for r in counted:
        if r.n <= left:
            taken.append((r.h, r.t, r.quality))
            left -= r.n

    def run(piece: pa.RecordBatch) -> dict:
        out = [line_features([t]) for t in piece.column(3).to_pylist()]
        return {"h": piece.column(0), "t": piece.column(1), "quality": piece.column(2), "n": [len(s) for _, s, _ in out], "f": [f.astype(np.float32).tobytes() for f, _, _ in out], "s": [s.astype(np.float32).tobytes() for _, s, _ in out]}

    if not taken:
        return fit(np.zeros((0, OWN)), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    keep = F.broadcast(docs.sparkSession.createDataFrame(taken, "h bigint, t bigint, quality int"))
    once = rows.join(keep, ["h", "t", "quality"]).groupBy("h", "t", "quality").agg(F.first("text").alias("text"))
    made = by_chunk(once, run, "h bigint, t bigint, quality int, n int, f binary, s binary")
    got = sorted(made.collect(), key=lambda r: (r.h, r.t, r.quality))
    features = np.concatenate([np.frombuffer(r.f, np.float32).reshape(-1, OWN) for r in got]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r.s, np.float32) for r in got]).astype(np.float64)
    return fit(features, size, np.array([r.n for r in got], np.int64), np.array([r.quality for r in got], np.float64))


def trainable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned: crc32 of the id is not 2 modulo 4."""
    return labels.where(F.coalesce(remainder(4), F.lit(2)) != 2).select("doc_id", "quality")


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; null texts are empty, and an empty text is one empty line.

    Repeated rows give repeated rows, an empty table an empty one.
    """
    held = (F.coalesce(remainder(4), F.lit(0)) == 2).alias("held_out")

    def run(piece: pa.RecordBatch) -> dict:
        score = model.scores([t or "" for t in piece.column(2).to_pylist()])
        return {"doc_id": piece.column(0), "held_out": piece.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return by_chunk(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text"), run, "doc_id bigint, held_out boolean, score double, predicted int")
