"""Quality classifier and language ID: exactness of inference and accuracy on held-out rows."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tarnhold.llm import langid, quality

from .conftest import SF10


def test_forward_backward():
    rng = np.random.default_rng(0)
    scores, trans, counts = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([1, 4, 2])
    marginal, pairs, logz = quality.forward_backward(scores, counts, trans)
    at, total = 0, np.zeros((2, 2))
    for n, z in zip(counts, logz):
        paths = list(itertools.product([0, 1], repeat=int(n)))
        w = np.array([np.exp(sum(scores[at + i] for i in range(n) if p[i]) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        assert np.isclose(np.log(w.sum()), z)
        for i in range(n):
            assert np.isclose(marginal[at + i], sum(x for x, p in zip(w, paths) if p[i]) / w.sum())
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += x / w.sum()
        at += n
    assert np.allclose(total, pairs)


def test_quality(spark, edges, empty):
    docs, labels = spark.read.parquet(f"{SF10}/documents.parquet"), spark.read.parquet(f"{SF10}/labels.parquet")
    model = quality.train(docs, quality.trainable(labels))
    got = quality.predict(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    pos, neg = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    print("held-out accuracy", right, "AUC", auc)
    assert auc > 0.85 and right > 0.75
    rows = quality.predict(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.predict(empty, model).count() == 0
    assert quality.predict(edges, quality.train(empty, labels)).count() == edges.count()


def test_language(spark, edges, empty):
    docs = spark.read.parquet(f"{SF10}/documents.parquet")
    model = langid.train(langid.trainable(docs))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    right = np.mean([r.lang_pred == r.lang for r in got if r.lang_pred != "und"])
    print("held-out accuracy", right)
    assert right > 0.9
    rows = langid.predict(edges, model).collect()
    assert len(rows) == edges.count() and {r.doc_id: r.lang_pred for r in rows}[3] == "und"
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.accepted(edges, model)
    assert kept.columns == edges.columns and {3, 4, 6}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.predict(empty, langid.train(empty)).count() == 0


def plain_features(text):
    """The 19 features of every line, in plain Python."""
    marks = [".,;:'\"-()?", "!", "|", "#$%&*@^~", "<>{}[]\\/_=+`"]
    sets = [set(map(chr, range(97, 123))), set(map(chr, range(65, 91))), set("0123456789"), set(" \t\r\x0b\x0c"), *map(set, marks)]
    out, seen = [], set()
    for line in text.split("\n"):
        n_bytes, words = len(line.encode()), line.split()
        counts = [sum(c in s for c in line) for s in sets]
        counts.append(n_bytes - sum(counts))
        size, n = max(1, n_bytes), max(1, len(words))
        row = [math.sqrt(c / size) for c in counts]
        row += [math.log1p(size) / 8, min(size / n, 30) / 10, len(set(words)) / n, float(line in seen and len(words) > 0), min(max(map(len, words), default=0), 60) / 20]
        row += [sum(w.isupper() for w in words) / n, min(sum(counts[5:9]) / n, 3), float(not words), math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n)]
        out.append((row, size))
        seen.add(line)
    return out


def plain_score(model, text):
    """Score of a text: enumerated marginals, weighted mean and least good tenth, curve."""
    rows = plain_features(text)
    k = len(rows)
    pad = [0.0] * quality.OWN
    x = [rows[i][0] + (rows[i - 1][0] if i else pad) + (rows[i + 1][0] if i + 1 < k else pad) + [float(i == 0), float(i == k - 1), 1.0] for i in range(k)]
    score = [sum(a * b for a, b in zip(r, model.weights)) for r in x]
    weights = {}
    for path in itertools.product([0, 1], repeat=k):
        weights[path] = math.exp(sum(score[i] for i in range(k) if path[i]) + sum(model.trans[a][b] for a, b in zip(path, path[1:])))
    total = sum(weights.values())
    good = [min(max(sum(w for p, w in weights.items() if p[i]) / total, 1e-4), 1 - 1e-4) for i in range(k)]
    sizes = [s for _, s in rows]
    mean = sum(g * s for g, s in zip(good, sizes)) / sum(sizes)
    left, worst = 0.1 * sum(sizes), 0.0
    for g, s in sorted(zip(good, sizes)):
        worst += g * min(s, left)
        left = max(0.0, left - s)
    worst /= 0.1 * sum(sizes)
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / min(max(1 - p, 1e-4), 1))
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * logit(mean) + model.curve[2] * logit(worst))))


def test_quality_against_brute_force(spark):
    texts = ["One good line of words.\nTHE SAME\nTHE SAME\n\nfive 55 five!", "", "\n", "a", "\u00fc\u00df \u4e2d\u6587 | x||y # <b>\ttab", "word word word\nWORD 1 2 3\n" + "z" * 70, "\n".join("line %d of ten" % i for i in range(9))]
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=3 * quality.OWN + 3), rng.normal(size=(2, 2)), np.array([0.3, 1.1, -0.4]))
    features, size, counts = quality.line_features(texts)
    plain = [row for t in texts for row in plain_features(t)]
    assert np.allclose(features, [r for r, _ in plain]) and np.allclose(size, [s for _, s in plain]) and counts.tolist() == [t.count("\n") + 1 for t in texts]
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.predict(docs, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain_score(model, t) for t in texts])


def test_quality_training_passes_over_what_does_not_fit(spark):
    """A giant text, wherever it stands in the order of the sample, costs the training nothing but itself."""
    good = [(i, f"A calm sentence about river number {i} and its banks.\nAnother one follows it, quite as calm.", 1) for i in range(60)]
    bad = [(100 + i, "BUY NOW!!! $$$ %d\nclick click click click" % i, 0) for i in range(60)]
    giants = [(1000 + i, "x\n" * 500, i % 2) for i in range(40)]
    rows = good + bad + giants
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "Another calm text of the same number.")] + [(3, t) for i, t, _ in rows if i == 3], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels, lines=400)
    assert np.abs(model.weights).sum() > 0
    got = {r.doc_id: r.score for r in quality.predict(docs.where("doc_id < 100 OR doc_id > 100 AND doc_id < 200"), model).collect()}
    assert min(got[i] for i, _, _ in good) > max(got[i] for i, _, _ in bad if i > 100)
    assert np.allclose(model.weights, quality.train(docs.repartition(3), labels, lines=400).weights)


def plain_histogram(text):
    data = b" " + b" ".join(bytes(32 if b < 128 and not chr(b).isalpha() else b for b in text.encode().lower()).split()) + b" "
    out, m = np.zeros(langid.BINS), 0xFFFFFFFF
    put = lambda h: (((h ^ h >> 15) * 0x2C1B3C6D & m) >> 20)
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & m for a, b in zip(data, data[1:])]
    for h in two + [(h * 0xC2B2AE3D + c * 0x27D4EB2F) & m for h, c in zip(two, data[2:])]:
        out[put(h)] += 1
    return out


def test_language_against_brute_force(spark, monkeypatch):
    """Every gram counted in plain Python, also across the pieces of a long text; probability and language from the whole model."""
    texts = ["Der Fluss ist breit.", "el ni\u00f1o come", "a", "\u4e2d\u6587 words", "\u00b2", "12 34", "", None, "\u00aa", "x" * 50, "The  quick\nbrown 7 fox " * 9]
    for t in filter(None, texts):
        assert np.array_equal(langid.histogram(t), plain_histogram(t)), t
    monkeypatch.setattr(langid, "_PIECE", 16)
    for t in filter(None, texts):
        assert np.array_equal(langid.histogram(t), plain_histogram(t)), t
    monkeypatch.undo()
    rng = np.random.default_rng(1)
    model = langid.Model(["de", "en", "es"], rng.normal(size=(langid.BINS, 3)) * 5, np.array([0.1, 0.2, 0.3]), 1.7, 0.4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in langid.predict(docs, model).collect():
        t = texts[r.doc_id]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True), t
            continue
        h = plain_histogram(t)
        z = [sum(h[b] * model.table[b, k] for b in np.flatnonzero(h)) / h.sum() + model.bias[k] for k in range(3)]
        p = [math.exp(x / 1.7) for x in z]
        assert r.lang_pred == model.langs[int(np.argmax(p))] and abs(r.score - max(p) / sum(p)) < 1e-9 and r.rejected == (r.score < 0.4)


def test_language_training_is_stable(spark):
    """Rows that share an id, and more rows than the sample, give the same model from any partitioning."""
    rows = [(i % 7, f"ein deutscher satz {i}" if i % 2 else f"an english phrase {i}", "de" if i % 2 else "en") for i in range(90)] + [(3, "an english phrase", "en")] * 30
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, two = (langid.train(d, sample=40) for d in (docs.coalesce(1), docs.repartition(5, F.rand(3))))
    assert np.array_equal(one.table, two.table) and one.threshold == two.threshold
