"""Near-duplicates and fingerprints against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnhold.llm import minhash, neardup
from tarnhold.llm.shingles import shingle_set, shingles


def word_sets(rows, width):
    out = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def classes(rows, width):
    sets, up = word_sets(rows, width), {r.doc_id: r.doc_id for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (r, a), (s, b) in itertools.combinations(zip(rows, sets), 2):
        if a and b and r.doc_id is not None and s.doc_id is not None and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((top(r.doc_id), top(s.doc_id)))
            up[y] = x
    return {(r.doc_id, len(s), None if r.doc_id is None else top(r.doc_id)) for r, s in zip(rows, sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_classes(spark, small, width):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.digest(small, width).collect()}
    assert got == classes(small.collect(), width)


def test_many_like_texts(spark):
    """Chains and families that band together without all being alike."""
    rng = np.random.default_rng(1)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        words = list(base)
        for j in rng.choice(120, i // 4, replace=False):
            words[j] = f"v{i}_{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.digest(docs, 2).collect()}
    assert got == classes(docs.collect(), 2)


def test_edges(edges, empty):
    got = neardup.digest(edges, 2).collect()
    assert len(got) == edges.count()
    part = {r.doc_id: r.component_id for r in got}
    assert part[2] == 1 and part[3] == 3 and part[4] == 4 and part[6] == 6 and part[None] is None
    edges = edges.withColumns({k: F.lit(1) for k in ("row", "n", "component", "component_id", "least", "times", "first", "regs", "keys", "n_shingles")})
    kept = neardup.deduplicated(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None]))
    assert neardup.digest(empty, 2).count() == 0


def test_bands_of_fingerprints(small):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(small, 5, minhash.band_keys).collect()}
    assert got == classes(small.collect(), 5)


def test_estimate():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        b = np.concatenate([a[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share), dtype=np.uint64)])
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        x, y = neardup.registers(np.unique(a)), neardup.registers(np.unique(b))
        assert abs(float(neardup.corrected((x == y).mean(), np.array(4000), np.array(4000))) - true) < 0.12
        assert not neardup.hopeless(x, x, np.array(4000), np.array(4000))


def check_fingerprints(docs):
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    got = sorted(minhash.digest(docs).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(got) == len(rows)
    for r, g, nxt in zip(rows, got, [*rows[1:], rows[0]]):
        text, after = r.text or "", nxt.text or ""
        k = len(text) // 3
        new = text[: len(text) - k] + after[:k]
        assert g.doc_id == r.doc_id and g.n_chars == len(text)
        assert g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, other, follow = (minhash.fingerprint(t) for t in (text, new, after))
        assert g.near_edited == pytest.approx(minhash.likeness(own, other)) and g.near_next == pytest.approx(minhash.likeness(own, follow))


def test_fingerprints(small, edges, empty):
    check_fingerprints(small)
    check_fingerprints(edges)
    assert minhash.digest(empty).count() == 0


def test_likeness_is_jaccard():
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 900)]
    a, b = " ".join(words), " ".join(words[:600] + [f"z{i}" for i in range(300)])
    x, y = set(shingle_set(a, 5).tolist()), set(shingle_set(b, 5).tolist())
    assert abs(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - len(x & y) / len(x | y)) < 0.2


def test_rows_that_share_an_id(spark):
    """Different texts of one id are different documents: both stay, however they are dealt, and near copies of each go."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x"), (5, b, "y"), (5, a, "x"), (6, a + " more", "z"), (7, b + " more", "z"), (5, b + " else", "w"), (None, a, "n"), (None, a, "n"), (8, "", "e"), (8, "", "e"), (9, None, None)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
        kept = sorted((str(r.doc_id), (r.text or "")[:2], r.source or "") for r in neardup.deduplicated(docs).collect())
        near = [r for r in kept if r[:2] == ("5", "b0")]
        assert len(near) == 1 and near[0][2] in ("y", "w")
        assert [r for r in kept if r not in near] == sorted([("5", "a0", "x"), ("8", "", "e"), ("8", "", "e"), ("9", "", ""), ("None", "a0", "n"), ("None", "a0", "n")])
        digest = sorted((str(r.doc_id), r.component_id, r.kept) for r in neardup.digest(docs, 5).where("doc_id IN (6, 7)").collect())
        assert digest == [("6", 5, False), ("7", 5, False)]


def test_common_counts():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(40)]
    got = neardup.common_counts(sets[:15], sets[15:], columns=32)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:15]) for j, b in enumerate(sets[15:]))


def test_open_buckets_in_small_blocks(spark, monkeypatch):
    """With blocks of a few nodes every pair of blocks is still compared: no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "WEIGHT", 400)
    monkeypatch.setattr(neardup, "SLICE", 150)
    rng, rows = np.random.default_rng(12), []
    for i in range(50):
        words = [f"w{j}" for j in range(80)]
        for j in rng.choice(80, i // 5, replace=False):
            words[j] = f"v{i}_{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.digest(docs, 2).collect()}
    assert got == classes(docs.collect(), 2)


def test_links_of_fingerprints(spark, small, edges, empty):
    """Bands of fingerprints joined and verified, against all pairs."""
    rows = small.collect()
    want = classes(rows, 5)
    size = {}
    for _, n, c in want:
        size[c] = size.get(c, 0) + 1
    got = {(r.doc_id, r.n_shingles, r.component_id, r.linked) for r in minhash.near(small).collect()}
    assert got == {(i, n, c, n > 0 and size[c] > 1) for i, n, c in want} and any(r[3] for r in got)
    assert minhash.near(edges).count() == edges.count() and minhash.near(empty).count() == 0


@pytest.mark.parametrize("signature", [neardup.REGISTERS, minhash.SIGNATURE])
def test_bands_are_cut_from_signatures(spark, small, signature):
    """Nodes share a key where they share a band, and a set leaves nothing but its signature."""
    signed = neardup.sign(small, 5, signature=signature)
    nodes = neardup._nodes(signed)
    kept = {r.node: bytes(r.regs) for r in nodes.select("node", "regs").collect()}
    assert signed.where("keys IS NOT NULL").isEmpty() and {len(x) for x in kept.values()} == {256 * 2 if signature is neardup.REGISTERS else 128}
    bands, by_key, by_band = 2 * signature.rows, {}, {}
    for r in neardup._keys_of(nodes, signature, False).collect():
        by_key.setdefault(r.key, set()).add(r.node)
    for node, x in kept.items():
        for i in range(signature.bands):
            by_band.setdefault((i, x[i * bands : (i + 1) * bands]), set()).add(node)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_band.values())) and any(len(x) > 1 for x in by_key.values())


def test_what_is_not_asked_for_is_not_shuffled(spark):
    """The filter before a join keeps every number that is known and few others."""
    rows = spark.range(-20_000, 20_000).toDF("key")
    known = rows.where("key % 100 = 7 OR key IN (-20000, -1, 0, 19999)")
    got = {r.key for r in neardup._among(rows, known, "key").collect()}
    want = {r.key for r in known.collect()}
    assert want <= got and len(got) < len(want) + 40
    assert neardup._among(rows, known.limit(0), "key").isEmpty()


def test_hopeless_fingerprints():
    rng = np.random.default_rng(8)
    for n in (5, 40, 900):
        both, rest = rng.integers(0, 2**63, 4 * n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = minhash.minima(both), minhash.minima(np.concatenate([both, rest]))  # similarity 0.8
        assert not minhash.hopeless(a, b, np.array(4 * n), np.array(5 * n))
        assert minhash.hopeless(a, minhash.minima(rest), np.array(4 * n), np.array(4 * n))
        assert minhash.hopeless(a, a, np.array(4 * n), np.array(6 * n))


def test_sets_are_sorted_and_distinct():
    for text in (None, "", "a", "a b", "a b a b a b a b a b", "b a " * 3 + "c", " ".join(f"w{i % 50}" for i in range(400))):
        for width in (1, 2, 5):
            assert shingle_set(text, width).tolist() == sorted(set(shingles(text, width).tolist()))
