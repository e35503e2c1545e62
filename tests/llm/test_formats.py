"""Matroska, pieces and packing: round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnhold.llm import matroska, packing, pieces


def check_media(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    seen = {}
    for r in matroska.digest(docs).collect():
        raw = [t for t in texts[r.doc_id] if len(t.encode()) == r.n_bytes][0].encode()
        payload = matroska.padded(raw)
        assert r.payload_bytes == len(payload) and len(payload) % 64 == 0 and len(payload) >= 64
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        own = (r.media_bytes, r.media_sha256, r.feature)
        assert seen.setdefault(raw, own) == own


def test_media(small, edges, empty):
    check_media(small)
    check_media(edges)
    assert matroska.digest(empty).count() == 0


def test_lacing_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 7]
    xiph = bytes([0x81, 0, 5, 0x82, 2, 255, 45, 10]) + b"".join(frames)
    group = matroska._element(0xA0, matroska._element(0xA1, xiph) + matroska._uint(0xFB, 1))
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + matroska._uint(0xE7, 100) + group
    cues = matroska._element(matroska.CUES, matroska._element(0xBB, matroska._uint(0xB3, 100) + matroska._element(0xB7, matroska._uint(0xF7, 1) + matroska._uint(0xF1, 0))))
    data = matroska._element(matroska.EBML, b"") + matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cues
    m = matroska.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in m.packets] == frames
    assert not m.packets[0].keyframe and m.packets[0].timestamp_ns == 105_000_000 and len(m.cues) == 1
    edge = matroska.parse(matroska.write_pcm(bytes(range(256)) * 37))
    assert sum(p.size for p in edge.packets) == 256 * 37 and edge.tracks[0]["codec"] == "A_PCM/INT/LIT"
    for cut in (3, 20, len(data) - 3):
        with pytest.raises(matroska.MatroskaError):
            matroska.parse(data[:cut])


def test_packet_table(spark):
    files = spark.createDataFrame([(1, bytearray(matroska.write_pcm(b"x" * 5000))), (2, bytearray(b"junk")), (3, None)], "media_id bigint, content binary")
    got = matroska.packet_table(files).collect()
    assert sum(r["size"] for r in got if r.media_id == 1) == 5000
    assert all(r.error for r in got if r.media_id != 1) and {r.media_id for r in got} == {1, 2, 3}


def all_paths(own, text, at=0):
    if at == len(text):
        yield 0, ()
        return
    for end in range(at + 1, min(len(text), at + own.longest) + 1):
        got = own.pieces.get(text[at:end])
        ids = (got[0],) if got else tuple(own._bytes_of(ord(text[at]))) if end == at + 1 else None
        if ids:
            for cost, rest in all_paths(own, text, end):
                yield cost + (got[1] if got else own.unknown), ids + rest


def test_n_best():
    own = pieces.lattice()
    for text in ("the cat", "in a", "café \U0001f600x", "a\nb  c", "▁a"):
        chunks = own.chunks(text)
        best = own.encode(chunks, own.learn([chunks])[0], 4)
        want = sorted(cost for cost, _ in all_paths(own, pieces.marked(text)))[:4]
        assert [c for c, _ in best] == want
        assert len({tuple(i.tolist()) for _, i in best}) == len(best)
        assert all(own.decode(i.tolist()) == text for _, i in best)


def test_pieces(small, edges, empty):
    for docs in (small, edges):
        made = pieces.encode(docs)
        rows = made.collect()
        assert len(rows) == docs.count() and all(r.round_trip for r in rows)
        assert all(r.n_best[0].score == r.score and r.n_best == sorted(r.n_best, key=lambda b: -b.score) for r in rows)
        back = sorted((str(r.doc_id), r.text) for r in pieces.decode(made).collect())
        assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert pieces.encode(empty).count() == 0


def test_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        length = rng.choice([1, 5, 64, 100])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        rows = []  # naive: the fullest row that still holds it
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [r for r in rows if r[0] >= sizes[i]]
            row = min(fits, key=lambda r: r[0]) if fits else [length, []]
            if not fits:
                rows.append(row)
            row[0] -= sizes[i]
            row[1].append(i)
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(length - r[0] for r in rows)


def test_packing(small, edges, empty, tmp_path):
    import tiktoken  # noqa: F401

    for docs in (small, edges):
        packed = packing.pack(docs)
        parts = {}
        for r in packed.collect():
            ids, cu = np.frombuffer(r.ids, "<u2"), r.cu_seqlens
            assert 0 < r.n_tokens <= packing.LENGTH and cu[0] == 0 and cu[-1] == r.n_tokens == len(ids)
            for d, at, a, b in zip(r.doc_ids, r.starts, cu, cu[1:]):
                parts.setdefault(d, []).append((at, ids[a:b].tolist()))
        own = packing.tokenizer(packing.VOCABULARY)
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        for d, (text, *copies) in texts.items():
            whole = [i for _, ids in sorted(parts.get(d, [])) for i in ids]
            if not copies:
                assert own.decode(whole) == text
            else:
                assert len(whole) == len(own.encode_ordinary(text)) * (1 + len(copies))
    for r in packing.pack(edges).collect():
        ids = np.frombuffer(r.positions, "<u2").tolist()
        assert ids == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
    files = packing.write_matrices(packing.pack(small), str(tmp_path / "m")).collect()
    assert files and all(f.ids[:6] == b"\x93NUMPY" for f in files)
    assert packing.pack(empty).count() == 0
    assert packing.position_ids([0, 2, 5], 7).tolist() == [0, 1, 0, 1, 2, 0, 0]


def test_packing_of_repeated_rows_spreads(spark):
    """3000 repeated rows and 3000 without an id are in as many stretches as other rows would be."""
    rows = spark.range(6000, numPartitions=4).selectExpr("CASE WHEN id < 3000 THEN 7L END AS doc_id", "'the same words again and again' AS text")
    got = packing.pack(rows).collect()
    shards = {r.shard: sum(a == 0 for a in r.starts) for r in got}
    assert len(shards) >= 12 and sum(len(r.doc_ids) for r in got) == 6000 and sum(d is None for r in got for d in r.doc_ids) == 3000


def plain_payload(data):
    """Bytes of all blocks of a file of known sizes, by an own walk through its elements."""

    def number(at, keep):
        first, n = data[at], 1
        while not first << n - 1 & 128:
            n += 1
        value = int.from_bytes(data[at : at + n], "big")
        return (value if keep else value & (1 << 7 * n) - 1), at + n

    out, todo = [], [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at < end:
            ident, at = number(at, True)
            size, at = number(at, False)
            if ident in (0x18538067, 0x1F43B675, 0xA0):  # segment, cluster, block group
                todo.append((at, at + size))
            elif ident in (0xA3, 0xA1):
                begin, lacing = at + 4, data[at + 3] >> 1 & 3
                if lacing == 3:  # the sizes of all frames but the last stand before them
                    frames, begin = data[begin], begin + 1
                    for _ in range(frames):
                        _, begin = number(begin, False)
                elif lacing == 2:
                    begin += 1
                assert lacing != 1
                out.append((at, data[begin : at + size]))
            at += size
    return b"".join(b for _, b in sorted(out))


def test_media_by_another_reader(spark, small):
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for r in matroska.digest(small).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = matroska.write_pcm(payload)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored) and plain_payload(stored) == payload
        x = [b - 128 for b in payload]
        said = dict(p.split("=") for p in r.feature.split(";"))
        assert said["mean"] == f"{sum(payload) / len(payload):.4f}" and said["rms"] == f"{(sum(v * v for v in x) / len(x)) ** 0.5:.4f}" and int(said["peak"]) == max(map(abs, x))
        assert int(said["zero_crossings"]) == sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))


def test_long_chunks(monkeypatch):
    """A chunk solved by itself, in little memory, has the paths of one that is solved with others."""
    monkeypatch.setattr(pieces, "LONG", 20)
    short, rng = pieces.Lattice(pieces.MODEL), random.Random(4)
    monkeypatch.undo()
    whole = pieces.Lattice(pieces.MODEL)
    for text in ("x" * 90, "".join(rng.choice("abcde\u00e9\U0001f600") for _ in range(200)), "ab" * 60 + " tail " + "q" * 30):
        chunks = whole.chunks(text)
        want = whole.encode(chunks, whole.learn([chunks])[0], 4)
        monkeypatch.setattr(pieces, "LONG", 20)
        got = short.encode(chunks, short.learn([chunks])[0], 4)
        monkeypatch.undo()
        assert [c for c, _ in got] == [c for c, _ in want] and got[0][1].tolist() == want[0][1].tolist()
        assert all(short.decode(i.tolist()) == text for _, i in got)
