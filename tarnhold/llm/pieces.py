"""SentencePiece encoding and decoding with the N best segmentations.

The segmentations of a text are the paths of the lattice of vocabulary pieces; a path's score is
the sum of its pieces' scores.  A character without a piece of its own becomes its UTF-8 bytes,
at a score below every piece.  Scores are counted in whole numbers (units of 2 ** -20 where a vocabulary's
are fractions), so sums are exact.

The N best paths come from a search in two directions: forward Viterbi gives the best score from
the start to every place; backward A-star from the end uses it as its heuristic.  As that is exact,
each path that reaches the start is the next best.

No piece has a word mark after another character, and none has a line end, so a text's lattice falls into
*chunks* there.  All new chunks of a batch go through the forward and backward passes at
once in numpy (edges in order of their ends), which also gives how much the second best path of a
chunk costs.  The N best of a text change at most the N - 1 chunks whose second best cost least, so
A-star runs on those alone and the exact N best of the text are sums over so few lists.

Solved chunks are kept per worker, up to ``KEEP`` chunks and ``KEEP_CHARS`` characters of them.  Texts of any length are
encoded whole; a chunk of more than ``LONG`` characters is solved by itself, in memory of a few numbers a character: A-star
keeps no more open ends than it still owes paths, as each of them leads to a path of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, text_of

MODEL, BEST, KEEP, KEEP_CHARS, BATCH, LONG = "/opt/tokenizers/piece_bpe_32k.model", 4, 600_000, 8_000_000, 1 << 17, 1 << 15
MARK, LITERAL = "▁", "\ud800"  # a word mark in the text itself is not a space: it goes through its bytes
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 60


def marked(text: str) -> str:
    return MARK + text.replace(MARK, LITERAL).replace(" ", MARK)


def _by(place: np.ndarray) -> np.ndarray:
    """A stable order; small numbers sort by radix."""
    return np.argsort(place.astype(np.uint16) if len(place) and place.max() < 65536 else place, kind="stable")


class Lattice:
    """A vocabulary's pieces, and chunks that were solved with it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        scores = [sp.get_score(i) for i in range(n)]
        self.scale = 1 if all(x == round(x) for x in scores) else 1 << 20
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, int]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                assert MARK not in piece.lstrip(MARK) and "\n" not in piece, "this vocabulary's lattice has no safe cuts"
                self.pieces[piece] = i, round(-scores[i] * self.scale)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.pieces))
        self.unknown = max((c for _, c in self.pieces.values() if c < 10**9 * self.scale), default=0) + 10 * self.scale
        self.tables = []
        for size in range(1, self.longest + 1):
            own = [(p, i, c) for p, (i, c) in self.pieces.items() if len(p) == size]
            codes = np.frombuffer("".join(p for p, _, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
            h = np.zeros(len(own), np.uint64)
            for j in range(size):
                h = h * _M + codes[:, j] + np.uint64(1)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([i for _, i, _ in own], np.int64)[order], np.array([c for _, _, c in own], np.int64)[order]))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.cost, self.second = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lists: dict[str, list] = {}
        self.listed = 0

    # --- many chunks at once ---------------------------------------------------------

    def _edges(self, chunks: list[str]):
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(chunks)), lens)
        ends = np.cumsum(lens)[owner]
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        wide = codes.astype(np.uint64) + np.uint64(1)
        out = []
        for size, (keys, ids, costs) in enumerate(self.tables, 1):
            inside = at + size <= ends[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _M + wide[at + size - 1]
            if not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            out.append((at[hit], np.full(int(hit.sum()), size), ids[k[hit]], costs[k[hit]]))
            if size == 1:  # bytes: negative code points, made into ids when the path is known
                miss = at[~hit]
                out.append((miss, np.ones(len(miss), np.int64), -codes[miss].astype(np.int64) - 1, np.full(len(miss), self.unknown)))
        start, size, ids, costs = (np.concatenate(x) for x in zip(*out))
        return lens, owner[start], start, size, ids, costs

    def solve(self, chunks: list[str]) -> None:
        """Adds the best path of each chunk and what the second best costs more."""
        lens, owner, start, size, ids, costs = self._edges(chunks)
        first = np.cumsum(lens + 1) - (lens + 1)  # a chunk of n characters has n + 1 nodes
        a = start + owner
        b = a + size
        alpha, beta = np.full(int((lens + 1).sum()), _FAR), np.full(int((lens + 1).sum()), _FAR)
        alpha[first] = 0
        beta[first + lens] = 0
        place = b - first[owner]
        order = _by(place)
        cuts = np.searchsorted(place[order], np.arange(1, int(lens.max()) + 2))
        for i, j in itertools.pairwise(cuts):
            e = order[i:j]
            np.minimum.at(alpha, b[e], alpha[a[e]] + costs[e])
        place = first[owner] + lens[owner] - a
        order = _by(place)
        cuts = np.searchsorted(place[order], np.arange(1, int(lens.max()) + 2))
        for i, j in itertools.pairwise(cuts):
            e = order[i:j]
            np.minimum.at(beta, a[e], beta[b[e]] + costs[e])
        tight = np.flatnonzero(alpha[a] + costs == alpha[b])
        tight = tight[_by(size[tight])]
        back = np.zeros(len(alpha), np.int64)
        back[b[tight]] = tight  # the longest last piece of equals
        used = np.zeros(len(a), bool)
        inner = np.ones(len(alpha), bool)
        inner[first] = False
        nodes = first + lens
        while len(nodes):
            e = back[nodes]
            used[e] = True
            nodes = a[e]
            nodes = nodes[inner[nodes]]
        best = alpha[first + lens]
        second = np.full(len(chunks), _FAR)
        rest = ~used
        np.minimum.at(second, owner[rest], alpha[a[rest]] + costs[rest] + beta[b[rest]])
        path = np.flatnonzero(used)
        path = path[np.argsort(a[path])]
        flat, counts = ids[path], np.bincount(owner[path], minlength=len(chunks))
        if (flat < 0).any():
            flat, counts = self._with_bytes(flat, owner[path], len(chunks))
        self._keep(chunks, flat, counts, best, second - best)

    def _keep(self, chunks: list[str], flat: np.ndarray, counts: np.ndarray, best: np.ndarray, more: np.ndarray) -> None:
        base = len(self.cost)
        self.index.update(zip(chunks, range(base, base + len(chunks))))
        self.chars += sum(map(len, chunks))
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.cost = np.concatenate([self.cost, best])
        self.second = np.concatenate([self.second, np.minimum(more, _FAR)])

    def _bytes_of(self, code: int) -> list[int]:
        char = chr(code)
        return [self.byte_ids[x] for x in (MARK if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def _with_bytes(self, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(flat < 0)
        codes, which = np.unique(-flat[odd] - 1, return_inverse=True)
        known = [self._bytes_of(int(c)) for c in codes]
        reps = np.ones(len(flat), np.int64)
        reps[odd] = np.array([len(k) for k in known])[which]
        out = np.repeat(flat, reps)
        where = (np.cumsum(reps) - reps)[odd]
        width = max(map(len, known))
        table = np.array([k + [0] * (width - len(k)) for k in known])
        for j in range(width):
            has = reps[odd] > j
            out[where[has] + j] = table[which[has], j]
        return out, np.bincount(np.repeat(owner, reps), minlength=n)

    # --- the N best of one chunk -------------------------------------------------------

    def n_best(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(cost, ids) of the n best paths, best first: Viterbi forward, A-star backward."""

        def into(end: int) -> list[tuple[int, int, int]]:
            found = [(start, *got) for start in range(max(0, end - self.longest), end) if (got := self.pieces.get(chunk[start:end]))]
            if chunk[end - 1] not in self.pieces:
                found.append((end - 1, -ord(chunk[end - 1]) - 1, self.unknown))
            return found

        alpha, seen = [0] * (len(chunk) + 1), {}
        for end in range(1, len(chunk) + 1):
            found = into(end)
            alpha[end] = min(alpha[start] + cost for start, _, cost in found)
            if len(chunk) <= LONG:
                seen[end] = found
        count = itertools.count()
        ends = [(alpha[-1], len(chunk), next(count), 0, None)]
        out = []
        while ends and len(out) < n:
            f, at, _, g, tail = ends.pop(0)
            if not at:
                path = []
                while tail:
                    path += self._bytes_of(-tail[0] - 1) if tail[0] < 0 else [tail[0]]
                    tail = tail[1]
                out.append((f, tuple(path)))
                continue
            more = [(g + cost + alpha[start], start, next(count), g + cost, (ident, tail)) for start, ident, cost in seen.get(at) or into(at)]
            ends = heapq.nsmallest(n - len(out), ends + more)
        return out

    # --- texts -------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(marked(text)) if text else []

    def learn(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The place of each chunk among the solved ones; new chunks are solved first, many characters at once."""
        if len(self.index) > KEEP or self.chars > KEEP_CHARS:
            self.clear()
        index, places = self.index, []
        unknown: set[str] = set()
        for chunks in lists:
            k = np.fromiter(map(index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
            places.append(k)
            unknown.update(chunks[i] for i in np.flatnonzero(k < 0))
        new = sorted(unknown)
        i = 0
        while i < len(new):
            if len(new[i]) > LONG:
                (best, path), *others = self.n_best(new[i], 2)
                self._keep([new[i]], np.array(path, np.int64), np.array([len(path)]), np.array([best]), np.array([others[0][0] - best if others else _FAR]))
                i += 1
                continue
            j, total = i, 0
            while j < len(new) and len(new[j]) <= LONG and (j == i or total < BATCH):
                total += len(new[j])
                j += 1
            self.solve(new[i:j])
            i = j
        for chunks, k in zip(lists, places):
            odd = np.flatnonzero(k < 0)
            k[odd] = [index[chunks[i]] for i in odd]
        return places

    def encode(self, chunks: list[str], k: np.ndarray, n: int = BEST) -> list[tuple[int, np.ndarray]]:
        """(cost, ids) of the n best segmentations of a text; ``k`` is what ``learn`` gave for its chunks."""
        if not chunks:
            return [(0, np.zeros(0, np.int32))]
        counts = self.starts[k + 1] - self.starts[k]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[k] - ends + counts, counts)]
        total = int(self.cost[k].sum())
        second = self.second[k]
        if n == 1:
            return [(total, ids)]
        some = np.argpartition(second, n - 2)[: n - 1] if len(k) >= n else np.arange(len(k))
        if len(k) >= n:  # of equals the first ones
            limit = second[some].max()
            some = np.concatenate([np.flatnonzero(second < limit), np.flatnonzero(second == limit)])[: n - 1]
        some = np.sort(some[second[some] < _FAR // 2])
        lists = []
        for i in some:
            c = chunks[i]
            if c not in self.lists:
                own = tuple(self.ids[self.starts[k[i]] : self.starts[k[i] + 1]].tolist())
                if len(self.lists) > KEEP or self.listed > KEEP_CHARS:
                    self.lists.clear()
                    self.listed = 0
                self.listed += len(c)
                self.lists[c] = [(0, None)] + [(cost - int(self.cost[k[i]]), path) for cost, path in self.n_best(c, n + 1) if path != own][: n - 1]
            lists.append(self.lists[c])
        more = reduce(np.add.outer, [np.array([x[0] for x in own]) for own in lists], np.zeros((), np.int64))
        sizes, more, out = more.shape, more.ravel(), []
        for w in np.argsort(more, kind="stable")[:n]:
            picks = np.unravel_index(w, sizes) if sizes else ()
            parts, at = [], 0
            for i, own, p in zip(some, lists, picks):
                if p:
                    parts += [ids[at : ends[i] - counts[i]], np.array(own[p][1], np.int32)]
                    at = ends[i]
            out.append((total + int(more[w]), np.concatenate([*parts, ids[at:]]) if parts else ids))
        return out

    def decode(self, ids) -> str:
        """The text of any segmentation of it."""
        return b"".join([self.bytes[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


@lru_cache(2)
def lattice(path: str = MODEL) -> Lattice:
    return Lattice(path)


ENCODED = "doc_id bigint, n_ids bigint, score double, ids binary, n_best array<struct<score: double, n_ids: bigint, ids_sha256: string>>, round_trip boolean"


def encode(docs: DataFrame, n: int = BEST, path: str = MODEL) -> DataFrame:
    """``ENCODED`` for every row: the best segmentation (ids as little-endian 16-bit numbers) and the n best.

    ``round_trip``: decoding the ids gave the text again.  Null texts are empty; an empty text has no ids and
    one segmentation.  Repeated rows give repeated rows, an empty table an empty one.
    """

    def run(piece: pa.RecordBatch) -> dict:
        own = lattice(path)
        texts = piece.column(1).to_pylist()
        lists = [own.chunks(t) for t in texts]
        places = own.learn(lists)
        out: dict[str, list] = {k: [] for k in ("n_ids", "score", "ids", "n_best", "round_trip")}
        for text, chunks, k in zip(texts, lists, places):
            best = own.encode(chunks, k, n)
            packed = [(-cost / own.scale, len(ids), ids.astype("<u2").tobytes()) for cost, ids in best]
            out["n_ids"].append(packed[0][1])
            out["score"].append(packed[0][0])
            out["ids"].append(packed[0][2])
            out["n_best"].append([{"score": s, "n_ids": k, "ids_sha256": hashlib.sha256(b).hexdigest()} for s, k, b in packed])
            out["round_trip"].append(own.decode(best[0][1].tolist()) == text)
        return {"doc_id": piece.column(0), **out}

    return by_chunk(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), run, ENCODED)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are an empty text."""

    def run(piece: pa.RecordBatch) -> dict:
        own = lattice(path)
        return {"doc_id": piece.column(0), "text": [own.decode(np.frombuffer(b or b"", "<u2").tolist()) for b in piece.column(1).to_pylist()]}

    return by_chunk(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", "ids")
