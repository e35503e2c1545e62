"""Near-duplicates: HyperMinHash registers, banding, corrected estimate, exact verification.

``registers`` hashes each shingle to one of ``BUCKETS`` buckets; a bucket keeps the leading-zero
count of its smallest hash and ten bits of mantissa, 16 bits in all.  Empty buckets take the
register of the bucket that a fixed random order puts first among the full ones (optimal
densification), so small sets band as large ones do.  ``BANDS`` bands of ``ROWS`` registers give a
pair of similarity 0.8 a chance of about 3e-6 to share no band.  A caller may bring another ``Signature``.

``link`` turns sets into classes without ever emitting the pairs of a group:

1. Rows with equal sets (128-bit hash of the sorted set) are one node with a number of its own; it knows
   the smallest id of its rows.  Rows that share an id but not a set are different nodes.
2. Each band bucket of two nodes or more names one hub, its smallest node; every other node of it gives one candidate
   (node, hub).  The collision-corrected estimate over the registers drops hopeless ones; the rest
   are verified on the full sets: 100 * intersection >= 80 * union.
3. Connected components of the links (alternating large and small stars).
4. A bucket whose nodes (without its hub, which was compared with all) are in one component is done.
   In any other, nodes of different components were not compared yet: they are dealt into blocks of
   about ``BLOCK`` nodes and ``WEIGHT`` shingles, and pairs of blocks (never of nodes) are dealt out.
   A task compares the registers of two blocks and gives the nodes with a promising partner in
   another component; a second task verifies those on full sets, by one product of membership
   matrices, and gives a link for each two components it finds linked.

Nodes, candidates and links are written to the shared folder, so a lost executor costs tasks, not
the query.  Before texts or band keys are shuffled to the few that are asked for, most others are sorted out by
a filter of bounded size (``_among``); the join behind it is exact.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chunk, discard, materialize, text_of
from .shingles import mixed, shingle_set

BUCKETS, BANDS, ROWS, MANTISSA, BLOCK, WEIGHT, SLICE = 256, 42, 6, 10, 2048, 2_000_000, 250_000
PERCENT = 80
#: Bits of the filter of ``_among``: a table of 131,072 numbers at most, whatever the input.
FILTER = 1 << 23
#: Standard errors under the threshold at which an estimate is hopeless.
SLACK = 6.0

_rng = np.random.default_rng(977)
#: Row i: the place of every bucket in the order in which empty bucket i looks for a register.
_PLACES = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.uint16)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a non-empty set: 6 bits of leading zeros, 10 bits of mantissa."""
    h = mixed(shingles ^ _SALT)
    bucket = (h >> np.uint64(56)).astype(np.intp)
    low = np.full(BUCKETS, 2**64 - 1, np.uint64)
    np.minimum.at(low, bucket, h << np.uint64(8))
    full = np.zeros(BUCKETS, bool)
    full[bucket] = True
    # a double's exponent is the place of the leading one, its next bits the mantissa
    high = (low >> np.uint64(12)) | np.uint64(1)
    bits = high.astype(np.float64).view(np.uint64)
    zeros = np.minimum(63, np.uint64(1023 + 51) - (bits >> np.uint64(52)))
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (bits >> np.uint64(52 - MANTISSA) & np.uint64(2**MANTISSA - 1)).astype(np.uint16)
    if not full.all():
        donors, empty = np.flatnonzero(full), np.flatnonzero(~full)
        out[empty] = out[donors[_PLACES[empty][:, donors].argmin(axis=1)]]
    return out


def corrected(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the share that collides by chance.

    ``n`` and ``m`` are the sets' sizes.  Two disjoint sets agree in a bucket by chance where
    leading zeros and mantissa meet, about 2 ** -MANTISSA / 3 of full buckets at like sizes.
    """
    like = 4 * np.minimum(n, m) / np.maximum(1, np.maximum(n, m)) / (1 + np.minimum(n, m) / np.maximum(1, np.maximum(n, m))) ** 2
    chance = 2.0**-MANTISSA / 3 * like
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def hopeless(regs_a: np.ndarray, regs_b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """True where the estimate lies ``SLACK`` errors under the threshold or the sizes alone rule a link out."""
    small = np.minimum(n, m)
    # densified registers repeat those of full buckets, so few shingles make few independent ones
    independent = np.maximum(1, np.minimum(BUCKETS, small) * 0.6)
    limit = PERCENT / 100
    estimate = corrected((regs_a == regs_b).mean(axis=-1), n, m)
    return (estimate < limit - SLACK * np.sqrt(limit * (1 - limit) / independent)) | (100 * small < PERCENT * np.maximum(n, m))


class Signature(NamedTuple):
    """How sets are signed: ``make`` gives a set's 16-bit numbers, ``bands`` bands of ``rows`` of them are its keys, and
    ``hopeless`` says of pairs of signatures, with the sets' sizes, that they are surely not linked."""

    make: Callable[[np.ndarray], np.ndarray]
    bands: int
    rows: int
    hopeless: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


REGISTERS = Signature(registers, BANDS, ROWS, hopeless)


def set_hash(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).hexdigest()


# --- Spark -----------------------------------------------------------------------------


def sign(docs: DataFrame, width: int, bands: Callable[[np.ndarray], np.ndarray] | None = None, signature: Signature = REGISTERS) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, set (hash; null if empty), regs (its signature), and keys if ``bands`` makes them from the set."""

    def run(piece: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_shingles", "set", "regs", "keys")}
        for text in piece.column(2).to_pylist():
            s = shingle_set(text, width)
            regs = signature.make(s) if len(s) else None
            out["n_shingles"].append(len(s))
            out["set"].append(set_hash(s) if len(s) else None)
            out["regs"].append(regs.tobytes() if len(s) else None)
            out["keys"].append(None if not len(s) else bands(s).view(np.int64) if bands else None)
        return {"doc_id": piece.column(0), "row": piece.column(1), **out}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    return by_chunk(rows, run, "doc_id bigint, row bigint, n_shingles bigint, set string, regs binary, keys array<bigint>")


def _nodes(signed: DataFrame) -> DataFrame:
    """node, set, least (smallest id of the set's rows), n_shingles, regs, keys: one row per set."""
    full = signed.where("set IS NOT NULL AND doc_id IS NOT NULL")
    one = full.groupBy("set").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    return materialize(one.withColumn("node", F.monotonically_increasing_id()))


def _keys_of(nodes: DataFrame, signature: Signature, given: bool) -> DataFrame:
    """node, its set's size, band key (as given, or a hash of the band): one row per node and band."""
    sized = F.col("n_shingles").alias("n")
    if given:
        return nodes.select("node", sized, F.explode("keys").alias("key"))
    wide = 2 * signature.rows
    each = nodes.select("node", sized, "regs", F.explode(F.sequence(F.lit(0), F.lit(signature.bands - 1))).alias("band"))
    return each.select("node", "n", F.expr(f"xxhash64(band, substring(regs, band * {wide} + 1, {wide}))").alias("key"))


def _among(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``rows`` without most of those whose number ``name`` is not in ``known``; none that is there is left out.

    Bits of hashes of the known numbers are sent to all tasks, so the others need no shuffle.
    """
    place = f"pmod(xxhash64({name}), {FILTER}L)"
    bits = known.selectExpr(f"{place} DIV 64 AS __word", f"shiftleft(1L, CAST({place} % 64 AS int)) AS bit").groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    here = F.expr(f"__word = {place} DIV 64 AND getbit(__bits, CAST({place} % 64 AS int)) = 1")
    return rows.join(F.broadcast(bits), here, "left_semi")


def _promising(pairs: DataFrame, nodes: DataFrame, signature: Signature) -> DataFrame:
    """The pairs (a, b, with the size n_a) whose estimate is not hopeless."""
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("r_b"))
    sized = pairs.join(b, "b").where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % PERCENT)
    both = sized.join(nodes.select(F.col("node").alias("a"), F.col("regs").alias("r_a")), "a")

    def run(piece: pa.RecordBatch) -> dict:
        a, b, n, m, x, y = piece.columns
        load = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), -1)
        keep = ~signature.hopeless(load(x), load(y), n.to_numpy(), m.to_numpy())
        return {"a": a.to_numpy()[keep], "b": b.to_numpy()[keep]}

    return by_chunk(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a bigint, b bigint", "r_a")


def _sets(asked: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles of the nodes in ``asked``, made again from their texts."""
    asked = materialize(asked.select("node").distinct().join(nodes.select("node", "set", "least"), "node"))
    texts = _among(docs.select(F.col("doc_id").cast("bigint").alias("least"), text_of().alias("text")), asked, "least").join(asked, "least")

    def run(piece: pa.RecordBatch) -> dict:
        out = [(i, s.astype("<u8").tobytes()) for i, t, h in zip(*[piece.column(k).to_pylist() for k in range(3)]) if set_hash(s := shingle_set(t, width)) == h]
        return {"node": [i for i, _ in out], "shingles": [s for _, s in out]}

    return by_chunk(texts.select("node", "text", "set"), run, "node bigint, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    sets = materialize(_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, nodes, width))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")

    def check(piece: pa.RecordBatch) -> dict:
        a, b = [], []
        for i, j, x, y in zip(*[c.to_pylist() for c in piece.columns]):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int(np.count_nonzero(large[at] == small))
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                a.append(i)
                b.append(j)
        return {"a": a, "b": b}

    return by_chunk(both.select("a", "b", "s_a", "s_b"), check, "a bigint, b bigint", "s_a")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of a link.

    Alternating large and small stars; each round is written, and ends when no edge changes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours of a go to the least of a's neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        # small star: a and its smaller neighbours go to the least of them
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").distinct()
        last, edges = edges, materialize(small)
        discard(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = state


def _promising_in(t: pa.Table, signature: Signature) -> pa.Table:
    """The rows of a task with a partner across sides and components whose estimate is not hopeless."""
    side, part, n = (t.column(c).to_numpy() for c in ("side", "component", "n"))
    regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(side), -1)
    right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(side))
    keep = np.zeros(len(side), bool)
    for i in np.flatnonzero(side == 0):
        js = right[part[right] != part[i]]
        if len(js):
            js = js[~signature.hopeless(regs[i], regs[js], np.full(len(js), n[i]), n[js])]
            keep[js] = True
            keep[i] |= len(js) > 0
    return t.select(["task", "side", "node", "component"]).filter(pa.array(keep))


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays, by products of membership matrices."""
    values = np.concatenate([*a, *b])
    order = np.argsort(values)
    owner = np.repeat(np.arange(len(a) + len(b), dtype=np.int32), [len(x) for x in [*a, *b]])[order]
    values = values[order]
    same = np.concatenate([[False], values[1:] == values[:-1]])
    shared = same | np.concatenate([same[1:], [False]])  # values that two arrays or more have
    owner, place = owner[shared], np.cumsum(~same[shared]) - 1
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        i, j = np.searchsorted(place, [low, low + columns])
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[owner[i:j], place[i:j] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _slices(sizes: list[int]) -> list[slice]:
    """Neighbours taken together until they have ``SLICE`` shingles."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > SLICE:
            out.append(slice(start, k))
            start, total = k, 0
        total += n
    return [*out, slice(start, len(sizes))]


def _linked_in(t: pa.Table) -> pa.Table:
    """One verified link for each two components that a task's sets link."""
    side, node, part = (t.column(c).to_numpy() for c in ("side", "node", "component"))
    sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    a, b = [], []
    if len(left) and len(right):
        common = np.zeros((len(left), len(right)), np.float32)
        for i, j in itertools.product(_slices([len(sets[k]) for k in left]), _slices([len(sets[k]) for k in right])):
            common[i, j] = common_counts([sets[k] for k in left[i]], [sets[k] for k in right[j]])
        n = np.array([len(x) for x in sets], np.float32)
        x, y = np.nonzero((100 * common >= PERCENT * (n[left][:, None] + n[right][None, :] - common)) & (part[left][:, None] != part[right][None, :]))
        x, y = left[x], right[y]
        if len(x):
            pairs = np.column_stack([np.minimum(part[x], part[y]), np.maximum(part[x], part[y])])
            _, first = np.unique(pairs, axis=0, return_index=True)
            a, b = np.maximum(node[x], node[y])[first], np.minimum(node[x], node[y])[first]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(members: DataFrame, parts: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, signature: Signature) -> DataFrame:
    """Links between different components of a bucket, blocks against blocks.

    ``members`` has node, n and key of buckets, without their hubs; ``parts`` node and component.
    """
    labelled = materialize(members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    count, weight = F.count(F.lit(1)), F.sum("n")
    blocks = F.greatest(count / BLOCK, weight / WEIGHT)
    open_ = labelled.groupBy("key").agg(blocks.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "blocks")
    rows = materialize(labelled.join(open_, "key"))
    own = rows.groupBy("key", "component").agg(blocks.alias("own")).where("own > 0.5")  # the others share blocks
    rows = rows.join(own, ["key", "component"], "left")
    # a large component has blocks of its own, by the node's hash; small ones share blocks, by the component's
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("own")))
    alone = F.concat_ws(":", F.col("component").cast("string"), spread.cast("string"))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("blocks"))).cast("string")
    rows = materialize(rows.select("key", "node", "n", "component", F.when(F.col("own").isNotNull() & (F.col("blocks") > 1), alone).otherwise(shared).alias("block")))
    blocks = rows.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    x, y = blocks.toDF("key", "x", "low_x", "high_x"), blocks.toDF("key", "y", "low_y", "high_y")
    tasks = x.join(y, "key").where("x <= y AND NOT (low_x = high_x AND low_y = high_y AND low_x = low_y)").select("key", "x", "y")
    tasks = tasks.withColumn("task", F.xxhash64("key", "x", "y"))
    sides = tasks.select("key", F.col("x").alias("block"), "task", F.lit(0).alias("side")).union(tasks.where("x <> y").select("key", F.col("y"), "task", F.lit(1)))
    dealt = rows.join(sides, ["key", "block"]).select("task", "side", "node", "n", "component")
    dealt = dealt.join(nodes.select("node", "regs"), "node")
    schema = "task bigint, side int, node bigint, component bigint"
    left = materialize(dealt.groupBy("task").applyInArrow(lambda t: _promising_in(t, signature), schema))
    sets = _sets(left, docs, nodes, width)
    links = materialize(left.join(sets, "node").groupBy("task").applyInArrow(_linked_in, "a bigint, b bigint").distinct())
    discard(labelled, rows, left)
    return links


def _classes(docs: DataFrame, width: int, bands: Callable[[np.ndarray], np.ndarray] | None, signature: Signature) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and set and component (a number) of every set."""
    signed = materialize(sign(docs, width, bands, signature))
    nodes = _nodes(signed)
    keyed = _keys_of(nodes, signature, bands is not None)
    hubs = materialize(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("in")).where("in > 1"))
    members = materialize(_among(keyed, hubs, "key").join(hubs, "key").where("node <> hub").select("key", "node", "n", "hub", "in"))
    pairs = members.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("n_a")).distinct()
    links = materialize(_verified(materialize(_promising(pairs, nodes, signature)), docs, nodes, width))
    parts = materialize(components(links))
    rest = _across(members.where("in > 2").select("node", "n", "key"), parts, docs, nodes, width, signature)
    if not rest.isEmpty():
        parts = components(links.union(rest))
    named = nodes.select("set", "node").join(parts, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    named = materialize(named)
    discard(hubs, members, links, rest)
    return signed, named


def link(docs: DataFrame, width: int = 5, bands: Callable[[np.ndarray], np.ndarray] | None = None, signature: Signature = REGISTERS) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, set, component (a number, null without words or id) and component_id of every row.

    Sets of shingles of ``width`` words are linked from a Jaccard similarity of 0.8 on.  Rows
    without words (null and empty texts too) link with nothing and are their own component; so is
    a row with null id, whose component_id is null.  Equal sets are linked.  Rows that share an id are
    linked only if their sets are, so rows of one id may be in several components.  ``bands`` may give other
    band keys than those of the signature.
    """
    signed, named = _classes(docs, width, bands, signature)
    known = "set IS NOT NULL AND doc_id IS NOT NULL"
    rows = signed.select("doc_id", "row", "n_shingles", "set")
    parts = rows.where(known).join(named, "set")
    least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = ["doc_id", "row", "n_shingles", "set", "component", "component_id"]
    own = rows.where(f"NOT ({known})").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col("doc_id")})
    return parts.join(least, "component").select(*names).unionByName(own.select(*names))


def digest(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id; true for a null id) of every row."""
    rows = link(docs, width)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without near copies, all columns: of each component the row of its smallest id (of rows that share it, the
    one whose text has the smallest hash), of rows with equal id and text one.  Rows with null id or without words stay.

    Texts are shuffled once, to meet the ids that stay; only rows that occur more than once are grouped.
    """
    rows = link(docs, width).where("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    times = rows.groupBy("component", F.struct("doc_id", "row").alias("first")).agg(F.count(F.lit(1)).alias("times"))
    kept = materialize(times.join(first, ["component", "first"]).select(F.col("first.doc_id").alias("__th_id"), F.col("first.row").alias("__th_row"), "times"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    known = docs.where(F.col("doc_id").isNotNull() & words)

    def those(of: DataFrame) -> DataFrame:
        here = (F.col("doc_id").cast("bigint") == F.col("__th_id")) & (F.xxhash64(text_of()) == F.col("__th_row"))
        return known.join(of, here, "left_semi")

    out = those(kept.where("times = 1")).unionByName(docs.where(F.col("doc_id").isNull() | ~words))
    again = kept.where("times > 1")
    if not again.isEmpty():
        out = out.unionByName(those(again).dropDuplicates(["doc_id", "text"]))
    return out
