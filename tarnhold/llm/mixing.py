"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. A document's size is its number of words.  Sources in code point order, null last, weigh
   1, 2, 3, repeating; a source's target is its share of all words, held at ``copies`` times
   its size, the excess reshared by weight (water filling).
2. The mix has as many equal blocks of ``block`` words as all words fill (one at least).  Sources get
   blocks by the highest quotients target / (2k + 1); a source's blocks go to its districts and from
   there to their shards (hash buckets of its documents) by the highest quotients of their sizes, so
   quotas are whole numbers that add up exactly at every level.
3. In a shard the documents lie end to end in seeded order.  Its quota is as many whole passes
   as fit, then a run of blocks from a seeded first block on, around the end.  A document
   takes ``passes * size`` plus its overlap with that run: at most ``copies * size``.

Quotients are ranked only where they can matter: with n claimants the last seat's divisor
lies between two that are known beforehand, and at most about 2n quotients lie between those
two, so nothing grows with the number of blocks.

No window or join has a source as its key but over sums per district, of ``FAN`` shards each: a source
that holds a third of all rows is as many shards as its rows need.  Rows with equal id, source and text
are one document with a number of copies; copies lie in stretches of ``STRETCH``, each with a place of its
own, so neither a repeated row nor a null id fills one shard.  Places and first blocks come from MD5, which
SQL has too.

Null texts have size 0, rows with null source are one source.  Repeated rows count as often
as they occur.  Empty tables give empty ones; if all sizes are 0 every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

SEED, BLOCK, COPIES, DOCS_PER_SHARD, FAN, STRETCH = 42, 8, 3, 1024, 1024, 256


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")


def number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _seeded(*parts: Column) -> Column:
    return number(F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key (of the text) of each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), number(text_of()).alias("key"))


def stretches(sized: DataFrame) -> DataFrame:
    """doc_id, source, size, key, times, copies, place: a document's copies, ``STRETCH`` at a time."""
    same = sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("times"))
    each = same.withColumn("first", F.explode(F.expr(f"sequence(0L, times - 1, {STRETCH}L)")))
    return each.withColumns({"copies": F.least(F.lit(STRETCH), F.col("times") - F.col("first")), "place": _seeded(F.col("doc_id"), F.col("key"), F.col("first"))})


def targets(sources: DataFrame, copies: int = COPIES) -> DataFrame:
    """source, source_size -> also weight and target.  One row per source: a sum, not the documents."""
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", ((F.row_number().over(byname) - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * F.lit(float(copies))
    full = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("ratio", cap / F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # from the first source on that the level leaves under its cap, all are
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("source").isNull().alias("last"), F.col("source").alias("name"), F.col("level").alias("at")))).over(everything)["at"])
    return w.select("source", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"))


def apportion(claims: DataFrame, group: list[str], key: list[Column], claim: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: adds ``out``, whole numbers that add up to ``seats`` in each group.

    ``seats`` (the same in a whole group) go to the rows with the highest ``claim / (2k + 1)``,
    ties to the row that ``key`` puts first.  A group without claims gets none.
    """
    g = Window.partitionBy(*group)
    total, n = F.sum(claim).over(g), F.count(F.lit(1)).over(g) / 2.0
    fair = F.when(F.col("__total") > 0, F.col(claim) / F.col("__total")).otherwise(F.lit(0.0))
    c = claims.withColumns({"__total": total.cast("double"), "__half": n})
    low = F.greatest(F.lit(0.0), F.floor(fair * F.greatest(F.lit(0.0), F.col(seats) - F.col("__half")) + 0.5) - 1)
    high = F.floor(fair * (F.col(seats) + F.col("__half")) + 0.5) + 1
    c = c.withColumns({"__low": low.cast("bigint"), "__high": F.when(F.col(claim) > 0, high).otherwise(F.lit(0)).cast("bigint")})
    c = c.withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    c = c.withColumn("__k", F.explode(F.expr("CASE WHEN __high > __low THEN sequence(__low, __high - 1) ELSE array(CAST(NULL AS BIGINT)) END")))
    c = c.withColumn("__q", F.when(F.col("__k").isNotNull(), F.col(claim) / (2 * F.col("__k") + 1)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__q").desc_nulls_last(), *key, F.col("__k")))
    c = c.withColumn("__won", (F.col("__q").isNotNull() & (rank <= F.col("__left"))).cast("bigint"))
    keep = [x for x in claims.columns]
    return c.groupBy(*keep, "__low").agg(F.sum("__won").alias("__more")).select(*keep, (F.col("__low") + F.col("__more")).alias(out))


def _cells(rows: DataFrame, block: int, copies: int) -> DataFrame:
    """c_name, c_shard: sizes, target, whole passes, length and start of the run of blocks of each shard.

    ``rows`` has source, name (of the source, never null), shard and words.
    """
    cells = rows.groupBy("source", "name", "shard").agg(F.sum("words").alias("shard_size"))
    cells = cells.withColumn("district", F.floor(F.col("shard") / FAN))
    districts = cells.groupBy("source", "name", "district").agg(F.sum("shard_size").alias("district_size"))
    sums = districts.groupBy("source").agg(F.sum("district_size").alias("source_size"))
    all_ = F.sum("source_size").over(Window.partitionBy())
    blocks = F.greatest(F.floor(all_ / F.lit(block)), F.signum(all_)).cast("bigint")
    quotas = apportion(targets(sums, copies).withColumn("blocks", blocks), [], [F.col("source").asc_nulls_last()], "target", "blocks", "seats")
    quotas = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "seats")
    districts = districts.join(quotas, F.col("source").eqNullSafe(F.col("q_source"))).select("name", "district", "district_size", "source_size", "target", "seats")
    districts = apportion(districts, ["name"], [F.col("district")], "district_size", "seats", "district_seats").select("name", "district", "source_size", "target", "district_seats")
    cells = cells.join(districts, ["name", "district"])
    cells = apportion(cells, ["name", "district"], [F.col("shard")], "shard_size", "district_seats", "quota")
    wanted = F.least(F.col("quota") * block, F.col("shard_size") * copies)
    held = F.greatest(F.col("shard_size"), F.lit(1))  # a shard without words gets nothing
    first = F.pmod(_seeded(F.col("name"), F.col("shard")), F.ceil(held / F.lit(block)))
    return cells.select(
        F.col("name").alias("c_name"), F.col("shard").alias("c_shard"), F.col("source_size").alias("c_source_size"), F.col("target").alias("c_target"), F.col("shard_size").alias("c_size"),
        F.floor(wanted / held).cast("bigint").alias("c_passes"),
        (wanted % held).alias("c_run"),
        (first * block).alias("c_first"),
    )


def _placed(sized: DataFrame, block: int, copies: int, docs_per_shard: int) -> DataFrame:
    """The stretches with their shard's cell and ``c_start``, the words before them in it."""
    shards = max(1, -(-sized.count() // docs_per_shard))
    name = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    rows = stretches(sized).withColumns({"name": name, "shard": F.col("place") % shards, "words": F.col("size") * F.col("copies")})
    cells = _cells(rows, block, copies)
    line = Window.partitionBy("name", "shard").orderBy("place", "doc_id", "key", "first").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("c_start", F.sum("words").over(line) - F.col("words"))
    return rows.join(cells, (F.col("name") == F.col("c_name")) & (F.col("shard") == F.col("c_shard")))


def _parts(start: Column) -> Column:
    """From and to, in words of a copy that starts at ``start``, of its two overlaps with the run."""

    def part(first: Column) -> Column:
        low = F.greatest(start, first, F.lit(0))
        high = F.least(start + F.col("size"), first + F.col("c_run"), F.col("c_size"))
        return F.struct((low - start).alias("low"), (F.greatest(low, high) - start).alias("high"))

    return F.array(part(F.col("c_first")), part(F.col("c_first") - F.col("c_size")))


def mix(docs: DataFrame, block: int = BLOCK, copies: int = COPIES, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    rows = _placed(materialize(sizes(docs)), block, copies, docs_per_shard)
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    rows = rows.withColumn("parts", _parts(F.col("c_start") + F.col("copy") * F.col("size")))
    taken = F.col("c_passes") * F.col("size") + F.aggregate("parts", F.lit(0).cast("bigint"), lambda t, p: t + p["high"] - p["low"])
    return rows.select("doc_id", "size", F.col("c_source_size").alias("source_size"), F.col("c_target").alias("target"), taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK, copies: int = COPIES, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass of a document and one for each part that
    the run of blocks covers, with those words as its text (n_chars, if there, follows).

    Texts are shuffled once, to meet their parts.  Of rows with equal id, source and text that differ elsewhere, all mixed rows
    carry the other columns of one.
    """
    names = docs.columns
    rows = _placed(materialize(sizes(docs)), block, copies, docs_per_shard)
    own = lambda j: F.filter(_parts(F.col("c_start") + j * F.col("size")), lambda x: x["high"] > x["low"])
    cut = F.flatten(F.transform(F.expr("sequence(0L, copies - 1)"), own))
    whole = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high")), (F.col("c_passes") * F.col("copies")).cast("int"))
    taken = rows.where("size > 0").select(F.col("doc_id").alias("__th_id"), F.col("source").alias("__th_source"), F.col("key").alias("__th_key"), F.col("size").alias("__th_size"), "times", F.concat(whole, cut).alias("__th_parts"))
    taken = materialize(taken.where(F.size("__th_parts") > 0))

    def of(part: DataFrame, rows: DataFrame) -> DataFrame:
        here = (number(text_of()) == F.col("__th_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__th_id")) & F.col("source").cast("string").eqNullSafe(F.col("__th_source"))
        rows = rows.join(part.drop("times"), here).withColumn("__th_part", F.explode("__th_parts"))
        low, high = F.col("__th_part.low"), F.col("__th_part.high")
        words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        text = F.when((low == 0) & (high == F.col("__th_size")), F.col("text")).otherwise(F.array_join(F.slice(words, (low + 1).cast("int"), (high - low).cast("int")), ""))
        rows = rows.withColumn("text", text)
        if "n_chars" in names:
            rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return rows.select(*names)

    out = of(taken.where("times = 1"), docs)
    again = taken.where("times > 1")
    return out if again.isEmpty() else out.unionByName(of(again, docs.dropDuplicates(["doc_id", "source", "text"])))
