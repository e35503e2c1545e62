"""Secret scans (DataFrame functions only).

Base spans, leftmost and not overlapping per kind, are matches of three patterns; see ``KINDS``.
Positions come from two built-in functions over the same pattern: ``split`` gives the text
between the matches, ``regexp_extract_all`` the matches, and running sums of both lengths the
spans, in code points.

A battery of tests judges the value of every base span, and every run: 20 or more characters of a key
alphabet, with a letter and a digit, outside base spans.  Runs that pass are added spans (kind ``random``); base
spans stay whatever their values pass, and the digest says how many of a text's were judged, how many pass and
the least p-value.  The battery:

* the narrowest of nine encodings that holds the value gives the alphabet of size k;
* chi-squared uniformity of its characters, a runs test about the middle of the alphabet and the
  serial correlation of neighbours: the sum of the three squared deviates (chi-squared, 3 degrees)
  must not speak against a random run (below its 99.9 % point);
* the run must speak against ordinary text in its own encoding: words and numbers, whose characters
  stay in a class (digits, upper case, lower case, marks) or change it at the rates ``CHANGES`` and whose
  letters have the frequencies of English, evened out by ``EVEN``.  The likelihood of the run under that
  model over the one under equal chances, 1 / k a character, is a p-value that is never too small
  (Markov's inequality), whatever k is.  It goes through Benjamini-Hochberg control over all values of the
  corpus, per kind, encoding and power of two of the length.  P-values are counted in classes of whole powers
  of two, so the procedure moves a table of bounded size (kinds x encodings x lengths x 65 classes), never
  the values.

Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an
empty one.  A row is known by its id and the hash of its text, so rows that share an id do not mix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
ASSIGN, ASSIGN_LONG = _ASSIGN % "+", _ASSIGN % "{12,}"
#: A run of 18 / 16 characters or more is a run whose whole match has that length.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding: pattern and alphabet, the narrowest first.
ENCODINGS = {
    "hex": (r"\A[0-9A-F]+\z", DIGITS + "ABCDEF"),
    "hex_lower": (r"\A[0-9a-f]+\z", DIGITS + "abcdef"),
    "base32": (r"\A[A-Z2-7]+\z", UPPER + "234567"),
    "base36": (r"\A[0-9a-z]+\z", DIGITS + LOWER),
    "base36_upper": (r"\A[0-9A-Z]+\z", DIGITS + UPPER),
    "base62": (r"\A[0-9A-Za-z]+\z", DIGITS + UPPER + LOWER),
    "base64": (r"\A[0-9A-Za-z+/]+\z", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"\A[0-9A-Za-z_-]+\z", UPPER + LOWER + DIGITS + "-_"),
    "mixed": (r"\A[0-9A-Za-z+/_.=-]+\z", UPPER + LOWER + DIGITS + "+/-_.="),
}
RATE, RANDOM_LIMIT = 0.01, 16.27
#: English letters by frequency, in percent.
FREQUENCY = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.06, 8.17, 7.51, 6.97, 6.75, 6.33, 6.09, 5.99, 4.25, 4.03, 2.78, 2.76, 2.41, 2.36, 2.23, 2.02, 1.97, 1.93, 1.49, 0.98, 0.77, 0.15, 0.15, 0.1, 0.07)))
#: Share of the letters of ordinary runs that have equal chances: other languages and short forms.
EVEN = 0.2
#: Classes of characters (digit, upper, lower, mark) and the chances of the next one's class; an encoding without
#: some class has the others in proportion.
CHANGES = {
    "d": {"d": 0.60, "u": 0.14, "l": 0.14, "o": 0.12},
    "u": {"d": 0.11, "u": 0.45, "l": 0.35, "o": 0.09},
    "l": {"d": 0.15, "u": 0.06, "l": 0.72, "o": 0.07},
    "o": {"d": 0.22, "u": 0.18, "l": 0.50, "o": 0.10},
}
_MARKS = "+/-_.="
_CLASSES = "d" * len(DIGITS) + "u" * len(UPPER) + "l" * len(LOWER) + "o" * len(_MARKS)
_CLASS_OF = dict(zip(DIGITS + UPPER + LOWER + _MARKS, _CLASSES))
_BLOCK = 128
SPAN = "struct<s:bigint,k:int,e:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def running(a: Column) -> Column:
    """Sums of what stands before each element of an array of bigint; sums of blocks keep the work small."""

    def blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: _sum(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))

    def before(s: Column) -> Column:
        return F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b)))

    def within(a: Column, bases: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(bases, F.floor(i / _BLOCK).cast("int")) + _sum(F.slice(a, i - i % _BLOCK + 1, i % _BLOCK)))

    return F.when(F.size(a) > 0, let(a, lambda x: let(let(blocks(x), before), lambda b: within(x, b)))).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters or more."""
    n = lambda x: F.length(x).cast("bigint")
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.zip_with(
        F.zip_with(F.transform(gaps, n), F.transform(whole, n), lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
        F.transform(checked, n),
        lambda x, c: F.struct(x["g"].alias("g"), x["m"].alias("m"), c.alias("c")),
    )
    found = F.filter(sizes, lambda x: x["m"].isNotNull())

    def placed(x: Column) -> Column:
        starts = running(F.transform(x, lambda y: y["g"] + y["m"]))
        return F.zip_with(x, starts, lambda y, s: F.struct((s + y["g"]).alias("s"), F.lit(kind).alias("k"), (s + y["g"] + y["m"]).alias("e"), (y["c"] >= least).alias("ok")))

    kept = F.filter(let(found, placed), lambda y: y["ok"])
    return F.transform(kept, lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e"))).cast(f"array<{SPAN}>")


def base(text: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{SPAN}>")
    return {
        "assign": F.when(text.rlike(ASSIGN_LONG), spans(text, ASSIGN, 0, 2, 12)).otherwise(none),
        "access": F.when(text.rlike(ACCESS), spans(text, ACCESS, 1)).otherwise(none),
        "hex": F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(none),
    }


def all_base(text: Column) -> Column:
    return F.array_sort(F.concat(*base(text).values()))


def shown(a: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


_TESTED = "array<struct<s:bigint,k:int,e:bigint,body:string>>"


def _values(text: Column, found: dict[str, Column]) -> Column:
    """The values of base spans: what is assigned, or the whole match."""
    none = F.array().cast(_TESTED)

    def of(kind: str, pattern: str, group: int, least: int) -> Column:
        values = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least)
        made = F.zip_with(found[kind], values, lambda x, v: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), v.alias("body")))
        return F.when(F.size(found[kind]) > 0, made.cast(_TESTED)).otherwise(none)

    return F.concat(of("assign", ASSIGN, 2, 12), of("access", ACCESS, 0, 1), of("hex", HEX, 0, 1))


def _runs(text: Column, found: Column) -> Column:
    """The runs of key alphabets outside base spans."""
    free = F.filter(spans(text, RUN, 3), lambda x: ~F.exists(found, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    body = lambda x: F.rtrim(F.substring(text, (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")), F.lit("="))
    made = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), body(x).alias("body")))
    return F.when(text.rlike(RUN), made.cast(_TESTED)).otherwise(F.array().cast(_TESTED))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), base spans by kind, ``found`` (all of them) and ``tested`` (values of base spans, and runs) of every row, in one pass over the texts."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("key"), "text", *[v.alias(k) for k, v in base(text).items()])
    rows = rows.withColumn("found", F.array_sort(F.concat("assign", "access", "hex")))
    tested = F.concat(_values(text, {k: F.col(k) for k in KINDS[:3]}), _runs(text, F.col("found")))
    return rows.select("doc_id", "key", *KINDS[:3], "found", tested.alias("tested"))


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, key, s, kind, e, body of each value to be tested; repeated rows count once."""
    x = rows.where(F.size("tested") > 0).select("doc_id", "key", F.explode("tested").alias("x"))
    return x.select("doc_id", "key", "x.s", F.col("x.k").alias("kind"), "x.e", "x.body").distinct()


def ordinary(alphabet: str) -> tuple[list[float], dict[str, float], float]:
    """Ordinary text in an alphabet, as logarithms to base 2: of each character within its class, of each pair of classes, of the first class."""
    classes = sorted({_CLASS_OF[x] for x in alphabet})
    members = {c: [x for x in alphabet if _CLASS_OF[x] == c] for c in classes}
    weight = {x: FREQUENCY.get(x.lower(), 1.0) for x in alphabet}
    share = lambda x, m: (1 - EVEN) * weight[x] / sum(weight[y] for y in m) + EVEN / len(m)
    pairs = {a + b: math.log2(CHANGES[a][b] / sum(CHANGES[a][c] for c in classes)) for a in classes for b in classes}
    return [math.log2(share(x, members[_CLASS_OF[x]])) for x in alphabet], pairs, -math.log2(len(classes))


def battery(given: DataFrame) -> DataFrame:
    """The tests of each value (``body``): adds encoding, k, n, chi, bits (against ordinary text), z_chi, z_runs, z_serial and random (the verdict of their sum)."""
    encoding = F.coalesce(*[F.when(F.col("body").rlike(p), F.lit(e)) for e, (p, _) in ENCODINGS.items()])
    alphabet = F.coalesce(*[F.when(F.col("encoding") == e, F.lit(a)) for e, (_, a) in ENCODINGS.items()])
    c = given.withColumn("encoding", encoding).where(F.col("encoding").isNotNull()).withColumn("alphabet", alphabet)
    letters = F.filter(F.split("alphabet", ""), lambda x: x != "")
    times = lambda x: (F.length("body") - F.length(F.replace(F.col("body"), x, F.lit("")))).cast("double")
    models = {e: ordinary(a) for e, (_, a) in ENCODINGS.items()}
    chosen = lambda of: F.coalesce(*[F.when(F.col("encoding") == e, of(m)) for e, m in models.items()])
    chances = chosen(lambda m: F.array(*[F.lit(x) for x in m[0]]))

    def counted(counts: Column) -> Column:
        squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
        return F.struct(squares.alias("squares"), F.aggregate(F.zip_with(counts, chances, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x).alias("within"))

    # a class holds a pair at each place where the next character's class follows
    follows = lambda pair: F.regexp_count("classes", F.lit(f"{pair[0]}(?={pair[1]})"))
    changes = chosen(lambda m: sum((follows(p) * F.lit(w) for p, w in m[1].items()), F.lit(m[2])))
    codes = F.transform(F.filter(F.split("body", ""), lambda x: x != ""), lambda x: F.position(x, F.col("alphabet")) - (F.length("alphabet") + 1) / 2.0)

    def tests(v: Column) -> Column:
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + ((p["a"] >= 0) != (p["b"] >= 0)).cast("double"))
        products = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + p["a"] * p["b"])
        own = F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
        return F.struct(turns.alias("turns"), (products / own).alias("serial"))

    c = c.select("*", F.length("body").cast("double").alias("n"), F.length("alphabet").cast("double").alias("k"), F.translate("body", "".join(_CLASS_OF), _CLASSES).alias("classes"), let(F.transform(letters, times), counted).alias("c"), let(codes, tests).alias("t"))
    n, k = F.col("n"), F.col("k")
    c = c.withColumns({"chi": k / n * F.col("c.squares") - n, "bits": -(n * F.log2(k) + F.col("c.within") + changes)})
    c = c.withColumns({"z_chi": (F.col("chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), "z_runs": (F.col("t.turns") - (n - 1) / 2) / F.sqrt((n - 1) / 4), "z_serial": (F.coalesce(F.col("t.serial"), F.lit(1.0)) + 1 / n) * F.sqrt(n)})
    total = F.pow(F.greatest(F.col("z_chi"), F.lit(0.0)), F.lit(2.0)) + F.pow("z_runs", F.lit(2.0)) + F.pow("z_serial", F.lit(2.0))
    return c.withColumn("random", total < RANDOM_LIMIT).drop("alphabet", "classes", "c", "t")


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``battery`` with ``found``: random, and passed by the false-discovery control of their kind."""
    from pyspark.sql import Window

    level = F.floor(F.least(F.greatest(F.col("bits"), F.lit(0.0)), F.lit(64.0))).cast("int")  # p <= 2 ** -bits
    t = tested.withColumns({"stratum": F.floor(F.log2("n")).cast("int"), "level": level})
    family = ["kind", "encoding", "stratum"]
    counts = t.groupBy(*family, "level").count()
    whole = Window.partitionBy(*family)
    up = whole.orderBy(F.col("level").desc())
    counts = counts.withColumns({"all": F.sum("count").over(whole), "above": F.sum("count").over(up)})
    limits = counts.where(F.pow(F.lit(2.0), -F.col("level")) <= F.col("above") * rate / F.col("all")).groupBy(*family).agg(F.min("level").alias("least"))
    # at most one row per kind, encoding and power of two
    joined = t.join(F.broadcast(limits), family, "left")
    return joined.withColumn("found", F.col("random") & F.coalesce(F.col("level") >= F.col("least"), F.lit(False)))


def judged(rows: DataFrame) -> DataFrame:
    """__th_id, __th_at (hash of the text), __th_more (added spans), n_judged, n_base_random and base_p of each text with a value to test."""
    tested = materialize(battery(candidates(rows)).drop("body"))
    span = F.struct(F.col("s"), F.col("kind").alias("k"), F.col("e")).cast(SPAN)
    run = F.col("kind") == 3
    return discoveries(tested).groupBy(F.col("doc_id").alias("__th_id"), F.col("key").alias("__th_at")).agg(
        F.collect_set(F.when(run & F.col("found"), span)).alias("__th_more"),
        F.count(F.when(~run, 1)).alias("n_judged"),
        F.count(F.when(~run & F.col("found"), 1)).alias("n_base_random"),
        F.min(F.when(~run, F.pow(F.lit(2.0), -F.greatest(F.col("bits"), F.lit(0.0))))).alias("base_p"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, and of the base spans n_judged, n_base_random and base_p (null without any) of every row."""
    rows = materialize(scanned(docs))
    said = judged(rows)
    rows = rows.drop("tested").join(said, F.col("doc_id").eqNullSafe(F.col("__th_id")) & (F.col("key") == F.col("__th_at")), "left")
    more = F.coalesce("__th_more", F.array().cast(f"array<{SPAN}>"))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown(F.col("found")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("found", more))).alias("spans"),
        F.size(more).cast("bigint").alias("n_random"),
        F.coalesce("n_judged", F.lit(0)).alias("n_judged"),
        F.coalesce("n_base_random", F.lit(0)).alias("n_base_random"),
        "base_p",
    )


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs``, all rows and columns, with every span replaced by ``mark``; n_chars, if there, follows."""
    names = docs.columns
    said = judged(scanned(docs)).where(F.size("__th_more") > 0).select("__th_id", "__th_at", "__th_more")
    here = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__th_id")) & (F.xxhash64(text_of()) == F.col("__th_at"))
    rows = docs.join(said, here, "left")
    marked = F.array_sort(F.concat(all_base(text_of()), F.coalesce("__th_more", F.array().cast(f"array<{SPAN}>"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        parts = F.when(x["s"] >= acc["at"], F.concat(acc["parts"], F.array(piece, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), parts.alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    rows = rows.withColumn("__th_marked", marked)
    clean = F.when(F.size("__th_marked") > 0, F.aggregate("__th_marked", start, step, rest)).otherwise(F.col("text"))
    rows = rows.withColumn("text", clean)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)
