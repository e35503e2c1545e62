"""Path rules as Column expressions, all of them built-in functions.

The NFC form of paths beyond ASCII has no built-in function; ``with_nfc`` makes it in Arrow batches of
those rows alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .limits import DEFAULT_LIMITS, Limits

SEPARATOR = r"[\\/]"
DEVICE = r"(?i)\A(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|\z)"
ADS = r":[^/\\]"
DRIVE = r"\A[A-Za-z]:"
#: White space beyond ASCII that counts as blank.
_WIDE = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_BLANK = r"\A[\t\n\x0B\f\r " + _WIDE + r"]*\z"
MAX_PATH = 4096
_DEVICES = r"(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])"
#: The rules on single segments, over whole paths.
DEVICE_IN = r"(?i)(?:\A|[\\/])" + _DEVICES + r"(?:[.\\/]|\z)"
_UP = r"(?:\A|[\\/])\.\.(?:[\\/]|\z)"
_ORDINARY, _SPECIAL = r"\A[A-Za-z0-9_-][A-Za-z0-9_./-]*\z", r"(?i)\.(?:/|\z)|/(?:[./]|\z)|(?:\A|/)" + _DEVICES + r"(?:[./]|\z)"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def plain(p: Column, depth: int = DEFAULT_LIMITS.max_depth) -> Column:
    """Whether a path is short and of ordinary letters and segments: it breaks no rule and lands where it says.

    This holds for most paths and costs two matches; any other path is held against the rules.  A path of n segments, none
    of them empty, has 2n - 1 characters at least.
    """
    short = F.length(p) < min(2 * depth, MAX_PATH + 1)
    return F.coalesce(short & p.rlike(_ORDINARY) & ~p.rlike(_SPECIAL), F.lit(False))


def segments(p: Column) -> Column:
    return F.split(p, SEPARATOR, -1)


def strip_dot_segments(p: Column) -> Column:
    """Without ``.`` segments, joined by ``/``; unchanged (separators too) if it has none."""
    dots = p.rlike(r"(?:\A|[\\/])\.(?:[\\/]|\z)")
    return F.when(dots, F.array_join(F.filter(segments(p), lambda s: s != "."), "/")).otherwise(p)


def normalize_path(p: Column) -> Column:
    """Where an NFC path lands below the output; null if it climbs out or nothing is left."""
    start = F.array(F.lit("^"))  # popping it empties the stack for good

    def step(stack: Column, s: Column) -> Column:
        return (
            F.when(F.size(stack) == 0, stack)
            .when((s == "") | (s == "."), stack)
            .when(s == "..", F.when(F.size(stack) == 1, F.array().cast("array<string>")).otherwise(F.slice(stack, 1, F.size(stack) - 1)))
            .otherwise(F.concat(stack, F.array(s)))
        )

    def landing(parts: Column) -> Column:
        down = F.concat(start, F.filter(parts, lambda s: (s != "") & (s != ".")))
        return _let(F.when(F.array_contains(parts, ".."), F.aggregate(parts, start, step)).otherwise(down), joined)

    joined = lambda stack: F.when(F.size(stack) > 1, F.array_join(F.slice(stack, F.lit(2), F.size(stack)), "/"))
    return F.when(plain(p), p).otherwise(_let(F.split(F.translate(p, "\\", "/"), "/", -1), landing))


def utf16_length(p: Column) -> Column:
    return F.length(F.encode(p, "UTF-16BE")) / 2


def path_error_code(path: Column, limits: Limits = DEFAULT_LIMITS, platform: str = "posix") -> Column:
    """The code of the first rule that a path breaks, else null."""
    policy = F.lit("PATH_POLICY_VIOLATION")

    def rules(p: Column) -> Column:
        parts = segments(p)
        marks = F.transform(parts, lambda s: F.when(s.rlike(r'[<>"|?*]'), "PATH_POLICY_VIOLATION").when(s.rlike(DEVICE), "PATH_WINDOWS_DEVICE"))
        out = (
            F.when(p.contains("\0"), F.lit("PATH_NUL_BYTE"))
            .when(p.rlike(_BLANK), policy)
            .when(p.rlike(r"[\x00-\x1F]"), policy)
            .when(p.contains("%"), policy)
            .when(p.startswith("/") | p.rlike(DRIVE) | p.startswith("\\\\"), F.lit("PATH_ABSOLUTE"))
            .when(p.rlike(ADS), F.lit("PATH_WINDOWS_ADS"))
            .when(p.rlike(r'[<>"|?*]') | p.rlike(DEVICE_IN), F.get(F.filter(marks, lambda m: m.isNotNull()), F.lit(0)))
            .when(p.rlike(_UP), F.lit("PATH_TRAVERSAL"))
            .when(p.rlike(r"[. ](?:[\\/]|\z)"), F.lit("PATH_WINDOWS_TRAILING_DOTS"))
            .when(p.contains("/") & p.contains("\\"), policy)
        )
        if platform == "posix":
            out = out.when(p.contains("\\"), policy)
        out = out.when(p.contains("//") | p.contains("\\\\"), policy).when(p.endswith("/") | p.endswith("\\"), policy)
        return out.when(F.size(parts) > limits.max_depth, F.lit("LIMIT_DEPTH")).when(utf16_length(p) > MAX_PATH, policy)

    given = F.when(path.contains("\\"), path).otherwise(strip_dot_segments(path))
    return F.when(~plain(path, limits.max_depth), _let(given, rules))


def strip_segments(p: Column, count: int) -> Column:
    """Without the first ``count`` segments; empty if there are no more."""
    parts = segments(p)
    return F.array_join(F.slice(parts, F.lit(count + 1), F.greatest(F.size(parts) - count, F.lit(0))), "/") if count else p


def path_depth(p: Column) -> Column:
    return F.size(segments(p))


def fold_case(p: Column) -> Column:
    return F.lower(p)


def is_inside(target: Column, root: Column) -> Column:
    """Whether a path lies in a folder, by whole segments."""
    t, r = normalize_path(target), normalize_path(root)
    return F.coalesce((t == r) | F.startswith(t, F.concat(r, F.lit("/"))), F.lit(False))


def link_escapes(path: Column, target: Column, kind: Column) -> Column:
    """Whether a link's target leaves the output folder, from the entry's folder (symlink) or the root (hardlink).

    The fold starts in a folder named ``output``, so a target that leaves it and enters it again by name stays inside.
    """
    absolute = target.contains("\0") | target.startswith("/") | target.startswith("\\") | target.rlike(DRIVE)
    entry, to = F.split(F.translate(path, "\\", "/"), "/", -1), F.split(F.translate(target, "\\", "/"), "/", -1)
    parent = F.when(kind == "symlink", F.slice(entry, F.lit(1), F.size(entry) - 1)).otherwise(F.array().cast("array<string>"))

    def step(stack: Column, s: Column) -> Column:
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when((s == "") | (s == "."), stack).when(s == "..", up).otherwise(F.concat(stack, F.array(s)))

    at = F.aggregate(F.concat(parent, to), F.array(F.lit("output")), step)
    return F.when(target.isNull(), F.lit(None).cast("boolean")).otherwise(absolute | F.coalesce(F.get(at, F.lit(0)) != "output", F.lit(True)))


def with_nfc(df: DataFrame, column: str, out: str, ascii_rows: Column | None = None) -> DataFrame:
    """``df`` with the NFC form of a text column.  ASCII rows never leave the JVM; the rest go through Arrow, without a join.

    ``ascii_rows`` is true for rows that are known to be ASCII, others may be too.
    """
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    plain = plain if ascii_rows is None else F.coalesce(ascii_rows, F.lit(False)) | plain
    at = df.columns.index(column)
    rest = df.where(~plain)
    schema = df.withColumn(out, F.col(column)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if p is None else unicodedata.normalize("NFC", p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.where(plain).withColumn(out, F.col(column)).unionByName(rest.mapInArrow(run, schema))
