import random

import pytest
from pyspark.sql import functions as F

from tarnhold import errors as E
from tarnhold.functions import modes, paths, scalar
from tarnhold.operators import audit
from tarnhold.plans import registry
from tarnhold.sources import detect

CASES = [
    ("docs/readme.txt", None), ("./docs/./a.txt", None), (".", "PATH_POLICY_VIOLATION"), ("../evil.txt", "PATH_TRAVERSAL"), ("a/../b", "PATH_TRAVERSAL"), ("/etc/passwd", "PATH_ABSOLUTE"),
    ("//server/share/x", "PATH_ABSOLUTE"), ("C:\\Windows\\evil.dll", "PATH_ABSOLUTE"), ("C:evil.txt", "PATH_ABSOLUTE"), ("\\\\server\\share", "PATH_ABSOLUTE"), ("file.txt:Zone.Identifier", "PATH_WINDOWS_ADS"),
    ("CON.txt", "PATH_WINDOWS_DEVICE"), ("dir/COM1", "PATH_WINDOWS_DEVICE"), ("console.txt", None), ("file.txt.", "PATH_WINDOWS_TRAILING_DOTS"), ("file.txt ", "PATH_WINDOWS_TRAILING_DOTS"), ("...", "PATH_WINDOWS_TRAILING_DOTS"),
    ("a//b", "PATH_POLICY_VIOLATION"), ("a/", "PATH_POLICY_VIOLATION"), ("foo/bar\\baz", "PATH_POLICY_VIOLATION"), ("foo\\bar", "PATH_POLICY_VIOLATION"), (".%2e/x", "PATH_POLICY_VIOLATION"), ("a<b>.txt", "PATH_POLICY_VIOLATION"),
    ("a\0b", "PATH_NUL_BYTE"), ("a\tb", "PATH_POLICY_VIOLATION"), ("..foo/bar", None), ("cafe\u0301.txt", None), ("/".join(["d"] * 128), None), ("/".join(["d"] * 129), "LIMIT_DEPTH"), ("././" + "/".join(["d"] * 128), None),
    ("CON\n", "PATH_POLICY_VIOLATION"), ("   ", "PATH_POLICY_VIOLATION"), ("\u00a0\u2003", "PATH_POLICY_VIOLATION"), ("x" * 4097, "PATH_POLICY_VIOLATION"), ("\U0001f600" * 2049, "PATH_POLICY_VIOLATION"), ("\U0001f600" * 2048, None),
]


def test_known_paths(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], "i int, path string")
    got = {r.i: r.code for r in df.select("i", paths.path_error_code(F.col("path")).alias("code")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c for _, c in CASES]
    assert [scalar.path_error_code(p) for p, _ in CASES] == [c for _, c in CASES]


def _random_paths(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcABC123-_./\\..:%éà \u0301CON") for _ in range(rng.randint(1, 24))) for _ in range(n)]


def _normal(p):
    try:
        return scalar.normalize_path(p)
    except E.ArchiveError:
        return None


@pytest.mark.parametrize("platform", ["posix", "windows"])
def test_columns_agree_with_the_model(spark, platform):
    given = _random_paths(1500, 42)
    df = audit.normalized(spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, path string"))
    rows = df.select("i", "path", "normalized", paths.path_error_code(F.col("path"), platform=platform).alias("code"), paths.strip_dot_segments(F.col("path")).alias("stripped"), paths.strip_segments(F.col("path"), 1).alias("cut")).collect()
    assert len(rows) == len(given)
    for r in rows:
        p = given[r.i]
        assert r.code == scalar.path_error_code(p, platform=platform), p
        assert r.normalized == _normal(p), p
        assert r.stripped == scalar.strip_dot_segments(p)
        assert r.cut == "/".join(scalar._segments(p)[1:])


def test_link_escapes_agree_with_the_model(spark):
    rng = random.Random(7)
    part = ["..", "a", "output", ".", "", "b"]
    rows = [(i, "/".join(rng.choices(part, k=3)), "/".join(rng.choices(part, k=rng.randint(1, 5))), rng.choice(["symlink", "hardlink"])) for i in range(800)]
    rows += [(900, "a", "C:x", "symlink"), (901, "a", "\\x", "hardlink"), (902, "a/b", "../output/x", "hardlink"), (903, "x", "a\0b", "symlink")]
    df = spark.createDataFrame(rows, "i int, path string, target string, kind string")
    for r in df.select("*", paths.link_escapes(F.col("path"), F.col("target"), F.col("kind")).alias("out")).collect():
        assert r.out == scalar.link_escapes(r.path, r.target, r.kind), r


def test_modes_agree_with_the_model(spark):
    rows = [(m, k) for m in [None, *range(0, 0o10000, 37)] for k in ("file", "directory", "symlink")]
    df = spark.createDataFrame(rows, "mode int, kind string")
    out = df.select("*", modes.sanitize_mode(F.col("mode"), F.col("kind")).alias("a"), modes.sanitize_mode(F.col("mode"), F.col("kind"), True, 0).alias("b"), modes.octal(F.col("mode")).alias("o")).collect()
    for r in out:
        assert r.a == scalar.sanitize_mode(r.mode, r.kind) and r.b == scalar.sanitize_mode(r.mode, r.kind, True, 0)
        assert r.o == (None if r.mode is None else oct(r.mode))


def test_public_helpers():
    assert scalar.is_inside_output("/out/a", "/out") and not scalar.is_inside_output("/out-evil/a", "/out")
    seen, folded = set(), {}
    assert scalar.check_duplicate(seen, "a") == "new" and scalar.check_duplicate(seen, "a", "skip") == "skip"
    with pytest.raises(E.DuplicatePathError):
        scalar.check_duplicate(seen, "a")
    assert scalar.check_case_collision(folded, "Foo", True) == "new" and scalar.check_case_collision(folded, "Foo", True) == "new"
    with pytest.raises(E.CaseCollisionError):
        scalar.check_case_collision(folded, "foo", True)
    assert scalar.check_case_collision(folded, "foo", False) == "new"
    with pytest.raises(E.SymlinkRefusedError):
        scalar.validate_symlink_target("a", "b", False)
    with pytest.raises(E.LinkEscapeError):
        scalar.validate_symlink_target("a", "../b", True)
    with pytest.raises(E.HardlinkTargetMissingError):
        scalar.validate_hardlink_target("a", "b", True, {"c"})
    with pytest.raises(E.PathTraversalError) as caught:
        scalar.validate_path("../x")
    assert caught.value.to_json()["code"] == "PATH_TRAVERSAL"


@pytest.mark.parametrize("bad", [None, 3, [], {}, {"path": "a"}, {"path": "", "source_format": "x", "type": "file"}, {"path": "a", "source_format": "x", "type": "fifo"}, *[{"path": "a", "source_format": "x", "type": "file", "size": s} for s in (-1, 1.5, float("inf"), 2**53, True)], {"path": "a", "source_format": "x", "type": "file", "mode": 0o20000}, {"path": "a", "source_format": "x", "type": "symlink"}])
def test_malformed_records(bad):
    with pytest.raises(E.PluginInvalidEntryError):
        scalar.validate_archive_entry(bad)


def _documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_whole_texts_as_paths(spark, tmp_path):
    """What stands far behind the 60th character counts: climbing out, letters to fold, long lists of segments."""
    rng = random.Random(9)
    far = "\n".join(["part"] * 30)
    texts = [None, "", far + "\n.." * 29 + "\nx", far + "\n.." * 31 + "\nx", far + "\ncafe\u0301", "é/" + far + "\n./.\\e\u0301", "\n".join(["d"] * 3000) + "\n..\nz"]
    texts += ["\n".join(rng.choice(["a", "bc", "..", ".", "", "e\u0301", "long" * 9]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    got = {r.doc_id: r.normalized for r in registry.QUERIES["normalize_path_whole"](spark, _documents(spark, tmp_path, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else _normal(t.replace("\n", "/")) for t in texts]


def test_whole_texts_as_archives(spark, tmp_path):
    """Headers behind the 8th character, blocks of zeros, and sizes in bytes."""
    header = "n" * 257 + "ustar" + "x" * 300
    texts = [None, "", "PK\3", "PK\3\4", "PK\5\6" + "é" * 300, "BZh9", header, "n" * 256 + "ustar", "é" * 128 + "nustar\0", "é" * 257 + "ustar", "\0" * 1024, "\0" * 1023, "\0" * 512 + "é" * 256, "\0" * 511 + "a" * 513, "\0" * 512]
    got = {r.doc_id: r for r in registry.QUERIES["detect_format_whole"](spark, _documents(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        data = None if t is None else t.encode()
        assert got[i].detected == (None if data is None else detect.detect_bytes(data)), i
        assert (got[i].size, got[i].peek) == (None if data is None else len(data), None if data is None else data[:512].hex().upper()), i
    assert [got[i].detected for i in (6, 8, 10, 12)] == ["tar"] * 4
