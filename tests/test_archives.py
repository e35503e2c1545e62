"""Archives rebuilt from their description, through the readers and the three calls."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tarnhold import api, cli, compat
from tarnhold import errors as E
from tarnhold.sources import readers
from tarnhold.sources.detect import detect_bytes
from tarnhold.sources.plugins import Plugin, legacy
from tarnhold.sources.writers import FORMATS, pack

GOOD = [{"path": "dir", "type": "directory", "mode": 0o755}, {"path": "dir/a.txt", "body": b"hello"}, {"path": "dir/b.sh", "body": b"x" * 3000, "mode": 0o4755}]


def codes(spark, data, **more):
    return {(f.code, f.severity) for f in api.audit_archive(spark, data, **more).findings.collect()}


def risk(spark, data, **more):
    return api.audit_archive(spark, data, **more).report.first().risk_level


@pytest.mark.parametrize("fmt", FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    data = pack(GOOD, fmt)
    assert detect_bytes(data) == fmt
    listed = api.list_archive(spark, data).orderBy("entry_index").collect()
    assert [(r.path, r.type, r.size) for r in listed] == [("dir", "directory", 0), ("dir/a.txt", "file", 5), ("dir/b.sh", "file", 3000)]
    assert listed[2].raw_mode == 0o4755 and listed[2].mode == 0o755
    got = api.extract(spark, data, str(tmp_path / "out"))
    assert got.total_bytes == 3005 and got.detected_formats == [fmt]
    assert (tmp_path / "out/dir/a.txt").read_bytes() == b"hello"
    assert stat.S_IMODE(os.stat(tmp_path / "out/dir/b.sh").st_mode) == 0o755
    assert sorted(os.listdir(tmp_path)) == ["out"]
    assert ("setuid_bit", "high") in codes(spark, data)


@pytest.mark.parametrize(
    "fmt,rows,finding,level",
    [
        ("tar", [{"path": "link", "type": "symlink", "link_target": ".."}], ("symlink_escape", "critical"), "critical"),
        ("tar", [{"path": "passwd", "type": "symlink", "link_target": "/etc/passwd"}], ("symlink_escape", "critical"), "critical"),
        ("tar", [{"path": "r", "body": b"x"}, {"path": "leak", "type": "hardlink", "link_target": "../secret"}], ("hardlink_escape", "critical"), "critical"),
        ("tar", [{"path": "f", "mode": 0o1777}], ("sticky_bit", "medium"), "medium"),
        ("tar", [{"path": "d/" * 129 + "f"}], ("excessive_depth", "medium"), "medium"),
        ("zip", [{"path": "a/../../x"}], ("path_traversal", "critical"), "critical"),
        ("tar.gz", [{"path": "../output-evil/file.txt"}], ("path_traversal", "critical"), "critical"),
        ("zip", [{"path": "file.txt."}], ("trailing_dots_spaces", "high"), "high"),
        ("zip", [{"path": "caf\u00e9"}, {"path": "cafe\u0301"}], ("duplicate_path", "medium"), "medium"),
        ("zip", [{"path": "Foo"}, {"path": "foo"}], ("case_collision", "medium"), "medium"),
        ("zip", [{"path": "C:\\x"}], ("windows_drive_absolute", "critical"), "critical"),
        ("zip", [{"path": "nested/link", "type": "symlink", "mode": 0o777, "link_target": "../../outside.txt"}], ("symlink_escape", "critical"), "critical"),
        ("tar.gz", [{"path": "z", "body": bytes(1 << 20)}], ("excessive_compression_ratio", "high"), "high"),
        ("tar.gz", [{"path": f"f{i}"} for i in range(1001)], ("high_entry_count", "low"), "low"),
    ],
)
def test_malicious(spark, tmp_path, fmt, rows, finding, level):
    data = pack(rows, fmt)
    assert finding in codes(spark, data) and risk(spark, data) == level
    if level in ("critical",):
        with pytest.raises(E.ArchiveError):
            api.extract(spark, data, str(tmp_path / "out"), allow_symlinks=True, allow_hardlinks=True)
        assert os.listdir(tmp_path) == []


def test_all_or_nothing(spark, tmp_path):
    data = pack([{"path": "good.txt", "body": b"x"}, {"path": "../evil.txt"}], "tar")
    with pytest.raises(E.PathTraversalError) as caught:
        api.extract(spark, data, str(tmp_path / "out"))
    assert caught.value.entry_index == 1 and os.listdir(tmp_path) == []


def test_broken_archives(spark, tmp_path):
    tar = pack(GOOD, "tar")
    assert api.list_archive(spark, bytes(1024)).count() == 0
    for data, kind in [(b"no archive at all", E.UnknownFormatError), (tar[:1000], E.TruncatedArchiveError), (pack(GOOD, "tar.gz")[:60], E.TruncatedArchiveError), (pack(GOOD, "zip")[:-30], E.CorruptArchiveError), (pack([{"path": "p", "type": "fifo"}], "tar"), E.CorruptArchiveError), (tar[:-9216], E.TruncatedArchiveError)]:
        with pytest.raises(kind):
            api.list_archive(spark, data)
    with pytest.raises(E.ArchiveNotFoundError):
        api.list_archive(spark, str(tmp_path / "none.zip"))
    for given in (3, str(tmp_path)):
        with pytest.raises(E.InvalidInputError):
            api.list_archive(spark, given)
    with pytest.raises(E.ArchiveSizeExceededError):
        api.list_archive(spark, tar, max_archive_size=100)
    with pytest.raises(E.ArchiveSizeExceededError):
        api.list_archive(spark, iter([tar, tar]), max_archive_size=len(tar) + 1)
    assert api.list_archive(spark, iter([tar[:700], tar[700:]])).count() == 3
    assert api.list_archive(spark, pack([{"path": "c", "type": "contiguous", "body": b"x"}], "tar")).first().type == "file"


def test_one_broken_archive_keeps_the_batch(spark):
    files = readers.of_bytes(spark, [("good", pack(GOOD, "zip")), ("bad", b"PK\x03\x04 nothing"), ("odd", b"?" * 600)])
    parsed = readers.parse(files)
    assert readers.entries(parsed).groupBy("archive_id").count().collect() == [("good", 3)]
    assert {(r.archive_id, r.error_code) for r in readers.failures(parsed).collect()} == {("bad", "CORRUPT_ARCHIVE"), ("odd", "UNKNOWN_FORMAT")}


def test_limits(spark, tmp_path):
    data = pack([{"path": f"f{i}", "body": b"x" * 10} for i in range(5)], "tar")
    for more, kind in [({"max_files": 4}, E.FileCountExceededError), ({"max_entry_size": 9}, E.EntrySizeExceededError), ({"max_total_size": 49}, E.TotalSizeExceededError), ({"max_depth": 0}, E.DepthExceededError)]:
        with pytest.raises(kind):
            api.extract(spark, data, str(tmp_path / "out"), **more)
    assert os.listdir(tmp_path) == []
    api.extract(spark, data, str(tmp_path / "out"), max_files=5, max_entry_size=10, max_total_size=50, max_depth=1)
    bomb = pack([{"path": "z", "body": bytes(1 << 20)}], "tar.gz")
    with pytest.raises(E.CompressionRatioExceededError):
        api.extract(spark, bomb)
    assert ("excessive_entry_count", "high") in codes(spark, data, max_files=4)
    assert api.audit_archive(spark, data, max_files=2).report.first().entry_count == 3


def test_overflow(spark):
    size = (2**53 - 1) // 100 + 1
    big = Plugin("big", lambda data, warn: [{"path": f"f{i}", "type": "file", "size": size, "source_format": "big"} for i in range(100)])
    assert ("total_size_overflow", "critical") in codes(spark, b"x", plugins=[big])
    with pytest.raises(E.TotalSizeExceededError):
        api.extract(spark, b"x", plugins=[big], max_entry_size=2**53 - 1, max_total_size=2**53 - 1, max_compression_ratio=1e300)


def test_output_states(spark, tmp_path):
    data = pack(GOOD, "zip")
    (tmp_path / "file").write_text("x")
    (tmp_path / "full").mkdir()
    (tmp_path / "full/old").write_text("x")
    os.symlink(tmp_path / "full", tmp_path / "link")
    for name, kind in (("file", E.OutputIsFileError), ("full", E.OutputExistsError), ("link", E.OutputIsSymlinkError)):
        with pytest.raises(kind):
            api.extract(spark, data, str(tmp_path / name))
    api.extract(spark, data, str(tmp_path / "full"), overwrite=True)
    assert os.listdir(tmp_path / "full") == ["dir"] and sorted(os.listdir(tmp_path)) == ["file", "full", "link"]


def test_duplicates(spark, tmp_path):
    data = pack([{"path": "foo", "body": b"1"}, {"path": "foo", "body": b"2"}], "zip")
    with pytest.raises(E.DuplicatePathError):
        api.extract(spark, data)
    got = api.extract(spark, data, str(tmp_path / "skip"), duplicates="skip")
    assert [w["code"] for w in got.warnings] == ["duplicate_skipped"] and (tmp_path / "skip/foo").read_bytes() == b"1"
    got = api.extract(spark, data, str(tmp_path / "last"), duplicates="overwrite")
    assert got.entries.count() == 2 and (tmp_path / "last/foo").read_bytes() == b"2"
    pair = pack([{"path": "Foo"}, {"path": "foo"}], "tar")
    assert api.extract(spark, pair).entries.count() == 2
    with pytest.raises(E.CaseCollisionError):
        api.extract(spark, pair, case_insensitive=True)


def test_strip_filter_map(spark, tmp_path):
    data = pack(GOOD, "tar")
    got = api.extract(spark, data, str(tmp_path / "a"), strip=1)
    assert [w["code"] for w in got.warnings] == ["path_strip_collapsed"] and sorted(os.listdir(tmp_path / "a")) == ["a.txt", "b.sh"]
    got = api.extract(spark, data, filter=F.col("path").endswith(".txt"), map={"path": F.concat(F.lit("new/"), F.col("path"))})
    assert [(r.path, r.raw_path, r.disposition) for r in got.entries.collect()] == [("new/dir/a.txt", "dir/a.txt", "renamed")]
    with pytest.raises(E.PathTraversalError):
        api.extract(spark, data, map={"path": F.concat(F.lit("../"), F.col("path"))})
    with pytest.raises(E.PluginInvalidEntryError):
        api.extract(spark, data, map={"size": F.lit(-1)})


def test_links(spark, tmp_path):
    data = pack([{"path": "real", "body": b"x"}, {"path": "h2", "type": "hardlink", "link_target": "h1"}, {"path": "h1", "type": "hardlink", "link_target": "real"}, {"path": "d/s", "type": "symlink", "link_target": "../real"}], "tar")
    with pytest.raises(E.HardlinkRefusedError):
        api.extract(spark, data)
    got = api.extract(spark, data, str(tmp_path / "o"), allow_symlinks=True, allow_hardlinks=True)
    assert os.stat(tmp_path / "o/h2").st_ino == os.stat(tmp_path / "o/real").st_ino and os.readlink(tmp_path / "o/d/s") == "../real"
    assert {r.path: r.mode for r in got.entries.collect()}["d/s"] == 0
    for rows, kind in [
        ([{"path": "h", "type": "hardlink", "link_target": "none"}], E.HardlinkTargetMissingError),
        ([{"path": "trap", "type": "symlink", "link_target": "x"}, {"path": "trap/f"}], E.LinkThroughSymlinkError),
        ([{"path": "f"}, {"path": "f/g"}], E.NotADirectoryError),
    ]:
        with pytest.raises(kind):
            api.extract(spark, pack(rows, "tar"), str(tmp_path / "no"), allow_symlinks=True, allow_hardlinks=True)


def test_plugins(spark):
    own = Plugin("own", lambda data, warn: [{"path": "x", "type": "file", "size": 4, "source_format": "own", "body": data}], detect=lambda peek: peek[:2] == b"OW")
    assert api.list_archive(spark, b"OWN!", plugins=[own]).first().source_format == "own"
    assert api.list_archive(spark, b"nope", plugins=[own]).first().path == "x"  # a lone plugin is an explicit choice
    with pytest.raises(E.UnknownFormatError):
        api.list_archive(spark, b"nope", plugins=[own, own])
    with pytest.raises(E.PluginInvalidEntryError):
        api.list_archive(spark, b"x", plugins=[Plugin("bad", lambda data, warn: [{"path": ""}])])
    old = legacy("old", lambda data: [{"path": "a", "type": "odd", "data": data}])
    with pytest.raises(E.LegacyPluginNotEnabledError):
        api.list_archive(spark, b"x", plugins=[old])
    report = api.audit_archive(spark, b"data", plugins=[old], legacy_plugins=True)
    assert {f.code for f in report.findings.collect()} == {"legacy_plugin_used"} and report.entries.first().size == 4


def test_compat(spark, tmp_path):
    rows = compat.expand(spark, pack(GOOD, "tar.bz2"), str(tmp_path / "o"), strip=1)
    assert [(r["path"], bytes(r["data"])[:5]) for r in rows] == [("a.txt", b"hello"), ("b.sh", b"xxxxx")] and (tmp_path / "o/a.txt").exists()
    with pytest.raises(E.TotalSizeExceededError):
        compat.expand(spark, pack(GOOD, "tar"), max_in_memory=100)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.tar.gz").write_bytes(pack(GOOD, "tar.gz"))
    (tmp_path / "evil.zip").write_bytes(pack([{"path": "../x"}], "zip"))
    assert cli.main(["list", str(tmp_path / "a.tar.gz")], spark) == 0
    assert [r["path"] for r in json.loads(capsys.readouterr().out)] == ["dir", "dir/a.txt", "dir/b.sh"]
    assert cli.main(["audit", str(tmp_path / "evil.zip"), "--pretty"], spark) == 1
    assert json.loads(capsys.readouterr().out)[0]["risk_level"] == "critical"
    assert cli.main(["extract", str(tmp_path / "a.tar.gz"), str(tmp_path / "o")], spark) == 0 and (tmp_path / "o/dir/a.txt").exists()
    assert cli.main(["extract", str(tmp_path / "evil.zip"), str(tmp_path / "p")], spark) == 1
    assert cli.main(["nothing"], spark) == 2 and cli.main(["list", "x", "--max-depth", "3"], spark) == 2
    assert cli.default_output("/x/my.TAR.GZ") == "my" and cli.default_output("x.bin") == "output"


def test_stream(spark, tmp_path):
    from tarnhold.streaming import dropdir

    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([{"path": "ok"}], [{"path": "../x"}])):
        (tmp_path / f"in/{i}.zip").write_bytes(pack(rows, "zip"))
    for _ in range(2):  # what was seen is not read again
        dropdir.audit_to(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert sorted(r.risk_level for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["critical", "low"]


def _body(tar):
    """A TAR without the blocks of zeros at its end."""
    data = tar.rstrip(b"\0")
    return data + bytes(-len(data) % 512)


@pytest.mark.parametrize("with_body", [False, True])
def test_readers_read_to_the_end(with_body):
    """What hides or is broken behind the last entry: a row for each entry, then the verdict."""
    import bz2
    import gzip

    import zstandard

    rows = [{"path": f"f{i}", "body": bytes([65 + i]) * 700} for i in range(5)]
    tar, gz, bz, zst = (pack(rows, f) for f in ("tar", "tar.gz", "tar.bz2", "tar.zst"))
    sum_checked = zstandard.ZstdCompressor(write_checksum=True).compress(tar)
    cases = [
        (tar, 5, None), (gz, 5, None), (bz, 5, None), (zst, 5, None), (sum_checked, 5, None),
        (gz[:-8] + bytes(x ^ 1 for x in gz[-8:-4]) + gz[-4:], 5, "CORRUPT_ARCHIVE"), (gz[:-4], 5, "TRUNCATED_ARCHIVE"), (gz[:-12], None, "TRUNCATED_ARCHIVE"),
        (gz + b"junk behind the last member", 5, None), (gzip.compress(tar[:1536]) + gzip.compress(tar[1536:]), 5, None),
        (bz[:-5], 5, "TRUNCATED_ARCHIVE"), (bz[: len(bz) // 2], 0, "TRUNCATED_ARCHIVE"), (bz2.compress(tar[:1024]) + bz2.compress(tar[1024:]), 5, None), (bz[:-6] + bytes(x ^ 255 for x in bz[-6:]), None, "CORRUPT_ARCHIVE"),
        (zst[:-1], None, "TRUNCATED_ARCHIVE"), (sum_checked[:-2], 5, "TRUNCATED_ARCHIVE"), (sum_checked[:-1] + bytes([sum_checked[-1] ^ 1]), None, "CORRUPT_ARCHIVE"), (zst + zstandard.ZstdCompressor().compress(tar), 10, None),
        (_body(tar), 5, None), (_body(tar) + bytes(512) + _body(tar), 10, None), (_body(tar) + bytes(512) * 7 + tar, 10, None), (_body(tar) + bytes(100), 5, "TRUNCATED_ARCHIVE"), (tar + b"junk" * 128, 5, "CORRUPT_ARCHIVE"), (tar[:-3], 5, "TRUNCATED_ARCHIVE"),
    ]
    for i, (data, entries, code) in enumerate(cases):
        got = list(readers.records("a", data, readers.DEFAULT_LIMITS, with_body, []))
        errors = [r["error_code"] for r in got if r["kind"] == "error"]
        assert errors == ([code] if code else []), (i, got[-1])
        assert entries is None or sum(r["kind"] == "entry" for r in got) == entries, i
    bomb = gzip.compress(_body(tar) + bytes(40 << 20))
    assert list(readers.records("a", bomb, readers.Limits(max_total_size=1 << 20), with_body, []))[-1]["error_code"] == "LIMIT_TOTAL_SIZE"


def test_zip_types_and_modes(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, attributes, body in (("d/", 1, b""), ("plain", 1, b"x"), ("run", 0o100755 << 16, b"x"), ("bits", 0o104755 << 16, b"x"), ("dir", 0o040700 << 16, b""), ("l", 0o120777 << 16, b"plain")):
            info = zipfile.ZipInfo(name)
            info.external_attr = attributes
            z.writestr(info, body)
    rows = api.list_archive(spark, out.getvalue()).orderBy("entry_index").collect()
    assert [(r.path, r.type, r.raw_mode, r.link_target) for r in rows] == [("d", "directory", 0o755, None), ("plain", "file", 0o644, None), ("run", "file", 0o755, None), ("bits", "file", 0o4755, None), ("dir", "directory", 0o700, None), ("l", "symlink", 0o777, "plain")]


def test_choice_of_plugins(spark):
    """A lone plugin is the source whatever it names; of several the one that claims, then the one of the format; else nothing is."""
    made = lambda name, **more: Plugin(name, lambda data, warn: [{"path": name, "type": "file", "size": 0, "source_format": name}], **more)
    tar = pack(GOOD, "tar")

    def broken(peek):
        raise RuntimeError("no")

    first = lambda *p: api.list_archive(spark, tar, plugins=list(p)).first().path
    assert first(made("a", formats=("zip",))) == "a"
    assert first(made("a", detect=lambda peek: False)) == "a"
    assert first(made("a", formats=("zip",)), made("b", formats=("tar",))) == "b"
    assert first(made("a", formats=("tar",)), made("b", detect=lambda peek: True)) == "b"
    assert first(made("a", detect=broken), made("b", detect=lambda peek: True), made("c", detect=lambda peek: True)) == "b"
    with pytest.raises(E.UnknownFormatError):
        first(made("a", formats=("zip",)), made("b", detect=broken))


def test_functions_of_callers(spark, tmp_path):
    data = pack([*GOOD, {"path": "dir/c.txt", "body": b"no"}], "tar.gz")
    seen = ("path", "type", "mode", "mtime", "link_target", "size", "source_format", "raw_path", "raw_mode", "disposition")
    got = api.extract(spark, data, str(tmp_path / "o"), filter=lambda e: set(seen) <= set(e) and e["path"].endswith(".txt"), map=lambda e: {**e, "path": "new/" + e["path"].rpartition("/")[2]})
    assert sorted((r.path, r.raw_path, r.disposition) for r in got.entries.collect()) == [("new/a.txt", "dir/a.txt", "renamed"), ("new/c.txt", "dir/c.txt", "renamed")]
    assert (tmp_path / "o/new/c.txt").read_bytes() == b"no" and sorted(os.listdir(tmp_path / "o")) == ["new"]
    for more, kind in (({"filter": lambda e: 1 / 0}, E.UserFunctionError), ({"map": lambda e: e["none"]}, E.UserFunctionError), ({"map": lambda e: {**e, "size": -1}}, E.PluginInvalidEntryError), ({"map": lambda e: None}, E.PluginInvalidEntryError), ({"map": lambda e: {**e, "path": "../x"}}, E.PathTraversalError), ({"filter": 3}, E.InvalidInputError), ({"map": 3}, E.InvalidInputError)):
        with pytest.raises(kind):
            api.extract(spark, data, str(tmp_path / "no"), **more)
    assert os.listdir(tmp_path) == ["o"]


def test_abort_and_progress(spark, tmp_path):
    import threading
    import time

    signal, said = threading.Event(), []
    api.extract(spark, pack(GOOD, "zip"), str(tmp_path / "a"), signal=signal, on_progress=said.append)
    assert [p["entries_processed"] for p in said] == [1, 2, 3] and said[-1] == {"entries_processed": 3, "entries_total": 3, "bytes_processed": 3005}
    signal.set()
    for call in (api.extract, api.list_archive, api.audit_archive):
        with pytest.raises(E.AbortError):
            call(spark, pack(GOOD, "zip"), signal=signal)
    signal.clear()
    slow = Plugin("slow", lambda data, warn: (time.sleep(60), [])[1])
    began = time.time()
    threading.Timer(2, signal.set).start()
    with pytest.raises(E.AbortError):
        api.extract(spark, b"x", str(tmp_path / "b"), plugins=[slow], signal=signal)
    assert time.time() - began < 40 and sorted(os.listdir(tmp_path)) == ["a"]


def test_links_that_leave_by_other_links(spark, tmp_path, monkeypatch):
    """Each link stays inside by its letters; the last one leaves through the others."""
    rows = [{"path": "d/x", "body": b"x"}, {"path": "d/l1", "type": "symlink", "link_target": ".."}, {"path": "l2", "type": "symlink", "link_target": "d/l1/.."}, {"path": "l3", "type": "symlink", "link_target": "l2"}]
    with pytest.raises(E.LinkEscapeError):
        api.extract(spark, pack(rows, "tar"), str(tmp_path / "o"), allow_symlinks=True)
    assert os.listdir(tmp_path) == []
    good = pack([{"path": "d/x", "body": b"x"}, {"path": "l", "type": "symlink", "link_target": "d/x", "mtime": 1_000_000_000}], "tar")
    api.extract(spark, good, str(tmp_path / "o"), allow_symlinks=True)
    assert os.lstat(tmp_path / "o/l").st_mtime == 1_000_000_000

    def refused(*a, **k):
        raise PermissionError("no links here")

    monkeypatch.setattr(os, "symlink", refused)
    with pytest.raises(PermissionError):
        api.extract(spark, good, str(tmp_path / "p"), allow_symlinks=True)
    got = api.extract(spark, good, str(tmp_path / "skip"), allow_symlinks=True, symlink_fallback="skip")
    assert [w["code"] for w in got.warnings] == ["symlink_fallback_skip"] and os.listdir(tmp_path / "skip") == ["d"]
    got = api.extract(spark, good, str(tmp_path / "hard"), allow_symlinks=True, symlink_fallback="hardlink")
    assert [w["code"] for w in got.warnings] == ["symlink_fallback_hardlink"] and os.stat(tmp_path / "hard/l").st_nlink == 2


def test_compat_functions_see_and_replace_bytes(spark, tmp_path):
    """A filter sees the bytes and a map replaces them, in the rows and on disk."""
    data = pack([*GOOD, {"path": "dir/z", "body": bytes(1 << 20)}], "tar.gz")  # over any ratio
    rows = compat.expand(spark, data, str(tmp_path / "o"), filter=lambda f: f["data"] is not None and bytes(f["data"]).startswith(b"hel"), map=lambda f: {**f, "path": "b.txt", "data": b"changed"})
    assert [(r["path"], r["data"]) for r in rows] == [("b.txt", b"changed")]
    assert os.listdir(tmp_path / "o") == ["b.txt"] and (tmp_path / "o/b.txt").read_bytes() == b"changed"
    with pytest.raises(E.UserFunctionError):
        compat.expand(spark, data, filter=lambda f: f["nothing"])
    with pytest.raises(E.ArchiveError):
        compat.expand(spark, data, str(tmp_path / "p"), map=lambda f: {**f, "path": "../x"})
    assert os.listdir(tmp_path) == ["o"]


def test_version(capsys):
    assert cli.main(["--version"]) == 0 and capsys.readouterr().out.strip()


def test_hot_paths_and_entries_that_land_nowhere(spark):
    """3000 entries of one path and 3000 without one spread over all tasks of the marks."""
    from tarnhold.operators import dedup

    rows = spark.range(9000).selectExpr("'a' AS archive_id", "id AS entry_index", "CASE id % 3 WHEN 0 THEN 'Same' WHEN 1 THEN NULL ELSE concat('p', id) END AS normalized", "1 AS extra")
    rows = rows.unionByName(spark.createDataFrame([("a", 9001, "same", 1), (None, 1, "x", 1), (None, 2, "x", 1)], "archive_id string, entry_index bigint, normalized string, extra int"))
    got = dedup.mark(rows)
    counts = {(r.duplicate, r.case_collision): r["count"] for r in got.groupBy("duplicate", "case_collision").count().collect()}
    assert counts == {(False, False): 3000 + 3000 + 1 + 1, (True, False): 2999 + 1, (False, True): 1}
    assert "Window" not in got._jdf.queryExecution().toString()


def test_shared_folder_of_a_cluster():
    from tarnhold import cuts

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError):
        cuts.root(Session)
    Session.conf = {"spark.checkpoint.dir": "store://shared"}
    assert cuts.root(Session) == "store://shared"
