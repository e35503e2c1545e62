"""Audit queries over archives of more entries than an extraction may have."""

import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from tarnhold.functions import paths, scalar
from tarnhold.operators import audit, budgets, dedup, links
from tarnhold.plans import registry


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """Documents of two sources, one of them beyond the limit on files, with hostile paths on both sides of it."""
    folder = str(tmp_path_factory.mktemp("large"))
    duckdb.execute(f"COPY (SELECT i AS doc_id, 'text' AS text, 'en' AS lang, CASE WHEN i % 100 = 7 THEN 'few' ELSE 'many' END AS source, CAST(4 AS BIGINT) AS n_chars FROM range(11000) t(i)) TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["audit_finding_counts", "audit_findings", "audit_report", "risk_by_archive"])
def test_entries_beyond_the_limit_on_files(spark, large, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{large}/documents.parquet'")
    q = db.execute(registry.ORACLES[name])
    names = [d[0] for d in q.description]
    rows = lambda got: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in got)
    assert rows(registry.QUERIES[name](spark, large).select(*names).collect()) == rows(q.fetchall())


def test_archives_are_packed_once(spark, tmp_path, monkeypatch):
    """The branches of an audit read what was packed; they do not pack it again."""
    log, packed = str(tmp_path / "log"), registry._packed

    def counted(spark, sf_dir, fmt):
        def run(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write("packed\n" * b.num_rows)
                yield b

        files = packed(spark, sf_dir, fmt)
        return files.mapInArrow(run, files.schema)

    monkeypatch.setattr(registry, "_packed", counted)
    n = registry.archive_audit(spark, SF).count()
    assert n == len(open(log).readlines())


def test_findings_explode_a_column(spark):
    """Of an expression, explode finds out the type anew for each row."""
    rows = spark.createDataFrame([("a", 0, "x", "file", 1, 420, None)], "archive_id string, entry_index bigint, path string, type string, size bigint, mode int, link_target string")
    plan = audit.entry_findings(audit.normalized(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(__found#" in plan


def test_plain_paths_break_no_rule(spark):
    rng = random.Random(3)
    given = ["".join(rng.choices(["a", "Con", "com1", "nul", "x.y", ".", "/", "_", "-9", " ", "\\", ":"], k=rng.randint(1, 9))) for _ in range(3000)]
    given += ["/".join(["d"] * n) for n in (127, 128, 129)]
    rows = spark.createDataFrame([(p,) for p in given], "path string").select("path", paths.plain(F.col("path")).alias("plain")).where("plain").collect()
    assert len(rows) > 100
    for r in rows:
        assert scalar.path_error_code(r.path) is None and scalar.normalize_path(r.path) == r.path, r.path


def test_entries_of_lines_lie_by_archive(spark):
    """Steps on archives behind the numbering of entries need no other shuffle."""
    rows = registry._docs(spark, SF, "line_entries").withColumn("n", F.sum("size").over(Window.partitionBy("archive_id").orderBy("entry_index")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _odd_entries(spark):
    rng = random.Random(8)
    names = ["a", "A", "a/b", "A/b", "a/b/c", "é", "É", "x/y", "x", "y"]
    given = [(rng.choice(["p", "q", None]), i * rng.choice([1, 3000]), rng.choice([*names, *(f"one_{i}/two" for _ in range(9)), None]), rng.choice(["file", "symlink", "directory"]), rng.choice([None, 1, 2**62])) for i in range(1500)]
    given = [r for n, r in {(r[0], r[1]): r for r in given}.items()]
    return given, spark.createDataFrame(given, "archive_id string, entry_index bigint, normalized string, type string, size bigint")


def test_sums_marks_and_ancestors_by_brute_force(spark):
    """Long archives with gaps between their entries, an archive without a name, sums beyond 64 bits."""
    given, rows = _odd_entries(spark)
    given.sort(key=lambda r: r[1])
    sums, firsts, spelled, marks, below = {}, {}, {}, {}, set()
    for a, i, p, _, size in given:
        sums[a, i] = sums.get(a, 0) + (size or 0)
        sums[a] = sums[a, i]
        marks[a, i] = (p is not None and (a, p) in firsts, p is not None and spelled.setdefault((a, p.lower()), p) != p)
        firsts.setdefault((a, p), i)
    files = {(a, p): i for a, i, p, kind, _ in reversed(given) if kind == "file"}
    for a, i, p, _, _ in given:
        up = ["/".join(p.split("/")[:k]) for k in range(1, p.count("/") + 1)] if p else []
        at = [(files[a, u], u) for u in up if a is not None and (a, u) in files and files[a, u] < i]
        if at:
            below.add((a, i, min(at)[1]))
    assert {(r.archive_id, r.entry_index): int(r.running_size) for r in budgets.running_total(rows).collect()} == {k: v for k, v in sums.items() if isinstance(k, tuple)}
    assert {(r.archive_id, r.entry_index): (r.duplicate, r.case_collision) for r in dedup.mark(rows).collect()} == marks
    assert {(r.archive_id, r.entry_index, r.ancestor) for r in links.not_a_directory(rows).collect()} == below and below
