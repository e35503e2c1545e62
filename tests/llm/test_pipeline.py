"""The corpus pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnhold.llm import langid, mixing, neardup, secrets

from .conftest import SF1


def written(spark, rows):
    return spark.createDataFrame(rows.collect(), rows.schema)


def test_stages(spark, small):
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF1)
        assert out.columns == docs.columns, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        if name == "language ID":
            assert 0.9 * docs.count() <= rows.count() <= docs.count()
        if name == "near duplicates":
            assert rows.count() == rows.select("doc_id").distinct().count() < docs.count()
        if name == "secret scan":
            assert rows.count() == docs.count()
        docs = rows
    made = corpus_pipeline.STAGES[-1][1](spark, docs, SF1)
    assert made.count() == docs.count() and made.where("NOT round_trip").count() == 0


def test_stages_on_edges(spark, edges):
    """Nulls, empty and giant texts, repeated rows, ties and clashing columns, through every stage on its own."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, SF1)
        assert out.columns == edges.columns and [t for _, t in out.dtypes] == [t for _, t in edges.dtypes], name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "language ID":
            assert {3, 4, 6}.isdisjoint(ids)
        if name == "near duplicates":
            assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, None]))
        if name == "secret scan":
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in edges.collect())
        if name == "source mixing":
            assert {3, 4, 6}.isdisjoint(ids) and ids
    made = corpus_pipeline.STAGES[-1][1](spark, edges, SF1)
    assert made.count() == edges.count() and made.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("rows", ["edges", "empty"])
def test_run_on(spark, request, tmp_path, rows):
    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_ids", "score", "ids", "n_best", "round_trip"]
    assert (got.count() > 0) == (rows == "edges") and got.where("NOT round_trip").count() == 0


def test_run(spark):
    """The rows of run() are those of its operators, one after the other on rows in memory."""
    got = corpus_pipeline.run(spark, SF1)
    assert got.count() > 0 and got.where("NOT round_trip").count() == 0
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    model = langid.train(langid.trainable(docs))
    kept = [r for r in docs.collect() if not model.predict(r.text)[2]]
    docs = spark.createDataFrame(kept, docs.schema)
    ids = {r.doc_id for r in neardup.digest(docs, 5).where("kept").collect()}
    docs = spark.createDataFrame([r for r in kept if r.doc_id in ids], docs.schema)
    spans = {r.doc_id: r.spans for r in secrets.digest(docs).collect()}
    clean = written(spark, secrets.redacted(docs))
    assert all((r.text == t.text) == (not spans[r.doc_id]) for r, t in zip(sorted(clean.collect(), key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id)))
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken}
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(taken)
    mixed = mixing.mixed(clean).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r.doc_id: r.n for r in mixed} == taken
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {r.doc_id: r.rows for r in mixed}
