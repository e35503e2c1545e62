import pytest

SF1, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Nulls in any column, empty and very long texts, ties, repeated rows.
EDGES = [
    (1, "the same words are here again and again for all of us", "en", "a", 53),
    (1, "the same words are here again and again for all of us", "en", "a", 53),
    (2, "the same words are here again and again for all of us", None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "de", "b", 0),
    (5, "word " * 60_000, "en", None, 300_000),
    (6, "  \t\n ", "en", "a", 5),
    (7, "café \U0001f600 ▁ token = 'abcdefghijklmnop123'", "fr", "c", 40),
    (None, "a row without an id has words too", "en", "c", 33),
    (8, "x" * 50_000 + "1", "en", "c", 50_001),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.withColumns({k: F.lit(7) for k in ("size", "h", "key", "place", "set", "node", "hash", "shard", "score", "found")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF1}/documents.parquet")
