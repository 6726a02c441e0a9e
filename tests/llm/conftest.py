import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()), T.StructField("score", T.IntegerType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text) or (id, text, source), with extra columns whose names operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
    return make_docs((1, None), (2, ""), (3, " \t\n"), (4, words), (4, words), (5, words), (6, words + "tail"), (None, "text"), (None, None), (7, "x" * 300_000), (8, "word " * 60_000), (9, "one", None))
