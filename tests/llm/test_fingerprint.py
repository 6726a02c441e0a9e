import hashlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lectern.llm import fingerprint
from lectern.llm.queries_fingerprint import op6_fingerprint


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("stretch", [7, 4_000])
def test_query_equals_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(fingerprint, "STRETCH", stretch)
    got = {r.doc_id: r for r in op6_fingerprint(spark, SF).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    wrong = 0.0
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == got[after[0]].fingerprint) >= (text == after[1])
        a, b = shingles(text), shingles(edited)
        wrong += abs(r.near_edited - len(a & b) / len(a | b))
    assert wrong / len(docs) < 0.09


def test_plans_are_native(spark):
    plan = op6_fingerprint(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd_docs):
    got = {r.doc_id: r for r in fingerprint.edited_documents(odd_docs.where("doc_id IS NOT NULL")).collect()}
    assert got[1].sketch == [] and got[4].sketch == got[5].sketch and got[9].sketch_least is not None and got[1].sketch_least is None
    assert fingerprint.edited_documents(odd_docs).count() == odd_docs.count()
    assert fingerprint.edited_documents(odd_docs.limit(0)).count() == 0
    single = fingerprint.edited_documents(odd_docs.where("doc_id = 9")).first()
    assert single.next_sketch == single.sketch and single.edited == "ono"


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(400))
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_sketch(df, c, f"s{c}")
    r = df.select(fingerprint.merged(F.col("sa"), F.col("sb")).alias("m"), "sc", fingerprint.containment(F.col("sa"), F.col("sc")).alias("k")).first()
    assert r.k == 1.0 and set(r.m) <= set(r.sc) and len(set(r.sc) - set(r.m)) <= 4


def test_sketches_of_short_texts_merge(spark):
    """The sketch of a whole is the union of the sketches of its parts and of what spans them, whatever their length."""
    rows = [(" ".join(f"a{k}x{i}" for i in range(6)), " ".join(f"b{k}x{i}" for i in range(40))) for k in range(200)]
    df = spark.createDataFrame([(a, b, f"{b} {a} {b}") for a, b in rows], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_sketch(df, c, f"s{c}")
    out = df.select("sa", "sb", "sc", fingerprint.containment(F.col("sa"), F.col("sc"), F.col("sa_least")).alias("k")).collect()
    assert all(set(r.sa) | set(r.sb) <= set(r.sc) for r in out)
    assert {r.k for r in out} == {1.0, None} and all((r.k is None) == (not r.sa) for r in out)
