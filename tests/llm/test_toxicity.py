import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import toxicity
from lectern.llm.toxicity import Scorer, fit, kernel


def plain_kernel(s, t, decay=0.5, order=3):
    from itertools import combinations

    def features(w):
        out = {}
        for at in combinations(range(len(w)), order):
            key = "".join(w[i] for i in at)
            out[key] = out.get(key, 0) + decay ** (at[-1] - at[0] + 1)
        return out

    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_equals_enumeration():
    words = ["idiot", "idxiot", "abc", "cba", "aabbcc", "xyzxyz"]
    s = toxicity.coded(words, 6)
    got = kernel(s, s)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), rel=1e-4, abs=1e-6)


def test_expansion_equals_kernels():
    landmarks, weights = ["moron", "scum", "pathetic"], np.array([0.5, -1.0, 2.0])
    model = toxicity.Model.of(landmarks, weights, 0.25)
    words = ["moron", "scumbag", "apathetically", "zzz", "mo"]
    for word, got in zip(words[:4], model.margins(words[:4]), strict=True):
        want = sum(w * plain_kernel(word, m) for w, m in zip(weights, landmarks, strict=True)) / max(plain_kernel(word, word), 1e-12) ** 0.5 + 0.25
        assert got == pytest.approx(want, rel=1e-3, abs=1e-4)
    assert model.margins(["mo"])[0] == -np.inf
    assert model.margins(["z" * 500 + "pathetic" + "z" * 500])[0] > model.margins(["z" * 900])[0]


INSULTS = ("idiot", "moron", "pathetic", "worthless")


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "be", "sti", "thor", "er", "ing", "ou", "re", "nd")) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 120))], int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(1, 700)
    return fit([t for _, t, _ in rows], [y for *_, y in rows])


def test_held_out_accuracy(model):
    rows = corpus(2, 400)
    scores = Scorer(model)([t for _, t, _ in rows])
    y = np.array([y for *_, y in rows])
    assert ((scores >= 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("text", ["thor i d i o t ing", "what a m.o.r.o.n er", "an id-iot here", "ing idioot thor", "re mor0on pathetiic nd"])
def test_gaps_and_inserted_letters(model, text):
    score = Scorer(model)
    assert score([text])[0] > score(["thor ing er nd"])[0] + 0.2


def test_odd_rows(spark, odd_docs, model):
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    kept = toxicity.reject(odd_docs, model)
    assert kept.columns == odd_docs.columns and toxicity.reject(odd_docs.limit(0), model).count() == 0
    assert [r.score for r in toxicity.score(odd_docs.where("doc_id = 4"), 0.0).collect()] == [0.0, 0.0]


def test_training_ignores_the_held_out_fold(spark):
    rows = corpus(3, 500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lied = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, lied)
    assert np.array_equal(a.table, b.table) and (a.slope, a.offset) == (b.slope, b.offset)
    assert toxicity.train(docs, labels.where("toxic = 0")) == 0.0 and toxicity.train(docs.limit(0), labels) == 0.0
