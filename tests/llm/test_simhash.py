import random
import re

import numpy as np
import xxhash
from conftest import SF

from lectern.llm import simhash
from lectern.llm.components import connected_components
from lectern.llm.queries_simhash import op4_simhash
from lectern.llm.simhash import link_fingerprints


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in (None, "", " \n", "One", "A b C", "The quick brown fox jumps", "É É É É É a", "x y " * 5000, "a b c"):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def near_family(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    return sorted(set(out))


def components_of(spark, fps, **patch):
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    return [got.get(f, f) for f in signed]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_links_equal_brute_force(spark):
    fps = near_family(3, 400)
    assert same_partition(components_of(spark, fps), plain_components(fps))


def test_full_prefixes_are_lengthened(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 4)
    monkeypatch.setattr(simhash.hot_prefixes, "__defaults__", (4,))
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | set(near_family(5, 60)))
    assert same_partition(components_of(spark, fps), plain_components(fps))


def test_prefixes_that_are_too_many_to_travel(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHIPPED", 0)
    monkeypatch.setattr(simhash.hot_prefixes, "__defaults__", (4,))
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)} | set(near_family(6, 60)))
    assert same_partition(components_of(spark, fps), plain_components(fps))


def test_of_rows_with_one_id_the_same_stays(spark, make_docs):
    rows = [(1, "b c d e"), (1, "a c d e"), (1, None), (2, "x y z w v"), (2, "x y z w v")]
    for order in (rows, rows[::-1]):
        kept = {r.doc_id: r.text for r in simhash.keep_one(make_docs(*order)).collect()}
        assert kept == {1: None, 2: "x y z w v"}


def test_query_equals_brute_force(spark):
    rows = op4_simhash(spark, SF).collect()
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    ids = [i for i, _ in docs]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, plain_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(docs)


def test_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert of[1].component_id == of[2].component_id == of[3].component_id == 1 and of[1].fp == 0
    assert of[4].component_id == of[5].component_id == 4
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and ids.count(4) == 1 and ids.count(None) == 2
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_long_paths_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    got = connected_components(edges).collect()
    assert {r.component for r in got} == {0} and len(got) == 201
