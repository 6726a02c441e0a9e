import random
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import repeats
from lectern.llm.repeats import repeated_passages, without_repeats


def brute(docs, least=50):
    places = defaultdict(set)
    for i, text in docs:
        w = (text or "").split()
        for k in range(len(w) - least + 1):
            places[tuple(w[k : k + least])].add((i, k))
    out = defaultdict(set)
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, k in found:
                out[i].update(range(k, k + least))
    return dict(out)


def planted(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 75, 130)]
    line = fresh(20)
    docs = []
    for i in range(60):
        words = fresh(rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 3)):
            words += p + fresh(rng.randint(0, 5))
        docs.append((i, " ".join(words + line * rng.randint(0, 1))))
    p = passages[5]
    # Matches whose place in the passage differs: one shares the beginning, one the middle, one the end with the same neighbours.
    docs += [(100, " ".join(fresh(3) + p[:70])), (101, " ".join(p[35:100])), (102, " ".join(p[70:] + fresh(3))), (103, docs[7][1]), (104, docs[7][1])]
    return docs


@pytest.mark.parametrize("seed, full", [(1, 50_000), (2, 50_000), (3, 3)])
def test_equals_brute_force(spark, make_docs, monkeypatch, seed, full):
    monkeypatch.setattr(repeats, "FULL", full)
    docs = planted(seed)
    rows = repeated_passages(make_docs(*docs)).collect()
    got = defaultdict(set)
    for r in rows:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.first_doc_id <= r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert dict(got) == brute(docs)


def test_selected_places_are_in_every_window():
    hashes = np.random.default_rng(2).integers(0, 1 << 62, 3000).astype(np.uint64)
    at = repeats.selected(hashes, 41)
    assert np.diff(np.concatenate(([-1], at, [3000]))).max() <= 41
    assert all(hashes[k : k + 41].min() in hashes[at[(at >= k) & (at < k + 41)]] for k in range(0, 2900, 97))


def test_odd_rows(spark, odd_docs, make_docs):
    rows = repeated_passages(odd_docs).collect()
    assert {r.doc_id for r in rows} == {4, 5, 6} and repeated_passages(odd_docs.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    out = {r.doc_id: r.text for r in without_repeats(make_docs((1, text), (2, f"a {text} b"), (3, "c"), (4, None))).collect()}
    assert out == {1: text, 2: "a  b", 3: "c", 4: None}


def test_no_passage_is_lost(spark, make_docs):
    """Every passage of 50 words stays whole in the first document that has it; nothing else goes that a document does not hold still."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = fresh(60), fresh(60)
    out = {r.doc_id: r.text.strip() for r in without_repeats(make_docs((1, a), (3, f"{a} {b}"), (5, b))).collect()}
    assert out == {1: a, 3: b, 5: ""}
    docs = planted(9) + [(200, f"{a} {b}"), (201, a), (202, f"{b} {a} {b}"), (203, None), (None, a)]
    rows = without_repeats(make_docs(*docs)).collect()
    assert len(rows) == len(docs)
    out = {r.doc_id: r.text for r in rows}
    assert out[None] == a and out[203] is None
    windows = lambda text: {tuple(w[k : k + 50]) for w in [(text or "").split()] for k in range(len(w) - 49)}
    first = {}
    for i, text in sorted((i, t) for i, t in docs if i is not None and t):
        for w in windows(text):
            first.setdefault(w, []).append(i)
    repeated = {w: ids for w, ids in first.items() if len(set(ids)) > 1}
    assert len(repeated) > 100 and all(w in windows(out[ids[0]]) for w, ids in repeated.items())
    for i, text in docs:
        words = (text or "").split()
        mine, theirs = set(), set()
        for k in range(len(words) - 49):
            if ids := repeated.get(tuple(words[k : k + 50])):
                (mine if ids[0] == i else theirs).update(range(k, k + 50))
        if i is not None and text:
            assert out[i].split() == [w for k, w in enumerate(words) if k not in theirs - mine]


def test_equal_marks_of_different_texts(spark, make_docs, monkeypatch):
    """Texts are told apart by SHA-256, so that a collision of the short mark loses and lends nothing."""
    real = repeats.F.xxhash64
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c: real(*c) % 2)
    docs = planted(6)
    got = defaultdict(set)
    for r in repeated_passages(make_docs(*docs)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    want = brute(docs)
    assert all(got[i] <= want.get(i, set()) for i in got) and sum(map(len, got.values())) > 0.5 * sum(map(len, want.values()))


def test_rows_of_a_matrix_come_back():
    x = np.arange(40, dtype=np.uint32).reshape(8, 5)
    assert (repeats.matrix_of(repeats.fixed_rows(x).slice(3, 4), 5) == x[3:7]).all()
