"""The stage of near-duplicates against brute force on five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
from lectern.llm import near_texts, simhash

STAGE = dict(corpus_pipeline.STAGES)["simhash"]


def plain(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, plain(t)) for i, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.randrange(10**6)}"
    return words


def test_similar_texts_leave_one(spark, make_docs):
    rng, rows = random.Random(3), []
    for group in range(40):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        rows += [(group * 10 + k, " ".join(edited(base, round(len(base) * 0.005 * k), rng))) for k in range(1, 8)]
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "ONE  two"), (1004, "one three")]
    rng.shuffle(rows)
    want = kept(rows)
    got = STAGE(spark, make_docs(*rows), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == want
    of = dict(rows)
    far = [1 for i, j in combinations(sorted(of), 2) if i // 10 == j // 10 and i < 1000 and 5 * len(plain(of[i]) & plain(of[j])) >= 4 * len(plain(of[i]) | plain(of[j])) and (simhash.fingerprint_of(of[i]) ^ simhash.fingerprint_of(of[j])).bit_count() > 4]
    assert len(far) > 20  # pairs that fingerprints of radius 4 do not link


def test_stage_on_odd_rows(spark, odd_docs):
    out = STAGE(spark, odd_docs, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 4), (False, 7), (False, 8), (False, 9), (True, 0), (True, 0)]
    assert STAGE(spark, odd_docs.limit(0), "").count() == 0


def test_components_equal_enumeration():
    rng = random.Random(8)
    texts = [" ".join(edited([f"x{i}" for i in range(60)], rng.randrange(3), rng)) for _ in range(60)]
    root = near_texts.components([near_texts.shingles(t) for t in texts])
    assert sorted(set(root)) == kept(list(enumerate(texts)))


def test_result_does_not_depend_on_blocks(spark, make_docs):
    """Groups of many blocks: a dense one, chains whose neighbours alone are similar, and repeated rows."""
    rng, rows = random.Random(5), []
    base = [f"d{i}" for i in range(80)]
    rows += [(i, " ".join(edited(base, 1, rng))) for i in range(100, 140)]
    for chain in range(4):
        words = [f"c{chain}x{i}" for i in range(90)]
        for step in range(25):
            rows.append((200 + 100 * chain + step, " ".join(words)))
            words = [*words[5:], *(f"c{chain}y{step}z{k}" for k in range(5))]
    rows += [rows[3], (None, "x")]
    rng.shuffle(rows)
    want = kept([r for r in dict(rows).items() if r[0] is not None])
    for weight in (150, 2_000, near_texts.WEIGHT):
        got = near_texts.keep_one(make_docs(*rows), weight).select("doc_id").collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == want


def lowest(pairs, n):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_links_equal_enumeration():
    """All against all, and the first twenty against the rest."""
    rng = random.Random(9)
    texts = [" ".join(edited([f"x{i}" for i in range(60)], rng.randrange(3), rng)) for _ in range(50)]
    sets, sim = [near_texts.shingles(t) for t in texts], [plain(t) for t in texts]
    similar = [(i, j) for i, j in combinations(range(50), 2) if 5 * len(sim[i] & sim[j]) >= 4 * len(sim[i] | sim[j])]
    for first, pairs in ((50, similar), (20, [(i, j) for i, j in similar if i < 20 <= j])):
        assert lowest(near_texts.links(sets, list(range(50)), first), 50) == lowest(pairs, 50)
