import numpy as np
import pytest

from lectern.llm import embedding_dups
from lectern.llm.embedding_dups import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in vectors], SCHEMA)


def brute(x):
    x = np.float32(x).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return near.sum(axis=1), [find(i) for i in range(len(x))]


def clustered(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, 32))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, 32))
    x[: n // 4] = x[0] + 0.2 * rng.standard_normal((n // 4, 32))
    return x


@pytest.mark.parametrize("spread, full", [(0.15, 8_192), (0.3, 40)])
def test_recall_against_brute_force(spark, monkeypatch, spread, full):
    monkeypatch.setattr(embedding_dups, "FULL", full)
    monkeypatch.setattr(embedding_dups, "PER_CELL", 16)
    x = clustered(5, 900, spread)
    want, component = brute(x)
    got = {r.vec_id: r for r in near_duplicates(table(spark, list(enumerate(x)))).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    if found.sum() == want.sum():
        assert [got[i].component_id for i in range(len(x))] == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, None), (4, [0, 0, 0]), (5, [1, None, 0]), (6, [float("nan"), 1, 1]), (7, [float("inf"), 1, 1]), (8, [1, 0]), (9, []), (1, [1, 0, 0]), (None, [1, 0, 0]), (10, [0.9, 0.1, 0.3])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(table(spark, rows)).collect()}
    assert len(got) == 11 and got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and got[None] == (0, None, False)
    assert near_duplicates(table(spark, [])).count() == 0


def test_traversal_visits_all_cells_within_the_bound_nearest_first():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dups.build(x, 300 * 640, 0.9, 0.98)
    home, rows, cells = index.traversal(x)
    _, near_a = index.left.places(x[:, :8])
    _, near_b = index.right.places(x[:, 8:])
    sums = (near_a[:, :, None] + near_b[:, None, :]).reshape(300, -1)
    assert len(index.left.words) > 10 and index.recall >= 0.98
    for r in range(300):
        own = cells[rows == r]
        assert set(own) == set(np.flatnonzero(sums[r] <= index.bound)) and (np.diff(sums[r][own]) >= 0).all()
    same, below, visited = index.visits(x)
    want = {(r, c) for r, c in zip(rows.tolist(), cells.tolist(), strict=True) if c < home[r]}
    assert (same == home).all() and set(zip(below.tolist(), visited.tolist(), strict=True)) == want


def test_codebooks_grow_with_the_table():
    x = np.random.default_rng(4).standard_normal((2_000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sizes = [len(embedding_dups.build(x, n, 0.9, 0.9).left.words) for n in (10**4, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[2] == 395 and sizes[3] > 256
