"""Near-duplicate embeddings by an inverted multi-index.

Each half of a (normalised) vector has a codebook of its own; the pairs of
codewords form a grid, and a vector lives in the cell of its two nearest
codewords.  A vector searches the grid from its own cell outwards: for each half
the codewords are put in order of how far the vector is from the border to their
region, and a multi-sequence traversal visits cells nearest first, by the sum of
both squared distances.  That sum is a lower bound of the squared distance to anything in the cell, so a
traversal that ends where it exceeds that of the cosine threshold would miss
nothing; the traversal ends earlier, where the target recall is met on a sample.

A pair in different cells is looked for from the cell with the higher number, so
each link is found once.  What a task compares are blocks: residents of a cell
(a full cell is split into several) against the vectors that visit it, which
stream by.  It emits the number of links per vector and a spanning forest of
them, never the pairs.

Codebooks, traversal bound and recall target come from at most ``SAMPLE``
vectors, by a hash of their ids; all vectors are indexed and all search.  The
codebooks grow with the square root of the table (up to 4,096 codewords a half,
16.7 million cells); the share of the sample's near pairs that the traversal
reaches is logged as the recall of the run.

Defined results: a null or zero vector, or one with a null or non-finite
component, has no links and is its own component; vectors of different length
are not compared; rows repeated under one vec_id are one vector (the smallest);
a null vec_id links with nothing and has no component; equal vectors are linked;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.storage import materialize

COSINE, RECALL = 0.9, 0.98
SAMPLE, PER_CELL, CODEWORDS = 20_000, 640, 4_096
#: Residents of a cell that are compared as one block, and rows of a comparison at a time.
FULL, ROWS = 8_192, 2_048
#: Vectors whose traversals go on at once.
TRAVERSED = 1_024


@dataclass
class Half:
    words: np.ndarray
    norms: np.ndarray = field(init=False)
    gaps: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norms = (self.words**2).sum(axis=1)
        apart = np.maximum(0, self.norms[:, None] + self.norms - 2 * self.words @ self.words.T)
        self.gaps = 2 * np.sqrt(apart)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword, and the squared distance to the border of each codeword's region as seen from there."""
        far = self.norms - 2 * x @ self.words.T
        home = far.argmin(axis=1)
        over = far - far[np.arange(len(x)), home][:, None]
        gaps = self.gaps[home]
        border = np.divide(over, gaps, out=np.zeros_like(over), where=gaps > 0)
        return home, border**2


@dataclass
class Index:
    left: Half
    right: Half
    bound: float = 0.0
    recall: float = 1.0

    @property
    def cut(self) -> int:
        return self.left.words.shape[1]

    def homes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)
        for at in range(0, len(x), TRAVERSED):
            part = slice(at, at + TRAVERSED)
            a, _ = self.left.places(x[part, : self.cut])
            b, _ = self.right.places(x[part, self.cut :])
            out[part] = a * len(self.right.words) + b
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells; and (row, cell) of all visits to cells below the row's own, the nearest of each row first."""
        homes, rows, cells = [], [], []
        for at in range(0, len(x), TRAVERSED):
            home, row, cell = self.traversal(x[at : at + TRAVERSED])
            below = cell < home[row]
            homes.append(home)
            rows.append(row[below] + at)
            cells.append(cell[below])
        return tuple(np.concatenate(p) if p else np.zeros(0, int) for p in (homes, rows, cells))

    def traversal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and (row, cell) of all cells within the bound.

        Both sequences of codewords are sorted.  For each place in the left one a
        pointer says how far the right one has been taken; every round takes, for
        all rows at once, the place whose next cell is nearest.
        """
        a, near_a = self.left.places(x[:, : self.cut])
        b, near_b = self.right.places(x[:, self.cut :])
        k = len(self.right.words)
        order_a, sums_a = self.sequence(near_a)
        order_b, sums_b = self.sequence(near_b)
        sums_b = np.hstack((sums_b, np.full((len(x), 1), np.inf)))
        taken = np.zeros(order_a.shape, int)
        front = sums_a + sums_b[:, :1]
        rows, cells, on = [], [], np.arange(len(x))
        while len(on):
            i = front[on].argmin(axis=1)
            within = front[on, i] <= self.bound
            on, i = on[within], i[within]
            j = taken[on, i]
            rows.append(on)
            cells.append(order_a[on, i] * k + order_b[on, j])
            taken[on, i] = j + 1
            front[on, i] = sums_a[on, i] + sums_b[on, j + 1]
        return a * k + b, np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cells) if cells else np.zeros(0, int)

    def sequence(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codewords within the bound, nearest first, and their distances; as many columns as the row with most needs."""
        most = max(1, int((near <= self.bound).sum(axis=1).max(initial=1)))
        order = np.argpartition(near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(near, order, axis=1), axis=1, kind="stable"), axis=1)
        return order, np.take_along_axis(near, order, axis=1)


def normalized(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared, and those in double precision at length 1 (all of one dimension)."""
    x = np.array(vectors, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(x).all(axis=1) & (top > 0)
    x = x[good] / top[good][:, None]
    return np.flatnonzero(good), x / np.linalg.norm(x, axis=1)[:, None]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    words = np.unique(x, axis=0) if len(x) <= k else x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds if len(words) == k else 0):
        norms = (words**2).sum(axis=1)
        home = np.concatenate([(norms - 2 * x[i : i + 4_096] @ words.T).argmin(axis=1) for i in range(0, len(x), 4_096)])
        sums = np.zeros_like(words)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(words))
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def build(sample: np.ndarray, n: int, cosine: float, recall: float) -> Index:
    """Codebooks for about ``PER_CELL`` of ``n`` vectors a cell, and the bound of the traversal.

    The bound is where the wanted share of the sample's near pairs is found:
    pairs made by moving each vector to the threshold in a random direction, and
    the pairs that the sample itself holds.
    """
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 1, min(CODEWORDS, max(1, len(sample)))))
    cut = sample.shape[1] // 2
    index = Index(Half(k_means(sample[:, :cut], k)), Half(k_means(sample[:, cut:], k)))
    rng = np.random.default_rng(11)
    x = sample[:4_000]
    step = rng.standard_normal(x.shape)
    step -= (step * x).sum(axis=1)[:, None] * x
    size = np.linalg.norm(step, axis=1)[:, None]
    moved = cosine * x + (1 - cosine**2) ** 0.5 * np.divide(step, size, out=np.zeros_like(step), where=size > 0)
    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    pick = np.linspace(0, len(a) - 1, min(len(a), 50_000)).astype(int)
    asked = [distance(index, p, q) for p, q in ((x, moved), (x[a[pick]], x[b[pick]])) if len(p)]
    index.bound = float(min(2 - 2 * cosine, max(np.quantile(d, recall) for d in asked))) + 1e-9
    index.recall = min(float((d <= index.bound).mean()) for d in asked)
    logging.getLogger(__name__).info("%d x %d cells for %d vectors; recall on the sample %.4f", len(index.left.words), len(index.right.words), n, index.recall)
    return index


def distance(index: Index, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum at which the search for the pair reaches the lower of both cells from the higher one."""
    hx, hy = index.homes(x), index.homes(y)
    swap = hy > hx
    x, goal = np.where(swap[:, None], y, x), np.where(swap, hx, hy)
    k, out = len(index.right.words), np.zeros(len(x))
    for at in range(0, len(x), TRAVERSED):
        part = slice(at, at + TRAVERSED)
        _, a = index.left.places(x[part, : index.cut])
        _, b = index.right.places(x[part, index.cut :])
        rows = np.arange(len(a))
        out[part] = a[rows, goal[part] // k] + b[rows, goal[part] % k]
    return out


def by_length(ids, vectors, raw: bool = False):
    """Batches of one dimension each: (dimension, ids, comparable vectors at length 1, their bytes as stored if ``raw``); the rest is left out."""
    of: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is not None and v.is_valid and len(values := v.values) and not values.null_count:
            own = of.setdefault(len(values), ([], []))
            own[0].append(i)
            own[1].append(values.to_numpy(zero_copy_only=False))
    for length, (own, rows) in sorted(of.items()):
        good, x = normalized(rows)
        if len(good):
            found = length, np.array(own, np.int64)[good], x
            yield (*found, [rows[i].tobytes() for i in good.tolist()]) if raw else found


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        root = self.root
        while True:
            cross = mask & (root[rows][:, None] != root[cols])
            on = np.flatnonzero(cross.any(axis=1))
            if not len(on):
                return
            for r, c in zip(rows[on].tolist(), cols[cross[on].argmax(axis=1)].tolist(), strict=True):
                a, b = root[r], root[c]
                if a != b:
                    self.edges.append((r, c))
                    root[root == max(a, b)] = min(a, b)


def compare(ids: np.ndarray, x: np.ndarray, visitors, cosine: float):
    """Links among residents, and between them and what visits: batches of (a, n, b), n counted links of a, a-b an edge if b."""
    n = len(ids)
    counts, forest, place = np.zeros(n, np.int64), Forest(n), np.arange(n)
    for at in range(0, n, ROWS):
        rows = place[at : at + ROWS]
        for to in range(at, n, ROWS):
            cols = place[to : to + ROWS]
            mask = x[rows] @ x[cols].T >= cosine
            if at == to:
                mask = np.triu(mask, 1)
            if mask.any():
                counts[rows] += mask.sum(axis=1)
                counts[cols] += mask.sum(axis=0)
                forest.link(mask, rows, cols)
    a, b = np.array(forest.edges, np.int64).reshape(-1, 2).T
    yield ids[a], np.zeros(len(a), np.int64), ids[b]
    for other, y in visitors:
        forest = Forest(n + len(other))
        theirs = np.zeros(len(other), np.int64)
        for to in range(0, n, ROWS):
            cols = place[to : to + ROWS]
            mask = y @ x[cols].T >= cosine
            if mask.any():
                theirs += mask.sum(axis=1)
                counts[cols] += mask.sum(axis=0)
                forest.link(mask, n + np.arange(len(other)), cols)
        if theirs.any():
            names = np.concatenate((ids, other))
            a, b = np.array(forest.edges, np.int64).reshape(-1, 2).T
            yield names[a], np.zeros(len(a), np.int64), names[b]
            on = theirs > 0
            yield other[on], theirs[on], None
    on = counts > 0
    yield ids[on], counts[on], None


FOUND = "a long, n long, b long"


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector."""
    single = vectors.select(F.col("vec_id").cast("long"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    table = materialize(single, "vectors")
    total = table.count()
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    parts = {length: x for length, _, x in by_length(sample.column("vec_id"), sample.column("embedding"))}
    indexes = {length: build(x, total * len(x) // max(1, sum(map(len, parts.values()))), cosine, recall) for length, x in parts.items()}
    spread = 1 << 24
    stored = np.float32 if single.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def index_of(length: int) -> Index:
        return indexes.get(length) or Index(Half(np.zeros((1, length // 2))), Half(np.zeros((1, length - length // 2))))

    def cells(batches):
        for batch in batches:
            for length, _, x in by_length(batch.column(0), batch.column(1)):
                cell, n = np.unique(index_of(length).homes(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length * spread + cell), pa.array(n)], names=["cell", "n"])

    # At most one row in FULL vectors.
    full = {r[0]: -(-r[1] // FULL) for r in table.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > FULL).collect()}

    def deal(batches):
        for batch in batches:
            for length, ids, x, raw in by_length(batch.column(0), batch.column(1), raw=True):
                home, rows, visited = index_of(length).visits(x)
                home, visited = home + length * spread, visited + length * spread
                parts_of = np.array([full.get(c, 1) for c in home.tolist()])
                part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts_of
                keys, roles, at = [home * 65_536 + part], [np.zeros(len(ids), np.int8)], [np.arange(len(ids))]
                for p in range(int(parts_of.max(initial=1)) - 1):  # the parts of a full cell look into those before them
                    on = np.flatnonzero(part > p)
                    keys.append(home[on] * 65_536 + p)
                    roles.append(np.ones(len(on), np.int8))
                    at.append(on)
                times = np.array([full.get(c, 1) for c in visited.tolist()], np.int64)
                first = np.repeat(np.cumsum(times) - times, times)
                keys.append(np.repeat(visited * 65_536, times) + np.arange(times.sum()) - first)
                roles.append(np.ones(times.sum(), np.int8))
                at.append(np.repeat(rows, times))
                keys, roles, at = np.concatenate(keys), np.concatenate(roles), np.concatenate(at)
                for k in range(0, len(keys), 20_000):
                    own = at[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k : k + 20_000]), pa.array(roles[k : k + 20_000]), pa.array(ids[own]), pa.array([raw[i] for i in own.tolist()], pa.binary())],
                        names=["key", "role", "id", "x"],
                    )

    def meet(batches):
        for residents, visitors in blocks(batches, stored):
            for a, n, b in compare(*residents, visitors, cosine):
                if len(a):
                    b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), b], names=["a", "n", "b"])

    dealt = table.mapInArrow(deal, "key long, role byte, id long, x binary").repartition("key").sortWithinPartitions("key", "role")
    found = materialize(dealt.mapInArrow(meet, FOUND), "vector-links")
    links = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    components = connected_components(found.where(F.col("b").isNotNull()).select("a", "b"), "vectors")
    return (
        table.select("vec_id")
        .join(links, "vec_id", "left")
        .join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def blocks(batches, stored):
    """Blocks of rows sorted by key and role: the residents at once, what visits them as it comes."""
    flat = ((key, role, i, x) for batch in batches for key, role, i, x in _runs(batch, stored))
    now = next(flat, None)
    while now is not None:
        key, ids, xs = now[0], [], []
        while now is not None and now[0] == key and now[1] == 0:
            ids.append(now[2])
            xs.append(now[3])
            now = next(flat, None)
        state = {"next": now}

        def visitors(state=state, key=key):
            while state["next"] is not None and state["next"][0] == key:
                yield state["next"][2], state["next"][3]
                state["next"] = next(flat, None)

        guests = visitors()
        if ids:
            yield (np.concatenate(ids), np.concatenate(xs)), guests
        for _ in guests:
            pass
        now = state["next"]


def _runs(batch, stored):
    """(key, role, ids, vectors) of rows in a row, at most ``ROWS`` at a time."""
    if not batch.num_rows:
        return
    keys, roles, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1
    xs = batch.column(3)
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        for at in range(start, end, ROWS):
            to = min(end, at + ROWS)
            x = np.frombuffer(b"".join(v.as_py() for v in xs[at:to]), stored).reshape(to - at, -1)
            yield int(keys[at]), int(roles[at]), ids[at:to], normalized(x)[1]
