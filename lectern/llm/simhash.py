"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a common variant within half
the radius of each.  So every distinct fingerprint emits the ball of its
variants, and fingerprints that meet at a variant are linked.

The shuffle deals *prefixes* of variants: a ball of radius 2 over 64 bits has
2,081 variants but only a few dozen prefixes, so a row is one (prefix,
fingerprint), and the task that owns a prefix finishes the variants under it.
There it sorts them, verifies the colliding neighbours by their distance, and
emits a spanning forest of what it linked: as many edges as fingerprints at
most, whatever the size of a group.  Prefixes that hold many fingerprints of
their own (a large group of near copies) are lengthened, by a rule that looks
at the variant alone, until their share is small.

Equal texts, and different texts with one fingerprint, meet before that: the
ball search sees each fingerprint once.

Defined results: null text, empty text and text of blanks have fingerprint 0;
fewer words than a shingle form one shingle; repeated rows (also of one doc_id)
share fingerprint and component; rows whose doc_id is null take part with no
id: they link nothing, and their component is null unless their fingerprint has
a document with an id; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.storage import materialize

WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
BLOCK = 50_000
#: Own fingerprints that a prefix may hold before it is lengthened, and by how many bits at a time.
FULL, STEP = 512, 4
#: Longest prefix to begin with, longest of all, and how many prefixes may travel with a task.
FIRST_BITS, LAST_BITS, SHIPPED = 40, 48, 100_000


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the hashes of all word shingles."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII blanks only
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@functools.lru_cache(maxsize=256)
def flips(low: int, high: int, weight: int) -> np.ndarray:
    """Masks of up to ``weight`` bits out of bits ``low`` to ``high`` - 1, the empty one first."""
    return np.array([sum(1 << b for b in bits) for k in range(weight + 1) for bits in combinations(range(low, high), k)], np.uint64)


@functools.lru_cache(maxsize=64)
def prefix_flips(bits: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of up to ``weight`` of the top ``bits`` bits, and how many bits each has."""
    masks = flips(BITS - bits, BITS, weight)
    return masks, np.array([int(m).bit_count() for m in masks.tolist()], np.uint8)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars with the same components as the edges a-b."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def collisions(fps: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``fps`` (already flipped to one prefix of ``bits`` bits at a cost of ``half - left`` bits each).

    Returns positions; every two that share a variant are linked through the
    first of them.
    """
    variants, owner = [], []
    for w in np.unique(left).tolist():
        of = np.flatnonzero(left == w)
        masks = flips(0, BITS - bits, w)
        variants.append((fps[of, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(of, len(masks)))
    variants, owner = np.concatenate(variants), np.concatenate(owner)
    order = np.argsort(variants, kind="stable")
    variants, owner = variants[order], owner[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    return owner[same], owner[same + 1]


def lengthened(own: np.ndarray, variant: np.ndarray, left: np.ndarray, done: int, bits: int):
    """Rows of prefixes of ``done`` bits -> those of ``bits`` bits: fingerprints, flipped ones, flips left, prefixes."""
    out = [], [], []
    for w in np.unique(left).tolist():
        of = np.flatnonzero(left == w)
        masks, cost = prefix_flips(bits - done, w)
        masks = masks >> np.uint64(done)
        out[0].append(np.repeat(own[of], len(masks)))
        out[1].append((variant[of, None] ^ masks[None, :]).ravel())
        out[2].append((w - np.tile(cost, len(of))).astype(np.uint8))
    own, variant, left = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.uint64, np.uint64, np.uint8), strict=True))
    return own, variant, left, (variant >> np.uint64(BITS - bits) | (np.uint64(1) << np.uint64(bits))).view(np.int64)


def expand(key_bits: int, half: int, hot: dict[int, np.ndarray]):
    """Turns fingerprints into (key, fingerprint) rows; ``hot`` has, by length, the prefixes to be lengthened."""

    def keys_of(fps: np.ndarray):
        todo = [(fps, fps.copy(), np.full(len(fps), half, np.uint8), 0, key_bits)]
        while todo:
            *rows, done, bits = todo.pop()
            own, variant, left, key = lengthened(*rows, done, bits)
            longer = np.isin(key, hot[bits]) if bits in hot else np.zeros(len(key), bool)
            if longer.any():
                todo.append((own[longer], variant[longer], left[longer], bits, bits + STEP))
            yield key[~longer], own[~longer].view(np.int64)

    return keys_of


def joined(distinct: DataFrame, key_bits: int, half: int, hot: DataFrame, longest: int) -> DataFrame:
    """What ``expand`` does, with the prefixes to be lengthened in a table (``key``) of any size."""
    schema, done = "own long, variant long, left byte, key long", 0
    rows = distinct.select(F.col("fp").alias("own"), F.col("fp").alias("variant"), F.lit(half).cast("byte").alias("left"))
    out = None
    for bits in range(key_bits, longest + STEP + 1, STEP):

        def step(batches, done=done, bits=bits):
            for batch in batches:
                own, variant, left = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                for at in range(0, len(own), 2_000):
                    part = slice(at, at + 2_000)
                    a, b, c, d = lengthened(own[part].view(np.uint64), variant[part].view(np.uint64), left[part].view(np.uint8), done, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int64), c.view(np.int8), d)], names=["own", "variant", "left", "key"])

        made = rows.mapInArrow(step, schema)
        if bits > longest:
            return out.union(made.select("key", F.col("own").alias("fp")))
        marked = materialize(made.join(hot.select("key", F.lit(True).alias("longer")), "key", "left"), "simhash-variants")
        stays = marked.where(F.col("longer").isNull()).select("key", F.col("own").alias("fp"))
        out = stays if out is None else out.union(stays)
        rows, done = marked.where("longer").select("own", "variant", "left"), bits


def hot_prefixes(distinct: DataFrame, key_bits: int, full: int = FULL) -> tuple[DataFrame | None, int, int]:
    """Prefixes (as ``key``, and their length ``bits``) with more than ``full`` fingerprints of their own, their number, and the longest length.

    A length is looked at only where the one before it has such prefixes, and then
    among their fingerprints only; the table has at most one row in ``full``
    fingerprints for each length.
    """
    found, number, longest, rows = None, 0, 0, distinct.select("fp")
    for bits in range(key_bits, LAST_BITS + 1, STEP):
        key = F.shiftrightunsigned("fp", BITS - bits).bitwiseOR(F.lit(1 << bits)).alias("key")
        keyed = rows.select("fp", key)
        now = materialize(keyed.groupBy("key").count().where(F.col("count") > full).select("key", F.lit(bits).alias("bits")), "simhash-hot")
        if not (n := now.count()):
            break
        found, number, longest = now if found is None else found.union(now), number + n, bits
        rows = keyed.join(now, "key", "left_semi").select("fp")
    return found, number, longest


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp`` (distinct longs) -> edges ``a, b`` whose components are those of all links within ``radius`` bits."""
    n = distinct.count()
    half = (radius + 1) // 2
    key_bits = int(min(FIRST_BITS, max(8, np.ceil(np.log2(max(n, 1) / 128)))))
    table, number, longest = hot_prefixes(distinct, key_bits)
    if number > SHIPPED:
        rows = joined(distinct, key_bits, half, table, longest)
    else:
        hot: dict[int, list[int]] = {}
        for r in table.collect() if number else ():
            hot.setdefault(r.bits, []).append(r.key)
        hot = {bits: np.array(sorted(keys), np.int64) for bits, keys in hot.items()}

        def emit(batches):
            keys_of = expand(key_bits, half, hot)
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fps), 2_000):
                    for keys, own in keys_of(fps[at : at + 2_000]):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own)], names=["key", "fp"])

        rows = distinct.select("fp").mapInArrow(emit, "key long, fp long")

    def meet(batches):
        for key, fps in grouped(batches):
            if len(fps) < 2:
                continue
            bits = int(key).bit_length() - 1
            low = np.uint64(BITS - bits)
            differ = (fps >> low) ^ np.uint64(key - (1 << bits))
            left = (half - np.unpackbits(np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)).astype(np.uint8)
            a, b = collisions(fps & ((np.uint64(1) << low) - np.uint64(1)), left, bits)
            if len(a):
                a, b = fps[a], fps[b]
                near = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= radius
                a, b = forest(a[near], b[near])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long")


def grouped(batches):
    """(key, values) of rows that come sorted by key; one key's values at a time."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if keys[start] != key:
                if parts:
                    yield key, np.concatenate(parts)
                key, parts = int(keys[start]), []
            parts.append(values[start:end])
    if parts:
        yield key, np.concatenate(parts)


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept``; of rows repeated under one id the one with the smallest text, then the smallest other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = F.struct("text", "doc_id", *others)
    if any(kind in docs.schema.simpleString() for kind in ("map<", "variant")):  # these have no order of their own
        row = F.min_by(whole, F.struct("text", F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]))))
    else:
        row = F.min(whole)
    found = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(row.alias("row"))
    return found.select("row.*").select(*docs.columns)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: one row per document."""
    marked = materialize(fingerprints(docs, words), "simhash-fps")
    lead = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("lead")), "simhash-lead")
    edges = link_fingerprints(lead.where(F.col("lead").isNotNull()), radius)
    of_fp = connected_components(edges, "simhash").withColumnRenamed("node", "fp")
    # Components are named by a fingerprint so far; give each the smallest document in it.
    named = lead.join(of_fp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    by_fp = materialize(named.join(least, "component").select("fp", "component_id"), "simhash-components")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the smallest doc_id.  Rows repeated under that id are one document; rows without id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), words, radius)
    kept = found.where((F.col("doc_id") == F.col("component_id"))).select("doc_id").distinct()
    return one_row_each(docs, kept).unionByName(docs.where(F.col("doc_id").isNull()))
