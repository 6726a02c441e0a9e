"""Repeated passages by sparse suffix arrays.

A text is its words (runs between ASCII blanks).  A position is *selected* if
the hash of the ``ANCHOR`` words from it is the smallest of a window of such
hashes; the choice depends on the words alone, so two texts that share
``least`` words in a row select the same places within them.  Suffixes are kept
at selected places only, about one in twenty.

1. Suffixes are dealt by the hash of their first ``ANCHOR`` words; those alone
   in that are dropped, as nothing can match them.
2. The rest, with the words around them, are sorted by what follows.  Where
   neighbours agree on ``b`` words they form an interval of the suffix array;
   within it, suffixes that also agree on the ``least - b`` words before them
   belong to one passage.  This is asked for every split of ``least`` into words
   before and after, so a passage is found wherever its selected place falls,
   and no pair within an interval is compared but neighbours.
3. A match is extended left and right, as far as the neighbour agrees and the
   words at hand go; these overlap from one selected place to the next, so that
   the union of a document's matches covers its repeated passages whole.

An anchor with more than ``FULL`` suffixes (a line that much of the corpus
shares) is too much for one task.  Each of its suffixes is then turned into the
hashes of the ``least``-word windows around it, one for each split, and the
windows that two documents have are found by partial aggregation; the union of
those windows is what sorting would have found.

A passage counts if two different documents have it.  Equal texts (by SHA-256)
are one text to this search (their smallest doc_id stands for them) and are
repeated whole if they have ``least`` words.

``without_repeats`` gives every passage of ``least`` words to the smallest doc_id
that has it, which keeps it whole; other documents lose those of its words that
no passage of their own needs.  So each passage stays in one document at least.

Defined results: null texts, empty ones and ones of fewer than ``least`` words
have no passages; rows repeated under one doc_id with one text are one document;
rows with a null doc_id are left out; an empty table gives an empty result;
extra columns are ignored by ``repeated_passages`` and kept by ``without_repeats``,
which also keeps rows with a null doc_id or text as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.storage import materialize

LEAST, ANCHOR = 50, 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Suffixes with one anchor that a task sorts together; those of a larger group are matched window by window.
FULL = 16_384
#: Suffixes, of many anchors, that are compared at a time.
TOGETHER = 8_192


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word."""
    known: dict[bytes, int] = {}
    words = (text or "").encode("utf-8", "surrogatepass").split()
    for w in set(words):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def anchors(codes: np.ndarray, anchor: int) -> np.ndarray:
    """Hash of the ``anchor`` words from each position."""
    n = len(codes) - anchor + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(anchor if n > 0 else 0):
        total = total * FACTOR + codes[k : k + n]
    return mixed(total)


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash of some window of ``window``; of equal ones the last."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    low, at, width = hashes, np.arange(n), 1
    while width < window:
        step = min(width, window - width)
        right = low[step:] <= low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    return np.unique(at)


def _suffixes(codes: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = anchors(codes, anchor)
    at = selected(hashes, least - anchor + 1)
    return at, hashes[at]


def _context(codes: np.ndarray, at: np.ndarray, least: int, anchor: int) -> np.ndarray:
    """The words before each place (nearest first, ``least - anchor`` of them) and from it (``least``), in 32 bits; 0 beyond the text."""
    short = np.concatenate((np.zeros(least, np.uint32), (codes >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(least, np.uint32)))
    before = at[:, None] + least - 1 - np.arange(least - anchor)
    after = at[:, None] + least + np.arange(least)
    return short[np.concatenate((before, after), axis=1)]


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the first k words of each row, for k from 0; rows that end before k get hashes of their own."""
    n, width = words.shape
    out = np.zeros((n, width + 1), np.uint64)
    for k in range(width):
        out[:, k + 1] = mixed(out[:, k] * FACTOR + words[:, k].astype(np.uint64) + np.uint64(k + 1))
    ended = np.cumsum(words == 0, axis=1) > 0
    own = mixed(np.arange(n, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    out[:, 1:] = np.where(ended, own[:, None] + np.arange(1, width + 1, dtype=np.uint64), out[:, 1:])
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words two rows have in common from their beginning."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1))


def passages(docs: np.ndarray, words: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes with a common anchor: words to the left and right that another document repeats, and the smallest doc_id that does.

    0 words: no passage of ``least`` words goes through the place.
    """
    n, reach = len(docs), least - anchor
    left, right, first = np.zeros(n, np.int64), np.zeros(n, np.int64), docs.copy()
    before, after = words[:, :reach], words[:, reach:]
    ranks = np.lexsort(after.T[::-1])  # the sparse suffix array
    docs, before, after = docs[ranks], before[ranks], after[ranks]
    shared = np.concatenate(([0], agreement(after[1:], after[:-1])))
    runs = run_hashes(before)
    out_left, out_right, out_first = np.zeros(n, np.int64), np.zeros(n, np.int64), docs.copy()
    for b in range(anchor, least + 1):
        interval = np.cumsum(shared < b)
        key = mixed(interval.astype(np.uint64) * FACTOR + runs[:, least - b])
        order = np.lexsort((docs, key))
        cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        size = np.diff(np.append(cut, n))
        low, high = docs[order][cut], docs[order][cut + size - 1]
        hit = np.repeat(low < high, size)
        if not hit.any():
            continue
        on, before_it, whose = order[hit], np.roll(order, 1)[hit], np.repeat(low, size)[hit]
        head = np.isin(np.flatnonzero(hit), cut)
        next_of = np.roll(order, -1)[hit]
        for other, good in ((before_it, ~head), (next_of, np.append(head[1:] == 0, False) if len(head) else head)):
            p, q = on[good], other[good]
            ahead, back = agreement(after[p], after[q]), agreement(before[p], before[q])
            np.maximum.at(out_left, p, back)
            np.maximum.at(out_right, p, ahead)
        np.minimum.at(out_first, on, whose)
    left[ranks], right[ranks], first[ranks] = out_left, out_right, out_first
    return left, right, first


def union_of(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching (start, end, first) spans as one; the smallest ``first`` stays."""
    out: list[list[int]] = []
    for start, end, first in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = min(out[-1][2], first)
        else:
            out.append([start, end, first])
    return [tuple(x) for x in out]


def fixed_rows(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, without a Python object for each."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def matrix_of(rows: pa.Array, width: int) -> np.ndarray:
    """The matrix that ``fixed_rows`` made values of (none of them null); it shares their memory."""
    rows = rows.cast(pa.binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint32).reshape(-1, width)


def repeated_passages(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, first_doc_id``: passages of ``least`` words or more that another document has, too.

    Words are counted from 0, ``end_word`` is exclusive; ``first_doc_id`` is the
    smallest doc_id found to share a part of the passage.  Texts are shuffled
    once, to meet the places that were found worth comparing.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    # Suffixes carry a short mark of their text; texts whose marks collide only lend each other places to look at.
    mark = F.xxhash64("text").alias("mark")
    words = F.regexp_count("text", F.lit(WORD.pattern)).cast("long")
    ids = materialize(texts.select("doc_id", sha, mark, words.alias("n")).distinct(), "repeats-ids")
    leads = ids.groupBy("sha", "mark", "n").agg(F.min("doc_id").alias("lead"), (F.min("doc_id") < F.max("doc_id")).alias("copied"))
    leads = materialize(leads, "repeats-leads")

    def select(batches):
        for batch in batches:
            ids, keys, places = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, hashes = _suffixes(word_codes(text.as_py()), least, anchor)
                ids.append(np.full(len(at), i, np.int64))
                keys.append(hashes.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, places)], names=["mark", "anchor", "place"])

    suffixes = materialize(texts.select(mark, "text").mapInArrow(select, "mark long, anchor long, place int"), "repeats-suffixes")
    shared = suffixes.groupBy("anchor").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high"))
    shared = materialize(shared.select("anchor", (F.col("n") > FULL).alias("full")), "repeats-anchors")
    of = lambda full: F.collect_set(F.when(F.col("full") == full, F.col("place")))
    wanted = suffixes.join(shared, "anchor").groupBy("mark").agg(of(False).alias("places"), of(True).alias("full_places"))
    wanted = materialize(wanted.join(leads.select("mark", "sha", "lead"), "mark").select(F.col("lead").alias("doc_id"), "sha", "places", "full_places"), "repeats-wanted")

    def surround(batches):
        """Suffixes with the words around them; of full anchors, the hashes of the windows around them (and no words)."""
        names = ["key", "doc_id", "place", "words"]
        for batch in batches:
            for i, text, places, full in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                codes = word_codes(text.as_py())
                hashes = anchors(codes, anchor).view(np.int64)
                at = np.sort(places.values.to_numpy(zero_copy_only=False)).astype(np.int64)
                at = at[at < len(hashes)]
                hashes = hashes[at]
                for k in range(0, len(at), 5_000):
                    part = at[k : k + 5_000]
                    rows = fixed_rows(_context(codes, part, least, anchor))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[k : k + 5_000]), pa.array(np.full(len(part), i, np.int64)), pa.array(part), rows], names=names)
                at = full.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(at):
                    hashes = anchors(codes, least).view(np.int64)
                    starts = np.unique(at[:, None] - np.arange(least - anchor + 1))
                    starts = starts[(starts >= 0) & (starts < len(hashes))]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[starts]), pa.array(np.full(len(starts), i, np.int64)), pa.array(starts), pa.nulls(len(starts), pa.binary())], names=names)

    chosen = texts.withColumn("sha", sha).join(wanted, ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]).select("doc_id", "text", "places", "full_places")
    around = materialize(chosen.mapInArrow(surround, "key long, doc_id long, place long, words binary"), "repeats-around")

    def match(batches):
        for ids, places, words in sorted_groups(batches, 2 * least - anchor):
            left, right, first = passages(ids, words, least, anchor)
            on = left + right >= least
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (ids, places - left, places + right, np.minimum(first, ids))], names=["doc_id", "start", "end", "first"])

    dealt = around.where(F.col("words").isNotNull()).repartition("key").sortWithinPartitions("key", "words")
    found = dealt.mapInArrow(match, "doc_id long, start long, end long, first long")
    windows = around.where(F.col("words").isNull()).drop("words")
    common = windows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("high")).where(F.col("first") < F.col("high"))
    found = found.union(windows.join(common, "key").select("doc_id", F.col("place").alias("start"), (F.col("place") + least).alias("end"), "first"))
    found = materialize(found, "repeats-found")
    # Texts of one doc_id that differ are one document here; their passages count for both.
    whole = leads.where(F.col("copied") & (F.col("n") >= least)).select(F.col("lead").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("lead").alias("first"))
    per_doc = found.union(whole).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "first")).alias("spans"))

    def unite(batches):
        for batch in batches:
            rows = [(i, *span) for i, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for span in union_of([(s["start"], s["end"], s["first"]) for s in spans])]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["lead", "start_word", "end_word", "first_doc_id"])

    united = per_doc.mapInArrow(unite, "lead long, start_word long, end_word long, first_doc_id long")
    owners = ids.join(leads.select("sha", "lead"), "sha").select("doc_id", "lead").distinct()
    return owners.join(united, "lead").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def sorted_groups(batches, width: int):
    """(doc_ids, places, words) of rows that come sorted by anchor: some thousands of rows, the last anchor whole.

    Anchors need not be told apart: their suffixes differ within the first words.
    """
    key, size, parts = None, 0, []

    def whole():
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        ids, places, words = *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)), matrix_of(batch.column(3), width)
        start = 0
        if size >= TOGETHER or (size and keys[0] != key and size + len(keys) > 2 * TOGETHER):
            ends = np.flatnonzero(keys != key)  # the anchor at hand may go on into this batch
            start = int(ends[0]) if len(ends) else len(keys)
            if start:
                parts.append((ids[:start], places[:start], words[:start]))
                size += start
            if len(ends):
                yield whole()
                size, parts = 0, []
        if start < len(keys):
            parts.append((ids[start:], places[start:], words[start:]))
            size += len(keys) - start
        key = keys[-1]
    if size:
        yield whole()


def without_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """The documents without the repeated passages that a document with a smaller doc_id keeps.

    The windows of ``least`` words within repeated passages are dealt by a hash;
    the smallest doc_id with a window owns it.  Words of windows that others own
    are cut, but for those that a repeated window of the document's own covers.
    """
    names = docs.columns
    spans = repeated_passages(docs, least, anchor).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans"))
    spans = materialize(spans, "repeats-spans")

    def windows(batches):
        for batch in batches:
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                one, two = window_marks(text.as_py(), least)
                sha = hashlib.sha256((text.as_py() or "").encode("utf-8", "surrogatepass")).digest()
                at = np.unique(np.concatenate([np.arange(s["start_word"], min(s["end_word"] - least + 1, len(one))) for s in own])).astype(np.int64)
                for k in range(0, len(at), 20_000):
                    part = at[k : k + 20_000]
                    columns = one[part], two[part], np.full(len(part), i, np.int64), part, [sha] * len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["one", "two", "doc_id", "place", "sha"])

    within = docs.select(F.col("doc_id").cast("long"), "text").join(spans, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__spans")
    found = materialize(within.mapInArrow(windows, "one long, two long, doc_id long, place long, sha binary"), "repeats-windows")
    owned = found.groupBy("one", "two").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where(F.col("owner") < F.col("last")).drop("last")
    met = found.join(owned, ["one", "two"])
    of = lambda mine: F.collect_set(F.when((F.col("owner") == F.col("doc_id")) == mine, F.col("place")))
    cuts = met.groupBy(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).agg(of(True).alias("__mine"), of(False).alias("__theirs")).where(F.size("__theirs") > 0)
    same = (docs["doc_id"].cast("long") == F.col("__id")) & (F.unhex(F.sha2(docs["text"], 256)) == F.col("__sha"))
    joined = docs.join(cuts, same, "left").drop("__id", "__sha")

    def cut(batches):
        for batch in batches:
            at = names.index("text")
            texts = [kept(t.as_py(), m.as_py(), o.as_py(), least) for t, m, o in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)


def window_marks(text: str | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``least`` words from each place, which together tell windows apart."""
    codes = word_codes(text)
    return anchors(codes, least).view(np.int64), anchors(mixed(codes), least).view(np.int64)


def kept(text: str | None, mine: list[int] | None, theirs: list[int] | None, least: int) -> str | None:
    """``text`` without the words, and the blanks between them, that windows at ``theirs`` cover and none at ``mine`` does."""
    if not text or not theirs:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    covered = lambda starts: np.cumsum(np.bincount(starts, minlength=len(at) + 1)[: len(at) + 1] - np.bincount(np.asarray(starts) + least, minlength=len(at) + 1)[: len(at) + 1])[: len(at)] > 0
    gone = covered(theirs) & ~(covered(mine) if mine else False)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    out, done = [], 0
    for start, end in edges.reshape(-1, 2).tolist():
        out.append(text[done : at[start][0]])
        done = at[end - 1][1]
    return "".join([*out, text[done:]])
