"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares two strings by the letter triples they share, in order but
not in a row; each letter a triple spans costs a factor ``DECAY``.  So a word
with letters put in, or a family of words on one stem, stays close to it.  The
kernel against ``LANDMARKS`` strings is whitened to a feature vector, on which a
linear SVM is trained.

Training takes a bounded sample of labelled documents (``MAX_TOXIC`` and
``MAX_CLEAN``, by a hash of the id).  Their sentences carry the document's label
down to their words; which words of a toxic sentence speak for the label is
settled by a greedy cover: letter runs that occur in many yet unexplained toxic
documents and hardly in clean ones.  Words with such a run, also with letters
put in or doubled, are the positive strings; frequent, random and then the
hardest words of clean documents are the negative ones.  The score of a document
is a logistic function, fitted on the sampled documents, of its highest margin.

A document's strings are its words, and what remains of writings with gaps
(``i d i o t``, ``i.d-i_o.t``) once what is between the letters is left out.
Words longer than ``LONG`` are cut into overlapping windows, none is dropped.
Each distinct string of a batch is scored once.

Defined results: a null or empty text, or one without letters, has the score of
a document in which nothing speaks for toxicity; repeated rows get equal scores;
without labelled documents of both classes all scores are 0 (or 1, if all are
toxic); a null doc_id is not held out; extra columns are ignored by ``score``
and kept by ``reject``.  Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.workers import release

MAX_TOXIC, MAX_CLEAN = 1_500, 3_000
#: Strings that the machine learns from: toxic ones, those of them also put in with changes; clean ones that are frequent, random, and the worst of each of two rounds.
MAX_STRINGS, MAX_WIDENED, MAX_FREQUENT, MAX_RANDOM, MAX_HARDEST = 2_000, 600, 1_500, 2_500, 1_000
LANDMARKS = 32
DECAY, ORDER = 0.5, 3
LONG, STEP = 24, 12
GRAMS = (4, 5, 6)
FOLDS = 5
MAX_SCORED = 150_000
#: Texts that are scored at a time.
SLICE = 1_000
#: The margin of a text without strings.
LOWEST = -2.0
#: How many letter runs may explain one toxic document.
COVERS = 4

WORD = re.compile(r"[^\W\d_]+")
GAPPED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W\d_]{1,2}[^\W\d_](?![^\W\d_])){2,}")
EDGES = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿"""


def strings_of(text: str | None) -> set[str]:
    low = (text or "").lower()
    words = WORD.findall(low)
    out = set(words)
    if sum(len(w) == 1 for w in words) >= 3:
        out.update("".join(WORD.findall(m.group())) for m in GAPPED.finditer(low))
    for token in low.split():
        if not token.isalpha() and (inner := token.strip(EDGES)) and not inner.isalpha():
            out.add("".join(WORD.findall(inner)))
    return {w for w in out if len(w) >= ORDER}


# --- the kernel -----------------------------------------------------------------------------------------------------


def coded(words: list[str], width: int) -> np.ndarray:
    """Code points in rows, 0 behind the end."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, width), np.uint32)


def kernel(s: np.ndarray, t: np.ndarray, decay: float = DECAY, order: int = ORDER) -> np.ndarray:
    """Unnormalised kernel of every row of ``s`` with every row of ``t`` (3-d ``t``: with its own rows only)."""
    t = t[None] if t.ndim == 2 else t
    n, m, width = len(s), t.shape[1], t.shape[2]
    span = np.arange(width)
    ahead = span[None, :] - span[:, None]
    carry = np.where(ahead >= 0, float(decay) ** np.maximum(ahead, 0), 0).astype(np.float32)
    prefix = [np.ones((n, m, width), np.float32)] + [np.zeros((n, m, width), np.float32) for _ in range(order - 1)]
    total = np.zeros((n, m), np.float32)
    square = np.float32(decay * decay)
    for j in range(s.shape[1]):
        letter = s[:, j, None, None]
        hit = ((letter == t) & (letter != 0)).astype(np.float32) * square
        new = []
        for i in range(order):
            before = prefix[i]
            if i:
                before = np.concatenate((np.zeros((n, m, 1), np.float32), before[:, :, :-1]), axis=2)
            met = hit * before
            if i == order - 1:
                total += met.sum(axis=2)
            else:
                new.append(np.float32(decay) * prefix[i + 1] + met @ carry)
        prefix[1:] = new
    return total


@functools.cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of three letters in ``n``, and what the span of each costs."""
    at = np.array(list(combinations(range(n), ORDER)), np.int16).reshape(-1, ORDER).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)


@dataclass
class Model:
    """The decision function, expanded: a sum of kernels with fixed landmarks is a weight for every letter triple."""

    letters: np.ndarray  # the landmarks' letters, ascending
    table: np.ndarray  # weight of each triple of letters; 0 stands for all other letters
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def of(landmarks: list[str], weights: np.ndarray, bias: float) -> Model:
        """``weights``: of the kernel with each landmark."""
        letters = np.unique(np.array([ord(c) for w in landmarks for c in w], np.uint32))
        size = len(letters) + 1
        table = np.zeros(size**ORDER)
        for word, weight in zip(landmarks, weights, strict=True):
            codes = np.searchsorted(letters, [ord(c) for c in word]) + 1
            at, cost = triples(len(word))
            np.add.at(table, (codes[at[0]] * size + codes[at[1]]) * size + codes[at[2]], weight * cost)
        return Model(letters, table.astype(np.float32), bias)

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of strings of any length."""
        by_length: dict[int, tuple[list[str], list[int]]] = {}
        for i, w in enumerate(words):
            for at in range(0, max(1, len(w) - STEP), STEP) if len(w) > LONG else (0,):
                pieces, owner = by_length.setdefault(min(LONG, len(w) - at), ([], []))
                pieces.append(w[at : at + LONG])
                owner.append(i)
        out = np.full(len(words), -np.inf)
        size = len(self.letters) + 1
        for n, (pieces, owner) in by_length.items():
            if n < ORDER:
                continue
            at, cost = triples(n)
            block = max(1, 2_000_000 // len(cost))
            for k in range(0, len(pieces), block):
                points = coded(pieces[k : k + block], n)
                place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
                codes = np.where(self.letters[place] == points, place + 1, 0).astype(np.int32)
                total = self.table[(codes[:, at[0]] * size + codes[:, at[1]]) * size + codes[:, at[2]]] @ cost
                own = kernel(points, points[:, None, :])[:, 0]
                np.maximum.at(out, owner[k : k + block], total / np.sqrt(np.maximum(own, 1e-12)) + self.bias)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(margin, LOWEST) + self.offset, -30, 30)))


def similarities(words: list[str], landmarks: np.ndarray, root: np.ndarray) -> np.ndarray:
    s = coded(words, max(map(len, words)))
    own = kernel(s, s[:, None, :])[:, 0]
    return kernel(s, landmarks) * root / np.sqrt(np.maximum(own, 1e-12))[:, None]


# --- training -------------------------------------------------------------------------------------------------------


def unlike(docs: list[set[str]], size: int = 8) -> list[set[str]]:
    """Documents without those that share half of their smallest hashes with one before."""
    seen: set[int] = set()
    out = []
    for words in docs:
        low = sorted(zlib.crc32(w.encode()) for w in words)[:size]
        if not low or 2 * sum(h in seen for h in low) < len(low):
            out.append(words)
        seen.update(low)
    return out


def grams_of(docs: list[set[str]], only: set[str] | None = None):
    """The letter runs of each document (of those in ``only``); each distinct word is cut up once."""
    known: dict[str, list[str]] = {}
    for words in docs:
        found: set[str] = set()
        for w in words:
            if (own := known.get(w)) is None:
                own = [w[i : i + k] for k in GRAMS for i in range(len(w) - k + 1)]
                own = known[w] = own if only is None else [g for g in own if g in only]
            found.update(own)
        yield found


def cover(toxic: list[set[str]], clean: list[set[str]], limit: int) -> list[str]:
    """Letter runs that, one after the other, explain most of what is left of the toxic documents.

    A document counts until ``COVERS`` runs explain it.
    """
    least = max(3, len(toxic) // 150)
    support = Counter(g for found in grams_of(toxic) for g in found)
    open_grams = {g for g, n in support.items() if n >= least}
    against = Counter(g for found in grams_of(clean, open_grams) for g in found)
    scale = len(toxic) / max(1, len(clean))
    where: dict[str, set[int]] = {g: set() for g in open_grams if against[g] * scale * 10 <= support[g]}
    for i, found in enumerate(grams_of(toxic, set(where))):
        for g in found:
            where[g].add(i)
    chosen: list[str] = []
    need = [COVERS] * len(toxic)
    left = set(range(len(toxic)))
    while len(chosen) < limit and where:
        best = max(where, key=lambda g: (len(where[g]) - 3 * against[g], len(g), g))
        docs = where.pop(best)
        if len(docs) - 3 * against[best] < least:
            break
        chosen.append(best)
        for i in docs:
            need[i] -= 1
        left = {i for i in left if need[i] > 0}
        # A run that goes along with a chosen one adds nothing to it.
        where = {g: now for g, old in where.items() if len(now := old & left) >= least and len(old & docs) < 0.8 * len(old)}
    return chosen


def widened(words: list[str], rng: random.Random) -> list[str]:
    """Each word with a letter put in and with a letter doubled."""
    out = []
    for w in words:
        at = rng.randrange(1, len(w))
        out += [w[:at] + rng.choice("aeinorstux") + w[at:], w[:at] + w[at - 1] + w[at:]]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM: squared hinge by accelerated gradient steps."""
    z = np.hstack((x, np.ones((len(x), 1))))
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.norm((z * weight[:, None]).T @ z, 2) + penalty)
    w = old = np.zeros(z.shape[1])
    for k in range(rounds):
        v = w + k / (k + 3) * (w - old)
        slack = np.maximum(0, 1 - y * (z @ v))
        slope = penalty * np.append(v[:-1], 0) - 2 * z.T @ (weight * y * slack)
        old, w = w, v - step * slope
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x), classes as frequent as each other, by damped Newton steps."""
    z = np.stack((x, np.ones_like(x)), axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    target = np.where(y > 0, 0.97, 0.03)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-5 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (weight * (target - p)) - 1e-5 * w)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: list[str | None], labels: list[int], seed: int = 5) -> Model | float:
    """The model, or the constant score if only one class is there."""
    rows = sorted({(t or "", int(y)) for t, y in zip(texts, labels, strict=True)})
    toxic = [strings_of(t) for t, y in rows if y]
    clean = [strings_of(t) for t, y in rows if not y]
    if not toxic or not clean:
        return 1.0 if toxic else 0.0
    rng = random.Random(seed)
    runs = cover(unlike(toxic), clean, LANDMARKS)
    common = Counter(w for words in clean for w in words)
    vocabulary = sorted(common)
    positive = Counter(w for words in toxic for w in words if w not in common and any(r in w for r in runs))
    if not positive:
        return 0.0
    strings = [w[:LONG] for w, _ in sorted(positive.items(), key=lambda x: (-x[1], x[0]))[:MAX_STRINGS]]
    strings = list(dict.fromkeys(strings))
    extra = widened(sorted({*runs, *strings[:MAX_WIDENED]}), rng)
    frequent = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:MAX_FREQUENT]]
    negative = list(dict.fromkeys(w[:LONG] for w in (*frequent, *rng.sample(vocabulary, min(MAX_RANDOM, len(vocabulary))))))
    shortest = [min((w for w in strings if r in w), key=lambda w: (len(w), w), default=r) for r in runs]
    landmarks = list(dict.fromkeys([*shortest, *runs, *strings]))[: LANDMARKS * 3 // 4]
    landmarks += [w for w in negative if w not in landmarks][: LANDMARKS - len(landmarks)]
    marks = coded(landmarks, max(map(len, landmarks)))
    root = 1 / np.sqrt(np.diag(kernel(marks, marks)))
    values, vectors = np.linalg.eigh((kernel(marks, marks) * root[:, None] * root).astype(float) + 1e-3 * np.eye(len(marks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    for again in range(3):
        words = [*strings, *extra, *negative]
        x = np.vstack([similarities(words[i : i + 2_000], marks, root) for i in range(0, len(words), 2_000)]) @ whiten
        y = np.where(np.arange(len(words)) < len(strings) + len(extra), 1.0, -1.0)
        weight = np.concatenate((np.full(len(strings), 1.0 / len(strings)), np.full(len(extra), 0.3 / len(extra)), np.full(len(negative), 1.3 / len(negative))))
        beta, bias = svm(x, y, weight)
        model = Model.of(landmarks, whiten @ beta * root, bias)
        if again < 2:  # the clean words that this machine finds worst
            hardest = np.argsort(-model.margins(vocabulary), kind="stable")[:MAX_HARDEST]
            negative = list(dict.fromkeys([*negative, *(vocabulary[i][:LONG] for i in hardest)]))
    sample = [(w, 1.0) for w in toxic] + [(w, 0.0) for w in clean]
    every = sorted({w for words, _ in sample for w in words})
    of = dict(zip(every, model.margins(every).tolist(), strict=True))
    best = np.maximum([max((of[w] for w in words), default=LOWEST) for words, _ in sample], LOWEST)
    y = np.array([y for _, y in sample])
    model.slope, _ = logistic(best, y)
    model.offset = -model.slope * boundary(best, y)
    return model


def boundary(x: np.ndarray, y: np.ndarray) -> float:
    """Where the classes part with the least sum of error rates; the middle of the widest such gap."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    wrong = np.cumsum(y) / max(1, y.sum()) + 1 - np.cumsum(1 - y) / max(1, (1 - y).sum())
    gaps = np.append(x[1:] - x[:-1], 0)
    at = max(range(len(x)), key=lambda i: (gaps[i] > 0, -round(wrong[i], 9), gaps[i]))
    return float(x[at] + gaps[at] / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | float:
    """Fits on at most ``max_toxic + max_clean`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    pick = lambda toxic, n: known.where((F.col("toxic") > 0) == toxic).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(True, max_toxic).union(pick(False, max_clean))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").toArrow()
    return fit(rows.column("text").to_pylist(), [int(y > 0) for y in rows.column("toxic").to_pylist()])


# --- scoring --------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores texts; remembers the margins of strings up to a bound."""

    def __init__(self, model: Model | float):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if isinstance(self.model, float):
            return np.full(len(texts), self.model)
        best = np.full(len(texts), -np.inf)
        at = 0
        while at < len(texts):  # some megabytes of text at a time
            to, size = at, 0
            while to < len(texts) and (to == at or size < 2_000_000):
                size += len(texts[to] or "")
                to += 1
            best[at:to] = self.highest([strings_of(t) for t in texts[at:to]])
            at = to
        return self.model.score(best)

    def highest(self, docs: list[set[str]]) -> list[float]:
        known = self.known
        if len(known) > MAX_SCORED:
            known.clear()
        new = [w for w in dict.fromkeys(w for words in docs for w in words) if w not in known]
        known.update(zip(new, self.model.margins(new).tolist(), strict=True))
        return [max(map(known.__getitem__, words), default=-np.inf) for words in docs]


def scored(docs: DataFrame, model: Model | float, column: str = "score") -> DataFrame:
    """``docs`` with the score of each text as its last column."""
    names = docs.columns

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(names.index("text"))
            scores = [scorer(texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=[*names, column])
        del scorer
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    out = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, name).where(F.col(name) < threshold).drop(name)
