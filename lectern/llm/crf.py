"""A linear-chain conditional random field in numpy.

Training maximises the penalised likelihood of a small labelled table by Adam
over padded batches (forward-backward); decoding is Viterbi over padded batches.
Features are strings per token; weights are kept for features seen in training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    labels: tuple[str, ...]
    index: dict[str, int]  # feature -> row of weights; row 0 stands for unseen ones and stays zero
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels, from row to column
    begin: np.ndarray


def _padded(rows: list[list[list[str]]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    width = max((len(token) for row in rows for token in row), default=1)
    ids = np.zeros((len(rows), max(map(len, rows), default=1), width), np.int32)
    mask = np.zeros(ids.shape[:2], bool)
    for r, row in enumerate(rows):
        mask[r, : len(row)] = True
        for t, token in enumerate(row):
            known = [index[f] for f in token if f in index]
            ids[r, t, : len(known)] = known
    return ids, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[list[list[str]]], tags: list[list[str]], labels: tuple[str, ...], rounds: int = 80, rate: float = 0.08, penalty: float = 2e-3) -> Model:
    """``rows``: features of each token of each sequence; ``tags``: their labels."""
    index = {f: i + 1 for i, f in enumerate(sorted({f for row in rows for token in row for f in token}))}
    ids, mask = _padded(rows, index)
    n, length = mask.shape
    k = len(labels)
    gold = np.zeros((n, length), np.int64)
    for r, row in enumerate(tags):
        gold[r, : len(row)] = [labels.index(t) for t in row]
    params = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    one = np.eye(k)[gold] * mask[..., None]
    pairs = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("nti,ntj->ij", one[:, :-1] * pairs[..., None], one[:, 1:])
    for step in range(1, rounds + 1):
        weights, moves, begin = params
        score = weights[ids].sum(axis=2)
        alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = score[:, 0] + begin
        for t in range(1, length):
            new = _lse(alpha[:, t - 1, :, None] + moves, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _lse(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = _lse(alpha[:, -1], 1)
        node = np.exp(np.where(mask[..., None], alpha + beta - total[:, None, None], -np.inf))
        edge = alpha[:, :-1, :, None] + moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = np.exp(np.where(pairs[..., None, None], edge, -np.inf)).sum(axis=(0, 1))
        slope = np.zeros_like(weights)
        np.add.at(slope, ids.reshape(-1, ids.shape[2]), (one - node).reshape(-1, 1, k))
        slope[0] = 0
        for p, g, (m, v) in zip(params, [slope, gold_moves - expected, (one - node)[:, 0].sum(axis=0)], slots, strict=True):
            g = g / n - penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, *params)


def viterbi(model: Model, rows: list[list[list[str]]], batch: int = 256) -> list[list[str]]:
    """The likeliest labels of each sequence; sequences of like length share a batch."""
    out: list[list[str]] = [[] for _ in rows]
    order = sorted((i for i in range(len(rows)) if rows[i]), key=lambda i: len(rows[i]))
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        ids, mask = _padded([rows[i] for i in part], model.index)
        score = model.weights[ids].sum(axis=2)
        best, back = score[:, 0] + model.begin, []
        for t in range(1, mask.shape[1]):
            ways = best[:, :, None] + model.moves
            came = ways.argmax(axis=1)
            on = mask[:, t, None]
            best = np.where(on, ways.max(axis=1) + score[:, t], best)
            back.append(np.where(on, came, np.arange(len(model.labels))))
        at_label = best.argmax(axis=1)
        path = [at_label]
        for came in reversed(back):
            at_label = came[np.arange(len(part)), at_label]
            path.append(at_label)
        path = np.array(path[::-1]).T
        for r, i in enumerate(part):
            out[i] = [model.labels[x] for x in path[r, : len(rows[i])]]
    return out
