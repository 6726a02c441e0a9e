"""Slope and threshold come from all sampled documents."""

import random

from lectern.llm import toxicity


def test_threshold_sees_every_document(monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("an", "be", "sti", "thor", "er", "ing", "ou", "re", "nd")) for _ in range(rng.randint(2, 4)))
    text = lambda *more: " ".join([*(word() for _ in range(20)), *more])
    texts = [text(rng.choice(("idiot", "moron", "pathetic"))) for _ in range(900)] + [text() for _ in range(1_700)]
    seen, boundary = [], toxicity.boundary
    monkeypatch.setattr(toxicity, "boundary", lambda x, y: seen.append((int(y.sum()), int((1 - y).sum()))) or boundary(x, y))
    toxicity.fit(texts, [1] * 900 + [0] * 1_700)
    assert seen == [(900, 1_700)]
