"""Toxicity: training and scores against plain loops over words, passages and buckets."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tidemill.llm import toxicity as tx

MASK = (1 << 64) - 1


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def words(text: str) -> list[bytes]:
    return [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff@$!*]+", text.encode())]


def bag(word: bytes) -> list[int]:
    marked, out = b"<" + word + b">", []
    for n in tx.NGRAMS:
        for i in range(len(marked) - n + 1):
            code = 0
            for c in marked[i : i + n]:
                code = (code * 257 + c) & MASK
            out.append(mixed((code + (n << 56)) & MASK) & (tx.BUCKETS - 1))
    return out


def passages(ws: list) -> list[list]:
    return [ws[i : i + tx.SPAN] for i in range(0, len(ws), tx.SPAN)] or [[]]


def features(text: str, weight: np.ndarray, bias: float) -> tuple[float, float]:
    value = lambda w: sum(weight[b] for b in bag(w)) / max(1, len(bag(w)))
    logits = [sum(map(value, p)) / tx.SPAN + bias for p in passages(words(text))]
    return float(np.mean(sorted(logits)[::-1][: tx.TOP])), float(np.mean(logits))


TEXTS = ["", "one", "A b c", "what a m0r0n!", "é日本 @$!* x", "word " * 40, "Two words\x00three-four five's six seven eight nine ten eleven twelve thirteen"]


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(1)
    model = tx.Model(rng.normal(0, 1, tx.BUCKETS), -0.2, (1.3, 0.4, -0.1))
    got = model.scores(*tx._joined(TEXTS))
    for text, s in zip(TEXTS, got, strict=True):
        a, b = features(text, model.weight, model.bias)
        assert math.isclose(s, 1 / (1 + math.exp(-(1.3 * a + 0.4 * b - 0.1))), rel_tol=1e-9)


@pytest.mark.parametrize("epochs", [1, 4])
def test_training_equals_plain_loops(epochs):
    """Vectors, the direction and the bias after some steps: every gradient summed word by word and gram by gram."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["tree", "stone", "idiot", "moron", "a", "light"]) for _ in range(rng.randint(0, 15))) for _ in range(8)]
    labels = [i % 2 for i in range(8)]
    model = tx.train(texts, labels, seed=7, epochs=epochs)

    vocabulary = tx._Vocabulary(7)
    rows = vocabulary.of(texts)
    rows += vocabulary.misspelt(rows)
    names = list(vocabulary.ids)
    bags = [bag(w) for w in names]
    used = sorted({b for x in bags for b in x})
    place = {b: i for i, b in enumerate(used)}
    parts = [(p, y) for row, y in zip(rows, labels * 2, strict=True) for p in passages(row)]
    ones = sum(y for _, y in parts)
    draw = np.random.Generator(np.random.PCG64(7))
    E, V, c = draw.normal(0, 0.1, (len(used), tx.DIM)), draw.normal(0, 1.0, tx.DIM), 0.0
    m = {k: np.zeros_like(x) for k, x in (("E", E), ("V", V), ("c", np.zeros(1)))}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    for step in range(1, epochs + 1):
        gE, gV, gc = np.zeros_like(E), np.zeros_like(V), 0.0
        for p, y in parts:
            vectors = [sum(E[place[b]] for b in bags[w]) / max(1, len(bags[w])) if bags[w] else np.zeros(tx.DIM) for w in p]
            h = sum(vectors, np.zeros(tx.DIM)) / tx.SPAN
            g = (1 / (1 + math.exp(-(h @ V + c))) - y) * (0.5 / max(ones, 1) if y else 0.5 / max(len(parts) - ones, 1))
            gV += g * h
            gc += g
            for w in p:
                for b in bags[w]:
                    gE[place[b]] += g * V / (tx.SPAN * max(1, len(bags[w])))
        for k, grad in (("E", gE), ("V", gV), ("c", np.array([gc]))):
            m[k] = m[k] + 0.1 * (grad - m[k])
            v[k] = v[k] + 0.01 * (grad * grad - v[k])
        move = {k: tx.RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) for k in m}
        E, V, c = (E - move["E"]) * tx.DECAY, V - move["V"], c - move["c"][0]
    want = np.zeros(tx.BUCKETS)
    want[used] = E @ V
    assert np.abs(model.weight - want).max() < 2e-2 * max(1.0, np.abs(want).max()) and abs(model.bias - c) < 2e-2
    order = [np.argsort([x.features(*tx._joined([t]))[0, 0] for t in texts]).tolist() for x in (model, tx.Model(want, float(c), (1.0, 0.0, 0.0)))]
    assert order[0] == order[1]
