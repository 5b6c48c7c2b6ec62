"""Language-model scores against plain loops, and the model's own properties."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tokens(text) -> list[str]:
    return WORD.findall(lower(text or "")) + [lm.END]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def rows(spark):
    some = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    odd = ["", None, "  \n ", "İstanbul ÀB straße", "A" * 500, "x\x85y no break", "unseenword unseenword", "a\x1cb c\x0bd"]
    return some + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "a null id"), (5, "a shared id"), (5, "a shared id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x", 4) for i, t in rows], "doc_id long, text string, n_tokens int, word string, `a.b` int").repartition(3).cache()


@pytest.fixture(scope="module")
def learnt(docs, rows):
    train = docs.where(lm.fold() != 0)
    counts = lm.word_counts(train).cache()
    known = lm.numbers(counts, words=50, hot=400)
    return known, counts, lm.fit(train, known)


def test_counts_equal_plain_ones(learnt, rows):
    known, counts, _ = learnt
    want = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert (known.total, known.kinds) == (sum(want.values()), len(want))


def test_scores_equal_plain_loops(docs, learnt, rows):
    known, counts, model = learnt
    n = {r["word"]: r["n"] for r in counts.collect()}
    names = known.hot.to_pylist()[: known.vocabulary]
    rest, kinds = known.total - sum(n[w] for w in names), known.kinds - len(names)
    vectors, bias, places = (x.astype(np.float64) for x in (model.vectors, model.bias, model.places))

    def plain(text):
        two, one, score, base, seen = model.size, model.size, 0.0, 0.0, 0
        for w in tokens(text):
            c = n.get(w, 0)
            z = (vectors[one] @ places[0] + vectors[two] @ places[1]) @ vectors[:-1].T + bias
            s = names.index(w) if w in names else model.size - 1
            score += (z[s] - np.log(np.exp(z).sum())) / math.log(10)
            if s == model.size - 1:
                score += math.log10((c + 0.1) / (rest + 0.1 * (kinds + 1)))
            base += math.log10((c + 0.1) / (known.total + 0.1 * (known.kinds + 1)))
            seen += c > 0
            two, one = one, s
        return len(tokens(text)), seen, base, score

    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 1)) for r in lm.scores(docs, model, known, counts).collect())
    want = Counter((i, a, b, round(c, 5), round(d, 1)) for i, t in rows for a, b, c, d in [plain(t)])
    assert sum((got - want).values()) <= 3  # a score may lie at the edge of rounding
    exact = sorted((str(i), a, b, c) for (i, a, b, c, _), k in got.items() for _ in range(k))
    assert exact == sorted((str(i), a, b, c) for (i, a, b, c, _), k in want.items() for _ in range(k))


def test_probabilities_sum_to_one(learnt):
    known, counts, model = learnt
    symbols = np.arange(model.size)
    for before in ([model.size, model.size], [0, 3], [model.size - 1, 7]):
        p = np.exp(model.log_probabilities(np.tile(before, (model.size, 1)), symbols))
        assert abs(p.sum() - 1) < 1e-4
    names = set(known.hot.to_pylist()[: known.vocabulary])
    others = np.array([r["n"] for r in counts.collect() if r["word"] not in names] + [0])  # unseen words count as one
    assert abs((10 ** known.share(others)).sum() - 1) < 1e-9


def test_steps_follow_the_gradient_of_the_contrastive_loss():
    rng = np.random.default_rng(2)
    size, b = 9, 40
    model = lm.Model(rng.normal(0, 0.5, (size + 1, lm.DIM)).astype(np.float32), rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 0.3, (2, lm.DIM, lm.DIM)).astype(np.float32))
    share = np.log(np.full(size, 1 / size))
    before, w = rng.integers(0, size + 1, (b, 2)), rng.integers(0, size, b)
    noise = np.minimum(np.searchsorted(np.cumsum(np.exp(share)), np.random.Generator(np.random.PCG64(7)).random(lm.NOISE) * np.cumsum(np.exp(share))[-1], "right"), size - 1)

    def loss(flat):
        a, c = model.vectors.size, model.vectors.size + size
        v, bias, m = flat[:a].reshape(size + 1, lm.DIM), flat[a:c], flat[c:].reshape(2, lm.DIM, lm.DIM)
        h = v[before[:, 0]] @ m[0] + v[before[:, 1]] @ m[1]
        at = lambda s: 1 / (1 + np.exp(-s))
        yes = (h * v[w]).sum(1) + bias[w] - share[w] - np.log(lm.RATIO)
        no = h @ v[noise].T + bias[noise] - share[noise] - np.log(lm.RATIO)
        return (np.log(at(yes)).sum() + lm.RATIO / lm.NOISE * np.log(1 - at(no)).sum())

    trainer = lm.Trainer(model, share, 7)
    trainer.step(before, w)
    flat, moved = model.flat().astype(np.float64), trainer.m.flat() - model.flat()
    grad = np.zeros_like(flat)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        grad[i] = (loss(flat + e) - loss(flat - e)) / 2e-5
    want = lm.RATE * grad / np.sqrt(1 + grad * grad)
    assert np.abs(moved - want).max() < 1e-3


def test_it_learns_which_words_follow(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{(a := rng.integers(0, 30))} after{a}" for _ in range(40))
    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(2)
    out = lm.digests(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > 0.85 * out["sum(base_score)"]  # both negative


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    out = lm.digests(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.digests(docs).collect() == []
    alone = next(i for i in range(1000) if held_out(i))
    (r,) = lm.digests(spark.createDataFrame([(alone, "some words")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["held_out"]) == (3, 0, 0, 0.0, True)


def test_words_split_at_the_same_characters():
    texts = ["a\x1cb c\x0bd", "x\x85y z w", "", "É İ A"]
    words, n = lm._words(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in tokens(t)] and n.tolist() == [len(tokens(t)) for t in texts]
