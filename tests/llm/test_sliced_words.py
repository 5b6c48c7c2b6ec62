"""Words of record batches that are cut into slices."""

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


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [lm.END]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("hole", ["", None])
def test_words_of_slices(kind, hole):
    texts = [f"A b{i} É\x0b{'Z' * i} " for i in range(20)] + [hole, "last One"]
    for at, to in [(0, 22), (7, 3), (19, 3), (20, 1), (21, 1), (5, 0)]:
        words, n = lm._words(pa.array(texts, kind).slice(at, to))
        want = [tokens(t) for t in texts[at : at + to]]
        assert words.to_pylist() == [w for t in want for w in t] and n.tolist() == [len(t) for t in want]


def test_one_partition_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 200)
    texts = {i: f"Word w{i % 7} The tale " * (i % 5) + f"only{i}" for i in range(200)}
    got = lm.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    n = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    total, kinds = sum(n.values()), len(n)
    assert len(got) == len(texts)
    for r in got:
        words = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(n[w] > 0 for w in words), total)
        assert abs(r["base_score"] - sum(math.log10((n[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)) < 1e-9


@pytest.mark.parametrize("scale", [0.3, 4.0])
def test_norms_of_all_pairs_equal_direct_ones(scale):
    rng = np.random.default_rng(3)
    size = 60
    model = lm.Model(rng.normal(0, scale, (size + 1, lm.DIM)).astype(np.float32), rng.normal(-3, 1, size).astype(np.float32), rng.normal(0, 0.4, (2, lm.DIM, lm.DIM)).astype(np.float32))
    before, w = np.stack(np.meshgrid(np.arange(size + 1), np.arange(size + 1)), -1).reshape(-1, 2), rng.integers(0, size, (size + 1) ** 2)
    v, m = model.vectors.astype(np.float64), model.places.astype(np.float64)
    z = (v[before[:, 0]] @ m[0] + v[before[:, 1]] @ m[1]) @ v[:-1].T + model.bias
    want = z[np.arange(len(w)), w] - z.max(1) - np.log(np.exp(z - z.max(1)[:, None]).sum(1))
    few = model.log_probabilities(before[:50], w[:50])
    assert model.table is None
    got = model.log_probabilities(before, w)
    assert model.table is not None and np.isnan(model.table).any() == (scale > 1)
    near = 1e-5 * (1 + np.abs(z).max(1))  # vectors have 32 bits
    assert (np.abs(got - want) < near).all() and (np.abs(few - want[:50]) < near[:50]).all()
