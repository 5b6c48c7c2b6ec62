"""Sampled segmentations against the whole lattice of short texts: every segmentation comes as often as its weight says."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tidemill.llm import sentencepiece_sampling as sp
from tidemill.llm.queries import tokenizer_path

MODEL, N = tokenizer_path("piece_bpe_32k.model"), 4000


def lattice(text: str, lat: sp.Lattice) -> dict[tuple[int, ...], float]:
    """Probability of every segmentation of a space and the text; signs without a piece are bytes."""
    whole = " " + text

    def ways(at: int):
        if at == len(whole):
            yield (), 1.0
            return
        single = whole[at] in lat.piece
        for end in range(at + 1, len(whole) + 1) if single else ():
            if whole[at:end] in lat.piece:
                i, w = lat.piece[whole[at:end]]
                for rest, r in ways(end):
                    yield (i, *rest), w * r
        if not single:
            own = tuple(int(lat.byte_id[b]) for b in whole[at].encode())
            for rest, r in ways(at + 1):
                yield (*own, *rest), r

    found: Counter = Counter()
    for ids, w in ways(0):
        found[ids] += w
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


@pytest.mark.parametrize("sharpness", [1.0, 0.3])
@pytest.mark.parametrize("text", ["ab", "the cat", "a  b", "don't", "x\ny", "né 日", "▁a"])
def test_frequencies_follow_the_lattice(text, sharpness):
    lat = sp.lattice_of(MODEL, sharpness)
    want = lattice(text, lat)
    keys = np.random.default_rng(len(text)).integers(0, 1 << 63, N, dtype=np.uint64)
    ids, ends = sp.encode(lat, [text] * N, keys, 5)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    assert set(got) <= set(want)
    for k, p in want.items():
        assert abs(got[k] / N - p) < 5 * (p * (1 - p) / N) ** 0.5 + 1 / N
    for k in list(got)[:50]:
        assert sp.decode(MODEL, list(k)) == text


def test_rows_of_a_table_follow_the_same_lattice(spark):
    docs = spark.range(N).selectExpr("id AS doc_id", "'ab' AS text", "1 AS ids", "2 AS `a.b`").repartition(3)
    want = lattice("ab", sp.lattice_of(MODEL))
    rows = sp.sample(docs, MODEL, seed=9).collect()
    got = Counter(tuple(r["ids"]) for r in rows)
    assert all(r["lossless"] for r in rows) and all(abs(got[k] / N - p) < 5 * (p * (1 - p) / N) ** 0.5 + 1 / N for k, p in want.items())


def test_empty_table(spark):
    assert sp.sample(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
