"""Token alignment against a plain version: every pair of tokens is compared."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import tables, token_alignment
from tidemill.llm.bytemap import byte_symbols
from tidemill.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "  ", "a", "a ", "a  ", "  a", "<0x41> <s> </s> <unk>", "<|endoftext|> x", "▁", "x ▁y", "don't we'll  do\n\n it ", "日本語 テキスト", "é é", "\n", " \n ", "no break   spaces", "nul\x00byte", "x" * 3000, "ab " * 2000]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def plain(text, tokenizers):
    """(ids of A, ids of B, groups, links) of a text, by the bytes of each token."""
    a, b = tokenizers
    if not text:
        return [], [], "", []
    byte = {c: i for i, c in enumerate(byte_symbols())}
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], []
    for i in ids[1]:
        p = b.id_to_piece(i)
        spelt[1].append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return [], [], "", []
    spans = []
    for s in spelt:
        at, out = 0, []
        for token in s:
            out.append((at, at + len(token)))
            at += len(token)
        spans.append(out)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, last = [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids[k], spans[k]) if last <= s and e <= c) for k in (0, 1)))
        last = c
    near = lambda s, e: (j for j in range(len(ids[1])) if spans[1][j][0] < e and s < spans[1][j][1])
    return *ids, ";".join(groups), [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j in near(s, e)]


def corpus(texts, tokenizers):
    rows = [plain(t, tokenizers) for t in texts]
    n = Counter(p for r in rows for p in set(r[3]))
    best = defaultdict(int)
    for (a, _), c in n.items():
        best[a] = max(best[a], c)
    return [(len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, g, links in rows]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    letters = list("abz é\n\t'sdi ll 12.,; ▁üß€—日本<>|")
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    some = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").select("text").limit(60).collect()]
    return ODD + made + some + ["a", "don't  do"]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_digests_equal_the_plain_version(spark, texts, tokenizers):
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, row int, `a.b` int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_alignment.digests(docs, tokenizer_path(A), tokenizer_path(B)).collect()}
    assert [got[i] for i in range(len(texts))] == corpus(texts, tokenizers)


def test_groups_are_the_plain_ones(spark, texts, tokenizers):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_alignment.align(docs, tokenizer_path(A), tokenizer_path(B)).collect()
    assert {r["doc_id"]: r["groups"] for r in rows} == {i: plain(t, tokenizers)[2] for i, t in enumerate(texts)}
    assert {r["doc_id"]: dict(zip(r["pairs"], r["times"])) for r in rows} == {i: dict(Counter(a * 32000 + b for a, b in plain(t, tokenizers)[3])) for i, t in enumerate(texts)}


def test_repeated_rows_null_ids_and_an_empty_table(spark, tokenizers):
    texts = ["one two", "one two", "two", None]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id string, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in token_alignment.digests(docs, tokenizer_path(A), tokenizer_path(B)).collect())
    assert got == sorted(corpus(texts, tokenizers))
    assert token_alignment.digests(docs.limit(0), tokenizer_path(A), tokenizer_path(B)).collect() == []


def test_counts_beyond_the_broadcast_bound_are_joined(spark):
    facts = spark.range(1, 400).select("id", F.expr("1 + id % 37 + IF(id < 3, 900, 0)").alias("n"))
    rows = spark.range(0, 5000).select(F.expr("id % 450").alias("id"), F.col("id").alias("place"))
    want = {(p, p % 450): n for p, n in ((r["place"], r["n"]) for r in rows.join(facts, "id", "left").collect())}
    for most in (1000, 100, 1, 0):
        got = tables.looked_up(rows, facts, "id", "n", most).collect()
        assert len(got) == 5000 and {(r["place"], r["id"]): r["n"] for r in got} == want
