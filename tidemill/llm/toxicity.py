"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (with word boundaries, no whole-word
entry), so a misspelt word shares most of its vectors with the word it came from.
The vectors of a passage of ``SPAN`` words are averaged and a linear softmax tells
toxic from clean; vectors and softmax are trained jointly in numpy (Adam).  Each
training passage also counts once with misspelt words, clean ones too, so that an
insult's weight spreads over all its n-grams.  A text's score is the calibrated mean of
its ``TOP`` most toxic passages, so a long text is not diluted by its clean part.

The model is fitted on a bounded sample of labelled rows: at most ``MAX_ROWS`` of
either label, and at most ``MAX_BYTES`` of text in all, taken in the order of a hash of
doc_id, held-out rows never.  Scoring reads every whole text.  As the softmax is linear,
each n-gram bucket needs one number when scoring.

Defined results: null and empty texts have one empty passage and get its score;
without labelled rows of both kinds every score is the prior 0.0; repeated labels of
a document are used once (the largest), and so are repeated rows of it (the smallest
text); a null doc_id is scored, has no label and is in no fold (held_out is false);
other columns pass through ``keep_clean`` and are ignored by ``scores``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.textbatch import mix, slices, utf8

MAX_ROWS = 700
MAX_BYTES = 32 << 20
BUCKETS = 1 << 18
DIM = 8
SPAN = 6
TOP = 2
NGRAMS = (3, 4, 5)
EPOCHS = 30
RATE = 0.3
DECAY = 0.99
PIECE = 20_000
MISSPELT = 0.5  # share of longer words misspelt in the second copy of a training passage
FOLDS = 5

_FOLD = np.zeros(256, np.uint64)
_FOLD[:] = np.arange(256)
_FOLD[65:91] += np.uint64(32)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WORD[[0x40, 0x24, 0x21, 0x2A]] = True  # @ $ ! * stand for letters in disguised words
# Signs that stand for letters in disguised words.
_DISGUISE = {b"a": b"@", b"e": b"3", b"i": b"1", b"l": b"1", b"o": b"0", b"s": b"$", b"t": b"7", b"u": b"*"}


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all words, the words first[r]:first[r + 1] of each row, and the bytes inside words."""
    inside = _WORD[data]
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        cut = off[:-1][off[:-1] < len(data)]
        begin[cut] |= inside[cut]
        last = off[1:][off[1:] > 0] - 1
        stop[last] |= inside[last]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off), inside


def _bags(data: np.ndarray, size: np.ndarray) -> dict[int, np.ndarray]:
    """For each n, the buckets of the n-grams of words that follow one another in data, word by word.

    A word has max(0, size + 3 - n) of them: it stands between two marks.
    """
    found: dict[int, list[np.ndarray]] = {n: [] for n in NGRAMS}
    upto = np.concatenate(([0], np.cumsum(size)))
    for a in range(0, len(size), PIECE):  # words in pieces, so that their codes stay few
        own = size[a : a + PIECE]
        text = data[upto[a] : upto[a + len(own)]]
        place = np.concatenate(([0], np.cumsum(own + 2)))
        flat = np.full(place[-1], ord("<"), np.uint64)
        flat[np.arange(len(text)) + 2 * np.repeat(np.arange(len(own)), own) + 1] = _FOLD[text]
        flat[place[1:] - 1] = ord(">")
        left, code = np.repeat(place[1:], own + 2) - np.arange(len(flat)), flat
        for n in range(2, max(NGRAMS) + 1):
            code = code[:-1] * np.uint64(257) + flat[n - 1 :] if len(code) > 1 else code[:0]
            if n in found:
                ok = left[: len(code)] >= n
                found[n].append((mix(code[ok] + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return {n: np.concatenate(x) if x else np.zeros(0, np.int32) for n, x in found.items()}


@dataclass
class Model:
    """One number for each bucket, and the calibration of a text's features."""

    weight: np.ndarray
    bias: float
    blend: tuple[float, float, float]
    known: bool = True

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean logit of each text's TOP most toxic passages, and of all its passages."""
        s, e, first, inside = _spans(data, off)
        value = self._word_values(data, inside, s, e)
        n = np.diff(first)
        spans = np.maximum(1, -(-n // SPAN))
        lead = np.concatenate(([0], np.cumsum(spans)))
        own = np.repeat(np.arange(len(n)), n)
        where = lead[own] + (np.arange(len(s)) - first[own]) // SPAN
        # The last passage of a text may be short; the rest of it counts as unknown words.
        logit = np.bincount(where, weights=value, minlength=lead[-1]) / SPAN + self.bias
        row = np.repeat(np.arange(len(n)), spans)
        order = np.lexsort((-logit, row))
        best = order[np.arange(len(order)) - lead[row] < TOP]
        top = np.bincount(row[best], weights=logit[best], minlength=len(n)) / np.minimum(spans, TOP)
        return np.stack([top, np.bincount(row, weights=logit, minlength=len(n)) / spans], 1)

    def _word_values(self, data, inside, s, e) -> np.ndarray:
        """Mean weight of each word's n-grams."""
        size = e - s
        place = np.concatenate(([0], np.cumsum(size + 2)))
        flat = np.full(place[-1], ord("<"), np.uint64)
        own = np.repeat(np.arange(len(s)), size)
        flat[np.arange(len(own)) + 2 * own + 1] = _FOLD[data[inside]]
        flat[place[1:] - 1] = ord(">")
        total = np.zeros(len(s))
        code = flat.copy()
        count = np.zeros(len(s), np.int64)
        sums = np.zeros(len(flat) + 1)
        for n in range(2, max(NGRAMS) + 1):
            code = code[:-1] * np.uint64(257) + flat[n - 1 :] if len(code) > 1 else code[:0]
            if n in NGRAMS and len(code):
                got = self.weight[(mix(code + np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64)]
                sums[1 : len(got) + 1] = np.cumsum(got)
                sums[len(got) + 1 :] = sums[len(got)]
                many = np.maximum(size + 3 - n, 0)
                total += np.where(many > 0, sums[np.minimum(place[:-1] + many, len(got))] - sums[place[:-1]], 0.0)
                count += many
        return total / np.maximum(count, 1)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(off) - 1)
        z = self.features(data, off) @ np.array(self.blend[:2]) + self.blend[2]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


class _Vocabulary:
    """Distinct words, in the order of their first use, and misspelt forms of them."""

    def __init__(self, seed: int):
        self.ids: dict[bytes, int] = {}
        self.rng = random.Random(seed)

    def of(self, texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            data, off = _joined([t])
            s, e, _, _ = _spans(data, off)
            raw = _FOLD[data].astype(np.uint8).tobytes()
            out.append([self.ids.setdefault(raw[a:b], len(self.ids)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        return out

    def misspelt(self, words: list[list[int]]) -> list[list[int]]:
        """The same words, a share of the longer ones with one or two random edits."""
        names, rng = list(self.ids), self.rng

        def edit(w: bytes) -> bytes:
            for _ in range(rng.randint(1, 2)):
                i, how = rng.randrange(len(w)), rng.randrange(5)
                if how == 0 and len(w) > 3:
                    w = w[:i] + w[i + 1 :]
                elif how == 1:
                    w = w[: i + 1] + w[i:]
                elif how == 2 and i + 1 < len(w):
                    w = w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]
                elif how == 3:
                    w = w[:i] + _DISGUISE.get(w[i : i + 1], w[i : i + 1]) + w[i + 1 :]
                else:
                    w = w[:i] + bytes([rng.randrange(97, 123)]) + w[i + 1 :]
            return w

        return [[w if len(names[w]) < 4 or rng.random() > MISSPELT else self.ids.setdefault(edit(names[w]), len(self.ids)) for w in row] for row in words]

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(self.ids), np.uint8), np.fromiter(map(len, self.ids), np.int64, len(self.ids))


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fits vectors and softmax together on passages, then calibrates whole texts."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0, 0.0), known=False)
    vocabulary = _Vocabulary(seed)
    rows = vocabulary.of(texts)
    rows += vocabulary.misspelt(rows)
    labels2 = np.concatenate([y, y])
    letters, size = vocabulary.bytes()
    m = len(size)
    bags = _bags(letters, size)
    many = {k: np.maximum(size + 3 - k, 0) for k in NGRAMS}
    seen = np.zeros(BUCKETS, bool)
    for x in bags.values():
        seen[x] = True
    used = np.flatnonzero(seen)
    local = np.zeros(BUCKETS, np.int32)
    local[used] = np.arange(len(used), dtype=np.int32)
    bags = {k: local[x] for k, x in bags.items()}
    lead = {k: np.concatenate(([0], np.cumsum(x))) for k, x in many.items()}
    size = np.maximum(sum(many.values()), 1)[:, None].astype(np.float32)
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    first = np.concatenate(([0], np.cumsum(n)))
    each = np.fromiter((w for r in rows for w in r), np.int32, first[-1])
    row = np.repeat(np.arange(len(n)), n)
    spans = np.maximum(1, -(-n // SPAN))
    base = np.concatenate(([0], np.cumsum(spans)))
    pos = np.arange(len(row)) - first[row]
    grid = np.full((base[-1], SPAN), m, np.int32)
    grid[base[row] + pos // SPAN, pos % SPAN] = each
    target = labels2[np.repeat(np.arange(len(n)), spans)].astype(np.float32)
    del rows, each, row, pos
    weigh = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(seed))
    E = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    V = rng.normal(0, 1.0, DIM).astype(np.float32)
    c = np.float32(0)
    mE, vE, mV, vV, mc, vc = np.zeros_like(E), np.zeros_like(E), np.zeros_like(V), np.zeros_like(V), 0.0, 0.0
    has = {k: np.flatnonzero(x) for k, x in many.items()}
    for step in range(1, epochs + 1):
        W = np.zeros((m + 1, DIM), np.float32)
        for k in NGRAMS:
            for a in range(0, len(has[k]), PIECE):  # words in pieces, so that gathered vectors stay few
                own = has[k][a : a + PIECE]
                low, high = lead[k][own[0]], lead[k][own[-1] + 1]
                W[own] += np.add.reduceat(E[bags[k][low:high]], lead[k][own] - low, axis=0)
        W[:-1] /= size
        H = np.zeros((len(grid), DIM), np.float32)
        for k in range(SPAN):
            H += W[grid[:, k]]
        H /= SPAN
        z = H @ V + c
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weigh
        gV, gc = H.T @ g, g.sum()
        # The gradient of a word's vector is a number times V, and so is that of a bucket's.
        gw = sum(np.bincount(grid[:, k], weights=g, minlength=m + 1) for k in range(SPAN))[:-1] / (SPAN * size[:, 0])
        gE = (sum(np.bincount(bags[k], weights=np.repeat(gw, many[k]), minlength=len(used)) for k in NGRAMS)[:, None] * V).astype(np.float32)
        for p, grad, mean, v in ((E, gE, mE, vE), (V, gV, mV, vV)):
            mean += 0.1 * (grad - mean)
            v += 0.01 * (grad * grad - v)
            p -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        mc += 0.1 * (gc - mc)
        vc += 0.01 * (gc * gc - vc)
        c -= RATE * (mc / (1 - 0.9**step)) / (np.sqrt(vc / (1 - 0.99**step)) + 1e-6)
        E *= np.float32(DECAY)
    weight = np.zeros(BUCKETS)
    weight[used] = E @ V
    model = Model(weight, float(c), (1.0, 0.0, 0.0))
    x = np.concatenate([model.features(*_joined([t])) for t in texts])
    mid, wide = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([(x - mid) / wide, np.ones(len(x))])
    k, ridge = np.zeros(3), np.diag([1.0, 1.0, 1e-6])
    for _ in range(40):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ k, -30, 30)))
        k -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ k), -2, 2)
    slope = k[:2] / wide
    model.blend = (float(slope[0]), float(slope[1]), float(k[2] - slope @ mid))
    return model


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; 0 is held out; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from at most max_rows rows of either label and max_bytes of text, none of them held out."""
    train_rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = train_rows.where("__y = 1").orderBy(*order).limit(max_rows).unionByName(train_rows.where("__y = 0").orderBy(*order).limit(max_rows))
    # At most 2 * max_rows ids: a proven bound, so the documents are filtered where they are.
    ids = {r[0]: int(r[1]) for r in some.select(F.col("doc_id").cast("string"), "__y").collect()}

    def chosen(keys: list[str]) -> DataFrame:
        few = docs.sparkSession.createDataFrame([(k,) for k in keys], "id string")
        rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        return rows.join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"))

    if not ids:
        return train([], [])
    sizes = {r[0]: r[1] for r in chosen(list(ids)).select("id", F.octet_length("text")).collect()}
    kept, room = [], {0: max_bytes // 2, 1: max_bytes // 2}
    for k, y in ids.items():
        if k in sizes and sizes[k] <= room[y]:
            room[y] -= sizes[k]
            kept.append(k)
    if not kept:
        return train([], [])
    rows = sorted((r[0], r[1]) for r in chosen(kept).collect())
    return train([t for _, t in rows], [ids[k] for k, _ in rows])


def score(model: Model, text: str = "text") -> Column:
    """The score of a text column; only that column goes to Python."""
    sent = SparkSession.active().sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in batches:
            parts = slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t", 1 << 20)
            found = [m.scores(*utf8(part.column(0))) for part in parts]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return run(F.coalesce(F.col(text), F.lit("")))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    return docs.select("doc_id", score(model).alias("score"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, unchanged."""
    return docs.where(score(model) < limit)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of each document, with the fold it belongs to."""
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
