"""Language-model scores of whole texts: a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token a text.

counts    every word of the training documents is counted by Spark with map-side sums
model     the most frequent words (``WORDS`` of them), the end and one symbol for all other
          words have a vector each; the two words before a token predict its vector through a
          matrix for each place, and the product with a word's vector and a bias is its score
training  in ``ROUNDS`` rounds; a round takes the training documents of its own share, each
          task steps through its texts in numpy from the round's common start, and Spark
          averages the parameters, weighted by tokens.  Every training document is read by
          exactly one round
scores    are normalised to log-probabilities that sum to one: the sums over all symbols after
          every two symbols are a product of two matrices, made once for each worker (for few
          contexts they are taken directly).  A word
          without a vector shares the probability of "all other words" by its count, unseen
          words together as one word

Frequent words (``HOT`` of at most ``HOT_BYTES`` bytes each) are broadcast with their counts;
all other words of a document meet their counts in a shuffle join.

Defined results: null and empty texts are one end token; repeated rows and shared ids are
separate rows; a null id is never held out; other columns are ignored.  Without training
documents every base score is 0, and the model is even over the end and all other words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemill.llm.tables import stored
from tidemill.llm.textbatch import slices

FOLDS = 10
WORDS, DIM, PLACES = 4096, 32, 2
ROUNDS, BATCH, NOISE, RATIO, RATE = 3, 1024, 32, 16.0, 0.1
HOT, HOT_BYTES = 200_000, 64
PIECE_BYTES = 4 << 20
END = "\n"  # no word holds white space
ADD = 0.1


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, each text's followed by END, and how many each text has, END included."""
    # Lowered before the cast: Arrow reads the wrong bytes of a slice that was cast to large strings.
    cells = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    flat, row = cells.flatten(), pc.list_parent_indices(cells).to_numpy()
    real = pc.not_equal(flat, "")
    flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
    n = np.bincount(row, minlength=len(texts))
    # END follows the words of each text.
    place = np.arange(len(row)) + row
    take = np.full(len(row) + len(texts), len(row), np.int64)
    take[place] = np.arange(len(row))
    return pa.concat_arrays([flat, pa.array([END], pa.large_string())]).take(pa.array(take)), n + 1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows, END among the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[0], PIECE_BYTES):
                found = pc.value_counts(_words(part.column(0))[0])
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Numbers:
    """Totals of the training tokens and the frequent words with their counts."""

    total: int  # N
    kinds: int  # V
    hot: pa.Array
    hot_n: np.ndarray
    vocabulary: int  # the first so many of hot have a vector
    rest: int  # tokens without a vector
    rest_kinds: int

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADD) / (self.total + ADD * (self.kinds + 1)))

    def share(self, n: np.ndarray) -> np.ndarray:
        """log10 of a word's part of the probability of all words without a vector."""
        return np.log10((n + ADD) / (self.rest + ADD * (self.rest_kinds + 1)))


def numbers(counts: DataFrame, words: int = WORDS, hot: int = HOT) -> Numbers:
    """The bounded part of the counts that is sent to the tasks: words of at most ``HOT_BYTES`` bytes from a
    count on, the lowest one (in steps of a sixteenth of a power of two) that at most ``hot`` words reach.
    """
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    short = counts.where((F.octet_length("word") <= HOT_BYTES) & (F.col("word") != END))
    levels = sorted(((r[0], r[1]) for r in short.groupBy(step).count().collect()), reverse=True)  # at most 1024 rows
    reached = np.cumsum([n for _, n in levels]) if levels else np.zeros(0, np.int64)
    held = int(np.searchsorted(reached, hot, "right"))
    top = short.where(step >= (levels[held - 1][0] if held else 1 << 20)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    end = counts.where(F.col("word") == END).first()
    names = pa.concat_arrays([pa.array([END]), top["word"].combine_chunks().cast(pa.string())]) if len(top) else pa.array([END])
    n = np.concatenate(([end["n"] if end else 0], top["n"].to_numpy() if len(top) else np.zeros(0, np.int64))).astype(np.int64)
    size = min(words + 1, len(n))
    inside = n[:size]
    return Numbers(total, kinds, names, n, size, int(total - inside.sum()), int(kinds - (inside > 0).sum()))


@dataclass
class Model:
    """Vectors of END, the words and all other words; a start vector follows them.

    Symbols: 0 is END, 1 ... size - 2 are words, size - 1 stands for all others and size for the start.
    """

    vectors: np.ndarray  # (size + 1, DIM)
    bias: np.ndarray  # (size,)
    places: np.ndarray  # (PLACES, DIM, DIM)
    table: np.ndarray | None = None  # norms of all pairs before, made by the tasks that need many

    @property
    def size(self) -> int:
        return len(self.bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.vectors.ravel(), self.bias, self.places.ravel()])

    def filled(self, values: np.ndarray) -> Model:
        a, b = self.vectors.size, self.vectors.size + self.size
        v = values.astype(np.float32)
        return Model(v[:a].reshape(self.vectors.shape), v[a:b], v[b:].reshape(self.places.shape))

    def heads(self) -> np.ndarray:
        """What each symbol at each place adds to the predicted vector."""
        return np.einsum("md,pde->pme", self.vectors, self.places)

    def _norm(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the sum over all symbols after each pair of symbols before."""
        adds, targets = self.heads(), self.vectors[:-1].T
        out = np.empty(len(one), np.float64)
        for low in range(0, len(one), 512):
            at = slice(low, low + 512)
            z = (adds[0][one[at]] + adds[1][two[at]]) @ targets + self.bias
            most = z.max(1)
            out[at] = most + np.log(np.exp(z - most[:, None]).sum(1))
        return out

    def _table(self) -> np.ndarray:
        """_norm of all pairs: exp(a + b) is exp(a) exp(b), so the sums are one product of matrices; nan where 32 bits are too few."""
        adds, targets, n = self.heads(), self.vectors[:-1].T, self.size + 1
        out = np.empty((n, n), np.float32)
        for b in range(0, n, 1024):
            far = adds[1][b : b + 1024] @ targets
            most = far.max(1)
            far = np.exp(far - most[:, None]).T
            for a in range(0, n, 512):
                near = adds[0][a : a + 512] @ targets + self.bias
                top = near.max(1)
                sums = np.exp(near - top[:, None]) @ far
                out[a : a + 512, b : b + 1024] = np.log(np.where(sums > 1e-20, sums, np.nan)) + top[:, None] + most
        return out

    def log_probabilities(self, before: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol after its two symbols before (nearest first)."""
        one, two = before[:, 0], before[:, 1]
        if self.table is None:
            different, each = np.unique(one * (self.size + 1) + two, return_inverse=True)
            if len(different) > 8 * self.size:
                self.table = self._table()  # stays with the broadcast model for later tasks of the worker
            else:
                norm = self._norm(different // (self.size + 1), different % (self.size + 1))[each]
        if self.table is not None:
            norm = self.table[one, two].astype(np.float64)
            lost = np.flatnonzero(np.isnan(norm))
            norm[lost] = self._norm(one[lost], two[lost])
        adds = self.heads()
        out = -norm
        for low in range(0, len(out), 1 << 15):
            at = slice(low, low + (1 << 15))
            out[at] += np.einsum("nd,nd->n", adds[0][one[at]] + adds[1][two[at]], self.vectors[symbols[at]]) + self.bias[symbols[at]]
        return out


def start(known: Numbers, seed: int = 12) -> Model:
    """Small vectors, and biases that alone give each symbol its share of the training tokens."""
    n = np.append(known.hot_n[: known.vocabulary], known.rest) + ADD
    rng = np.random.Generator(np.random.PCG64(seed))
    near = np.eye(DIM, dtype=np.float32) / PLACES
    return Model(rng.normal(0, 0.1, (len(n) + 1, DIM)).astype(np.float32), np.log(n / n.sum()).astype(np.float32), np.stack([near] * PLACES))


def _symbols(place: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of tokens from their places among the frequent words, and the two symbols before each."""
    ids = np.where((place >= 0) & (place < size - 1), place, size - 1)
    first = np.cumsum(n) - n
    at = np.arange(len(ids)) - np.repeat(first, n)
    one = np.concatenate(([size], ids[:-1]))
    two = np.concatenate(([size, size], ids[:-2])) if len(ids) > 1 else np.full(len(ids), size)
    return ids, np.column_stack([np.where(at >= 1, one, size), np.where(at >= 2, two, size)])


class Trainer:
    """Noise-contrastive steps (AdaGrad) on a copy of a model; noise is drawn from the symbols' shares."""

    def __init__(self, model: Model, log_share: np.ndarray, seed: int):
        self.m = Model(model.vectors.copy(), model.bias.copy(), model.places.copy())
        self.log_share = log_share.astype(np.float32)
        self.cumulated = np.cumsum(np.exp(log_share.astype(np.float64)))
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.seen = [np.ones_like(x) for x in (self.m.vectors, self.m.bias, self.m.places)]
        self.tokens = 0

    def _sum(self, ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        flat = (ids[:, None] * DIM + np.arange(DIM)).ravel()
        return np.bincount(flat, weights=rows.ravel(), minlength=size * DIM).reshape(size, DIM)

    def step(self, before: np.ndarray, w: np.ndarray) -> None:
        m, size = self.m, self.m.size
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE) * self.cumulated[-1], "right"), size - 1)
        contexts = [m.vectors[before[:, p]] for p in range(PLACES)]
        h = sum(contexts[p] @ m.places[p] for p in range(PLACES))
        target, other = m.vectors[w], m.vectors[noise]
        shift = np.float32(np.log(RATIO))
        yes = np.einsum("bd,bd->b", h, target) + m.bias[w] - self.log_share[w] - shift
        no = h @ other.T + (m.bias[noise] - self.log_share[noise] - shift)
        up = 1 / (1 + np.exp(np.clip(yes, -30, 30)))
        down = -(RATIO / NOISE) / (1 + np.exp(-np.clip(no, -30, 30)))
        dh = up[:, None] * target + down @ other
        ids = np.concatenate([w, noise, *(before[:, p] for p in range(PLACES))])
        rows = np.concatenate([up[:, None] * h, down.T @ h, *(dh @ m.places[p].T for p in range(PLACES))])
        grads = (
            self._sum(ids, rows, size + 1),
            np.bincount(ids[: len(w) + NOISE], weights=np.concatenate([up, down.sum(0)]), minlength=size),
            np.stack([contexts[p].T @ dh for p in range(PLACES)]),
        )
        for param, grad, seen in zip((m.vectors, m.bias, m.places), grads, self.seen, strict=True):
            g = grad.astype(np.float32)
            seen += g * g
            param += RATE * g / np.sqrt(seen)
        self.tokens += len(w)


def fit(docs: DataFrame, known: Numbers, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> Model:
    """The averaged model after all rounds over docs; parameters (a fixed number of them) come back to the driver."""
    model = start(known)
    share = model.bias.copy()
    sc = docs.sparkSession.sparkContext
    part = F.pmod(F.xxhash64(F.lit("round"), f"`{key}`", F.octet_length(f"`{text}`")), F.lit(rounds))
    for turn in range(rounds):
        sent = sc.broadcast((model, share, known.hot[: known.vocabulary]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            begin, share, names = sent.value
            trainer = Trainer(begin, share, 1000 * turn + TaskContext.get().partitionId())
            for batch in batches:
                for piece in slices(batch, batch.schema.names[0], PIECE_BYTES):
                    words, n = _words(piece.column(0))
                    cells = words.dictionary_encode()
                    kinds = pc.fill_null(pc.index_in(cells.dictionary, names.cast(pa.large_string())), -1).to_numpy()
                    ids, before = _symbols(kinds[cells.indices.to_numpy()], n, begin.size)
                    for low in range(0, len(ids), BATCH):
                        trainer.step(before[low : low + BATCH], ids[low : low + BATCH])
            if trainer.tokens:
                values = trainer.m.flat()
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens]), pa.array([values.tolist()], pa.list_(pa.float32()))], ["tokens", "vals"])

        found = docs.where(part == turn).select(F.col(f"`{text}`")).mapInArrow(run, "tokens long, vals array<float>")
        each = found.select("tokens", F.posexplode("vals").alias("at", "v")).groupBy("at").agg((F.sum(F.col("v").cast("double") * F.col("tokens")) / F.sum("tokens")).alias("v"))
        mean = stored(each.select("at", F.round("v", 5).alias("v")), "parameters").toArrow()
        sent.unpersist()
        if mean.num_rows:
            values = np.empty(mean.num_rows)
            values[mean["at"].to_numpy()] = mean["v"].to_numpy()
            model = model.filled(values)
    return model


def scores(docs: DataFrame, model: Model, known: Numbers, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score and score (log10) of every row of docs."""
    kind = docs.schema[key].dataType
    out = StructType([StructField(key, kind)] + StructType.fromDDL("row long, n_tokens long, hot_known long, hot_base double, hot_score double, words array<string>, times array<int>").fields)
    sent = docs.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = sent.value
        hot = k.hot.cast(pa.large_string())
        base, share = k.base(k.hot_n), k.share(k.hot_n)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, batch.schema.names[1], PIECE_BYTES):
                words, n = _words(part.column(1))
                cells = words.dictionary_encode()
                at = cells.indices.to_numpy()
                kinds = pc.fill_null(pc.index_in(cells.dictionary, hot), -1).to_numpy()
                place, rows = kinds[at], np.repeat(np.arange(len(n)), n)
                ids, before = _symbols(place, n, m.size)
                value = m.log_probabilities(before, ids) / np.log(10)
                seen = place >= 0
                value[seen & (ids == m.size - 1)] += share[place[seen & (ids == m.size - 1)]]
                sums = [np.bincount(rows, weights=x, minlength=len(n)) for x in (seen & (k.hot_n[place] > 0), np.where(seen, base[place], 0.0), value)]
                # Words to look up: the different ones of each row with how often they stand.
                code, times = np.unique(rows[~seen] * len(cells.dictionary) + at[~seen], return_counts=True)
                edge = pa.array(np.searchsorted(code // len(cells.dictionary), np.arange(len(n) + 1)).astype(np.int32))
                rare = cells.dictionary.cast(pa.string()).take(pa.array(code % len(cells.dictionary)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + len(n))), pa.array(n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(edge, rare), pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32)))],
                    out.names,
                )
                row += len(n)

    each = stored(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, out), "scored", "zstd")
    rare = each.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    per = lambda total, kinds: F.col("times") * F.log10((n + ADD) / (total + ADD * (kinds + 1)))
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(per(known.total, known.kinds)).alias("base"), F.sum(per(known.rest, known.rest_kinds)).alias("share")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.join(sums, "row", "left").select(
        F.col(f"`{key}`"), "n_tokens", (F.col("hot_known") + zero("known")).alias("n_known"), (F.col("hot_base") + zero("base")).alias("base_score"), (F.col("hot_score") + zero("share")).alias("score")
    )


def digests(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    train = docs.where(fold() != 0)
    counts = stored(word_counts(train), "words")
    known = numbers(counts)
    out = scores(docs, fit(train, known), known, counts)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")
