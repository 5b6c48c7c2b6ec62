"""Substring dedup with repeated-phrase automata.

A passage is a window of ``SPAN`` words; the later copies of a passage go, the first
(smallest doc_id) stays.

1. Exact copies of a whole text are told apart by a 128-bit hash; only the first of
   each class goes on.
2. Winnowing: each window is named by the smallest hash of its phrases of ``K`` words,
   so two equal windows have equal names.  Names seen in two documents recur.
3. Documents are dealt to shards of about ``SHARD_BYTES``.  In each shard, windows
   with a recurring name are hashed and one representative of each is emitted.  An
   aggregation over all shards confirms the recurring ones and finds their first
   document; each shard gets back those that occur in it.
4. Each shard compiles an Aho-Corasick automaton of phrases of its confirmed passages
   (one phrase in SPAN - K + 1 words is enough to meet each window) and streams all
   its documents through it.  A hit is extended word by word on both sides.

No step gathers a group that grows with the number of copies: names, windows and
representatives are merged before each shuffle.

Defined results: null and empty texts have no words and lose none; rows that repeat a
doc_id are one document for the order and are each reduced by what smaller ids hold; a
passage repeated within one document only stays; rows with a null doc_id come before
and after no other, so they lose nothing and cost no other row a word; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tables import discard, few, first_of_copies, stored
from tidemill.llm.textbatch import Words, mix, segment_hash, slices, texts_of, utf8, words_of

SPAN, K = 50, 25
SHARD_BYTES = 4 << 20
MAX_TASKS = 4000  # of a shuffle, however many shards there are: a task takes its shards one after the other
_CODES = 1_100_000  # characters that stand for words; hits are verified, so words may share one


def _names(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start word and name of every window: the smallest of its phrases' hashes."""
    at = np.flatnonzero(w.left() >= K)
    phrase = np.full(len(w.starts) + SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    phrase[at] = segment_hash(w.hash, at, at + K)
    least, reach, need = phrase, 1, SPAN - K + 1
    while 2 * reach <= need:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (need - reach)], least[need - reach :])
    start = np.flatnonzero(w.left() >= SPAN)
    return start, least[start]


def _emit_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(part)
            start, name = _names(w)
            row = w.row()[start]
            change = np.ones(len(row), bool)
            change[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])  # the name stays for a while
            row, name = row[change], name[change]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["h", "doc_id", "s"])


def _one_by_one(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """work for one shard after the other, over batches sorted by their second column, the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            shard = b.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True) if len(cuts) else ():
                if held and shard[low] != now:
                    yield from work(iter(held))
                    held = []
                now = shard[low]
                held.append(b.slice(low, high - low))
        if held:
            yield from work(iter(held))

    return run


def _second(h: np.ndarray) -> np.ndarray:
    """An independent hash of each word, for a second hash of windows."""
    return mix(h ^ np.uint64(0xA0761D6478BD642F))


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One representative of each window with a recurring name, for the shard of each row."""
    names, docs = [], []
    for b in batches:
        h = b.column(3)
        names.append(h.drop_null().to_numpy(zero_copy_only=False))
        docs.append(b.filter(h.is_null()))
    known = np.unique(np.concatenate(names) if names else np.zeros(0, np.int64)).view(np.uint64)
    known.sort()
    found: list[tuple] = []
    for b in docs:
        for part in slices(b) if len(known) else ():
            w = words_of(part)
            start, name = _names(w)
            i = np.minimum(np.searchsorted(known, name), len(known) - 1)
            start = start[known[i] == name]
            if not len(start):
                continue
            row = w.row()[start]
            one = segment_hash(w.hash, start, start + SPAN)
            two = segment_hash(_second(w.hash), start, start + SPAN)
            doc, shard = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
            found.append((one, two, doc, shard, start - w.first[row]))
    if not found:
        return
    one, two, doc, shard, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, doc, one, shard))
    one, two, doc, shard, start = one[order], two[order], doc[order], shard[order], start[order]
    lead = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (shard[1:] != shard[:-1]))))
    last = np.maximum.reduceat(doc, lead)
    step = 1 << 16
    for a in range(0, len(lead), step):
        k = lead[a : a + step]
        yield pa.RecordBatch.from_arrays([pa.array(one[k].view(np.int64)), pa.array((two[k] >> np.uint64(33)).astype(np.int32)), pa.array(shard[k]), pa.array(doc[k]), pa.array(start[k].astype(np.int32)), pa.array(last[a : a + step])], ["w", "v", "s", "doc_id", "start", "last"])


class Shard:
    """All documents of a shard and the automaton of its confirmed passages."""

    def __init__(self, docs: list[pa.RecordBatch], phrases: list[np.ndarray]):
        self.ids = np.concatenate([b.column(0).to_numpy() for b in docs]) if docs else np.zeros(0, np.int64)
        hashes, counts = [], []
        for b in docs:
            for part in slices(b):
                w = words_of(part)
                hashes.append(w.hash)
                counts.append(w.n)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        self.cover = np.zeros(len(self.hash) + 1, np.int32)
        doc, start, owner, window = (np.concatenate(x) for x in zip(*phrases, strict=True)) if phrases else (np.zeros(0, np.int64),) * 4
        if len(doc):
            self._locate(doc, start, owner, window.view(np.uint64))

    def _locate(self, doc: np.ndarray, start: np.ndarray, owner: np.ndarray, window: np.ndarray) -> None:
        by_id = np.argsort(self.ids, kind="stable")
        nth = np.searchsorted(self.ids, doc, sorter=by_id)
        begin, todo = np.full(len(doc), -1), np.arange(len(doc))
        while len(todo):  # rows may share a doc_id: the window tells which one is meant
            row = by_id[nth[todo]]
            fits = self.n[row] - start[todo] >= SPAN
            at = self.first[row[fits]] + start[todo[fits]]
            right = segment_hash(self.hash, at, at + SPAN) == window[todo[fits]]
            begin[todo[fits][right]] = at[right]
            todo = todo[begin[todo] < 0]
            nth[todo] += 1
            todo = todo[nth[todo] < len(by_id)]
            todo = todo[self.ids[by_id[nth[todo]]] == doc[todo]]
        order = np.argsort(begin, kind="stable")[np.count_nonzero(begin < 0) :]
        begin, self.owner = begin[order], owner[order]
        runs = np.flatnonzero(np.concatenate(([True], begin[1:] != begin[:-1] + 1)))
        _, code = np.unique(self.hash, return_inverse=True)
        code = code % _CODES + 1
        code = np.where(code >= 0xD800, code + 0x800, code).astype("<u4")
        text = lambda a, b: code[a:b].tobytes().decode("utf-32-le")
        patterns: dict[str, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(begin)], strict=True):
            low, high = int(begin[a]), int(begin[b - 1])
            p = low - 1
            while p < high:
                p = min(p + SPAN - K + 1, high + SPAN - K)
                patterns.setdefault(text(p, p + K), []).append((p, low, high, a))
        automaton = ahocorasick.Automaton()
        for phrase, places in patterns.items():
            automaton.add_word(phrase, places)
        automaton.make_automaton()
        for r in np.flatnonzero(self.n >= SPAN).tolist():
            a, b = int(self.first[r]), int(self.first[r + 1])
            own = int(self.ids[r])
            for end, places in automaton.iter(text(a, b)):
                q = a + end - K + 1
                for place in places:
                    self._extend(q, a, b, own, *place)

    def _extend(self, q: int, a: int, b: int, own: int, p: int, low: int, high: int, run: int) -> None:
        """Covers the windows around the phrase at q that are windows of the passage around p."""
        h, reach = self.hash, SPAN - K
        if q != p and not np.array_equal(h[q : q + K], h[p : p + K]):
            return
        left = min(reach, q - a, p - low)
        right = min(reach, b - q - K, high + SPAN - p - K)
        if q != p:
            if left and len(bad := np.flatnonzero(h[q - left : q] != h[p - left : p])):
                left -= int(bad[-1]) + 1
            if right and len(bad := np.flatnonzero(h[q + K : q + K + right] != h[p + K : p + K + right])):
                right = int(bad[0])
        t0, t1 = p - left, p + K + right - SPAN
        if t1 < t0:
            return
        hit = np.flatnonzero(self.owner[run + t0 - low : run + t1 - low + 1] < own) + (q - left)
        if len(hit):
            self.cover[hit] += 1
            self.cover[hit + SPAN] -= 1

    def removed(self) -> np.ndarray:
        return np.cumsum(self.cover[:-1]) > 0


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, phrases = [], []
    for b in batches:
        start = b.column(3)
        docs.append(b.filter(start.is_null()))
        f = b.filter(start.is_valid())
        phrases.append(tuple(f.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5)))
    shard = Shard(docs, phrases)
    gone, at = shard.removed(), 0
    for b in docs:
        for part in slices(b):
            data, off = utf8(part.column(2))
            raw = data.tobytes()
            kept, n, lost = [], [], []
            for i in range(part.num_rows):
                words = raw[off[i] : off[i + 1]].split()  # bytes split at exactly the six separators
                mask = gone[at : at + len(words)]
                at += len(words)
                n.append(len(words))
                lost.append(int(mask.sum()))
                if lost[-1]:
                    words = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later copies of a whole text: all of it recurs, or it is shorter than a window."""
    for b in batches:
        for part in slices(b):
            data, off = utf8(part.column(1))
            raw = data.tobytes()
            words = [raw[off[i] : off[i + 1]].split() for i in range(part.num_rows)]
            n = [len(w) for w in words]
            kept = ["" if len(w) >= SPAN else b" ".join(w).decode("utf-8", "replace") for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([x if x >= SPAN else 0 for x in n], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that no order holds: all their words stay."""
    for b in batches:
        for part in slices(b):
            words = [t.encode().split() for t in texts_of(part)]
            n = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([0] * len(words), pa.int64()), pa.array([b" ".join(w).decode() for w in words], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    key_type = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    copies = stored(first_of_copies(docs.select("a", "b", "doc_id"), ["a", "b"], "doc_id").select("doc_id", "a", "b").distinct(), "copies")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    shard, tasks = F.pmod(F.hash("doc_id"), F.lit(shards)).alias("s"), min(shards, MAX_TASKS)
    late, row = few(copies), ["doc_id", "a", "b"]  # rows may share a doc_id: a row is known by its id and text
    fresh = docs.join(late, row, "left_anti").select("doc_id", shard, "text")

    named = stored(fresh.mapInArrow(_emit_names, "h long, doc_id long, s int").groupBy("h", "s").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "names")
    recurring = stored(named.groupBy("h").agg(F.min("least").alias("x"), F.max("most").alias("y")).where("x < y").select("h"), "recurring")
    asked = named.select("h", "s").join(recurring, "h", "left_semi")
    to_shards = fresh.select("doc_id", "s", "text", F.lit(None).cast("long").alias("h")).unionByName(asked.select(F.lit(None).cast("long").alias("doc_id"), "s", F.lit(None).cast("string").alias("text"), "h"))
    windows = stored(to_shards.repartition(tasks, "s").sortWithinPartitions("s").mapInArrow(_one_by_one(_emit_windows), "w long, v int, s int, doc_id long, start int, last long"), "windows")
    discard(named, recurring)
    owners = windows.groupBy("w", "v").agg(F.min("doc_id").alias("owner"), F.max("last").alias("most")).where("owner < most").select("w", "v", "owner")
    phrases = windows.join(owners, ["w", "v"]).where("last > owner").select("doc_id", "s", F.lit(None).cast("string").alias("text"), "start", "owner", "w")
    dealt = fresh.select("doc_id", "s", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("w")).unionByName(phrases)
    first = dealt.repartition(tasks, "s").sortWithinPartitions("s").mapInArrow(_one_by_one(_reduce), schema)
    rest = docs.join(late, row, "left_semi").select("doc_id", "text").mapInArrow(_copies, schema)
    out = first.unionByName(rest).unionByName(nameless.mapInArrow(_whole, schema))
    return out.withColumn("doc_id", F.col("doc_id").cast(key_type))


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
