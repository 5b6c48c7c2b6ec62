"""Alignment of two tokenizers: groups of tokens of equal bytes, linked tokens, and how common the links are.

Both tokenizers read the same bytes, a space and the text.  A label string holds one label
for each byte: none, the end of an A token, the end of a B token, or both.  A regex scan
extracts spans up to each both-label; the labels inside a span count the tokens of its group.
Each labelled byte ends one stretch that lies in exactly one A and one B token: a link.

Texts are cut into pieces at single spaces after a character that is no white space, where
neither tokenizer can hold a token together (checked on the vocabularies; texts are whole
pieces otherwise).  Different pieces of a slice are encoded, labelled and scanned once.

Counts of id pairs cover the corpus: each document's different pairs are counted by Spark
with map-side sums.  The most frequent pairs, counted to be few, are broadcast to look up
the links of all documents; links of other pairs meet their counts in a shuffle join.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte by
byte, have zeros and an empty ``groups``; strings of special tokens are plain text; repeated
rows and shared or null ids are separate documents; other columns are ignored; an empty table
gives no rows.  A text without spaces is one piece, however long.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemill.llm.bytemap import byte_symbols
from tidemill.llm.tables import looked_up, stored
from tidemill.llm.textbatch import slices, utf8

PIECE_BYTES = 5 << 20
NONE, A_END, B_END, BOTH = b".ab|"
_GROUP = re.compile(rb"[^|]*\|")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_SPACE_MARK = "▁"


class Vocabulary:
    """Bytes of every token id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of ids."""
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Pair:
    """The two tokenizers of a worker process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(byte_symbols())}
        entries = [b""] * (1 + max(self.a.get_vocab(with_added_tokens=True).values()))
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.vocab_a = Vocabulary(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.vocab_b = Vocabulary([bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(_SPACE_MARK, " ").encode() for p in pieces])
        spec = json.loads(self.a.to_str())
        split = spec["pre_tokenizer"] or {}
        apart = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", False)
        self.cut = apart and not any(re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}", p) for p in pieces)
        # What the B tokenizer makes of one space at the end of a text.
        self.end_space = self.b.encode("a ")[len(self.b.encode("a")) :]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space; B adds that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [self.end_space if t == " " else x for t, x in zip(texts, b, strict=True)]


@cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _pieces(data: np.ndarray, off: np.ndarray, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a space and each text that is not empty, where its pieces start, and the row of each."""
    full = np.flatnonzero(np.diff(off) > 0)
    buf = np.insert(data, off[full], 32)
    begin = off[full] + np.arange(len(full))
    mark = np.zeros(len(buf), bool)
    if cut and len(buf) > 2:
        before, last = buf[1:-1], buf[:-2]
        solid = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (before < 0xC0) & (last >= 0xC3) & (last < 0xE0)
        mark[2:] = solid & (buf[2:] == 32)
    mark[begin] = True
    starts = np.flatnonzero(mark)
    return buf, starts, full[np.searchsorted(begin, starts, "right") - 1]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for one in ids for i in one), np.int64, int(n.sum())), n


def _spelt_right(ids: np.ndarray, n: np.ndarray, vocab: Vocabulary, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each piece's tokens, none of them empty, give its bytes."""
    piece = np.repeat(np.arange(len(n)), n)
    length = vocab.size[ids]
    fine = np.bincount(piece, weights=length, minlength=len(n)).astype(np.int64) == size
    fine &= np.bincount(piece, weights=length == 0, minlength=len(n)) == 0
    owner = np.repeat(np.arange(len(n)), size)
    differ = vocab.spelt(ids[fine[piece]]) != text[fine[owner]]
    fine[owner[fine[owner]][differ]] = False
    return fine


class Aligned:
    """Groups and links of different pieces.

    ``groups[i]`` is the groups string of piece i; pairs of piece i are
    pair[first[i]:first[i + 1]], each a * (size of B's vocabulary) + b.
    """

    def __init__(self, texts: list[str], two: Pair):
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        (a, n_a), (b, n_b) = map(_flat, two.encode(texts))
        self.fine = _spelt_right(a, n_a, two.vocab_a, data, size) & _spelt_right(b, n_b, two.vocab_b, data, size)
        a, b = a[np.repeat(self.fine, n_a)], b[np.repeat(self.fine, n_b)]
        self.n_a, self.n_b, size = (np.where(self.fine, x, 0) for x in (n_a, n_b, size))
        end_a, end_b = np.cumsum(two.vocab_a.size[a]), np.cumsum(two.vocab_b.size[b])
        total = int(size.sum())
        label = np.full(total, NONE, np.uint8)
        label[end_a - 1] = A_END
        label[end_b - 1] = np.where(label[end_b - 1] == A_END, BOTH, B_END)
        stops = np.fromiter((m.end() for m in _GROUP.finditer(label.tobytes())), np.int64)
        count_a = np.cumsum((label == A_END) | (label == BOTH))
        count_b = np.cumsum((label == B_END) | (label == BOTH))
        to_a, to_b = count_a[stops - 1].tolist(), count_b[stops - 1].tolist()
        word_a, word_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts, at_a, at_b = [], 0, 0
        for x, y in zip(to_a, to_b, strict=True):
            parts.append(",".join(word_a[at_a:x]) + "|" + ",".join(word_b[at_b:y]))
            at_a, at_b = x, y
        edge = np.concatenate(([0], np.cumsum(size)))
        own = np.searchsorted(stops, edge, "right")
        own[0] = 0
        self.n_groups = np.diff(own)
        self.groups = np.array([";".join(parts[i:j]) for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], object)
        marked = np.flatnonzero(label != NONE)
        ends_a, ends_b = label[marked] != B_END, label[marked] != A_END
        self.pair = a[count_a[marked] - ends_a] * len(two.vocab_b.size) + b[count_b[marked] - ends_b]
        self.first = np.searchsorted(marked, edge)
        self.n_links = np.diff(self.first)


def _documents(part: pa.RecordBatch, two: Pair, digest: bool) -> tuple[list[np.ndarray], list[str], pa.Array, pa.Array]:
    """Counts, groups, different pairs and how often each, for the rows of a slice."""
    n = part.num_rows
    buf, starts, row = _pieces(*utf8(part.column(1)), two.cut)
    if not len(starts):
        none = np.zeros(n, np.int64)
        empty = np.zeros(n + 1, np.int32)
        return [none] * 4, [""] * n, pa.ListArray.from_arrays(pa.array(empty), pa.array([], pa.int64())), pa.ListArray.from_arrays(pa.array(empty), pa.array([], pa.int32()))
    edges = np.append(starts, len(buf)).astype(np.int64)
    cells = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
    kind = cells.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = Aligned(cells.dictionary.to_pylist(), two)
    bad = np.bincount(row, weights=~found.fine[kind], minlength=n) > 0
    kind, row = kind[~bad[row]], row[~bad[row]]
    counts = [np.bincount(row, weights=x[kind], minlength=n).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    edge = np.searchsorted(row, np.arange(n + 1)).tolist()
    words = found.groups[kind].tolist()
    joined = (";".join(words[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True))
    groups = [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for g in joined]
    # Pieces of a row with how often they stand in it, then their pairs with the same.
    kinds = len(found.fine)
    code, times = np.unique(row * kinds + kind, return_counts=True)
    kind, row = code % kinds, code // kinds
    m = found.n_links[kind]
    pairs = found.pair[np.repeat(found.first[kind] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    space = len(two.vocab_a.size) * len(two.vocab_b.size)
    code = np.repeat(row, m) * space + pairs
    order = np.argsort(code)
    code, weight = code[order], np.repeat(times, m)[order]
    head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, head) if len(head) else weight
    code = code[head]
    offsets = pa.array(np.searchsorted(code // space, np.arange(n + 1)).astype(np.int32))
    return counts, groups, pa.ListArray.from_arrays(offsets, pa.array(code % space)), pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.int32)))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Each document's counts, ``groups`` (``a1,a2|b1;a3|b2,b3``, or its sha256 with ``digest``) and different
    ``pairs`` of linked ids with ``times``, how often each stands; ``row`` tells rows apart once they are written.
    """
    names = [key, "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    out = StructType([StructField(key, docs.schema[key].dataType)] + StructType.fromDDL("row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair_of(path_a, path_b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, batch.schema.names[1], PIECE_BYTES):
                counts, groups, pairs, times = _documents(part, two, digest)
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), rows, *map(pa.array, counts), pa.array(groups, pa.string()), pairs, times], names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, out)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is linked in more."""
    from pyspark.sql import Window

    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    by_a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # at most size_b rows
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(by_a)).alias("best"))


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts, best links, sum of counts and the digest of the groups of each document."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    rows = stored(align(docs, path_a, path_b, digest=True), "aligned", "zstd")
    facts = stored(pair_counts(rows, size_b), "pairs")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    each = looked_up(links, facts, "pair", "n")
    sums = each.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
