"""Sampled SentencePiece segmentations, and lossless decoding.

A text is a lattice of vocabulary pieces.  Forward filtering gives each position the
total weight of all ways to reach it; backward sampling then walks from the end and
draws each piece in proportion to the weight of what leads to it, so whole
segmentations come out with their exact lattice probability.  Draws are a hash of
(seed, row key, segment, step): the same row gives the same pieces on any cluster,
whatever rows share its slice.  For that, weights are multiplied, added and divided
inside one segment only, and scaled by powers of two where products grow small.

No piece spans from a letter to a following space, nor a line end, so the lattice
falls apart into segments there.  Each distinct segment of a slice of rows is
filtered once; filtering and drawing go through all segments of the slice at once,
so memory is bounded by the slice, or by a single longer text.

Pieces weigh 1 / (rank + 50) ** sharpness.  A character without a piece of its own
is written in byte pieces, and so is U+2581, which the model uses for the space.

Defined results: null and empty texts have no pieces and decode to the empty text;
rows with the same key and text get the same pieces; a null key is a key like any
other; other columns are ignored.  A text without spaces is one segment and takes one
numpy step for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.textbatch import distinct_segments, mix, slices, texts_of, utf8

SLICE = 1 << 19
HELD = 1 << 17  # characters of segments whose lattices are held at one time
_BASE = np.uint64(0x2545F4914F6CDD1D)
_SYMBOL = np.uint64(0x8CB92BA72F3D8DD7)
_PREFIX_BITS = 20
SHORT = 40  # characters of a segment whose products of weights need no scaling
_G1, _G2, _G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _lookup_bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)


_step_salt = np.arange(1024, dtype=np.uint64) * _G3


class Lattice:
    """Pieces of a model, found by a hash of their characters."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte_id = np.zeros(256, np.int64)
        raw: list[bytes] = []
        for i in range(sp.vocab_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_id[value] = i
                raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                raw.append(b"")
            else:
                text = text.replace("▁", " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError("a piece spans a segment end")
                rank = min(-sp.get_score(i), sp.vocab_size())
                self.piece[text] = i, float(np.float32((rank + 50.0) ** -sharpness))
                raw.append(text.encode())
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.longest = max(map(len, self.piece))
        self.begins = np.zeros(1 << _PREFIX_BITS, bool)  # may say yes too often, never no
        hashes = {}
        for text, (i, w) in self.piece.items():
            code = 0
            for ch in text:
                code = (code * int(_BASE) + int(mix(np.array([ord(ch)], np.uint64) + _SYMBOL)[0])) & 0xFFFFFFFFFFFFFFFF
                self.begins[_lookup_bits(mix(np.array([code], np.uint64)))] = True
            hashes[code] = i, w
        if len(hashes) < len(self.piece):
            raise ValueError("two pieces share a hash")
        found = np.array(list(hashes), np.uint64)
        order = np.argsort(found)
        self.hash = found[order]
        # A direct table of slots, and a sorted list of what shares a slot with another piece.
        self.slot = np.zeros(1 << _PREFIX_BITS, np.int32)
        where = _lookup_bits(mix(self.hash))
        self.slot[where] = np.arange(len(found))
        lost = np.flatnonzero(self.slot[where] != np.arange(len(found)))
        self.rest, self.rest_at, self.shared = np.append(self.hash[lost], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(lost, 0), len(lost)
        self.ident, self.weight = (np.array([v[k] for v in hashes.values()])[order] for k in (0, 1))

    def filtered(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of segments that follow one another in points.

        Node p + 1 stands after character p; its edges are lead[p]:lead[p + 1].  Each
        edge has its cumulative share of the weight at its end, its length, and its
        piece id, or minus the code point if that is written in bytes.
        """
        total = len(points)
        left = np.repeat(np.cumsum(size), size) - np.arange(total)
        at = np.arange(total)
        symbols = mix(points.astype(np.uint64) + _SYMBOL)
        code = np.zeros(total, np.uint64)
        found = []
        alone = np.zeros(total, bool)
        for n in range(1, self.longest + 1):
            code = code * _BASE + symbols[at + (n - 1)]
            keep = np.flatnonzero(self.begins[_lookup_bits(mix(code))])
            at, code = at[keep], code[keep]
            j = self.slot[_lookup_bits(mix(code))]
            hit = np.flatnonzero(self.hash[j] == code)
            odd = np.flatnonzero(self.hash[j] != code)
            if self.shared and len(odd):  # the few pieces whose slot another piece has
                i = np.searchsorted(self.rest, code[odd])
                again = self.rest[i] == code[odd]
                j[odd[again]] = self.rest_at[i[again]]
                hit = np.sort(np.concatenate([hit, odd[again]]))
            found.append((at[hit] + n, n, j[hit]))
            if n == 1:
                alone[at[hit]] = True
            more = np.flatnonzero(left[at] > n)
            at, code = at[more], code[more]
        bare = np.flatnonzero(~alone)
        # Edges of a node are neighbours, long ones first, as they are the likely ones.
        many = np.zeros(total + 1, np.int64)
        many[bare + 1] = 1
        for end, _, _ in found:
            many[end] += 1
        lead = np.concatenate(([0], np.cumsum(many[1:])))
        fill = np.concatenate(([0], lead[:-1]))
        edges = lead[-1]
        length, ident, weight = np.empty(edges, np.int8), np.empty(edges, np.int32), np.empty(edges)
        for end, n, j in found[::-1]:
            to = fill[end]
            fill[end] += 1
            length[to], ident[to], weight[to] = n, self.ident[j], self.weight[j] * 64.0**n
        to, value = fill[bare + 1], points[bare].astype(np.int64)
        length[to], weight[to] = 1, 64.0 * 2.0**-20
        ident[to] = np.where(value < 128, self.byte_id[np.minimum(value, 127)], -value)
        end = np.repeat(np.arange(1, total + 1), many[1:])
        start = np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)
        level = np.arange(total) - start
        origin = end - length
        before = np.where(origin == start[end - 1], total + 1, origin)  # the start of a segment is not the end of the one before
        forward, power = np.ones(total + 2), np.zeros(total + 2, np.int32)  # a node weighs forward * 2 ** power
        long = np.repeat(size > SHORT, size)
        # Nodes are visited by their position in the segment, short and long segments apart.
        for group, scaled in ((np.flatnonzero(~long), False), (np.flatnonzero(long), True)):
            by_level = group[np.argsort(level[group], kind="stable")]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(level[group]))))
            for t in range(len(bounds) - 1):
                node = by_level[bounds[t] : bounds[t + 1]]
                a, k = lead[node], many[node + 1]
                own = np.cumsum(k) - k
                e = np.repeat(a - own, k) + np.arange(own[-1] + k[-1])
                w = weight[e] * forward[before[e]]
                if scaled:
                    p = power[before[e]]
                    top = np.maximum.reduceat(p, own)
                    forward[node + 1], more = np.frexp(np.add.reduceat(np.ldexp(w, p - np.repeat(top, k)), own))
                    power[node + 1] = top + more
                else:
                    forward[node + 1] = np.add.reduceat(w, own)
        share = np.ldexp(weight * forward[before], power[before] - power[end]) / forward[end]
        nth, node = 1, np.flatnonzero(many[1:] > 1)
        while len(node):  # cumulative inside each node
            i = lead[node] + nth
            share[i] += share[i - 1]
            nth += 1
            node = node[many[node + 1] > nth]
        share[lead[1:] - 1] = 1.0
        return np.minimum(share, 1.0), length, ident, lead


def _segments(points: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.zeros(len(points) + 1, bool)
    if len(points):
        space, line = points == 32, points == 10
        cut[:-1] = line
        cut[:-1] |= space & np.concatenate(([True], ~space[:-1]))
        cut[1:-1] |= line[:-1]
        cut[row_start] = True
    at = np.flatnonzero(cut[: len(points)])
    return at, np.append(at[1:], len(points)) if len(at) else at


def _drawn(lattice: Lattice, points: np.ndarray, a: np.ndarray, b: np.ndarray, one: np.ndarray, live: np.ndarray, each: np.ndarray, salt: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Pieces of the segments ``live``, each of a kind in ``one``: (segments, step from the end, pieces)."""
    size = (b - a)[one]
    place = np.concatenate(([0], np.cumsum(size)))
    share, length, ident, lead = lattice.filtered(points[np.repeat(a[one] - place[:-1], size) + np.arange(place[-1])], size)
    stop = place[:-1][each[live]]
    node, k, out = stop + (b - a)[live], 0, []
    while len(live):
        u = (mix((salt[live] ^ np.uint64(k >> 10)) + _step_salt[k & 1023]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        j = lead[node - 1]
        miss = np.flatnonzero(share[j] <= u)
        while len(miss):
            j[miss] += 1
            miss = miss[share[j[miss]] <= u[miss]]
        out.append((live, k, ident[j]))
        count[live] += 1
        node = node - length[j]
        more = node > stop
        live, node, stop = live[more], node[more], stop[more]
        k += 1
    return out


def encode(lattice: Lattice, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts in a row, and the offsets of each text's ids."""
    joined = "".join([" " + t if t else "" for t in texts])
    row_start = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts]))).astype(np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = _segments(points, row_start[:-1][row_start[:-1] < len(points)])
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    one, each = distinct_segments(points, a, b)
    row = np.searchsorted(row_start, a, "right") - 1
    nth = np.arange(len(a)) - np.searchsorted(a, row_start)[row]
    salt = mix(keys[row] * _G1 + np.uint64(seed)) + nth.astype(np.uint64) * _G2
    by_kind = np.argsort(each, kind="stable")  # equal segments side by side
    first = np.searchsorted(each[by_kind], np.arange(len(one) + 1))
    upto = np.cumsum((b - a)[one])
    count, drawn, low = np.zeros(len(a), np.int64), [], 0
    while low < len(one):  # some kinds of segments at a time, so that few lattices are held together
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HELD, "right")))
        drawn += _drawn(lattice, points, a, b, one[low:high], by_kind[first[low] : first[high]], each - low, salt, count)
        low = high
    last = np.cumsum(count)
    ids = np.empty(last[-1], np.int64)
    for which, step, got in drawn:  # the first drawn stands last
        ids[last[which] - 1 - step] = got
    ends = np.concatenate(([0], last))[np.append(np.searchsorted(a, row_start[:-1]), len(a))]
    if (ids < 0).any():
        many = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        code = -ids[odd]
        many[odd] = np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))
        place = np.concatenate(([0], np.cumsum(many)))
        full = np.repeat(ids, many)
        for i, c in zip(place[odd].tolist(), code.tolist(), strict=True):
            own = lattice.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))]
            full[i : i + len(own)] = own
        ids, ends = full, place[ends]
    return ids, ends


def decode_bytes(lattice: Lattice, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all decoded texts in a row, each with its leading space, and their offsets."""
    size = lattice.sizes[ids]
    place = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(lattice.offsets[ids] - place[:-1], size) + np.arange(place[-1])
    return lattice.bytes[take], place[ends]


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice_of(path: str, sharpness: float = 1.0) -> Lattice:
    """One lattice per worker process."""
    if (path, sharpness) not in _lattices:
        _lattices[path, sharpness] = Lattice(path, sharpness)
    return _lattices[path, sharpness]


def decode(path: str, ids: list[int]) -> str:
    """The text of one row's ids."""
    lat = lattice_of(path)
    raw, _ = decode_bytes(lat, np.asarray(ids, np.int64), np.array([0, len(ids)]))
    return raw.tobytes().decode("utf-8", "replace")[1:]


def sample(docs: DataFrame, model: str, seed: int = 1, sharpness: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids and lossless (decoding gave the text back) of every row."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice_of(model, sharpness)
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                ids, ends = encode(lat, texts_of(part, "t"), np.asarray(part.column(2)).view(np.uint64), seed)
                raw, off = decode_bytes(lat, ids, ends)
                data, own = utf8(part.column(1))
                size = np.diff(own)
                same = np.diff(off) == size + (size > 0)
                if same.all():
                    lead = np.zeros(len(raw), bool)
                    lead[off[:-1][size > 0]] = True
                    wrong = np.concatenate(([0], np.cumsum(raw[~lead] != data)))
                    same &= (raw[off[:-1][size > 0]] == 32).all() & (wrong[own[1:]] == wrong[own[:-1]])
                arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), arrays, pa.array(same)], [key, "n_pieces", "ids", "lossless"])

    rows = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.xxhash64(docs[key]).alias("h"))
    return rows.mapInArrow(run, f"{key} {key_type}, n_pieces long, ids array<int>, lossless boolean")


def restore(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """key and text of every encoded row."""
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice_of(model)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                raw, _ = decode_bytes(lat, np.asarray(ids or [], np.int64), np.array([0, len(ids or [])]))
                texts.append(raw.tobytes().decode("utf-8", "replace")[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {key_type}, text string").withColumnRenamed("k", key)
