"""Vectorised word and window hashing over Arrow string columns.

Python operators of this subpackage receive Arrow record batches, look at the
UTF-8 bytes of a whole column at once and never loop over characters.  Memory is
bounded by ``SLICE_BYTES`` and the longest single text, not by the batch size.

Nulls count as empty texts.  Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_LENGTH, _POINT = np.uint64(0xA24BAED4963EE407), np.uint64(0x632BE59BD9B4E019)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = np.random.Generator(np.random.PCG64(20250)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers.clear() if size > (SLICE_BYTES << 2) else None
        _powers[base] = have
    return have


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Order-sensitive 64-bit hashes of values[start:end] for many segments in one pass."""
    up, down = _power(base, len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + mix((ends - starts).astype(np.uint64) + _LENGTH))


def distinct_segments(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one segment of each kind, and the kind of every segment, of points[start:end].

    Kinds are found by hash and compared point by point with their first segment, so two
    different segments never share one.
    """
    symbols = mix(points.astype(np.uint64) + _POINT)
    _, one, each = np.unique(segment_hash(symbols, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    rep = one[each]
    wrong = size != size[rep]
    check = np.flatnonzero(~wrong & (rep != np.arange(len(rep))))
    n = size[check]
    place = np.concatenate(([0], np.cumsum(n)))
    step = 1 << 21
    for low in range(0, int(place[-1]), step):  # in pieces, so that the positions stay few
        a, b = np.searchsorted(place, [low, min(low + step, place[-1])], "right") - 1
        some = check[a : b + 1] if b < len(check) else check[a:]
        m = size[some]
        at = np.cumsum(m) - m
        walk = np.arange(int(m.sum()))
        differ = points[walk + np.repeat(starts[some] - at, m)] != points[walk + np.repeat(starts[rep[some]] - at, m)]
        if differ.any():
            wrong[some[np.unique(np.searchsorted(at, np.flatnonzero(differ), "right") - 1)]] = True
    lost = np.flatnonzero(wrong)
    if len(lost):
        kinds: dict[bytes, int] = {}
        more = []
        for i in lost.tolist():
            key = points[starts[i] : ends[i]].tobytes()
            if key not in kinds:
                kinds[key] = len(one) + len(more)
                more.append(i)
            each[i] = kinds[key]
        one = np.concatenate([one, more])
    return one, each


class Words:
    """Words of a slice of rows: byte spans, hashes and the row of each word.

    first[r]:first[r + 1] are the words of row r; row_start[r]:row_start[r + 1] its bytes.
    """

    def __init__(self, data: np.ndarray, row_start: np.ndarray, lower: bool = False):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.row_start = data, row_start
        inside = _IS_WORD[data]
        begin = inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            cut = row_start[:-1][row_start[:-1] < len(data)]
            begin[cut] |= inside[cut]
            stop = inside.copy()
            stop[:-1] &= ~inside[1:]
            last = row_start[1:][row_start[1:] > 0] - 1
            stop[last] |= inside[last]
            self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, row_start)
        self.n = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = segment_hash(_BYTE[self.data], self.starts, self.ends)
        return self._hash

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its row, itself included."""
        return np.repeat(self.first[1:], self.n) - np.arange(len(self.starts))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all k-word windows that stay in one row, and the windows' hashes."""
        at = np.flatnonzero(self.left() >= k)
        return at, segment_hash(self.hash, at, at + k)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@cache
def _trim():
    """The C library's malloc_trim, or None where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Returns freed memory to the system: worker processes live on between stages."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Pieces of a record batch with at most SLICE_BYTES of text each, or one longer row."""
    limit = limit or SLICE_BYTES
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(max(at + 1, np.searchsorted(off, off[at] + limit, "right") - 1))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def words_of(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> Words:
    return Words(*utf8(batch.column(batch.schema.get_field_index(text))), lower=lower)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def row_sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of per-word values for each row, rows without words included."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
