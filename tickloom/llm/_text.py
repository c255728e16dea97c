"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on the raw buffers of Arrow string columns, so no
Python object is made per document, word or byte.  Texts are cut in slices
of bounded size; a null text counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 2 << 20

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    i = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mix64(i) | U64(1)


BYTE = constants(256, 11)
_IN_WORD = np.where(SPACE, U64(0), BYTE)
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = constants(4096, 23)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 12), base, dtype=U64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


class RangeHash:
    """Hashes of arbitrary ranges of a symbol sequence, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self._sum = np.zeros(n + 1, dtype=U64)
        np.cumsum(symbols * _powers_of(_BASE, n), out=self._sum[1:])
        self._inverse = _powers_of(_INVERSE, n + 1)

    def grams(self, k: int) -> np.ndarray:
        """The hash of every range of k symbols."""
        n = len(self._sum) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        return mix64((self._sum[k:] - self._sum[:n]) * self._inverse[:n])

    def ranges(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (self._sum[start + length] - self._sum[start]) * self._inverse[start]
        return mix64(h ^ (length.astype(U64) * U64(0xD6E8FEB86659FD93)))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (len + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most `limit` bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each row
    (and past the last) the index of its first word.  `offsets` counts from
    the start of `data`; words never cross rows."""
    letter = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = letter[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = letter[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, dtype=U64)
    lo, hi = int(starts[0]), int(ends[-1])
    part, first = data[lo:hi], starts - lo
    lengths = ends - starts
    place = np.arange(hi - lo, dtype=np.int64)
    gaps = np.diff(np.append(first, hi - lo))
    place -= np.repeat(first, gaps)
    place &= 4095
    value = _IN_WORD[part] * _PLACE[place]
    value ^= value >> U64(29)
    return mix64(np.add.reduceat(value, first) + lengths.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every `span` neighbours."""
    if len(x) < span:
        return x[:0]
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def concatenated(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then from first[1]."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - count), count)


def take_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies of the byte ranges, one after the other, and their offsets."""
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    return data[concatenated(starts, lengths)], at


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary (or string) column from bytes and offsets."""
    kind = kind or pa.binary()
    wide = np.int64 if kind in (pa.large_binary(), pa.large_string()) else np.int32
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(wide))), pa.py_buffer(np.ascontiguousarray(data))])


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, a line end after each, and where
    each text starts (len + 1)."""
    low = [(t or "").lower() for t in texts]
    starts = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in low], out=starts[1:])
    flat = ("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, dtype=np.uint32), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]] along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def stretch(text: Column, key: Column, length: int) -> Column:
    """The text, or of a longer one a stretch of so many characters from a hashed place."""
    start = F.pmod(F.xxhash64(key, F.lit(9)), F.greatest(F.lit(1), F.length(text) - length + 1)) + 1
    return F.when(F.length(text) <= length, text).otherwise(F.substr(text, start.cast("int"), F.lit(length)))


def row_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of a string column of at most `limit` bytes, or of one longer row."""
    yield from slices(buffers(column)[1], limit)
