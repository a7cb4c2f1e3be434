"""Words of Arrow text columns as NumPy arrays: boundaries, hashes, code points.

All work runs over the UTF-8 bytes of a chunk of whole documents. A word is a
maximal run of bytes that are no separator; by default separators are space and
``\\x09``-``\\x0D``. Words hash to 64 bits (a polynomial over random byte values),
so equal words get equal hashes on every machine. Null texts hold no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
GRAM = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _BASE_INV))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1, 2, ... of the base and of its inverse, at least ``n`` of each."""
    return _powers(max(CHUNK_BYTES + 1, n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins; a null row has no bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, end row, bytes, row offsets."""
    if not len(column):
        return
    raw, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@dataclass
class Words:
    hash: np.ndarray  #: 64 bits per word
    row: np.ndarray  #: row of the chunk
    start: np.ndarray  #: first byte
    end: np.ndarray  #: byte after the last
    first: np.ndarray  #: index of each row's first word, and the count of all words at the end

    def per_row(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * GRAM)


def split(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, lower: bool = False) -> Words:
    """The words of a chunk. ``lower`` hashes A-Z as a-z."""
    inside = ~separator[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(span_hashes(raw, start, end, lower), row, start, end, first)


def code_points(raw: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``n`` words that stays in its row."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = words.hash[:m].copy()
    for k in range(1, n):
        h *= GRAM
        h += words.hash[k : k + m]
    at = np.flatnonzero(words.row[:m] == words.row[n - 1 :])
    return at, mix(h[at])


def occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more (all occurrences), and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[:-1]] = same
    return twice | later, later


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
