"""Vectorised words over Arrow string columns.

A slice of documents is handled as one byte buffer: word bounds, 64-bit word hashes and document
numbers come from a handful of numpy passes, so no Python object is made per word or per document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
SLICE_BYTES = 4 << 20

#: bytes that separate words: [\x20\x09-\x0D], and all ASCII but letters and digits
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_R and its inverse to the powers 0 to n; one table a worker, grown as needed."""
    if len(_held[0]) <= n:
        size = -(-(n + 1) // (1 << 18)) << 18
        for i, base in enumerate((_R, _RINV)):
            x = np.full(size, base)
            x[0] = 1
            _held[i] = np.cumprod(x, dtype=np.uint64)
    return _held[0][: n + 1], _held[1][: n + 1]


def forget_powers() -> None:
    _held[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end] (uint64 values); equal runs get equal hashes wherever they lie."""
    return Runs(values)(starts, ends)


class Runs:
    """run_hash of many runs of the same values."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = powers(len(values))
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])


@dataclass
class Words:
    buf: np.ndarray  # uint8, as the words are compared (lower-cased if asked for)
    start: np.ndarray  # int64 byte bounds of each word
    end: np.ndarray
    doc: np.ndarray  # int32 row of each word
    first: np.ndarray  # int64, n_docs + 1: the words of row i are first[i]:first[i + 1]
    n_docs: int
    _hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = run_hash(_BYTE[self.buf], self.start, self.end)
        return self._hash

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunks
        col = pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def split_words(col: pa.Array, blanks: np.ndarray, lower: bool) -> Words:
    raw, off = string_buffers(col)
    n = len(off) - 1
    # one separator after each row keeps words of neighbours apart
    buf = np.full(len(raw) + n, 0x20, np.uint8)
    if len(raw):
        at = np.arange(len(raw)) if n <= 1 else np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))
        buf[at] = LOWER[raw] if lower else raw
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~blanks[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    bounds = off + np.arange(n + 1)
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    return Words(buf, start, end, doc, first, n)


def slices(table: pa.Table | pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row ranges of a table with about `limit` bytes of text at most; a longer text is a range of its own."""
    if not table.num_rows:
        return
    _, off = string_buffers(table.column(column))
    lo = 0
    while lo < table.num_rows:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), table.num_rows)
        yield table.slice(lo, hi - lo)
        lo = hi


def member(keys: np.ndarray, table: np.ndarray, bits: np.ndarray | None = None) -> np.ndarray:
    """Which keys are in a sorted table; bits (from `sieve`) rejects most others first."""
    out = np.zeros(len(keys), bool)
    if not len(table) or not len(keys):
        return out
    at = np.flatnonzero(bits[keys >> np.uint64(44)]) if bits is not None else np.arange(len(keys))
    pos = np.searchsorted(table, keys[at])
    pos[pos == len(table)] = 0
    out[at] = table[pos] == keys[at]
    return out


def sieve(table: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[table >> np.uint64(44)] = True
    return bits
