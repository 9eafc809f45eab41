"""Vectorised words and hashes over Arrow string columns.

A batch's texts lie in one byte buffer; words are found and hashed with a
handful of NumPy passes over it, without a Python object per word. Word
hashes are 64-bit polynomials over random byte values, finished by a mixer;
runs of words are hashed from prefix sums in constant time a run.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20

#: Bytes whose words are hashed at once; a byte takes 8 in each of four arrays then, and in the two tables of powers, of 2**18 entries.
PIECE = (1 << 18) - 2

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE = np.uint64(int(_rng.integers(0, 2**63)) * 2 + 1)
RUN = np.uint64(int(_rng.integers(0, 2**63)) * 2 + 1)

#: Byte classes: True inside a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[:128] = [chr(c).isalnum() for c in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (at least)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for b in (int(base), pow(int(base), -1, 2**64)):
            out = np.empty(size, np.uint64)
            out[0], done = 1, 1
            while done < size:
                step = np.uint64(pow(b, done, 2**64))
                more = min(done, size - done)
                out[done : done + more] = out[:more] * step
                done += more
            both.append(out)
        have = (both[0], both[1])
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have


def prefix_hash(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``values[i] * base**i`` and the inverse powers, for :func:`run_hash`."""
    forth, back = powers(base, len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * forth[: len(values)], out=sums[1:])
    return sums, back


def run_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal runs wherever they stand."""
    sums, back = prefix
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def trim() -> None:
    """Give freed memory back to the system; workers are kept between stages, and share the executor's limit with it."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def rows_by_bytes(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` text bytes: (rows, bytes, row offsets into them). Null is empty."""
    text = pc.fill_null(batch.column(column), "")
    if pa.types.is_large_string(text.type):
        kind, width = np.int64, 8
    else:
        text, kind, width = text.cast(pa.string()), np.int32, 4
    n = len(text)
    if n == 0:
        return
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, kind, n + 1, text.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    trim()


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that :meth:`Words.hashes` gives these words."""
    out = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        data = np.frombuffer(word.encode(), np.uint8)
        out[i] = run_hash(prefix_hash(_BYTE[data], BASE), np.array([0]), np.array([len(data)]))[0]
    return out


class Words:
    """The words of a slice: byte ``start`` and ``end``, first word of each row in ``first`` (n_rows + 1)."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, kind: np.ndarray = SPACED):
        self.data, self.rows = data, rows
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        edge = inside[1:] != inside[:-1]
        begins, ends = edge[:-1] & inside[1:-1], edge[1:] & inside[1:-1]
        inner = rows[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        if len(inner):  # a row ends a word even where the next begins with one
            begins[inner] |= inside[1:-1][inner]
            ends[inner - 1] |= inside[1:-1][inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, rows)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False, head: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``head`` bytes; ``lower`` folds A-Z first."""
        table = _BYTE[_LOWER] if lower else _BYTE
        out = np.empty(len(self), np.uint64)
        i, step = 0, min(CHUNK, PIECE)
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + step, "right")))
            base = self.start[i]
            prefix = prefix_hash(table[self.data[base : self.end[j - 1]]], BASE)
            end = self.end[i:j] if head is None else np.minimum(self.end[i:j], self.start[i:j] + head)
            out[i:j] = run_hash(prefix, self.start[i:j] - base, end - base)
            i = j
        return out


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words inside each row and the row of each; a shorter, not empty row is one run."""
    row_of = words.row()
    n = words.count
    start = np.arange(len(words))
    left = words.first[1:][row_of] - start
    pick = (left >= size) | ((start == words.first[:-1][row_of]) & (n[row_of] < size))
    start, row = start[pick], row_of[pick]
    end = np.minimum(start + size, words.first[1:][row])
    return run_hash(prefix_hash(hashes, RUN), start, end), row
