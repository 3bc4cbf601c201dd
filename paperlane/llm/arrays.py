"""Whole-batch text primitives over Arrow buffers.

Everything here works on the UTF-8 bytes of a column slice at once: no Python
code runs per row or per word.  Slices are bounded in bytes so that a worker's
memory does not depend on the row count of an Arrow batch; one document is
never split, so a slice holds at least one whole document however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 3)  # 3 mod 4: P - 1 has a single factor of two
_RNG = np.random.RandomState(20240229)
BYTE_TABLE = _RNG.randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


_PINV = np.uint64(_inverse(int(_P)))


class _Powers:
    """P**i and P**-i modulo 2**64, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts and two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice in order: byte span, row and 64-bit hash; ``first`` has len(rows) + 1 entries."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


def split(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside`` set, cut at row borders: start, end, row, first."""
    n = len(raw)
    rows = len(offsets) - 1
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, np.zeros(rows + 1, np.int64)
    is_in = inside[raw]
    begins, ends = is_in.copy(), is_in.copy()
    begins[1:] &= ~is_in[:-1]
    ends[:-1] &= ~is_in[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = is_in[inner]
    ends[inner - 1] = is_in[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, "left")
    row = np.repeat(np.arange(rows), np.diff(first))
    return start, end, row, first


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_TABLE[raw] * up[:-1], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def folded_words(column: pa.Array) -> Words:
    """Lower-cased words (letters, digits and every byte from 0x80) of each row."""
    raw, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    start, end, row, first = split(raw, offsets, _WORD)
    return Words(start, end, row, span_hash(raw, start, end), first)


def spaced_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Words between ASCII white space, as they are; with the bytes and offsets they point into."""
    raw, offsets = utf8(column)
    start, end, row, first = split(raw, offsets, ~_SPACE)
    return raw, offsets, Words(start, end, row, span_hash(raw, start, end), first)


def fold_list(column: pa.Array) -> list[list[int]]:
    """The word hashes of each row as Python lists, for brute-force comparisons."""
    w = folded_words(column)
    return [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
