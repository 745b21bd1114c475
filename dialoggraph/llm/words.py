"""Words, hashes and windows of whole Arrow batches, as flat numpy arrays.

A batch of texts is one byte array with row offsets.  Everything here works on that array at
once: no Python object is made for a word.  Batches are cut into blocks of about ``BLOCK``
bytes (a longer text is a block of its own), so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once: a worker's arrays stay below 100 MB and mostly in its caches.
BLOCK = 1 << 20
# Where what a block holds several times is sent once, blocks are larger.
WIDE = 4 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
# The white space that ends a word is blank and the bytes 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept between blocks, as most have one size."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in ((0, _BASE), (1, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    a, b = _powers[0][:n], _powers[1][:n]
    if n > 2 * WIDE:  # one very long text: do not keep its tables
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return a, b


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on where the span stands."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Block:
    """Some rows of a batch: their bytes, row offsets (one more than rows), and other columns."""

    data: np.ndarray
    offs: np.ndarray
    rows: pa.RecordBatch

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def ids(self, name: str = "doc_id") -> np.ndarray:
        return self.column(name)

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


@dataclass
class Words:
    """Words of a block: start, end, hash; rows[i]:rows[i+1] are the words of row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1, dtype=np.int32), np.diff(self.rows))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[Block]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
            yield Block(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], batch.slice(lo, hi - lo))
            lo = hi


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row offsets of all words of the block."""
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(block.n + 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = block.offs[:-1]
    edge = edge[edge < len(data)]
    first[edge] = inside[edge]
    edge = block.offs[1:] - 1
    edge = edge[edge >= 0]
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, block.offs)


def words(block: Block, lower: bool) -> Words:
    start, end, rows = word_spans(block)
    prefix = prefix_hash(block.data, _BYTE_LOWER if lower else _BYTE)
    return Words(start, end, span_hash(prefix, start, end), rows)


def byte_prefix(block: Block) -> np.ndarray:
    return prefix_hash(block.data, _BYTE)


def window_hash(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values, also across rows; see ``window_starts``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    k = np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(width):
        out *= k
        out += values[j:j + n]
    return mix(out)


def window_starts(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of windows that stay inside a row, and the row of each."""
    lengths = np.maximum(np.diff(rows) - width + 1, 0)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - before[row] + rows[:-1][row], row
