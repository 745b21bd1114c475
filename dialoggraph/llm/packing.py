"""Cost-balanced packing of token ids into sequences of a fixed length.

The cost of a piece of n tokens is linear plus quadratic (attention within the piece):
n + quadratic * n**2.  Per block of text the sequences are laid out so that their capacities
sum to the block's tokens: full sequences and, for the rest, powers of two.  Documents come in
descending length; each goes to the lowest-cost sequence that has room for it.  Only when none
has room for the whole, it is cut and fills the lowest-cost sequence that has any.

Blocks are packed where they are read: no shuffle, memory bounded by a block.  A sequence is
named by the partition and its place, so a task that runs again gives the same names.

Defined results: null and empty texts are the end id alone; a null id stays null; repeated
rows are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import VOCABULARY, encode_block, encoder
from .words import blocks

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("cost", pa.float64())])
DDL = ("doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, "
       "offset long, cost double")


class Sequences:
    """Open sequences, found by remaining capacity and lowest cost: a tree of minima over
    remaining capacities, with a heap of sequences at each."""

    def __init__(self, capacity: int, rooms: list[int]):
        self.width = 1 << capacity.bit_length()
        self.room, self.cost = list(rooms), [0.0] * len(rooms)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.low = [np.inf] * (2 * self.width)
        for s, r in enumerate(rooms):
            self.heaps[r].append((0.0, s))
        for r in set(rooms):
            heapq.heapify(self.heaps[r])
            self._refresh(r)

    def _refresh(self, r: int) -> None:
        node = r + self.width
        self.low[node] = self.heaps[r][0][0] if self.heaps[r] else np.inf
        while node > 1:
            node >>= 1
            self.low[node] = min(self.low[2 * node], self.low[2 * node + 1])

    def lowest(self, least: int) -> int | None:
        """The room of a lowest-cost sequence with at least so much room."""
        best, at = np.inf, None
        lo, hi = least + self.width, 2 * self.width
        while lo < hi:
            if lo & 1:
                if self.low[lo] < best:
                    best, at = self.low[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.low[hi] < best:
                    best, at = self.low[hi], hi
            lo, hi = lo >> 1, hi >> 1
        if at is None:
            return None
        while at < self.width:
            at = 2 * at if self.low[2 * at] <= self.low[2 * at + 1] else 2 * at + 1
        return at - self.width

    def put(self, r: int, n: int, cost: float) -> int:
        """Put n tokens into the lowest-cost sequence of room r."""
        _, s = heapq.heappop(self.heaps[r])
        self._refresh(r)
        self.room[s] -= n
        self.cost[s] += cost
        if self.room[s]:
            heapq.heappush(self.heaps[self.room[s]], (self.cost[s], s))
            self._refresh(self.room[s])
        return s


def layout(total: int, capacity: int) -> list[int]:
    """Full sequences, and the binary digits of the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(capacity.bit_length())) if rest >> k & 1]


def pack_lengths(lengths: np.ndarray, capacity: int, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of all pieces, in the order of their places."""
    open_ = Sequences(capacity, layout(int(lengths.sum()), capacity))
    price = lambda n: n + quadratic * n * n
    placed = []
    for d in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[d]) - capacity + 1, capacity):
            placed.append((int(d), start, capacity, open_.put(capacity, capacity, price(capacity))))
    rest = lengths % capacity
    for d in np.argsort(-rest, kind="stable"):
        left = int(rest[d])
        while left:
            r = open_.lowest(left)
            n = left if r is not None else (r := open_.lowest(1))
            placed.append((int(d), int(lengths[d]) - left, n, open_.put(r, n, price(n))))
            left -= n
    return placed


def pack(docs: DataFrame, capacity: int = 1024, quadratic: float = 1 / 6144, vocabulary: str = VOCABULARY,
         end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, token_ids (little-endian
    unsigned 32 bit), doc_tokens, sequence_id, offset, cost.

    ``quadratic`` weighs attention against the linear layers (1 / (6 * model width)).
    """
    def packing(batches):
        enc, base, used = encoder(vocabulary), TaskContext.get().partitionId() << 36, 0
        for block in blocks(batches, "text"):
            ids, offs = encode_block(block, enc, end)
            lengths = np.diff(offs)
            placed = pack_lengths(lengths, capacity, quadratic)
            doc, start, n, seq = np.array(placed, np.int64).reshape(-1, 4).T
            order = np.argsort(seq, kind="stable")
            doc, start, n, seq = doc[order], start[order], n[order], seq[order]
            before = np.cumsum(n) - n
            new = np.r_[True, seq[1:] != seq[:-1]]
            offset = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
            raw, at = ids.tobytes(), (offs[:-1][doc] + start) * 4
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(n),
                 pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + 4 * n).tolist())], pa.binary()),
                 pa.array(lengths[doc]), pa.array(seq + (base + used)), pa.array(offset),
                 pa.array(n + quadratic * n.astype(float) ** 2)], schema=SCHEMA)
            used += int(seq[-1]) + 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(packing, DDL)
