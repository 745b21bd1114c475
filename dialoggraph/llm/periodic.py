"""Runs: stretches of words that repeat themselves with a period, and texts without the repeats.

A run is a maximal stretch with smallest period q that is at least ``shortest`` words and two
periods long.  Per block of text:

* words become numbers, equal for equal bytes; each text ends in a number of its own;
* only suffixes at positions of a difference cover (four of every 13 residues) are sorted: by
  two words at a time, then by doubling, only where ties are left; each round's names are kept;
* the common prefix of neighbours in that order comes from those names, and a sparse table
  answers range minima over it;
* the longest common extension of any two positions compares at most 12 words until both
  positions are in the cover, and asks the table for the rest;
* for each period q, places a period apart on a grid are compared: a run of two periods cannot
  slip through the grid, and the grids of a text of n words have about n ln n places.  Those
  whose words are equal are extended to the right by one query and to the left by bisection.

Texts are worked on where they are read: no shuffle, memory bounded by a block of texts (or one
longer text) and by ``CHUNK`` grid places.

Defined results: null and empty texts, and texts of blanks, have no words, no runs and an empty
rest; null ids stay null; repeated rows are treated alike, each by itself; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import picked
from .words import Block, blocks, word_spans

# A difference cover: every residue modulo 13 is a difference of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
CHUNK = 1 << 21

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
# How many words until positions with these residues are both in the cover.
_SHIFT = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(i + d) % MODULUS] and _IN_COVER[(j + d) % MODULUS])
                    for j in range(MODULUS)] for i in range(MODULUS)], np.int64)


def numbered(block: Block) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(values, rows, (start, end) of words): the words of all texts as numbers, each text
    followed by a number that occurs once; values[rows[i]:rows[i + 1] - 1] is text i."""
    start, end, rows = word_spans(block)
    inside = np.zeros(len(block.data) + 1, np.int32)
    inside[start] += 1
    inside[end] -= 1
    letters = block.data[np.cumsum(inside)[:-1] > 0]
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64) + block.n
    values = np.empty(len(start) + block.n, np.int64)
    ends = rows[1:] + np.arange(block.n)
    own = np.ones(len(values), bool)
    own[ends] = False
    values[own] = number
    values[ends] = np.arange(block.n)
    return values, np.r_[0, ends + 1], (start, end)


def _renamed(group: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
    """group[order[k]] = the first place of k's group, where ``new`` marks first places."""
    first = np.flatnonzero(new)
    group[order] = first[np.cumsum(new) - 1]


class Extensions:
    """Longest common extensions of positions of ``values``, whose last value occurs once."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = values
        self.at = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        index = np.full(n + MODULUS, -1, np.int64)
        index[self.at] = np.arange(len(self.at))
        padded = np.r_[values, np.full(2 * MODULUS + 2, -1)]
        order, names = self._sorted(padded, index)
        self.rank = np.full(n + MODULUS, -1, np.int64)
        self.rank[self.at[order]] = np.arange(len(order))
        self.table = self._minima(self._neighbours(padded, index, order, names))

    def _sorted(self, padded: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sampled suffixes in order, and for k = 0, 1, ... names of their first 13 * 2**k words."""
        at, m = self.at, len(self.at)
        base = int(padded.max()) + 2
        key = (padded[at] + 1) * base + padded[at + 1] + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        group = np.empty(m, np.int64)
        _renamed(group, order, new)

        def refine(key_of):
            """Split groups of more than one by a further key of their members."""
            nonlocal order, new
            alone = new & np.r_[new[1:], True]
            places = np.flatnonzero(~alone)
            members = order[places]
            keys = key_of(members)
            inner = np.lexsort((keys, group[members]))
            members, keys = members[inner], keys[inner]
            owner = group[members]
            order[places] = members
            split = np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]
            new[places] = split
            first = places[np.flatnonzero(split)]
            return members, first[np.cumsum(split) - 1]

        for k in range(2, MODULUS, 2):
            if new.all():
                break
            more = min(2, MODULUS - k)
            members, named = refine(lambda x: (padded[at[x] + k] + 1) * base
                                    + (padded[at[x] + k + 1] + 1 if more == 2 else 0))
            group[members] = named
        names, step = [group.copy()], MODULUS
        while not new.all():
            last = names[-1]
            def behind(x):
                place = at[x] + step
                inside = place < len(index) - MODULUS
                return np.where(inside, last[index[np.where(inside, place, 0)]], -1)
            members, named = refine(behind)
            group[members] = named
            names.append(group.copy())
            step *= 2
        return order, names

    def _neighbours(self, padded, index, order, names) -> np.ndarray:
        """Common words of each suffix with the one before it in order (0 for the first)."""
        i, j = self.at[order[1:]].copy(), self.at[order[:-1]].copy()
        n, common = len(self.values), np.zeros(max(len(order) - 1, 0), np.int64)
        for k in range(len(names) - 1, -1, -1):
            live = np.flatnonzero((i < n) & (j < n))
            same = live[names[k][index[i[live]]] == names[k][index[j[live]]]]
            for x in (i, j, common):
                x[same] += MODULUS << k
        live = np.arange(len(common))
        for _ in range(MODULUS):
            live = live[padded[i[live]] == padded[j[live]]]
            for x in (i, j, common):
                x[live] += 1
        return np.r_[0, common]

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        while 2 << len(table) - 1 <= len(values):
            a, half = table[-1], 1 << len(table) - 1
            table.append(np.minimum(a[:-half], a[half:]))
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions how many values agree from there on."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for d in range(MODULUS):
            live = live[shift[live] > d]
            equal = self.values[i[live] + d] == self.values[j[live] + d]
            out[live[equal]] += 1
            live = live[equal]
        live = np.flatnonzero(out == shift)
        a, b = self.rank[i[live] + shift[live]], self.rank[j[live] + shift[live]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            t = self.table[k]
            out[live[own]] += np.minimum(t[low[own]], t[high[own] - (1 << k) + 1])
        return out


def grid(lengths: np.ndarray, shortest: int):
    """(text, period, place) of all grids, ``CHUNK`` places at a time or one period's.

    Places of period q stand max(q, shortest - q) apart: a run has so many places whose word
    comes again q words on.
    """
    half = lengths // 2
    text = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    step = np.maximum(period, shortest - period)
    many = -((period - lengths[text]) // step)
    upto = np.cumsum(many)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
        own = np.repeat(np.arange(lo, hi), many[lo:hi])
        place = (np.arange(len(own)) - (upto[own] - many[own] - (upto[lo] - many[lo]))) * step[own]
        yield text[own], period[own], place, step[own]
        lo = hi


def runs(values: np.ndarray, rows: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted; values and rows as ``numbered`` gives."""
    lengths = np.diff(rows) - 1
    found, extension = [np.zeros((0, 4), np.int64)], None
    for text, period, place, step in grid(np.where(lengths >= shortest, lengths, 0), shortest):
        i = rows[text] + place
        hit = np.flatnonzero(values[i] == values[i + period])
        text, period, place, step, i = text[hit], period[hit], place[hit], step[hit], i[hit]
        if not len(i):
            continue
        extension = extension or Extensions(values)
        end = i + period + extension(i, i + period)
        # The first place of the run on this grid: the word a step before is not in it.
        low, high = np.maximum(rows[text], i - step), i.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            reach = extension(mid, mid + period[open_]) >= i[open_] - mid
            high[open_[reach]] = mid[reach]
            low[open_[~reach]] = mid[~reach] + 1
        keep = (end - low >= np.maximum(shortest, 2 * period)) & ((low > i - step) | (place == 0))
        found.append(np.stack([text, low - rows[text], end - low, period], 1)[keep])
    out = np.concatenate(found)
    # Of one stretch the smallest period.
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    out = out[np.r_[True, (out[1:, :3] != out[:-1, :3]).any(1)]] if len(out) else out
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """True for each value outside of the repeats: in no run after its first period."""
    depth = np.zeros(rows[-1] + 1, np.int64)
    start = rows[found[:, 0]] + found[:, 1]
    np.add.at(depth, start + found[:, 3], 1)
    np.add.at(depth, start + found[:, 2], -1)
    return np.cumsum(depth)[:-1] == 0


def joined(block: Block, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> pa.Array:
    """Texts of the words start:end of their ``text``, joined by one space."""
    data = np.r_[block.data, np.uint8(32)]
    size = end - start + 1
    upto = np.cumsum(size)
    take = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size - start, size)
    take[upto - 1] = len(block.data)
    letters = data[take]
    sums = np.bincount(text, size, block.n).astype(np.int64)
    last = np.zeros(len(letters), bool)
    last[(np.cumsum(sums) - 1)[sums > 0]] = True  # no space behind the last word
    offsets = np.r_[0, np.cumsum(np.maximum(sums - 1, 0))].astype(np.int64)
    raw = pa.py_buffer(letters[~last])
    return pa.LargeStringArray.from_buffers(block.n, pa.py_buffer(offsets), raw)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("kept_text", pa.string())])
DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


def periodic_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, runs (by start, then period, in
    words from 0), kept_text (the words outside of repeats, joined by one space)."""
    def finding(batches):
        for block in blocks(batches, "text"):
            values, rows, (start, end) = numbered(block)
            found = runs(values, rows, shortest)
            keep = np.delete(kept_words(rows, found), rows[1:] - 1)
            text = np.repeat(np.arange(block.n), np.diff(rows) - 1)
            offsets = pa.array(np.searchsorted(found[:, 0], np.arange(block.n + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)], fields=list(RUNS.value_type)))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(np.diff(rows) - 1), lists.cast(RUNS),
                 joined(block, start[keep], end[keep], text[keep]).cast(pa.string())], schema=SCHEMA)

    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(finding, DDL)
