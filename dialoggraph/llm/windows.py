"""Substring dedup over word windows behind a count-min prefilter.

1. Every task fills a count-min sketch of its windows (three rows of cells that count 0, 1,
   "2 or more").  The partition sketches are merged slice by slice.  The merged counts are
   never too low, so a window that occurs twice is estimated at 2 or more.
2. A second pass sends only windows estimated at 2 or more to an exact grouping by their
   96-bit hash.  Per block of text a repeated window travels once: later documents of the
   same block are settled on the spot, so a window that stands in a third of all documents
   costs one row per block.
3. The positions found go back to their documents.

The sketch is sized by the bytes of text and bounded by ``max_cells`` (32 MB a row by
default): what is broadcast has a fixed bound.  Beyond it the estimate gets looser and the
exact grouping gets more windows; the result is the same.

Defined results: a null text has no words; rows with a null id keep all their words and
are compared with nothing; rows that share an id never remove each other's words; identical
rows are treated alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import batch, by_key, pack, read_runs, repeated, sent_home, settled, unpack_all
from .tables import shuffle_partitions, text_bytes
from .words import Block, WIDE, blocks, window_hash, window_starts, words

ROWS = 3
SLICE_CELLS = 1 << 23


class Sketch:
    """Count-min rows with saturating counts, as two bit arrays a row: at least 1, at least 2."""

    def __init__(self, cells: int):
        self.cells = cells
        self.once = np.zeros((ROWS, cells // 8), np.uint8)
        self.twice = np.zeros((ROWS, cells // 8), np.uint8)

    def add(self, values: np.ndarray) -> None:
        for r in range(ROWS):
            cell = np.sort(place(values, r, self.cells))
            new = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
            again = np.unique(cell[~new])
            cell = cell[new]
            seen = (self.once[r][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
            _set(self.once[r], cell)
            _set(self.twice[r], again)
            _set(self.twice[r], cell[seen == 1])


def place(values: np.ndarray, row: int, cells: int) -> np.ndarray:
    k = np.uint64((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)[row])
    return ((values * k) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def squeeze(bits: np.ndarray) -> bytes:
    """A slice of bits, compressed: the gaps between set bits where that is shorter than the bits.

    A gap is bytes of 255 and a last byte below that, which add up to it.
    """
    gap = np.diff(np.flatnonzero(np.unpackbits(bits)), prepend=0)
    if len(gap) >= len(bits):
        return b"b" + zstandard.compress(bits.tobytes(), 1)
    size = gap // 255 + 1
    out = np.full(int(size.sum()), 255, np.uint8)
    out[np.cumsum(size) - 1] = gap % 255
    return b"g" + zstandard.compress(out.tobytes(), 1)


def unsqueeze(value: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(value[1:]), np.uint8)
    if value[:1] == b"b":
        return raw
    bits = np.zeros(8 * n, np.uint8)
    bits[np.cumsum(raw, dtype=np.int64)[raw < 255]] = 1
    return np.packbits(bits)


def _set(bits: np.ndarray, cell: np.ndarray) -> None:
    """Set the bits of sorted, distinct cells."""
    if len(cell):
        at = cell >> 3
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bits[at[new]] |= np.bitwise_or.reduceat(np.right_shift(np.uint8(128), (cell & 7).astype(np.uint8)), new)


def estimated_twice(twice: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    out = np.ones(len(values), bool)
    for r in range(ROWS):
        cell = place(values, r, cells)
        out &= ((twice[r][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
    return out


def sketch_cells(total_bytes: int, max_cells: int) -> int:
    """A power of two of about two cells for each expected window, within fixed bounds."""
    return min(max_cells, 1 << max(16, (total_bytes // 4).bit_length()))


def merged_sketch(docs: DataFrame, width: int, cells: int, text: str) -> np.ndarray:
    """The rows of cells that count 2 or more, over all documents: a fixed number of bytes."""
    part = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    step = min(SLICE_CELLS, cells) // 8

    def fill(batches: Iterator[pa.RecordBatch]):
        sketch = Sketch(cells)
        for block in blocks(batches, text, WIDE):
            w = words(block, lower=False)
            start, _ = window_starts(w.rows, width)
            sketch.add(window_hash(w.hash, width)[start])
        for r in range(ROWS):
            for k in range(0, cells // 8, step):
                if sketch.once[r][k:k + step].any():
                    yield batch(part, [(r, k // step, squeeze(sketch.once[r][k:k + step]),
                                        squeeze(sketch.twice[r][k:k + step]))])

    def merge(batches: Iterator[pa.RecordBatch]):
        whole: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r, k, once, twice in zip(*(c.to_pylist() for c in b.columns)):
                once, twice = unsqueeze(once, step), unsqueeze(twice, step)
                o, t = whole.get((r, k), (np.uint8(0), np.uint8(0)))
                whole[r, k] = (o | once, t | twice | (o & once))
        for (r, k), (_, t) in whole.items():
            yield batch(part, [(r, k, b"", squeeze(t))])

    ddl = "row int, slice int, once binary, twice binary"
    merged = (docs.select(text).mapInArrow(fill, ddl).repartition("row", "slice").mapInArrow(merge, ddl))
    twice = np.zeros((ROWS, cells // 8), np.uint8)
    for x in merged.select("row", "slice", "twice").toLocalIterator():
        twice[x["row"], x["slice"] * step:(x["slice"] + 1) * step] = unsqueeze(bytes(x["twice"]), step)
    return twice


def repeated_windows(docs: DataFrame, width: int = 13, max_cells: int = 1 << 28,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid, starts): word positions at which a window starts that also starts in a
    document with a smaller id; rid is a hash of the text, which tells rows of one id apart."""
    spark = docs.sparkSession
    source = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), F.col(text).alias("text"))
    total = text_bytes(source)
    cells = sketch_cells(total, max_cells)
    # Compressed, as every executor keeps a copy on disk; tasks unpack it.
    twice = spark.sparkContext.broadcast(zstandard.compress(merged_sketch(source, width, cells, "text").tobytes(), 1))
    parts = max(shuffle_partitions(spark), total >> 24)
    buckets = 4 * parts
    out = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
    ddl = "bucket long, blob binary"
    kinds = (np.uint64, np.uint32, np.int64, np.int64, np.int32)

    def settle(block: Block, w, bits) -> list[tuple]:
        h = window_hash(w.hash, width)
        start, row = window_starts(w.rows, width)
        h = h[start]
        at = np.flatnonzero(estimated_twice(bits, h, cells))
        if not len(at):
            return []
        h, start, row = h[at], start[at], row[at]
        second = (window_hash(w.hash, width, seed=77)[start] >> np.uint64(32)).astype(np.uint32)
        doc, rid, pos = block.ids()[row], block.column("rid")[row], (start - w.rows[:-1][row]).astype(np.int32)
        later = repeated((h, second), doc)
        rest = ~later
        open_ = by_key((h[rest] % np.uint64(buckets)).astype(np.int64),
                       [h[rest], second[rest], doc[rest], rid[rest], pos[rest]])
        return settled(doc[later], rid[later], pos[later], parts) + [(int(k), pack(a)) for k, a in open_]

    def candidates(batches):
        bits = np.frombuffer(zstandard.decompress(twice.value), np.uint8).reshape(ROWS, -1)
        for block in blocks(batches, "text", WIDE):
            rows = settle(block, words(block, lower=False), bits)
            if rows:
                yield batch(out, rows)

    def exact(batches):
        blobs = []
        for b in batches:
            done = b.filter(pa.compute.less(b.column(0), 0))
            if done.num_rows:
                yield done
            blobs += b.filter(pa.compute.greater_equal(b.column(0), 0)).column(1).to_pylist()
        if blobs:
            h, second, doc, rid, pos, _ = unpack_all(blobs, kinds)
            later = repeated((h, second), doc)
            rows = settled(doc[later], rid[later], pos[later], parts)
            if rows:
                yield batch(out, rows)

    found = source.mapInArrow(candidates, ddl).repartition(parts, "bucket").mapInArrow(exact, ddl)
    return sent_home(found, parts)


def without_repeated_windows(docs: DataFrame, width: int = 13, max_cells: int = 1 << 28,
                             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, kept_text (kept words joined by one blank), removed (word spans).

    A word goes if a window of ``width`` words that covers it also starts in a document
    with a smaller id; windows are judged on the input.
    """
    marks = repeated_windows(docs, width, max_cells, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"),
                       F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_text", pa.string()),
                        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cutting(batches):
        for block in blocks(batches, "text", WIDE):
            w = words(block, lower=False)
            given = block.rows.column(block.rows.schema.get_field_index("starts")).to_pylist()
            raw, texts, spans = block.data.tobytes(), [], []
            for i, starts in enumerate(given):
                lo, hi = w.rows[i], w.rows[i + 1]
                gone = covered(starts, hi - lo, width)
                kept = np.flatnonzero(~gone) + lo
                texts.append(b" ".join([raw[a:b] for a, b in zip(w.start[kept].tolist(), w.end[kept].tolist())])
                             .decode("utf-8", "replace"))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(np.diff(w.rows), pa.int64()),
                 pa.array(texts, pa.string()), pa.array(spans, schema.field(3).type)], schema=schema)

    return rows.join(marks, ["doc_id", "rid"], "left").select("doc_id", "text", "starts").mapInArrow(
        cutting, "doc_id long, n_words long, kept_text string, removed array<struct<start:long,end:long>>")


def covered(starts: bytes | None, n: int, width: int) -> np.ndarray:
    """True for each of n places that a window of ``width`` from one of the starts covers."""
    change = np.zeros(n + 1, np.int32)
    if starts:
        first, many = read_runs(starts)
        np.add.at(change, first, 1)
        np.add.at(change, np.minimum(first + many - 1 + width, n), -1)
    return np.cumsum(change[:n]) > 0
