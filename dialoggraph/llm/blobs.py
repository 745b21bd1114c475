"""Flat arrays as rows: many small values of one bucket travel as one binary value.

A map task sends, for each bucket of keys, one row with the arrays of all its values instead
of one row per value.  Shuffles then move bytes, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .words import mix


def pack(arrays: Sequence[np.ndarray], tail: bytes = b"") -> bytes:
    """Arrays of one length, behind that length, compressed; 32-bit integers as differences."""
    parts = [np.int64(len(arrays[0])).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.int32 else a).tobytes())
    return zstandard.compress(b"".join(parts) + tail, 1)


def unpack(blob: bytes, dtypes: Sequence) -> list[np.ndarray]:
    """The arrays, and what stands behind them as bytes."""
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for d in map(np.dtype, dtypes):
        a = np.frombuffer(raw, d, n, at)
        out.append(np.cumsum(a, dtype=np.int32) if d == np.int32 else a)
        at += n * d.itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def unpack_all(blobs: Sequence[bytes], dtypes: Sequence) -> list[np.ndarray]:
    parts = [unpack(b, dtypes) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, d)
            for k, d in enumerate([*dtypes, np.uint8])]


def by_key(key: np.ndarray, arrays: Sequence[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, the arrays' values under it), for every key that occurs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
    sorted_arrays = [a[order] for a in arrays]
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(key)] if len(cuts) else []):
        yield key[lo], [a[lo:hi] for a in sorted_arrays]


def repeated(keys: Sequence[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """True where the same key also stands in a row of a smaller ``doc``."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    sorted_doc = doc[order]
    first = sorted_doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else sorted_doc
    out = np.empty(len(order), bool)
    out[order] = sorted_doc > first
    return out


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, blob) by bucket, for ``by_bucket``."""
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its blobs), one bucket at a time; rows come sorted by bucket."""
    bucket, blobs = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if k != bucket and blobs:
                yield bucket, blobs
                blobs = []
            bucket = k
            blobs.append(blob.as_py())
    if blobs:
        yield bucket, blobs


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def by_document(doc: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, rid, its sorted positions) for every document that occurs."""
    order = np.lexsort((pos, rid, doc))
    doc, rid, pos = doc[order], rid[order], pos[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])]) if len(doc) else []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(doc)] if len(cuts) else []):
        yield int(doc[lo]), int(rid[lo]), pos[lo:hi]


def settled(doc: np.ndarray, rid: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Positions on their way back to their documents: rows (-1 - bucket of documents, arrays)."""
    home = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return [(-1 - int(k), pack(arrays)) for k, arrays in by_key(home, [doc, rid, pos])]


def as_runs(pos: np.ndarray) -> np.ndarray:
    """Sorted positions, which may repeat, as (first, how many) of each run."""
    first = np.flatnonzero(np.r_[True, np.diff(pos) > 1])
    last = np.r_[first[1:], len(pos)] - 1
    return np.stack([pos[first], pos[last] - pos[first] + 1], 1).astype(np.int32)


def read_runs(starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, many = np.frombuffer(starts, np.int32).reshape(-1, 2).T
    return first.astype(np.int64), many.astype(np.int64)


POSITIONS = (np.int64, np.int64, np.int32)


def sent_home(found: DataFrame, parts: int) -> DataFrame:
    """(doc_id, rid, starts) of rows as ``settled`` makes them: one row for each document.

    starts: runs of neighbouring positions as pairs (first, how many) of 32 bits.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("starts", pa.binary())])

    def gather(batches):
        for _, blobs in by_bucket(batches):
            doc, rid, pos, _ = unpack_all(blobs, POSITIONS)
            yield batch(schema, [(d, r, as_runs(p).tobytes()) for d, r, p in by_document(doc, rid, pos)])

    return dealt(found, parts).mapInArrow(gather, "doc_id long, rid long, starts binary")
