"""Substring dedup on bytes: column-wise construction over aligned pieces of many documents.

Equal strings of ``length`` bytes are found in three steps.

1. Every string of ``length`` bytes has an anchor: the seed of ``SEED`` bytes with the least
   hash inside it.  Equal strings have equal anchors at equal offsets.  Anchors are exchanged
   by hash, which leaves those that stand in two documents; only their surroundings matter.
2. The surroundings of such anchors (at most ``2 * length - SEED`` bytes) go to the partition
   of the anchor.  There they are aligned at the anchor, laid out by columns in a file, and
   read from the last column to the first: each round inserts one symbol of every piece,
   which updates the order of all suffixes (the column of a collection's Burrows-Wheeler
   transform) and the common prefixes of neighbours from those of the round before.  Runs of
   neighbours that share ``length`` bytes are equal strings; all but those of the smallest
   document are marked.
3. The marks go back to their documents.

A block of text sends an anchor, or a piece, that it holds in several documents once; what
the later documents share with the first is settled on the spot.  So a passage in a third of
all documents costs one row per block.

Defined results: a null text is empty; rows with a null id keep all bytes and are compared
with nothing; rows that share an id never remove each other's bytes; identical rows are
treated alike; extra columns are ignored.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import batch, by_bucket, by_key, dealt, pack, read_runs, repeated, sent_home, settled, unpack_all
from .encode import ragged
from .tables import cut, shuffle_partitions, text_bytes
from .words import Block, WIDE, blocks, byte_prefix, powers

SEED = 20
# One value above all bytes: a column that a piece does not have.
NOTHING = 256


def seed_hashes(block: Block) -> np.ndarray:
    """Hash of the SEED bytes at each place; places whose seed leaves its row get the most."""
    n = len(block.data) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = byte_prefix(block)
    h = (prefix[SEED:] - prefix[:n]) * powers(len(prefix))[1][:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for k in range(1, SEED):  # seeds that begin in the last bytes of a row
        at = block.offs[1:] - k
        h[at[(at >= 0) & (at < n)]] = np.uint64(2**64 - 1)
    return h


def anchors(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes in the block: hash, row, place in the block,
    and the first and last place at which a string with this anchor starts."""
    none = np.zeros(0, np.int64)
    lengths = np.maximum(np.diff(block.offs) - length + 1, 0)
    row = np.repeat(np.arange(block.n), lengths)
    if not len(row):
        return np.zeros(0, np.uint64), none, none, none, none
    start = ragged(block.offs[:-1], lengths)
    h = seed_hashes(block)
    seeds = length - SEED + 1
    # Least of `seeds` neighbours, the leftmost of equal ones: hash with the place below it.
    low = (h & ~np.uint64(63))
    least, where, span = low, np.arange(len(low), dtype=np.int32), 1
    while span < seeds:
        step = min(span, seeds - span)
        take = least[step:] < least[:-step]
        where = np.where(take, where[step:], where[:-step])
        least = np.where(take, least[step:], least[:-step])
        span += step
    at = where[start]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    at = at[new].astype(np.int64)
    return h[at], row[new], at, start[new], start[last]


# Of an anchor: the high 32 bits of its hash (the bucket has the low ones; a chance match costs a piece, no more).
ANCHOR = (np.uint32, np.int64, np.int64, np.int32)


def shared_anchors(source: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc_id, rid, starts): places of anchors whose seed stands in two documents."""
    buckets = 4 * parts
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
    ddl = "bucket long, blob binary"

    def several(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.argsort(h, kind="stable")
        s, d = h[order], doc[order]
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        many = np.maximum.reduceat(d, cuts) > np.minimum.reduceat(d, cuts)
        out = np.empty(len(h), bool)
        out[order] = np.repeat(many, np.diff(np.r_[cuts, len(h)]))
        return out

    def propose(batches):
        for block in blocks(batches, "text", WIDE):
            h, row, at, _, _ = anchors(block, length)
            if not len(h):
                continue
            doc, rid = block.ids()[row], block.column("rid")[row]
            pos = (at - block.offs[row]).astype(np.int32)
            known = several(h, doc)
            ask = ~known
            # Others still have to learn of a seed that is known here: it is asked for once.
            _, first = np.unique(h[known], return_index=True)
            ask[np.flatnonzero(known)[first]] = True
            rows = settled(doc[known], rid[known], pos[known], parts)
            open_ = by_key((h[ask] % np.uint64(buckets)).astype(np.int64),
                           [(h[ask] >> np.uint64(32)).astype(np.uint32), doc[ask], rid[ask], pos[ask]])
            yield batch(schema, rows + [(int(k), pack(a)) for k, a in open_])

    def answer(batches):
        for bucket, blobs in by_bucket(batches):
            if bucket < 0:  # settled
                yield batch(schema, [(bucket, x) for x in blobs])
                continue
            h, doc, rid, pos, _ = unpack_all(blobs, ANCHOR)
            yes = several(h, doc)
            yield batch(schema, settled(doc[yes], rid[yes], pos[yes], parts))

    found = dealt(source.mapInArrow(propose, ddl), parts).mapInArrow(answer, ddl)
    return sent_home(found, parts)


# Of a piece: anchor hash, document, row hash, place of the anchor, bytes before it, bytes from it on.
PIECE = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8)


def text_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"),
                       F.col(text).alias("text"))


def repeated_strings(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid, starts): byte positions at which a string of ``length`` bytes starts that
    also starts in a document with a smaller id."""
    spark = docs.sparkSession
    rows = text_rows(docs, doc_id, text)
    source = rows.filter("doc_id is not null")
    parts = max(shuffle_partitions(spark), text_bytes(source) >> 24)
    buckets = 4 * parts
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
    ddl = "bucket long, blob binary"
    anchored = cut(shared_anchors(source, length, parts))

    def send(batches):
        for block in blocks(batches, "text", WIDE):
            h, row, at, first, last = anchors(block, length)
            given = block.rows.column(block.rows.schema.get_field_index("starts")).to_pylist()
            wanted = np.zeros(len(block.data) + 1, bool)
            for i, places in enumerate(given):
                if places:
                    wanted[block.offs[i] + ragged(*read_runs(places))] = True
            use = np.flatnonzero(wanted[at])
            if not len(use):
                continue
            h, row, at, first, last = h[use], row[use], at[use], first[use], last[use]
            doc, rid = block.ids()[row], block.column("rid")[row]
            before, behind = at - first, last + length - at
            prefix = byte_prefix(block)
            whole = (prefix[at + behind] - prefix[first]) * powers(len(prefix))[1][first]
            # A piece that an earlier document of the block has as well is settled here.
            later = repeated((h, whole, before * 256 + behind), doc)
            starts = ragged(first[later], (last - first + 1)[later])
            owner = np.repeat(np.flatnonzero(later), (last - first + 1)[later])
            rows = settled(doc[owner], rid[owner], (starts - block.offs[row[owner]]).astype(np.int32), parts)
            rest = np.flatnonzero(~later)
            for k, (h_, doc_, rid_, at_, row_, before_, behind_) in by_key(
                    (h[rest] % np.uint64(buckets)).astype(np.int64),
                    [x[rest] for x in (h, doc, rid, at, row, before, behind)]):
                body = block.data[ragged(at_ - before_, before_ + behind_)]
                rows.append((int(k), pack([h_, doc_, rid_, (at_ - block.offs[row_]).astype(np.int32),
                                           before_.astype(np.uint8), behind_.astype(np.uint8)], body.tobytes())))
            yield batch(schema, rows)

    def construct(batches):
        for bucket, blobs in by_bucket(batches):
            if bucket < 0:  # settled
                yield batch(schema, [(bucket, x) for x in blobs])
                continue
            h, doc, rid, at, before, behind, body = unpack_all(blobs, PIECE)
            late = list(later_strings(h, doc, before.astype(np.int64), behind.astype(np.int64), body, length))
            if late:
                piece = np.concatenate([p for p, _ in late])
                start = np.repeat([c for _, c in late], [len(p) for p, _ in late])
                yield batch(schema, settled(doc[piece], rid[piece], (at[piece] + start).astype(np.int32), parts))

    # Left joins on one layout of the texts, here and for the cutting: they are shuffled once.
    texts = rows.join(anchored, ["doc_id", "rid"], "left")
    found = dealt(texts.mapInArrow(send, ddl), parts).mapInArrow(construct, ddl)
    return sent_home(found, parts)


def later_strings(group: np.ndarray, doc: np.ndarray, before: np.ndarray, behind: np.ndarray,
                  body: np.ndarray, length: int):
    """Of pieces aligned at their anchors: (pieces, start relative to the anchor) of strings of
    ``length`` bytes that a piece of the same group and a smaller document has at that start.

    One round per column, last column first.  ``order`` holds the pieces by (group, suffix),
    ``common`` the common prefix of each suffix with the one before it in its group.
    """
    n = len(group)
    offset = np.cumsum(before + behind) - (before + behind) + before
    order = np.argsort(group, kind="stable").astype(np.int32)
    sorted_group = group[order]
    new = np.r_[True, sorted_group[1:] != sorted_group[:-1]]
    number = np.cumsum(new) - 1
    del sorted_group, new
    common = np.zeros(n, np.int16)
    lo, hi = -int(before.max(initial=0)), int(behind.max(initial=0))
    with tempfile.TemporaryFile() as columns:
        # The columns as a file, in the order in which the rounds read them.
        for c in range(hi - 1, lo - 1, -1):
            has = (c >= -before) & (c < behind)
            column = np.full(n, NOTHING, np.uint16)
            column[has] = body[offset[has] + c]
            columns.write(column.tobytes())
        columns.seek(0)
        for c in range(hi - 1, lo - 1, -1):
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)[order]
            # The order of the new suffixes: stable by symbol within the group.
            key = number * (NOTHING + 1) + symbol
            place = np.argsort(key, kind="stable")
            key = key[place]
            same = np.r_[False, key[1:] == key[:-1]] & (symbol[place] != NOTHING)
            # Common prefix with the suffix before: one more than the least of the old ones between.
            grown = np.zeros(n, np.int16)
            j = np.flatnonzero(same)
            if len(j):
                upto, frm = place[j], place[j - 1]
                near = upto - frm == 1
                grown[j[near]] = common[upto[near]] + 1
                far = np.flatnonzero(~near)
                if len(far):
                    edges = np.stack([frm[far] + 1, upto[far] + 1], 1).ravel()
                    grown[j[far]] = np.minimum.reduceat(np.r_[common, 0], edges)[::2] + 1
            order, common = order[place], np.minimum(grown, np.int16(length))
            linked = common >= length
            if linked.any():
                run = np.cumsum(~linked) - 1
                owner = doc[order]
                least = np.minimum.reduceat(owner, np.flatnonzero(~linked))[run]
                late = np.flatnonzero(owner > least)
                if len(late):
                    yield order[late], c


def without_repeated_strings(docs: DataFrame, length: int = 50, doc_id: str = "doc_id",
                             text: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept_bytes, removed (byte spans, maximal runs).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document
    with a smaller id; strings are judged on the input.
    """
    from .windows import covered

    marks = repeated_strings(docs, length, doc_id, text)
    rows = text_rows(docs, doc_id, text)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cutting(batches):
        for block in blocks(batches, "text", WIDE):
            given = block.rows.column(block.rows.schema.get_field_index("starts")).to_pylist()
            kept, spans = [], []
            for i, starts in enumerate(given):
                own = block.data[block.offs[i]:block.offs[i + 1]]
                if starts is None:
                    kept.append(own.tobytes())
                    spans.append([])
                    continue
                gone = covered(starts, len(own), length)
                kept.append(own[~gone].tobytes())
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(np.diff(block.offs), pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, spans_type)], names=["doc_id", "n_bytes", "kept_bytes", "removed"])

    return rows.join(marks, ["doc_id", "rid"], "left").select("doc_id", "text", "starts").mapInArrow(
        cutting, "doc_id long, n_bytes long, kept_bytes binary, removed array<struct<start:long,end:long>>")
