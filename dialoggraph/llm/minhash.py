"""b-bit MinHash near-duplicates with exact confirmation.

Every document gets the minima of 128 hash functions over its word shingles.  Bands of four
minima bring candidates together; of each minimum only two low bits are kept, packed in four
64-bit words, and the similarity of a candidate pair is estimated from the count of equal
bit pairs, corrected for chance collisions.

Documents with equal shingle sets are one class from the start (a digest of the set), so a
text repeated a billion times is one row afterwards.  No stage emits the pairs of a group:

1. The members of a band belong to the group of its smallest id, which joins most bands of a
   family of near copies into one group.  Groups are cut into blocks by a hash of the id;
   each pair of blocks is one small task that compares bits and sizes as matrices and sends
   back a spanning forest of the pairs that may reach the threshold.
2. The components of those edges are candidate clusters.  Only their texts are read again.
   Pairs of blocks of a cluster count common shingles as matrix products and send back a
   spanning forest of the confirmed links, whose components are the result.

At similarity 0.85 a pair shares none of the 32 bands with probability 6e-11, and its
estimate falls below ``estimate`` by more than five standard deviations.  At 0.80 no band is
shared with probability 5e-8; ``least_estimate`` gives the estimate for other similarities.

Defined results: null or wordless texts have no shingles and no links; fewer words than a
shingle make one shingle of all words; rows with a null id come back unlinked and kept; rows
that share an id are one document whose links count together; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.simjoin import components
from .blobs import batch
from .tables import cut
from .words import Block, blocks, mix, window_hash, words

HASHES, BANDS, ROWS_PER_BAND, BITS = 128, 32, 4, 2
# Rows of a block of a group when bits, and when shingle sets are compared.
BIT_BLOCK, SET_BLOCK = 256, 96
# Shingles that are counted at once, as columns of a matrix.
COLUMNS = 1 << 14

_rng = np.random.default_rng(85)
_MUL = _rng.integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, and row offsets into them."""
    w = words(block, lower=True)
    n = np.diff(w.rows)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    offs = np.r_[0, np.cumsum(count)]
    out = np.empty(offs[-1], np.uint64)
    full = window_hash(w.hash, width)
    row = np.repeat(np.arange(block.n), count)
    at = np.arange(offs[-1]) - offs[:-1][row] + w.rows[:-1][row]
    long = (n >= width)[row]
    out[long] = full[at[long]]
    for i in np.flatnonzero((n > 0) & (n < width)):
        whole = w.hash[w.rows[i]:w.rows[i + 1]]
        out[offs[i]] = window_hash(whole, len(whole), seed=len(whole))[0]
    return out, offs


def signatures(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minima (hashes x rows) of rows that have values."""
    out = np.empty((HASHES, len(offs) - 1), np.uint64)
    for k in range(HASHES):
        h = values ^ _XOR[k]
        h *= _MUL[k]
        out[k] = np.minimum.reduceat(h, offs[:-1])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band (bands x rows)."""
    keys = np.empty((BANDS, minima.shape[1]), np.uint64)
    for b in range(BANDS):
        keys[b] = window_hash(np.ascontiguousarray(minima[b * ROWS_PER_BAND:(b + 1) * ROWS_PER_BAND].T).ravel(),
                              ROWS_PER_BAND, seed=b)[::ROWS_PER_BAND] if minima.shape[1] else 0
    return keys


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """Low bits of the mixed minima, 32 to a word (words x rows)."""
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    out = np.zeros((HASHES // per, minima.shape[1]), np.uint64)
    for k in range(HASHES):
        out[k // per] |= low[k] << np.uint64(BITS * (k % per))
    return out


def _signature_rows(width: int):
    words_n = HASHES * BITS // 64
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("bands", pa.list_(pa.int64()))] + [(f"s{k}", pa.int64()) for k in range(words_n)])

    def sign(batches):
        for block in blocks(batches, "text"):
            values, offs = shingles(block, width)
            n = np.zeros(block.n, np.int64)
            digest = np.zeros((2, block.n), np.uint64)
            for i in np.flatnonzero(np.diff(offs)):
                own = np.unique(values[offs[i]:offs[i + 1]])
                n[i] = len(own)
                digest[0, i] = mix(own ^ np.uint64(0x5BD1E9955BD1E995)).sum()
                digest[1, i] = mix(own * np.uint64(0x9FB21C651E98DF25)).sum()
            has = np.flatnonzero(n)
            bands = np.zeros((BANDS, block.n), np.uint64)
            bits = np.zeros((words_n, block.n), np.uint64)
            if len(has):
                minima = signatures(values, np.r_[offs[:-1][has], offs[-1]])
                bands[:, has], bits[:, has] = band_keys(minima), packed_bits(minima)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, BANDS * (block.n + 1), BANDS), pa.int32()),
                pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest), lists,
                 *(pa.array(b.view(np.int64)) for b in bits)], schema=schema)

    ddl = ("doc_id long, n long, d1 long, d2 long, bands array<long>, "
           + ", ".join(f"s{k} long" for k in range(words_n)))
    return sign, ddl


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed rows of a with packed rows of b."""
    x = a[:, None, :] ^ b[None, :, :]
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    match = 1 - np.bitwise_count(x).sum(2, dtype=np.int64) / HASHES
    chance = 1.0 / (1 << BITS)
    return (match - chance) / (1 - chance)


def least_estimate(num: int, den: int) -> float:
    """Six standard deviations of the estimate below the similarity num / den."""
    s, chance = num / den, 1.0 / (1 << BITS)
    match = s + (1 - s) * chance
    return s - 6 * (match * (1 - match) / HASHES) ** 0.5 / (1 - chance)


def common_counts(rows: list[np.ndarray], split: int) -> np.ndarray:
    """Common values of rows before and from ``split`` on; every row has distinct values."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, value, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = count[value] > 1
    owner, value = owner[shared], np.cumsum(count > 1)[value[shared]] - 1
    out = np.zeros((split, len(rows) - split), np.float32)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    last = int(value[-1]) + 1 if len(value) else 0
    for lo in range(0, last, COLUMNS):
        i, j = np.searchsorted(value, (lo, lo + COLUMNS))
        part = np.zeros((len(rows), min(COLUMNS, last - lo)), np.float32)
        part[owner[i:j], value[i:j] - lo] = 1
        out += part[:split] @ part[split:].T
    return out.astype(np.int64)


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest id, id) of the components of a bipartite relation between two id lists."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    if not near.any():
        return []
    while True:
        na = np.minimum(a, np.where(near, b[None, :], big).min(1))
        nb = np.minimum(b, np.where(near, na[:, None], big).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    return sorted({(int(r), int(i)) for r, i in zip(np.r_[a, b], np.r_[left, right]) if r != i})


def runs(batches, keys: int):
    """Batches of the rows of one key each; the rows come sorted by their first columns."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            v = b.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield b.slice(lo, hi - lo)
        held = b.slice(cuts[-1])
    if held is not None:
        yield held


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def met_in_blocks(groups: DataFrame, size: int, values: list[str], compare) -> DataFrame:
    """Edges (a, b) from every pair of blocks of every group.

    groups: grp, doc_id and ``values``, without repeated rows.  compare(rows, split) tells for rows of a pair of
    blocks which rows before ``split`` are near which rows from it on.
    """
    count = groups.groupBy("grp").count().filter("count > 1")
    blocks_ = F.ceil(F.col("count") / size)
    own = F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int")
    met = (groups.join(count, "grp").withColumn("_n", blocks_).withColumn("_own", own)
           .withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
           .select("grp", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q"),
                   F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("_side"), "doc_id", *values))

    def edges(batches):
        found = []
        for rows in runs(batches, 3):
            side = rows.column(3).to_numpy()
            ids = rows.column(4).to_numpy()
            split = int((side == 0).sum())
            if rows.column(1)[0].as_py() == rows.column(2)[0].as_py():  # a block with itself
                rows, ids = pa.Table.from_batches([rows, rows]), np.r_[ids, ids]
            elif split == len(ids):
                continue
            found += forest(compare(rows, split), ids[:split], ids[split:])
            if len(found) > 100_000:
                yield batch(EDGES, found)
                found = []
        if found:
            yield batch(EDGES, found)

    key = ["grp", "_p", "_q"]
    return met.repartition(*key).sortWithinPartitions(*key, "_side").mapInArrow(edges, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, width: int = 5, estimate: float = 0.65,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if den * common shingles >= num * shingles of either; a component
    is known by its smallest id, whose document is kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sign, ddl = _signature_rows(width)
    sig = cut(rows.mapInArrow(sign, ddl))
    known = sig.filter("doc_id is not null and n > 0")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    member = known.select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("doc_id", "rep")
    reps = cut(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
               .dropDuplicates(["doc_id", "d1", "d2"]))
    links = confirmed_links(rows, reps, num, den, width, estimate)
    # An id that stands in several rows can be in several classes; then it links them.
    shared = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    shared = shared.select("doc_id", "a").join(member, "doc_id").select("a", F.col("rep").alias("b"))
    root = components(links.unionByName(shared), [])
    best = (member.join(root.withColumnRenamed("id", "rep"), "rep", "left")
            .groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id")))
    return (sig.select("doc_id", F.col("n").alias("n_shingles")).join(best, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def confirmed_links(rows: DataFrame, reps: DataFrame, num: int, den: int, width: int,
                    estimate: float) -> DataFrame:
    """Links (a, b) between representatives whose components are those of all links."""
    bits = [c for c in reps.columns if c.startswith("s")]
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    first = (keyed.groupBy("band").agg(F.min("doc_id").alias("grp"), F.count(F.lit(1)).alias("c"))
             .filter("c > 1").drop("c"))
    groups = (keyed.join(first, "band").select("grp", "doc_id").distinct()
              .join(reps.select("doc_id", "n", *bits), "doc_id").select("grp", "doc_id", "n", *bits))

    def may_link(block, split: int) -> np.ndarray:
        n = block.column(5).to_numpy()
        packed = np.stack([block.column(6 + k).to_numpy() for k in range(len(bits))], 1).view(np.uint64)
        a, b = n[:split, None], n[None, split:]
        return (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (
            estimates(packed[:split], packed[split:]) >= estimate)

    candidate = components(met_in_blocks(cut(groups), BIT_BLOCK, ["n", *bits], may_link), [])

    def sets(batches):
        for block in blocks(batches, "text"):
            values, offs = shingles(block, width)
            own = [np.unique(values[a:b]).tobytes() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), block.rows.column(1), pa.array(own, pa.binary())],
                                             names=["grp", "doc_id", "shingles"])

    def link(block, split: int) -> np.ndarray:
        own = [np.frombuffer(x, np.uint64) for x in block.column(5).to_pylist()]
        n = np.array([len(x) for x in own])
        common = common_counts(own, split)
        return common * den >= (n[:split, None] + n[None, split:] - common) * num

    # Merge join at every size: the texts are shuffled once, whether few or many are wanted.
    texts = rows.join(candidate.select(F.col("id").alias("doc_id"), F.col("root").alias("grp")).hint("merge"), "doc_id")
    members = cut(texts.select("grp", "doc_id", "text").mapInArrow(sets, "grp long, doc_id long, shingles binary"))
    return cut(met_in_blocks(members, SET_BLOCK, ["shingles"], link))
