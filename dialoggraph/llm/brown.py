"""Brown class-based bigram scoring.

1. Vocabulary: exact counts of all training words; the ``frequent`` ones are known to every
   task, all others stay in hashed partitions.  By its form (kind of last byte, length) every
   word has an open class to start from.
2. Exchange clustering.  The bigrams of the ``heads`` most frequent words are a matrix, on which
   one word at a time moves to the class that raises the likelihood of class bigrams most.  Then
   every other word with ``least`` training tokens, however many words these are, is exchanged
   out of its open class against the same class bigrams: Spark groups its (word, neighbour
   class) counts, each task moves the words of its partitions.
3. Scoring: log10 P(text) = sum of log10 P(class | context) + log10 P(word | class).  The context
   is the class of the word before; behind a word outside the frequent ones it is that word's open
   class, so no text waits for another partition.  Words outside the frequent ones travel hashed to
   the partition that knows their class and send sums back; nothing of that passes the driver.

Transitions are smoothed after Witten and Bell towards class frequencies, emissions by one
added count; an open class keeps one more for unseen words.  The driver holds ``frequent`` words,
``heads``^2 counts and the class bigrams; what grows with the corpus stays in partitions.

Defined results: a null or empty text is its end token alone; a null id is in no fold: it is
scored, not learned from, and its ``held_out`` is null; equal rows get equal scores; the split of
the rows over tasks changes no score; extra columns are ignored.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import batch, by_bucket, by_key, dealt, pack, unpack_all
from .tables import cut, text_bytes
from .words import Block, blocks, mix, words

# Open classes: four kinds of last byte times four lengths.
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
OPEN = 16
NO_ID = -2**63


class Lookup:
    """Places of hashes in a list of words; of words with equal leading bits the first stays."""

    BITS = 21

    def __init__(self, hashes: np.ndarray):
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.kept = np.sort(first)
        self.hashes = np.r_[hashes[self.kept], np.uint64(0)]
        self.slots = np.full(1 << self.BITS, len(self.kept), np.int32)
        self.slots[slot[self.kept]] = np.arange(len(self.kept), dtype=np.int32)

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.slots[(h >> np.uint64(64 - self.BITS)).astype(np.int64)]
        return np.where((self.hashes[at] == h) & (at < len(self)), at, -1)


@dataclass
class Model:
    """What every task needs of the training set, all of a size that parameters fix."""

    words: Lookup        # frequent words
    count: np.ndarray    # training count of each frequent word
    klass: np.ndarray    # class of each frequent word
    learned: int         # learned classes; open classes and the end follow

    @property
    def size(self) -> int:
        return self.learned + OPEN + 1


@dataclass
class Chances:
    """The smoothed model: logarithms to base 10."""

    transition: np.ndarray  # P(class | context)
    room: np.ndarray        # denominator of the words of each class
    ends: int               # training texts
    tokens: int             # training tokens, ends included


def open_class(block: Block, w) -> np.ndarray:
    if not len(w.end):
        return np.zeros(0, np.int64)
    size = np.searchsorted([5, 9, 13], w.end - w.start, side="right")
    return _KIND[block.data[w.end - 1]].astype(np.int64) * 4 + size


def with_ends(values: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows with ``end`` before each row and after it; where each row begins."""
    n = len(rows) - 1
    out = np.full(len(values) + 2 * n, end, np.int64)
    row = np.repeat(np.arange(n), np.diff(rows))
    out[np.arange(len(values)) + 2 * row + 1] = values
    return out, rows[:-1] + 2 * np.arange(n)


BLOBS = "bucket long, blob binary"
BLOB = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
COUNTS = (np.uint64, np.int64, np.int64)
# Distinct words a task holds before it sends them on.
HELD = 1 << 19


def frequent_words(train: DataFrame, keep: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, open classes and counts of the most frequent words, most frequent first."""
    buckets = 16 * parts

    def sent(h, kind, c):
        return batch(BLOB, [(int(k), pack(a)) for k, a in by_key((h % np.uint64(buckets)).astype(np.int64), [h, kind, c])])

    def merged(h, kind, c):
        h, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        return h, kind[index], np.bincount(inverse, c, len(h)).astype(np.int64)

    def count(batches):
        none = held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for block in blocks(batches, "text"):
            w = words(block, lower=True)
            own, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            held = merged(*map(np.concatenate, zip(held, (own, open_class(block, w)[first], n))))
            if len(held[0]) > HELD:
                yield sent(*held)
                held = none
        yield sent(*held)

    schema = pa.schema([("h", pa.int64()), ("kind", pa.int64()), ("c", pa.int64())])

    def top(batches):
        for _, blobs in by_bucket(batches):
            h, kind, c = merged(*unpack_all(blobs, COUNTS)[:-1])
            h = h.view(np.int64)
            first = np.lexsort((h, -c))[:keep]
            yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (h, kind, c)], schema=schema)

    rows = (dealt(train.select("text").mapInArrow(count, BLOBS), parts).mapInArrow(top, "h long, kind long, c long")
            .orderBy(F.desc("c"), "h").limit(keep).collect())
    h, kind, c = (np.array([r[k] for r in rows], np.int64) for k in ("h", "kind", "c"))
    return h.view(np.uint64), kind, c


# Cells of a counted array in one row, and rows of one slice that are added before the last step.
STEP = 1 << 16
FAN = 32


def slices(total: np.ndarray, step: int = STEP) -> pa.RecordBatch:
    """A counted array as rows (slice, counts), without slices of zeros."""
    return batch(BLOB, [(k // step, zstandard.compress(total[k:k + step].astype(np.int64).tobytes(), 1))
                        for k in range(0, len(total), step) if total[k:k + step].any()])


def opened(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bytes(blob)), np.int64)


def added(counts: DataFrame) -> DataFrame:
    """Slices of all tasks added up: one row per slice, in two steps, so that no task takes all."""
    def add(batches):
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                whole[k] = whole.get(k, 0) + opened(blob.as_py())
        yield batch(BLOB, [(k, zstandard.compress(v.tobytes(), 1)) for k, v in whole.items()])

    fanned = counts.select("bucket", "blob", (F.spark_partition_id() % FAN).alias("fan")).repartition("bucket", "fan")
    return fanned.select("bucket", "blob").mapInArrow(add, BLOBS).repartition("bucket").mapInArrow(add, BLOBS)


def gathered(counts: DataFrame, size: int) -> np.ndarray:
    """The whole counted array; its size is fixed by parameters."""
    out = np.zeros(size, np.int64)
    for r in added(counts).collect():
        v = opened(r["blob"])
        out[r["bucket"] * STEP:r["bucket"] * STEP + len(v)] = v
    return out


def bigrams(values: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(value before, value) of every word and end of all texts, text by text."""
    s, first = with_ends(values, rows, end)
    inside = np.ones(max(len(s) - 1, 0), bool)
    inside[first[1:] - 1] = False
    return s[:-1][inside], s[1:][inside]


def counted(train: DataFrame, known: Lookup, heads: int) -> np.ndarray:
    """Counts of neighbouring heads, open classes and ends over all training texts."""
    size = heads + OPEN + 1

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for block in blocks(batches, "text"):
            w = words(block, lower=True)
            place = known(w.hash)
            symbol = np.where((place >= 0) & (place < heads), place, heads + open_class(block, w))
            before, after = bigrams(symbol, w.rows, size - 1)
            code, n = np.unique(before * size + after, return_counts=True)
            total[code] += n
        yield slices(total)

    return gathered(train.select("text").mapInArrow(count, BLOBS), size * size).reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of every symbol: the first ``movable`` are clustered, the others stay alone."""
    fixed = len(counts) - movable
    classes = max(1, min(classes, movable)) if movable else 0
    klass = np.r_[np.arange(movable) % max(classes, 1), classes + np.arange(fixed)].astype(np.int64)
    total = classes + fixed
    counts = counts.astype(np.float64)
    member = np.zeros((len(counts), total))
    member[np.arange(len(counts)), klass] = 1
    pair = member.T @ counts @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a, self_ = klass[w], counts[w, w]
            after = np.bincount(klass, counts[w], total)     # w before a class
            before = np.bincount(klass, counts[:, w], total)
            after[a] -= self_
            before[a] -= self_
            pair[a] -= after
            pair[:, a] -= before
            pair[a, a] -= self_
            own = slice(0, classes)
            row = xlogx(pair[own] + after) - xlogx(pair[own])
            col = xlogx(pair[:, own].T + before) - xlogx(pair[:, own].T)
            diag = np.arange(classes)
            corner = pair[diag, diag]
            gain = (row.sum(1) - row[diag, diag] + col.sum(1) - col[diag, diag]
                    + xlogx(corner + after[own] + before[own] + self_) - xlogx(corner))
            # what stands beside the word is there whatever class the word takes
            left, right = (pair.sum(1) + before)[own], (pair.sum(0) + after)[own]
            gain -= xlogx(left + after.sum() + self_) - xlogx(left)
            gain -= xlogx(right + before.sum() + self_) - xlogx(right)
            b = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else int(a)
            klass[w] = b
            pair[b] += after
            pair[:, b] += before
            pair[b, b] += self_
            moved += b != a
        if not moved:
            break
    return klass


def reassigned(word: np.ndarray, context: np.ndarray, count: np.ndarray, home: np.ndarray, table: np.ndarray,
               margins: Sequence[np.ndarray], learned: int) -> np.ndarray:
    """One exchange of every word against fixed class counts: a learned class, or ``home``.

    word, context, count: sorted rows; home: class of each distinct word; table: counts of contexts
    with classes; margins: counts of classes, one array for each side that contexts come from.
    """
    out = home.copy()
    begin = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)] if len(word) else np.zeros(1, np.int64)
    step = 512
    for lo in range(0, len(begin) - 1 if learned else 0, step):
        cuts = begin[lo:lo + step + 1]
        ctx, n, h = context[cuts[0]:cuts[-1]], count[cuts[0]:cuts[-1]].astype(np.float64), home[lo:lo + step]
        at = cuts[:-1] - cuts[0]
        into, own = table[ctx, :learned], table[ctx, np.repeat(h, np.diff(cuts))]
        gain = np.add.reduceat(xlogx(into + n[:, None]) - xlogx(into), at)
        stay = np.add.reduceat(xlogx(own) - xlogx(own - n), at)
        total = np.add.reduceat(n, at) / len(margins)
        for m in margins:
            gain -= xlogx(m[:learned] + total[:, None]) - xlogx(m[:learned])
            stay -= xlogx(m[h]) - xlogx(m[h] - total)
        best = gain.argmax(1)
        out[lo:lo + step] = np.where(gain.max(1) > stay + 1e-9, best, h)
    return out


def exchanged(train: DataFrame, model: Model, heads: int, pair: np.ndarray, least: int) -> np.ndarray:
    """Class of every frequent word behind the heads, from the classes on both of its sides."""
    size, many = model.size, len(model.words) - heads
    shared = train.sparkSession.sparkContext.broadcast((model, pair))
    step = max(1, STEP // (2 * size)) * 2 * size  # whole words in every slice

    def count(batches):
        m = shared.value[0]
        total, tokens = np.zeros(many * 2 * size, np.int32), 0
        for block in blocks(batches, "text"):
            w = words(block, lower=True)
            place = m.words(w.hash)
            s, _ = with_ends(visible(m, place, open_class(block, w)), w.rows, size - 1)
            own = np.flatnonzero(place >= heads)
            at, cell = own + 2 * w.row_of()[own] + 1, (place[own] - heads) * 2 * size
            code, n = np.unique(np.r_[cell + s[at - 1], cell + size + s[at + 1]], return_counts=True)
            tokens += len(w.hash)
            if tokens >= 1 << 31:
                yield slices(total, step)
                total[:], tokens = 0, len(w.hash)
            total[code] += n.astype(np.int32)
        yield slices(total, step)

    schema = pa.schema([("place", pa.int64()), ("klass", pa.int64())])

    def move(batches):
        m, counts = shared.value
        table, margins = np.vstack([counts, counts.T]), [counts.sum(0), counts.sum(1)]
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                cells = opened(blob.as_py()).reshape(-1, 2 * size)
                cells = np.where(cells[:, :size].sum(1, keepdims=True) >= least, cells, 0)
                word, context = np.nonzero(cells)
                place = heads + k * (step // (2 * size)) + np.unique(word)
                klass = reassigned(word, context, cells[word, context], m.klass[place], table, margins, m.learned)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(klass)], schema=schema)

    klass = model.klass.copy()
    if many and model.learned:
        for r in added(train.select("text").mapInArrow(count, BLOBS)).mapInArrow(move, "place long, klass long").collect():
            klass[r["place"]] = r["klass"]
    return klass


def visible(m: Model, place: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The class a word shows to the next one: its own, or its open class outside the frequent words."""
    return np.where(place >= 0, np.r_[m.klass, 0][place], m.learned + kind)


def fit(train: DataFrame, heads: int, classes: int, frequent: int, sweeps: int, least: int, parts: int) -> Model:
    hashes, kinds, count = frequent_words(train, frequent, parts)
    known = Lookup(hashes)
    kinds, count = kinds[known.kept], count[known.kept]
    heads = min(heads, len(known))
    counts = counted(train, known, heads)
    klass = exchange(counts, heads, classes, sweeps)
    learned = int(klass[heads])
    model = Model(known, count, np.r_[klass[:heads], learned + kinds[heads:]], learned)
    member = np.zeros((len(counts), model.size))
    member[np.arange(len(counts)), klass] = 1
    model.klass = exchanged(train, model, heads, member.T @ counts @ member, least)
    return model


def chances(model: Model, pair: np.ndarray, distinct: np.ndarray) -> Chances:
    """pair: training counts of (context, class); distinct: training words of each class."""
    k = model.size
    arrive = pair.sum(0)
    base = (arrive + 1) / (arrive.sum() + k)
    varied = np.maximum((pair > 0).sum(1, keepdims=True), 1)
    transition = np.log10((pair + varied * base) / (pair.sum(1, keepdims=True) + varied))
    unseen = np.r_[np.zeros(model.learned), np.ones(OPEN), 0]
    return Chances(transition, np.log10(np.maximum(arrive + distinct + unseen, 1)), int(arrive[-1]), int(arrive.sum()))


TAIL = (np.uint64, np.int64, np.int64, np.uint8, np.uint16)
BEYOND = (np.uint64, np.uint16, np.uint8, np.uint32)
CLASSED = (np.uint64, np.int64, np.uint16)
SUMS = (np.int64, np.int64, np.int64, np.int64, np.int64, np.float64, np.float64)


def score(docs: DataFrame, train: Column, heads: int = 2048, classes: int = 64, frequent: int = 1 << 16,
          sweeps: int = 3, least: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (unigrams), score (class bigrams).

    ``train`` is true for the rows to learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(text).alias("rid"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.col(text).alias("text"))
    parts = max(8, text_bytes(rows) >> 25)
    buckets = 16 * parts
    model = fit(rows.filter("train"), heads, classes, frequent, sweeps, least, parts)
    k, learned = model.size, model.learned
    shared = spark.sparkContext.broadcast(model)

    def show(batches):
        """Class bigrams of training texts as the words show."""
        m = shared.value
        total = np.zeros(k * k, np.int64)
        for block in blocks(batches, "text"):
            w = words(block, lower=True)
            before, after = bigrams(visible(m, m.words(w.hash), open_class(block, w)), w.rows, k - 1)
            total += np.bincount(before * k + after, minlength=k * k)
        yield slices(total)

    learn = rows.filter("train").select("text")
    shown = gathered(learn.mapInArrow(show, BLOBS), k * k).reshape(k, k)
    start = spark.sparkContext.broadcast(shown.astype(np.float64))

    def dealt_words(arrays: list[np.ndarray]) -> list[tuple[int, bytes]]:
        key = (arrays[0] % np.uint64(buckets)).astype(np.int64)
        return [(int(b), pack(a)) for b, a in by_key(key, arrays)]

    def beyond(batches):
        """Training counts of (word outside the frequent ones, context)."""
        m = shared.value
        for block in blocks(batches, "text"):
            w = words(block, lower=True)
            place, kind = m.words(w.hash), open_class(block, w)
            before, _ = bigrams(visible(m, place, kind), w.rows, k - 1)
            rare = np.flatnonzero(place < 0)
            own, index, word = np.unique(w.hash[rare], return_index=True, return_inverse=True)
            code, n = np.unique(word * k + before[rare + w.row_of()[rare]], return_counts=True)
            yield batch(BLOB, dealt_words([own[code // k], (code % k).astype(np.uint16),
                                           kind[rare][index][code // k].astype(np.uint8), n.astype(np.uint32)]))

    def move(batches):
        """Class and count of the words of each bucket, and what the classes change in the bigrams.

        Rows (bucket, words), and in negative buckets slices of the changes and words of each class.
        """
        change, distinct = np.zeros(k * k, np.int64), np.zeros(k, np.int64)
        for bucket, blobs in by_bucket(batches):
            h, before, kind, n, _ = unpack_all(blobs, BEYOND)
            own, index, word = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(word, n, len(own)).astype(np.int64)
            home = learned + kind[index].astype(np.int64)
            klass = home.copy()
            code, at = np.unique(word * k + before, return_inverse=True)
            n = np.bincount(at, n, len(code)).astype(np.int64)
            word, before = code // k, code % k
            many = c[word] >= least
            chosen = np.unique(word[many])
            klass[chosen] = reassigned(word[many], before[many], n[many], home[chosen], start.value,
                                       [start.value.sum(0)], learned)
            np.add.at(change, before * k + klass[word], n)
            np.subtract.at(change, before * k + home[word], n)
            distinct += np.bincount(klass, minlength=k)
            yield batch(BLOB, [(bucket, pack([own, c, klass.astype(np.uint16)]))])
        table = slices(np.r_[change, distinct])
        yield pa.RecordBatch.from_arrays([pa.array(-1 - table.column(0).to_numpy()), table.column(1)], schema=BLOB)

    classed = cut(dealt(learn.mapInArrow(beyond, BLOBS), parts).mapInArrow(move, BLOBS))
    changes = classed.filter("bucket < 0").select((-1 - F.col("bucket")).alias("bucket"), "blob")
    moved = gathered(changes, k * k + k)
    distinct = moved[k * k:] + np.bincount(model.klass, minlength=k)
    known = chances(model, shown + moved[:k * k].reshape(k, k), distinct)
    final = spark.sparkContext.broadcast(known)

    def home(arrays: list[np.ndarray]) -> list[tuple[int, bytes]]:
        key = (mix(arrays[0].view(np.uint64) ^ mix(arrays[1].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        return [(-1 - int(b), pack(a)) for b, a in by_key(key, arrays)]

    def read(batches):
        """Sums of the frequent words of every text, on their way home; all other words to their buckets."""
        m, p = shared.value, final.value
        log = np.r_[np.log10(m.count + 1.0), 0.0]
        emission = np.r_[log[:-1] - p.room[m.klass], 0.0]
        for block in blocks(batches, "text"):
            w, n = words(block, lower=True), block.n
            row, place, kind = w.row_of(), m.words(w.hash), open_class(block, w)
            doc, rid = block.ids(), block.column("rid")
            before, after = bigrams(visible(m, place, kind), w.rows, k - 1)
            at = np.arange(len(place)) + row
            slot = np.full(len(before), len(log) - 1, np.int64)  # ends: certain in their class
            slot[at] = place
            step = p.transition[before, after] + emission[slot]
            step[slot < 0] = 0  # scored in their buckets
            common, rare = place >= 0, np.flatnonzero(place < 0)
            out = home([doc, rid, np.ones(n, np.int64), np.diff(w.rows) + 1,
                        np.bincount(row[common], minlength=n).astype(np.int64) + int(p.ends > 0),
                        np.bincount(row[common], log[place[common]], n) + np.log10(p.ends + 1.0),
                        np.bincount(np.repeat(np.arange(n), np.diff(w.rows) + 1), step, n)])
            r = row[rare]
            yield batch(BLOB, out + dealt_words([w.hash[rare], doc[r], rid[r], kind[rare].astype(np.uint8),
                                                 before[at[rare]].astype(np.uint16)]))

    def rare(batches):
        p = final.value
        for bucket, blobs in by_bucket(batches):
            if bucket < 0:
                yield batch(BLOB, [(bucket, x) for x in blobs])
                continue
            lists = [x[1:] for x in blobs if x[:1] == b"\1"]
            own, c, klass, _ = unpack_all(lists, CLASSED)
            h, doc, rid, kind, before, _ = unpack_all([x[1:] for x in blobs if x[:1] != b"\1"], TAIL)
            at = np.searchsorted(own, h)
            seen = np.r_[own, np.uint64(0)][at] == h
            seen &= at < len(own)
            c = np.where(seen, np.r_[c, 0][at], 0)
            klass = np.where(seen, np.r_[klass, np.uint16(0)][at], learned + kind).astype(np.int64)
            order = np.lexsort((before, h, rid, doc))
            doc, rid, before, c, klass = (x[order] for x in (doc, rid, before, c, klass))
            at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])]) if len(doc) else order
            logs = np.log10(c + 1.0)
            whole = logs + p.transition[before, klass] - p.room[klass]
            none = np.zeros(len(at), np.int64)
            sums = [np.add.reduceat(x, at) if len(at) else x for x in ((c > 0).astype(np.int64), logs, whole)]
            yield batch(BLOB, home([doc[at], rid[at], none, none, *sums]))

    denominator = np.log10(known.tokens + int(distinct.sum()) + int(known.ends > 0) + 1.0)
    n_train = known.tokens

    def finish(batches):
        for _, blobs in by_bucket(batches):
            arrays = unpack_all(blobs, SUMS)[:-1]
            # Sums are added in one order, however the parts arrived.
            order = np.lexsort((arrays[6], arrays[5], arrays[1], arrays[0]))
            arrays = [a[order] for a in arrays]
            doc, rid = arrays[:2]
            at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])])
            copies, tokens, seen, logs, whole = (np.add.reduceat(a, at) for a in arrays[2:])
            base = logs - tokens * denominator
            # Equal rows have added up; each gets its share.
            each = np.repeat(np.arange(len(at)), copies)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at][each], mask=doc[at][each] == NO_ID), pa.array((tokens // copies)[each]),
                 pa.array((seen // copies)[each]), pa.array(np.full(len(each), n_train, np.int64)),
                 pa.array((base / copies)[each]), pa.array((whole / copies)[each])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # The first byte of a row tells classes of words (1) from their occurrences (0).
    occurring = rows.mapInArrow(read, BLOBS)
    occurring = occurring.select("bucket", F.when(F.col("bucket") < 0, F.col("blob")).otherwise(
        F.concat(F.lit(b"\0"), "blob")).alias("blob"))
    both = occurring.unionByName(
        classed.filter("bucket >= 0").select("bucket", F.concat(F.lit(b"\1"), "blob").alias("blob")))
    return dealt(dealt(both, parts).mapInArrow(rare, BLOBS), parts).mapInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
