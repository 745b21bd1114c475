"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages; their words are the vocabulary.  One pass over all
   documents counts in how many of them each word stands (inverse document frequency).
2. A randomised SVD of the TF-IDF passages, summed up from partitions of the benchmark (range
   finder with one power iteration), gives the latent space.
3. Windows of every document are projected into it.  A window whose benchmark words weigh too
   little to reach the cosine limit is passed over, which loses nothing: its cosine is at most
   that share.  Pairs above the limit are candidates, and so are windows that have ``covered`` of
   the places of a passage: an item that leaked into many documents has light words and a low
   cosine, but covers as much of a window as any other.
4. A candidate is a leak if the longest common subsequence of words with the surroundings of the
   window covers enough of the item, and the item's answer (its closing words, rare ones
   first) is there too or the subsequence is nearly the whole item.

The benchmark is worked through in rounds of at most ``per_round`` passages, so what is
broadcast has a fixed bound; every round reads all documents.  With ``rank`` at least
``per_round`` the latent space keeps every passage whole.

Defined results: null and empty texts hold no leak; null or empty items are nobody's leak;
null ids and repeated rows are judged like all others; extra columns are kept, but for one named ``leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_bucket, dealt
from .brown import Lookup
from .encode import ragged
from .words import Block, blocks, words

PASSAGE, WINDOW, STRIDE = 32, 64, 32
OVERSAMPLING, SEED = 8, 7
# Tasks of a sum over a round's passages, and numbers of a piece of it (1 MiB).
SUMS, PIECE = 4, 1 << 17


def lowered(batches):
    """The batches with a last column ``_lower``: the texts in small letters of any script."""
    for b in batches:
        text = pa.compute.utf8_lower(b.column(b.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "_lower"])


def lowered_blocks(batches):
    return blocks(lowered(batches), "_lower")


def text_words(text: str) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
    return words(next(blocks(lowered([batch]), "_lower", size=1 << 62)), lower=True).hash


def item_passages(hashes: np.ndarray) -> list[np.ndarray]:
    """Pieces of at most PASSAGE words; the last one ends with the item."""
    n = len(hashes)
    starts = [*range(0, max(n - PASSAGE, 0), PASSAGE), max(n - PASSAGE, 0)]
    return [hashes[s:s + PASSAGE] for s in starts]


def rounds(benchmark: DataFrame, per_round: int):
    """Lists of (item_id, word hashes) with at most per_round passages (an item is not cut)."""
    held, passages = [], 0
    rows = (benchmark.filter("item_id is not null and text is not null")
            .select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text"))
    for r in rows.toLocalIterator():
        h = text_words(r["text"])
        if not len(h):
            continue
        n = len(item_passages(h))
        if held and passages + n > per_round:
            yield held
            held, passages = [], 0
        held.append((r["item_id"], h))
        passages += n
    if held:
        yield held


def document_counts(docs: DataFrame, vocabulary: Lookup) -> tuple[np.ndarray, int]:
    """In how many documents each vocabulary word stands, and the number of documents."""
    size = len(vocabulary) + 1

    def count(batches):
        total = np.zeros(size, np.int64)
        for block in lowered_blocks(batches):
            w = words(block, lower=True)
            place = vocabulary(w.hash)
            hit = place >= 0
            key = np.unique(w.row_of()[hit].astype(np.int64) * size + place[hit])
            total += np.bincount(key % size, minlength=size)
            total[-1] += block.n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    total = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r["place"]] = r["n"]
    return total[:-1], int(total[-1])


class Postings:
    """For each word the passages that it counts for, and how much."""

    def __init__(self, word: np.ndarray, passage: np.ndarray, value: np.ndarray, words: int, passages: int):
        """Rows sorted by word."""
        self.passage, self.value = passage, value
        self.count = np.bincount(word, minlength=words)
        self.first = np.cumsum(self.count) - self.count
        self.passages = passages

    def sums(self, place: np.ndarray, stride: np.ndarray, strides: int) -> np.ndarray:
        """Sums (strides x passages) over words (places in the table) that stand in strides."""
        n = self.count[place]
        at = ragged(self.first[place], n)
        key = np.repeat(stride, n) * self.passages + self.passage[at]
        return np.bincount(key, self.value[at], strides * self.passages).reshape(strides, self.passages)


def latent_space(benchmark: DataFrame, low: int, high: int, vocabulary: Lookup, idf: np.ndarray,
                 rank: int) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages of items low to high."""
    terms = len(vocabulary)
    items = (benchmark.filter(F.col("item_id").between(low, high) & F.col("text").isNotNull())
             .select("item_id", "text").distinct().repartition(SUMS))

    def matrices(batches):
        for block in lowered_blocks(batches):
            w = words(block, lower=True)
            own = [p for a, b in zip(w.rows[:-1], w.rows[1:]) if b > a for p in item_passages(w.hash[a:b])]
            for k in range(0, len(own), 256):
                a = np.zeros((len(own[k:k + 256]), terms))
                for i, p in enumerate(own[k:k + 256]):
                    place, tf = np.unique(vocabulary(p), return_counts=True)
                    a[i, place[place >= 0]] = np.log2(1 + tf[place >= 0]) * idf[place[place >= 0]]
                yield a

    def added(batches):
        for piece, sums in by_bucket(batches):
            # In a fixed order, so that a rerun adds alike.
            total = sum(np.frombuffer(x) for x in sorted(sums))
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([total.tobytes()], pa.binary())], names=["bucket", "blob"])

    def summed(step):
        """Sum over all partitions of step(matrix of passages), an array; the driver gets the sum alone, piece by piece."""
        def partial(batches):
            total = None
            for a in matrices(batches):
                x = step(a)
                total = x if total is None else total + x
            for k, lo in enumerate(range(0, 0 if total is None else total.size, PIECE)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.ravel()[lo:lo + PIECE].tobytes()], pa.binary())],
                                                 names=["bucket", "blob"])

        rows = "bucket long, blob binary"
        # Read in a few parts, into however many the pieces were dealt.
        pieces = dealt(items.mapInArrow(partial, rows), SUMS).mapInArrow(added, rows).coalesce(SUMS)
        found = {r["bucket"]: np.frombuffer(r["blob"]) for r in pieces.toLocalIterator()}
        return np.concatenate([found[k] for k in sorted(found)])

    r = min(rank + OVERSAMPLING, terms)
    draw = lambda: np.random.default_rng(SEED).standard_normal((terms, r))
    q = np.linalg.qr(summed(lambda a: a.T @ (a @ draw())).reshape(terms, r))[0]
    both = summed(lambda a: (a @ q).T @ np.c_[a @ q, a]).reshape(r, r + terms)
    size, turn = np.linalg.eigh(both[:, :r])
    good = size > max(size.max(), 1e-300) * 1e-10
    b = (turn[:, good].T @ both[:, r:]) / np.sqrt(size[good])[:, None]
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    return vt[:min(rank, int((s > s.max() * 1e-6).sum()))].T


class Index:
    """One round of the benchmark: vocabulary, weights, latent space, items.

    Words outside the vocabulary weigh ``unknown`` each in the length of a window.
    """

    def __init__(self, items, vocabulary, idf, unknown, space, covered):
        self.items, self.vocabulary, self.idf, self.unknown = items, vocabulary, idf, unknown
        self.space = space.astype(np.float32)
        owner, latent = [], []
        for k, (_, h) in enumerate(items):
            for p in item_passages(h):
                place, tf = np.unique(vocabulary(p), return_counts=True)
                place, tf = place[place >= 0], tf[place >= 0]
                v = (self.space[place] * (np.log2(1 + tf) * idf[place])[:, None]).sum(0)
                owner.append(k)
                latent.append(v / max(float(np.linalg.norm(v)), 1e-30))
        self.owner, self.latent = np.array(owner), np.array(latent, np.float32).reshape(len(owner), -1)
        # What a word can add to the cosine with each passage, times the window's length.  Words of
        # many documents add little; for them, and where next to nothing is added, the most counts.
        terms, word, passage, value = len(idf) - 1, [], [], []
        self.rest = np.zeros(terms + 1)
        for lo in range(0, terms, 256):  # some words at a time: no table of all words and passages
            own = slice(lo, min(lo + 256, terms))
            gain = (np.abs(self.space[own] @ self.latent.T) * idf[own][:, None]).astype(np.float64)
            listed = (gain > 1e-4 * gain.max(1, keepdims=True, initial=0)) & (idf[own] > 0.25 * unknown)[:, None]
            row, at = np.nonzero(listed & (gain != 0))
            word.append(row + lo)
            passage.append(at)
            value.append(gain[row, at])
            self.rest[own] = np.where(listed, 0.0, gain).max(1, initial=0)
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, passage, value)]
        self.gain = Postings(*joined, terms, len(self.latent))
        self.cover, self.least = self._cover(covered)
        self.answers = [self._answer(h) for _, h in items]

    def _cover(self, covered: float) -> tuple[Postings, np.ndarray]:
        """The rarest words of each passage, and how many of their places a window has that has
        the share ``covered`` of all places of the passage: all but those it may lack."""
        passages = [p for _, h in self.items for p in item_passages(h)]
        self.terms, self.need = [], []
        word, passage, value, least = [], [], [], np.zeros(len(passages))
        for k, p in enumerate(passages):
            place, tf = np.unique(self.vocabulary(p), return_counts=True)
            place, tf = place[place >= 0], tf[place >= 0]
            need = int(np.ceil(covered * len(p)))
            self.terms.append((place, tf))
            self.need.append(need)
            lack = len(p) - need  # words that are not in the vocabulary count as lacking or not at all
            order = np.argsort(-self.idf[place], kind="stable")
            upto = int(np.searchsorted(np.cumsum(tf[order]), lack + (need + 1) // 2)) + 1
            word.append(place[order[:upto]])
            passage.append(np.full(len(word[-1]), k))
            value.append(tf[order[:upto]].astype(float))
            least[k] = max(value[-1].sum() - lack, 1)
        self.need = np.array(self.need)
        self.size = np.array([len(t) for t, _ in self.terms])
        self.begin = np.cumsum(self.size) - self.size
        self.terms = [np.concatenate(x) for x in zip(*self.terms)]
        word, passage, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, passage, value))
        order = np.lexsort((passage, word))
        return Postings(word[order], passage[order], value[order], len(self.idf) - 1, len(passages)), least

    def _held(self, pairs: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How many places of the passage each pair (window, passage) shares, given the sorted
        keys (window, word)."""
        n = self.size[pairs[:, 1]]
        at = ragged(self.begin[pairs[:, 1]], n)
        pair = np.repeat(np.arange(len(pairs)), n)
        want = pairs[pair, 0] * len(self.idf) + self.terms[0][at]
        found = np.searchsorted(key, want)
        there = (found < len(key)) & (key[np.minimum(found, len(key) - 1)] == want) if len(key) else np.zeros(len(want), bool)
        return np.bincount(pair, self.terms[1][at] * there, len(pairs))

    def _answer(self, h: np.ndarray) -> np.ndarray:
        """The rarer half of the closing quarter (four words at least)."""
        tail = np.unique(h[-max(4, len(h) // 4):])
        place = self.vocabulary(tail)
        weight = np.where(place >= 0, self.idf[place], self.unknown)
        return tail[np.argsort(-weight, kind="stable")[:max(1, (len(tail) + 1) // 2)]]

    def candidates(self, w, rows: np.ndarray, limit: float):
        """(row, first word of the window, item, cosine) of window and item pairs that are above the
        limit or share enough places of a passage, whatever these words weigh."""
        n = np.diff(rows)
        count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        if not len(row):
            return []
        start = rows[:-1][row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) * STRIDE
        end = np.minimum(start + WINDOW, rows[1:][row])
        place = self.vocabulary(w.hash)
        known = np.where(place >= 0, self.idf[place], 0.0)
        # Upper bound of the cosine from sums.  A word that stands f times counts log2(1 + f), at
        # most f in the product and, squared, at least 0.56 * f (f up to 64) in the length.
        square, rest = (np.r_[0, np.cumsum(x)] for x in (known ** 2, np.where(place >= 0, self.rest[place], 0.0)))
        unknown = np.r_[0, np.cumsum(place < 0)]
        inside = square[end] - square[start]
        outside = (unknown[end] - unknown[start]) * self.unknown ** 2
        rest = rest[end] - rest[start]
        lowest = limit * np.sqrt(0.56 * inside + outside)
        out = []
        for lo in range(0, len(row), 2048):
            hi = min(lo + 2048, len(row))
            # A window is its own stride and the next one.
            at = ragged(start[lo:hi], np.minimum(STRIDE, end[lo:hi] - start[lo:hi]))
            first = np.repeat(np.arange(hi - lo), np.minimum(STRIDE, end[lo:hi] - start[lo:hi]))
            after = ragged(start[lo:hi] + STRIDE, np.maximum(end[lo:hi] - start[lo:hi] - STRIDE, 0))
            # The next stride is the next window's own, but for the last window of a row.
            last = np.r_[row[lo + 1:hi] != row[lo:hi - 1], True]
            second = np.repeat(np.arange(hi - lo), np.maximum(end[lo:hi] - start[lo:hi] - STRIDE, 0))
            after, second = after[last[second]], second[last[second]] + hi - lo
            words_at, stride = np.r_[at, after], np.r_[first, second]
            hit = place[words_at] >= 0
            words_at, stride = place[words_at[hit]], stride[hit]

            def summed(postings):
                x = postings.sums(words_at, stride, 2 * (hi - lo))
                own, ends = x[:hi - lo], x[hi - lo:]
                ends[:-1][~last[:-1]] = own[1:][~last[:-1]]
                return own + ends

            pairs = np.argwhere(summed(self.cover) >= self.least)
            near = (summed(self.gain).max(1) + rest[lo:hi]) * (1 + 1e-5) + 1e-6 >= lowest[lo:hi]
            use = lo + np.union1d(np.flatnonzero(near & (inside[lo:hi] > 0)), pairs[:, 0])
            at = ragged(start[use], end[use] - start[use])
            owner = np.repeat(np.arange(len(use)), end[use] - start[use])
            hit = place[at] >= 0
            key, tf = np.unique(owner[hit] * len(self.idf) + place[at][hit], return_counts=True)
            # Repeated words of a window have counted more than once; now each counts once.
            enough = np.zeros((len(use), len(self.owner)), bool)
            pairs[:, 0] = np.searchsorted(use, pairs[:, 0] + lo)
            pairs = pairs[self._held(pairs, key) >= self.need[pairs[:, 1]]]
            enough[pairs[:, 0], pairs[:, 1]] = True
            far = ~near[use - lo]
            far[pairs[:, 0]] = False
            keep = ~far[key // len(self.idf)]
            key, tf = key[keep], tf[keep]
            if not len(key):
                continue
            owner, term = key // len(self.idf), key % len(self.idf)
            value = np.log2(1 + tf) * self.idf[term]
            norm = np.sqrt(np.bincount(owner, value ** 2, len(use)) + outside[use])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            latent = np.add.reduceat(self.space[term] * value[:, None].astype(np.float32), first)
            which = owner[first]
            cosine = latent @ self.latent.T / np.maximum(norm[which], 1e-30)[:, None]
            for i, p in zip(*np.nonzero((cosine >= limit) | enough[which])):
                k = use[which[i]]
                out.append((int(row[k]), int(start[k]), int(self.owner[p]), float(cosine[i, p])))
        return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def leaks_of(block: Block, index: Index, cosine: float, ordered: float, answered: float, whole: float):
    """For each row the leaks (item_id, cosine, lcs, answer)."""
    w = words(block, lower=True)
    best: dict[tuple[int, int], tuple] = {}
    tried: set[tuple[int, int, int]] = set()
    for row, start, item, near in index.candidates(w, w.rows, cosine):
        if (row, start, item) in tried:
            continue
        tried.add((row, start, item))
        item_id, h = index.items[item]
        around = w.hash[max(w.rows[row], start - len(h)):min(w.rows[row + 1], start + WINDOW + len(h))]
        lcs = common_subsequence(h, around) / len(h)
        if lcs < ordered:
            continue
        answer = float(np.isin(index.answers[item], around).mean())
        if answer < answered and lcs < whole:
            continue
        key = (row, item)
        best[key] = max(best.get(key, (0.0,)), (lcs, answer, near, int(item_id)))
    out: list[list[dict]] = [[] for _ in range(block.n)]
    for (row, _), (lcs, answer, near, item_id) in sorted(best.items()):
        out[row].append({"item_id": item_id, "cosine": near, "lcs": lcs, "answer": answer})
    return out


LEAKS = "array<struct<item_id:long,cosine:double,lcs:double,answer:double>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 512, per_round: int = 512, cosine: float = 0.15,
               ordered: float = 0.6, answered: float = 0.5, whole: float = 0.8, covered: float = 0.4) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items that each text holds."""
    spark, docs = docs.sparkSession, docs.drop("leaks")
    names = [f.name for f in docs.schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()),
                               ("answer", pa.float64())]))
    out = docs.withColumn("leaks", F.array().cast(LEAKS))
    for items in rounds(benchmark, per_round):
        vocabulary = Lookup(np.unique(np.concatenate([h for _, h in items])))
        seen, total = document_counts(docs, vocabulary)
        idf = np.log((total + 1) / (seen + 1)) + 1e-3
        # No more directions than passages: the range finder has nothing to find beyond them.
        most = min(rank, sum(len(item_passages(h)) for _, h in items))
        space = latent_space(benchmark, items[0][0], items[-1][0], vocabulary, idf, most)
        index = spark.sparkContext.broadcast(
            Index(items, vocabulary, np.r_[idf, 0.0], 0.6 * float(np.log(total + 1)), space, covered))

        def search(batches, index=index):
            for block in lowered_blocks(batches):
                found = leaks_of(block, index.value, cosine, ordered, answered, whole)
                before = block.rows.column(block.rows.schema.get_field_index("leaks")).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    list(block.rows.columns[:len(names)]) + [pa.array([a + b for a, b in zip(before, found)], kind)],
                    names=names + ["leaks"])

        out = out.mapInArrow(search, f"{ddl}, leaks {LEAKS}")
    return out
