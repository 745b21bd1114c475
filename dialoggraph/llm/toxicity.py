"""Counterfactual-regularised toxicity classifier.

A logistic model over indicators of words and of the beginnings of words.  For every labelled
text that names a group, a twin is made in which each identity term is swapped for another of
its kind; the fit adds ``penalty`` times the squared difference of the two scores.  So a
mention as such moves the score little, and neutral mentions stay below the limit.

The fit takes a bounded sample of labelled rows (``most``: negatives, positives); weights give
the sample the class shares of all labelled training rows.  Scoring is one pass over whole
texts without a shuffle.

Defined results: null and empty texts score what the intercept gives; null ids stay null and
are never learned from; labels other than 0 and 1 are ignored; repeated rows score alike; extra
columns are kept, but for those named like an output; without labelled texts of both classes every score is the share of label 1 (0.0
if there is no label).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import Sparse, collected, counted, distinct_sums, feature_table, labelled_sample, sigmoid
from .words import _BYTE_LOWER, Block, blocks, prefix_hash, span_hash, word_spans

DIM = 1 << 20
BEGINNINGS = (4, 5, 6)

# Identity terms by kind; a swap stays within its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "extranjeros"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "étrangers"),
)

_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def swaps(kinds=IDENTITY_TERMS) -> dict[str, str]:
    return {t: kind[(k + 1) % len(kind)] for kind in kinds for k, t in enumerate(kind)}


def swapped(text: str, terms: dict[str, str], pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: terms[m[0].lower()], text)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all words without their outer punctuation, and of their beginnings."""
    start, end, rows = word_spans(block)
    row = np.repeat(np.arange(block.n), np.diff(rows))
    start, end = start.copy(), end.copy()
    todo = np.arange(len(start))
    while len(todo):  # until no word ends in punctuation
        todo = todo[_EDGE[block.data[end[todo] - 1]]]
        end[todo] -= 1
        todo = todo[end[todo] > start[todo]]
    todo = np.flatnonzero(end > start)
    while len(todo):
        todo = todo[_EDGE[block.data[start[todo]]]]
        start[todo] += 1
        todo = todo[end[todo] > start[todo]]
    full = end > start
    start, end, row = start[full], end[full], row[full]
    prefix = prefix_hash(block.data, _BYTE_LOWER)
    found, owner = [span_hash(prefix, start, end)], [row]
    for k in BEGINNINGS:
        more = end - start > k
        found.append(span_hash(prefix, start[more], start[more] + k) ^ np.uint64(k))
        owner.append(row[more])
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


def feature_rows(block: Block) -> list[np.ndarray]:
    row, feature = features(block)
    key = np.unique(row * DIM + feature)
    return np.split(key % DIM, np.searchsorted(key // DIM, np.arange(1, block.n)))


def chosen(each: np.ndarray, seen: np.ndarray, selected: int) -> np.ndarray:
    """Features whose shares in the two classes differ most, and by three standard deviations at least."""
    rate = [(s + np.float32(0.5)) / np.float32(n + 1) for s, n in zip(seen, each)]
    z = np.abs(rate[1] - rate[0]) / np.sqrt(rate[0] * (1 - rate[0]) / each[0] + rate[1] * (1 - rate[1]) / each[1])
    z[(seen[0] + seen[1] < 3) | ~(z > 3)] = 0
    keep = np.zeros(len(z), bool)
    keep[np.argsort(-z, kind="stable")[:selected]] = True
    return keep & (z > 0)


def fit(y: np.ndarray, x: Sparse, own: Sparse, twin: Sparse, size: int, share: np.ndarray, penalty: float,
        ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and intercept; own, twin: features only of the texts, and only of their twins."""
    weight = (share / np.bincount(y, minlength=2))[y]
    w, b = np.zeros(size), float(np.log(share[1] / share[0]))
    scale, scale_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):  # gradient steps with per-feature rates
        g = weight * (sigmoid(x.dot(w) + b) - y)
        gap = weight * 2 * penalty * (own.dot(w) - twin.dot(w))
        grad = x.sums(g, size) + own.sums(gap, size) - twin.sums(gap, size) + ridge * w
        scale += grad ** 2
        w -= 0.5 * grad / np.sqrt(scale)
        scale_b += g.sum() ** 2
        b -= 0.5 * g.sum() / np.sqrt(scale_b)
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, most: tuple[int, int] = (10_000, 5_000),
             penalty: float = 1.0, ridge: float = 1e-5, selected: int = 1 << 14, rounds: int = 150,
             limit: float = 0.3, kinds=IDENTITY_TERMS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= limit).

    docs: doc_id, text; labels: doc_id, toxic; train: rows of labels to learn from.
    """
    docs = docs.drop("score", "predicted")
    sample, totals = labelled_sample(docs, labels, "toxic", train, most)
    terms = swaps(kinds)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")\b", re.I)

    def twins(batches):
        for block in blocks(batches, "text"):
            texts = [t or "" for t in block.rows.column(block.rows.schema.get_field_index("text")).to_pylist()]
            other = [swapped(t, terms, pattern) for t in texts]
            own = feature_rows(block)
            twin_block = next(blocks(iter([pa.RecordBatch.from_arrays([pa.array(other, pa.string())], ["text"])]),
                                     size=1 << 62))
            twin = feature_rows(twin_block)
            yield block.column("y"), [own, [np.setdiff1d(a, b) for a, b in zip(own, twin)],
                                      [np.setdiff1d(b, a) for a, b in zip(own, twin)]]

    # Twice through the written sample: the driver holds the chosen features only.
    table, share = feature_table(sample, twins, 3), totals / max(totals.sum(), 1)
    each, seen = counted(table, DIM)
    if (each > 0).all():
        keep = chosen(each, seen, selected)
        del seen
        used = np.flatnonzero(keep)
        y, (x, own, twin) = collected(table, 3, keep)
        w, b = fit(y, x, own, twin, len(used), share, penalty, ridge, rounds)
    else:
        used, w = np.zeros(0, np.int64), np.zeros(0)
        b = float(np.log(max(share[1], 1e-12) / max(1 - share[1], 1e-12)))
    model = docs.sparkSession.sparkContext.broadcast((used, w, b))  # at most ``selected`` weights

    def scoring(batches):
        index, value, intercept = model.value
        weights = np.zeros(DIM)
        weights[index] = value
        for block in blocks(batches, "text"):
            row, feature = features(block)
            total, _ = distinct_sums(row, feature, weights, block.n)
            cols = [c for c in block.rows.columns]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(sigmoid(total + intercept))], names=block.rows.schema.names + ["score"])

    out = F.when(F.col("score") >= limit, 1).otherwise(0)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(scoring, ddl).withColumn("predicted", out)
