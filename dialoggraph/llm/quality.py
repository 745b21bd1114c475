"""Naive Bayes support vectors over n-gram indicators.

n-grams: one and two words; one to three word forms (capitals, last sign, length, same as the
word before).  Indicators are scaled by the log-count ratio of the two classes, rows by the
root of their number of n-grams, and a linear hinge-loss model is fitted by dual coordinate
descent.  A part of the sample that the model has not seen maps margins to probabilities.

The fit takes a bounded sample of labelled rows (``most``: label 0, label 1).  Scoring is one
pass over whole texts without a shuffle.

Defined results: null and empty texts have no n-grams and score what margin 0 maps to; null ids
stay null and are never learned from; labels other than 0 and 1 are ignored; repeated rows
score alike; extra columns are ignored; without labelled texts of both classes every score is the share
of label 1 (0.0 if there is no label).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import Sparse, collected, distinct_sums, feature_table, labelled_sample, sigmoid
from .words import Block, blocks, mix, window_hash, window_starts, words

DIM = 1 << 20

_SIGN = np.zeros(256, np.uint8)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all n-grams."""
    w = words(block, lower=False)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = w.row_of()
    capitals = np.r_[0, np.cumsum(_CAPITAL[block.data], dtype=np.int64)]
    high = capitals[w.end] - capitals[w.start]
    size = w.end - w.start
    case = np.where(high == 0, 0, np.where(2 * high > size, 2, 1))
    last = block.data[w.end - 1].astype(np.int64)
    sign = np.where(_SIGN[last] == 1, last, np.where((last >= 48) & (last < 58), 1, 0))
    again = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])]
    form = (((sign * 3 + case) * 8 + np.minimum(size // 4, 7)) * 2 + again).astype(np.uint64)
    form = mix(form + np.uint64(0x0123456789ABCDEF))
    found, owner = [], []
    for values, width, seed in ((w.hash, 1, 1), (w.hash, 2, 2), (form, 1, 3), (form, 2, 4), (form, 3, 5)):
        start, r = window_starts(w.rows, width)
        found.append(window_hash(values, width, seed)[start] >> np.uint64(44))
        owner.append(r)
    return np.concatenate(owner).astype(np.int64), np.concatenate(found).astype(np.int64)


def descend(x: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, epochs: int,
            size: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss with upper bounds ``cost``; weights, intercept.

    x: for each row its features and their values; the intercept is a feature of value 1.
    """
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(x))
    square = np.array([float(v @ v) + 1.0 for _, v in x])
    order = np.random.default_rng(6)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(x)):
            f, v = x[i]
            grad = sign[i] * (float(w[f] @ v) + b) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * v
                b += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, b


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic map of margins, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([g @ margin + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        hess = np.array([[h @ margin ** 2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(y: np.ndarray, x: Sparse, totals: np.ndarray, least: int, cost: float,
        epochs: int) -> tuple[np.ndarray, float, float, float]:
    """Weights (ratios included), intercept, slope and shift of the logistic map."""
    if np.bincount(y, minlength=2).min() == 0 or not (totals > 0).all():
        p = totals[1] / totals.sum() if totals.sum() else 0.0
        return np.zeros(DIM), 0.0, 1.0, float(np.log(max(p, 1e-12) / max(1 - p, 1e-12)))
    kept_back = np.arange(len(y)) % 5 == 0
    kept_back &= np.bincount(y[~kept_back], minlength=2).min() > 0
    known = x.row_of()
    seen = [np.bincount(x.index[((y == k) & ~kept_back)[known]], minlength=DIM) for k in (0, 1)]
    p, q = seen[1] + 1.0, seen[0] + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[seen[0] + seen[1] < least] = 0
    x = x.only(ratio != 0)
    rows = []
    for i in range(len(y)):
        f = x.row(i)
        rows.append((f, ratio[f] / np.sqrt(max(len(f), 1))))
    share = totals / totals.sum()
    train = np.flatnonzero(~kept_back)
    each = np.bincount(y[train], minlength=2)
    bound = cost * (len(train) / 2 / each)[y[train]]
    w, b = descend([rows[i] for i in train], np.where(y[train] == 1, 1.0, -1.0), bound, epochs, DIM)
    held = np.flatnonzero(kept_back) if kept_back.any() else train
    margin = np.array([float(w[f] @ v) + b for f, v in (rows[i] for i in held)])
    each = np.maximum(np.bincount(y[held], minlength=2), 1)
    slope, shift = calibrate(margin, y[held], (share / each * len(held))[y[held]])
    return w * ratio, b, slope, shift


def quality(docs: DataFrame, labels: DataFrame, train: Column, most: tuple[int, int] = (4_000, 8_000),
            least: int = 3, cost: float = 1.0, epochs: int = 20, limit: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= limit).

    docs: doc_id, text; labels: doc_id, quality; train: rows of labels to learn from.
    """
    docs = docs.drop("score", "predicted")
    sample, totals = labelled_sample(docs, labels, "quality", train, most)

    def gather(batches):
        for block in blocks(batches, "text"):
            row, feature = features(block)
            key = np.unique(row * DIM + feature)
            yield block.column("y"), [np.split(key % DIM, np.searchsorted(key // DIM, np.arange(1, block.n)))]

    y, (x,) = collected(feature_table(sample, gather, 1))
    # Alternate the classes, so that the part kept back has both.
    order = np.argsort(np.concatenate([np.arange((y == k).sum()) / max((y == k).sum(), 1) for k in (0, 1)])
                       if len(y) else y, kind="stable")
    y, x = y[order], Sparse([x.row(i) for i in order])
    w, b, slope, shift = fit(y, x, totals, least, cost, epochs)
    used = np.flatnonzero(w)
    model = docs.sparkSession.sparkContext.broadcast((used, w[used], b, slope, shift))

    def scoring(batches):
        index, value, intercept, a, c = model.value
        weights = np.zeros(DIM)
        weights[index] = value
        for block in blocks(batches, "text"):
            row, feature = features(block)
            total, n = distinct_sums(row, feature, weights, block.n)
            margin = np.where(n > 0, total / np.sqrt(np.maximum(n, 1)) + intercept, 0.0)
            yield pa.RecordBatch.from_arrays(
                list(block.rows.columns) + [pa.array(sigmoid(a * margin + c))],
                names=block.rows.schema.names + ["score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(scoring, ddl).withColumn("predicted", F.when(F.col("score") >= limit, 1).otherwise(0))
