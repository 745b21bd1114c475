"""What the two text classifiers share: bounded labelled samples, sparse rows, calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, picked

# Parts in which a bounded sample comes to the driver.
PARTS = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    most: tuple[int, int]) -> tuple[DataFrame, np.ndarray]:
    """Texts and labels of at most ``most[y]`` training rows of class y, chosen by a hash of
    the id, and how many training rows each class has.

    An id with several labels counts as its largest, an id with several texts gives its least;
    labels without a document do not count.
    """
    docs = picked(docs, "doc_id", "text")
    known = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & F.coalesce(train, F.lit(False)))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    known = cut(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    totals = np.zeros(2, np.int64)
    for r in known.groupBy("y").count().collect():
        totals[r["y"]] = r["count"]
    chosen = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    # At most sum(most) ids: a bound that the parameter sets.
    ids = F.broadcast(chosen[0].union(chosen[1]))
    return docs.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), totals


class Sparse:
    """Rows of feature numbers (indicators)."""

    def __init__(self, rows: list[np.ndarray]):
        self.offs = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.offs) - 1

    def row(self, i: int) -> np.ndarray:
        return self.index[self.offs[i]:self.offs[i + 1]]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offs))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of(), w[self.index], len(self)) if len(self) else np.zeros(0)

    def sums(self, g: np.ndarray, size: int) -> np.ndarray:
        """Transposed product: for each feature the sum of g over its rows."""
        return np.bincount(self.index, g[self.row_of()], size)

    def only(self, keep: np.ndarray) -> "Sparse":
        out = Sparse([])
        mask = keep[self.index]
        out.index = self.index[mask]
        out.offs = np.r_[0, np.cumsum(np.bincount(self.row_of()[mask], minlength=len(self)))]
        return out


def feature_table(sample: DataFrame, features: Callable, n: int) -> DataFrame:
    """y and n columns of feature numbers (32-bit integers) of a bounded sample, as a written table;
    features(batches) yields for each block the labels and n lists of index arrays."""
    schema = pa.schema([("y", pa.int32())] + [(f"f{k}", pa.binary()) for k in range(n)])

    def rows(batches):
        for y, lists in features(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32())] + [pa.array([r.astype(np.int32).tobytes() for r in x], pa.binary())
                                             for x in lists], schema=schema)

    ddl = "y int, " + ", ".join(f"f{k} binary" for k in range(n))
    # Written by all tasks at once; then read back in a few parts, one at a time.
    return cut(sample.mapInArrow(rows, ddl)).coalesce(PARTS)


def counted(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and in how many each feature of the first column stands."""
    each, seen = np.zeros(2, np.int64), np.zeros((2, size), np.int32)
    for r in table.select("y", "f0").toLocalIterator():
        each[r["y"]] += 1
        seen[r["y"], np.frombuffer(r["f0"], np.int32)] += 1
    return each, seen


def collected(table: DataFrame, n: int = 1, keep: np.ndarray | None = None) -> tuple[np.ndarray, list[Sparse]]:
    """Labels and n sparse matrices of a feature table, rows sorted; with ``keep`` only those
    features, numbered anew."""
    number = None if keep is None else (np.cumsum(keep) - 1).astype(np.int32)

    def kept(raw) -> bytes:
        if keep is None:
            return bytes(raw)
        f = np.frombuffer(raw, np.int32)
        return number[f[keep[f]]].tobytes()

    got = sorted((r["y"], *[kept(r[f"f{k}"]) for k in range(n)]) for r in table.toLocalIterator())
    return (np.array([r[0] for r in got], np.int64),
            [Sparse([np.frombuffer(r[k + 1], np.int32) for r in got]) for k in range(n)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def distinct_sums(row: np.ndarray, feature: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows the sum of weights, and the number, of its distinct weighted features."""
    use = weights[feature] != 0
    key = np.unique(row[use].astype(np.int64) * len(weights) + feature[use])
    r, f = key // len(weights), key % len(weights)
    return np.bincount(r, weights[f], n), np.bincount(r, minlength=n)
