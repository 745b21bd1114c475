"""Exact top-k inner products with an impact-ordered score-at-a-time index.

Vectors are quantised to integers and cut into blocks of rows.  A block's index holds its
postings (dimension, row, impact) in segments of equal quantised impact, the power of two below
the size of the component, largest first, and for each segment the length of what every row has
left after it.  A block of queries takes the segments of a block of rows in that order, each for
all queries at once, and after each knows a lower and an upper bound of every score: the sum so
far, plus or minus the product of the lengths of query and rest.  It stops when the rows whose
upper bound reaches the k-th best lower bound are few, or at the last segment; these rows and no
others can be members, and are scored again exactly.  The k best of all row blocks meet per query.

The query set is a stated one; it meets all rows in blocks of a fixed size, so a task holds one
block of each.  Sums are exact: floats are used only while whole numbers of that size fit.

Defined results: null ids and vectors that are null or hold a null or non-finite component take no
part; of rows that share an id the least vector counts; shorter vectors end in zeros; ties go to the
smaller id; a query with fewer candidates has fewer ranks; extra columns are ignored.  Scores or
components beyond 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut

ROW_BLOCK, QUERY_BLOCK = 4096, 1024


def quantised(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * component)."""
    v = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & v.isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale))
    return (vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def blocked(rows: DataFrame, count: int, size: int, name: str, dims: int) -> DataFrame:
    """(name, ids, values): blocks of about ``size`` rows, chosen by a hash of the id."""
    n = max(1, -(-count // size))

    def build(batches):
        held: dict[int, list] = {}
        for b in batches:
            for k, i, v in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(k, []).append((i, v))
        for k, own in held.items():
            own.sort()
            x = np.zeros((len(own), dims), np.int64)
            for r, (_, v) in enumerate(own):
                x[r, :len(v)] = v
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([np.array([i for i, _ in own], np.int64).tobytes()], pa.binary()),
                 pa.array([x.tobytes()], pa.binary())], names=[name, "ids", "values"])

    key = F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)
    return rows.select(key, "vec_id", "v").repartition(n, name).mapInArrow(
        build, f"{name} long, ids binary, values binary")


def segments(x: np.ndarray):
    """(part of x with one quantised impact, length of each row's rest), by descending impact."""
    level = np.where(x == 0, -1, np.floor(np.log2(np.maximum(np.abs(x), 1).astype(np.float64)))).astype(np.int64)
    square = x.astype(np.float64) ** 2
    for k in range(int(level.max(initial=-1)), -1, -1):
        here = level == k
        if here.any():
            # Rounded up, so that the bound holds.
            yield np.where(here, x, 0), np.sqrt((square * (level < k)).sum(1)) * (1 + 1e-9)


def best(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query number, row number, score): the k best rows of the block for each query."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1]
    if bound >= 2**63:
        raise ValueError("a score needs more than 64 bits")
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    q = queries.astype(kind)
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    score = np.zeros((len(q), len(x)), kind)
    own = query_ids[:, None] == ids[None, :]
    whole = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    possible = ~own
    for part, rest in segments(x):
        score += q @ part.T.astype(kind)
        if rest.max(initial=0) > 0 and np.median(rest) > 0.25 * np.median(whole):
            continue  # bounds this wide settle nothing
        slack = length[:, None] * rest[None, :]
        low = np.where(own, -np.inf, score - slack)
        if low.shape[1] > k:
            limit = np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
        else:
            limit = np.full((len(q), 1), -np.inf)
        possible = ~own & (score + slack >= limit)
        if possible.sum() <= 4 * k * len(q):
            break
    i, j = np.nonzero(possible)
    exact = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 16):
        use = slice(lo, lo + (1 << 16))
        exact[use] = np.einsum("nd,nd->n", queries[i[use]], x[j[use]])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], exact[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` is a condition on vec_id."""
    rows = cut(quantised(vectors, scale, vec_id, embedding))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"),
                    F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    index = cut(blocked(rows, size["n"], ROW_BLOCK, "row_block", size["d"]))
    asked = cut(blocked(rows.filter(is_query), size["q"], QUERY_BLOCK, "query_block", size["d"]))
    numbers = max(1, -(-size["q"] // QUERY_BLOCK))
    dims = size["d"]

    def search(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, values, query_ids, query_values = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in range(4))
                i, j, score = best(query_values.reshape(-1, dims), query_ids, values.reshape(-1, dims), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(ids[j]), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])

    met = (index.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))
           .join(asked.select("query_block", F.col("ids").alias("query_ids"), F.col("values").alias("query_values")),
                 "query_block")
           .repartition("row_block", "query_block").select("ids", "values", "query_ids", "query_values"))
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
