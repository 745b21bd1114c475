"""Ordered per-key computations that stay parallel when one key is very large.

A plain ``Window.partitionBy(session)`` sends a whole session to one task.  Here the
position axis of a key is cut into fixed-size blocks: the window runs inside a block,
one summary row per block is scanned the same way (recursively, with the remaining
block sizes), and the carry of each block is joined back on ``keys + block``.  No task
ever sees more than one block of one key, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Positions per block.  A key with 10^11 positions has about 1.5 million block summaries,
# which one window task scans easily; more sizes add more levels.
TURN_BLOCKS = (65_536,)
# One minute, for positions counted in microseconds.
TIME_BLOCKS = (60_000_000,)
# Rows folded together, then block results folded together, for state machines.
STATE_BLOCKS = (4096, 4096)


def _window_value(op: str, col: str) -> Column:
    return {
        "sum": lambda: F.sum(col),
        "min": lambda: F.min(col),
        "max": lambda: F.max(col),
        "last": lambda: F.last(col, ignorenulls=True),
    }[op]()


def _block_value(op: str, col: str, order: Sequence[str]) -> Column:
    if op == "last":
        return F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order)))
    return _window_value(op, col)


def _combine(op: str, local: Column, carry: Column) -> Column:
    if op == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if op == "min":
        return F.least(local, carry)
    if op == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple[str, str]], pos: str,
            sizes: Sequence[int] = TURN_BLOCKS, inclusive: bool = True) -> DataFrame:
    """Add running aggregates per ``keys`` along ``order``.

    ``aggs`` maps output name to ``(op, column)`` with op in sum / min / max / last
    (last ignores nulls).  ``pos`` is a BIGINT column that never decreases along
    ``order``; it only decides the block.  ``order`` columns sort ascending.
    """
    keys, order = list(keys), list(order)
    upto = 0 if inclusive else -1
    if not sizes:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumns({n: _window_value(op, c).over(w) for n, (op, c) in aggs.items()})

    blk = f"_blk{len(sizes)}"
    blocked = df.withColumn(blk, F.expr(f"`{pos}` div {int(sizes[0])}"))
    w = (Window.partitionBy(*keys, blk).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, upto))
    local = blocked.withColumns({f"_l_{n}": _window_value(op, c).over(w)
                                 for n, (op, c) in aggs.items()})
    summary = blocked.groupBy(*keys, blk).agg(
        *[_block_value(op, c, order).alias(f"_t{len(sizes)}_{n}") for n, (op, c) in aggs.items()])
    carried = running(summary, keys, [blk],
                      {f"_c{len(sizes)}_{n}": (op, f"_t{len(sizes)}_{n}")
                       for n, (op, _) in aggs.items()},
                      blk, sizes[1:], inclusive=False)
    carried = carried.select(*keys, blk, *[f"_c{len(sizes)}_{n}" for n in aggs])
    joined = local.join(carried, [*keys, blk], "left")
    out = joined.withColumns({
        n: _combine(op, F.col(f"_l_{n}"), F.col(f"_c{len(sizes)}_{n}"))
        for n, (op, _) in aggs.items()})
    return out.select(*df.columns, *aggs)


def one_block(df: DataFrame, keys: Sequence[str], pos: str, most: int = TURN_BLOCKS[0]) -> DataFrame:
    """``pos`` becomes 0 for keys of at most ``most`` rows, so each of them is a single block.

    Cut by time, sparse rows are almost a block each, and the summary is as long as the data.  Only
    keys with more rows keep their positions; there are rows / ``most`` of them, so joining them is cheap.
    """
    crowded = cut(df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
                  .filter(F.col("_rows") > most))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(crowded, same, "left").withColumn(
        pos, F.when(F.col("_rows").isNotNull(), F.col(pos)).otherwise(F.lit(0).cast("bigint"))).select(*df.columns)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, pos: str,
             sizes: Sequence[int] = TURN_BLOCKS) -> DataFrame:
    """1-based row number per ``keys`` along ``order``, block-parallel."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, keys, order, {name: ("sum", "_one")}, pos, sizes).drop("_one")


def run_states(df: DataFrame, keys: Sequence[str], pos: str, step: str, n_states: int,
               name: str, start: int = 0, sizes: Sequence[int] = STATE_BLOCKS) -> DataFrame:
    """Run a finite-state machine along ``pos`` and add the state after each row.

    ``step`` is an ARRAY<INT> column: the state reached from each of the ``n_states``
    states by this row.  Steps compose associatively, so a block folds to one step
    array and only those arrays are folded across blocks.  One row per (key, pos).
    """
    keys = list(keys)
    identity = F.array(*[F.lit(i) for i in range(n_states)])
    entry = _entry_states(df, keys, pos, step, identity, start, list(sizes), 0)
    blk = "_sb0"
    rows = (df.withColumn(blk, F.expr(f"`{pos}` div {int(sizes[0])}"))
            .groupBy(*keys, blk)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                      F.col(step).alias("f")))).alias("_rows")))
    walked = rows.join(entry, [*keys, blk]).withColumn(
        "_states", _walk("_rows", F.col("_entry")))
    states = walked.select(*keys, F.explode("_states").alias("_s")).select(
        *keys, F.col("_s.p").alias(pos), F.col("_s.state").alias(name))
    return df.join(states, [*keys, pos])


def _walk(rows: str, entry: Column) -> Column:
    """States after every row of a block, as an array of (p, state)."""
    init = F.struct(entry.alias("cur"),
                    F.array().cast("array<struct<p:bigint,state:int>>").alias("out"))
    return F.aggregate(
        rows, init,
        lambda acc, x: F.struct(
            F.get(x["f"], acc["cur"]).alias("cur"),
            F.concat(acc["out"], F.array(F.struct(
                x["p"].cast("bigint").alias("p"),
                F.get(x["f"], acc["cur"]).alias("state")))).alias("out")),
        lambda acc: acc["out"])


def _entry_states(df, keys, pos, step, identity, start, sizes, level) -> DataFrame:
    """State in which each block of this level is entered."""
    blk, size = f"_sb{level}", int(sizes[0])
    maps = (df.withColumn(blk, F.expr(f"`{pos}` div {size}"))
            .groupBy(*keys, blk)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                      F.col(step).alias("f")))).alias("_rows"))
            .withColumn("_map", F.aggregate(
                "_rows", identity,
                lambda acc, x: F.transform(acc, lambda s: F.get(x["f"], s))))
            .select(*keys, blk, "_map"))
    if len(sizes) > 1:
        upper = _entry_states(maps, keys, blk, "_map", identity, start, sizes[1:], level + 1)
        up, group = f"_sb{level + 1}", [*keys, f"_sb{level + 1}"]
        grouped = maps.withColumn(up, F.expr(f"`{blk}` div {int(sizes[1])}"))
    else:
        up, group = None, keys
        upper = None
        grouped = maps
    lists = grouped.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct(F.col(blk).alias("p"),
                                             F.col("_map").alias("f")))).alias("_rows"))
    if upper is not None:
        lists = lists.join(upper, group)
    else:
        lists = lists.withColumn("_entry", F.lit(start))
    init = F.struct(F.col("_entry").cast("int").alias("cur"),
                    F.array().cast("array<struct<p:bigint,entry:int>>").alias("out"))
    entries = F.aggregate(
        "_rows", init,
        lambda acc, x: F.struct(
            F.get(x["f"], acc["cur"]).alias("cur"),
            F.concat(acc["out"], F.array(F.struct(
                x["p"].cast("bigint").alias("p"), acc["cur"].alias("entry")))).alias("out")),
        lambda acc: acc["out"])
    return (lists.select(*keys, F.explode(entries).alias("_e"))
            .select(*keys, F.col("_e.p").alias(blk), F.col("_e.entry").alias("_entry")))
