"""Similarity joins and connected components without all-pairs work.

Copies are collapsed to distinct token sets first, so a text repeated a billion times is
one row here.  Distinct sets meet only where they share several of their rarest tokens, and a token
shared by very many sets is worked in bounded blocks that report links between sets
rather than every similar pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Largest number of sets under one token that are still joined pair by pair.
HOT_TOKEN_SETS = 2048
# Sets per side of a block comparison under a hot token.
BLOCK_SETS = 1024


def exceeds(common: Column, size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """common / union > num / den in whole numbers, so no rounding is involved."""
    return common * (num + den) > (size_a + size_b) * num


def distinct_sets(df: DataFrame, keys: Sequence[str], tokens: str, order: str) -> DataFrame:
    """One row per (keys, token set): keys, tokens, set_id = first ``order``, n.

    Sets are dealt as one text, which takes about half the bytes of an array.  A set whose text does not
    tell the tokens apart, because one of them holds a blank, is dealt as it is.
    """
    line = F.array_join(tokens, " ")
    told = (line != "") & (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) == F.size(tokens) - 1)
    return (df.filter(F.size(tokens) > 0).groupBy(*keys, F.when(told, line).alias("_line"), F.when(~told, F.col(tokens)).alias("_raw"))
            .agg(F.min(order).alias("set_id"), F.count(F.lit(1)).alias("n"))
            .select(*keys, F.coalesce("_raw", F.split("_line", " ")).alias("tokens"), "set_id", "n"))


# Places of the marks that say which rows may be wanted: 4 MB of bits whatever the input.
MARKS, MARKS_ROW = 1 << 25, 1 << 19


def narrowed(rows: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose ``on`` stands in ``wanted``, and a few others that share a mark with them.

    To be followed by a join on the same columns: long rows that would find nothing are not dealt.
    """
    import numpy as np
    import pyarrow as pa

    def packed(batches):
        lines = {}
        for b in batches:
            place = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(place // MARKS_ROW):
                line = lines.setdefault(int(k), np.zeros(MARKS_ROW, bool))
                line[place[place // MARKS_ROW == k] % MARKS_ROW] = True
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array(
                [np.packbits(x).tobytes() for x in lines.values()], pa.binary())], names=["line", "bits"])

    spark, place = rows.sparkSession, F.pmod(F.xxhash64(*on), F.lit(MARKS))
    table = np.zeros(MARKS // 8, np.uint8)
    places = wanted.select(place.alias("place")).distinct().repartition(F.expr(f"place div {MARKS_ROW}"))
    for r in places.mapInArrow(packed, "line int, bits binary").toLocalIterator():
        table[r["line"] * MARKS_ROW // 8:(r["line"] + 1) * MARKS_ROW // 8] |= np.frombuffer(r["bits"], np.uint8)
    marks = spark.sparkContext.broadcast(table.tobytes())

    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((np.frombuffer(marks.value, np.uint8)[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return rows.filter(F.pandas_udf(marked, "boolean")(place))


# Buckets of the sketch of token frequencies, and of one row of it.
SKETCH, SKETCH_ROW = 1 << 22, 1 << 16
# Shared tokens asked for at most where two sets meet; the prefixes are longer by as many tokens.
SHARED = 4
# Tokens in common that one more shared token is asked for.  Short sets meet by their rarest token
# alone: asked for more, two words would meet by the frequent one as well.
PER_SHARED = 4


def _least_common(size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """The smallest overlap that exceeds num / den of the union."""
    return F.floor((size_a + size_b) * num / (num + den)).cast("int") + 1


def _shared(least: Column) -> Column:
    """Shared tokens asked for of sets that need ``least`` in common; it grows slower than ``least``."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(least / PER_SHARED).cast("int")))


def _hashed(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sets with their tokens as 64-bit hashes that differ from key to key."""
    return sets.select(*keys, "set_id", F.array_distinct(F.transform(
        "tokens", lambda t: F.xxhash64(*[F.col(k) for k in keys], t))).alias("hashes"))


def _levels(sets: DataFrame, keys: Sequence[str]) -> bytes:
    """How frequent tokens are, one byte for each bucket of their hashes: 8 * log2 of the count.

    A fixed size whatever the input.  Tokens of one bucket count together, which makes some
    look more frequent than they are; any order of the tokens gives the same pairs.
    """
    import numpy as np
    import pyarrow as pa

    # a row per token before it is hashed: that is compiled, other than a function over an array
    tokens = sets.select(*keys, F.explode("tokens").alias("_t"))
    counts = (tokens.groupBy(F.pmod(F.xxhash64(*keys, "_t"), F.lit(SKETCH)).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.expr(f"cast(bucket div {SKETCH_ROW} as int)").alias("line"),
                      F.expr(f"cast(bucket % {SKETCH_ROW} as int)").alias("place"), "n"))

    def packed(batches):
        lines = {}
        for b in batches:
            line, place, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            level = np.minimum(254, np.floor(8 * np.log2(n))).astype(np.uint8) + 1
            for k in np.unique(line):
                lines.setdefault(int(k), np.zeros(SKETCH_ROW, np.uint8))[place[line == k]] = level[line == k]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array(
                [x.tobytes() for x in lines.values()], pa.binary())], names=["line", "levels"])

    table = np.zeros(SKETCH, np.uint8)
    for r in counts.repartition("line").mapInArrow(packed, "line int, levels binary").toLocalIterator():
        table[r["line"] * SKETCH_ROW:(r["line"] + 1) * SKETCH_ROW] = np.frombuffer(r["levels"], np.uint8)
    return table.tobytes()


def _prefixes(sets: DataFrame, keys: Sequence[str], num: int, den: int) -> DataFrame:
    """Every set with its rarest tokens (hashes): keys, set_id, token, size, at (place in rare-first order), level.

    Two sets that share c tokens or more share the l-th of them, in any fixed global order, no
    later than at place size - c + l - 1 of either.  With the smallest c that a set of the
    smallest size in question asks for, these rows hold the first common tokens of every pair above
    the threshold, as many as ``_shared`` says.  Tokens that stand in one set only are left out.
    """
    import numpy as np
    import pyarrow as pa

    hashed = _hashed(sets, keys)
    names = [*keys, "set_id"]
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets, keys))
    types = {f.name: f.dataType.simpleString() for f in hashed.schema}
    ddl = ", ".join([*(f"`{n}` {types[n]}" for n in names), "token bigint, size int, at int, level int"])

    def pieces(batches):
        """Batches of at most about 2^20 hashes: long sets share a batch with fewer others."""
        for b in batches:
            ends, lo = b.column(len(names)).offsets.to_numpy()[1:], 0
            while lo < b.num_rows:
                first = ends[lo - 1] if lo else b.column(len(names)).offsets[0].as_py()
                hi = max(lo + 1, int(np.searchsorted(ends, first + (1 << 20), "right")))
                yield b.slice(lo, hi - lo)
                lo = hi

    def ranked(batches):
        level_of = np.frombuffer(levels.value, np.uint8)
        for b in pieces(batches):
            lists = b.column(len(names))
            h = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            level = level_of[h % SKETCH]
            order = np.lexsort((h, level, row))
            h, level = h[order], level[order]
            at = np.arange(len(h)) - (np.cumsum(size) - size)[row]
            common = (size + size * num // den + 1) * num // (num + den) + 1
            shared = np.clip(common // PER_SHARED, 1, SHARED)
            keep = np.flatnonzero((at < (size - common + shared)[row]) & (level > 1))
            for lo in range(0, len(keep), 1 << 17):
                k = keep[lo:lo + (1 << 17)]
                own = [b.column(i).take(pa.array(row[k])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(h[k]), pa.array(size[row[k]].astype(np.int32)), pa.array(at[k].astype(np.int32)),
                     pa.array(level[k].astype(np.int32))], names=[*names, "token", "size", "at", "level"])

    return hashed.mapInArrow(ranked, ddl)


def _hot_buckets(prefixes: DataFrame, keys: Sequence[str], hot: int) -> DataFrame:
    """Tokens in the prefixes of more than ``hot`` sets.  A level is never below the token's own
    frequency, so only tokens of a high level are counted."""
    often = prefixes.filter(F.col("level") > math.floor(8 * math.log2(max(1, hot))))
    return (often.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("_in_bucket"))
            .filter(F.col("_in_bucket") > hot))


def _meetings(pre: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Pairs (a < b) that share so many of their rarest tokens that they may exceed the threshold.

    A pair that shares c tokens, the least it needs, has the first l of them at places below
    size - c + l on both sides.  With l as ``_shared`` says (never more than c) a pair with fewer
    common tokens there is below the threshold.  This cannot lose a pair, and what is left is
    close to the result; rows are the prefixes alone, dealt once for both sides.
    """
    x, y = pre.alias("x"), pre.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    sa, sb = c("x", "size"), c("y", "size")
    least = _least_common(sa, sb, num, den)
    need = _shared(least)
    same = F.lit(True)
    for k in [*keys, "token"]:
        same &= c("x", k) == c("y", k)
    met = (x.join(y, same & (c("x", "set_id") < c("y", "set_id"))
                  & (F.least(sa, sb) * den > F.greatest(sa, sb) * num)
                  & (c("x", "at") < sa - least + need) & (c("y", "at") < sb - least + need))
           .select(*[c("x", k).alias(k) for k in keys], c("x", "set_id").alias("a"), c("y", "set_id").alias("b"),
                   (F.shiftleft(sa.cast("bigint"), 32) + sb).alias("_sizes")))
    sizes = F.shiftright("_sizes", 32).cast("int"), F.col("_sizes").bitwiseAND((1 << 32) - 1).cast("int")
    return (met.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("_n"), F.min("_sizes").alias("_sizes"))
            .filter(F.col("_n") >= _shared(_least_common(*sizes, num, den)))
            .select(*keys, "a", "b", sizes[0].alias("size_a"), sizes[1].alias("size_b")))


def similar_pairs(sets: DataFrame, keys: Sequence[str], num: int, den: int) -> DataFrame:
    """All pairs of distinct sets with Jaccard > num/den: keys, a, b (a < b), common, sizes.

    The result itself is the pairs, so its size is what the data says; use
    ``similarity_links`` where only connectivity is needed.
    """
    keys = list(keys)
    return _verified(_meetings(_prefixes(sets, keys, num, den), keys, num, den), sets, keys, num, den)


# Tokens of the sets of one side that are compared in one task at once.
BLOCK_TOKENS = 1 << 22
# Steps over which sets look for the smallest one they are compared with.
STEPS = 3


def _blocks(met: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the block they are compared in: keys, _g, _i, _j, a, b.

    A pair goes to the smallest set within a few steps of its first one, so near copies of each other come
    together and the words of a set are dealt once for all of its pairs there, not once for each.  Sets
    of more than ``BLOCK_TOKENS`` tokens in all are parted, and part meets part.
    """
    ends = lambda df, *more: df.select(*keys, *more, F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("size_a").alias("size")),
        F.struct(F.col("b").alias("id"), F.col("size_b").alias("size")))).alias("e"), "a").select(*keys, *more, "a", "e.*")
    least = ends(met).groupBy(*keys, F.col("id").alias("a")).agg(F.min("a").alias("_g"))
    both = met.select(*keys, "a", F.col("b").alias("id")).unionByName(met.select(*keys, F.col("b").alias("a"), F.col("a").alias("id")))
    for _ in range(STEPS - 1):
        least = both.join(least, [*keys, "a"]).groupBy(*keys, F.col("id").alias("a")).agg(F.min("_g").alias("_g"))
    grouped = met.join(least, [*keys, "a"])
    parts = (ends(grouped, "_g").select(*keys, "_g", "id", "size").distinct().groupBy(*keys, "_g")
             .agg(F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("_parts")))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_parts")).cast("int")
    return grouped.join(parts, [*keys, "_g"]).select(
        *keys, "_g", F.least(part("a"), part("b")).alias("_i"), F.greatest(part("a"), part("b")).alias("_j"), "a", "b")


def _verified(met: DataFrame, sets: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """The pairs of ``met`` above the threshold, by their words: keys, a, b, common, size_a, size_b."""
    import numpy as np
    import pyarrow as pa

    types = {f.name: f.dataType.simpleString() for f in sets.schema}
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"a {types['set_id']}", f"b {types['set_id']}", "common int, size_a int, size_b int"])
    pairs, block = cut(_blocks(cut(met), keys)), [*keys, "_g", "_i", "_j"]
    ids = pairs.select(*block, F.explode(F.array("a", "b")).alias("set_id")).distinct()
    words = narrowed(sets.select(*keys, "set_id", "tokens"), ids, [*keys, "set_id"]).join(ids, [*keys, "set_id"])
    none = F.lit(None)
    rows = words.select(*block, F.col("set_id").alias("a"), none.cast(types["set_id"]).alias("b"), "tokens").unionByName(
        pairs.withColumn("tokens", none.cast("array<string>")))
    rows = rows.repartition(*block).sortWithinPartitions(*block, F.col("b").isNotNull(), "a")

    def compared(batches):
        """Words of a block's sets come before its pairs; words are numbered within the block."""
        now, known, number, seen = None, {}, {}, np.zeros(1, bool)
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(block)))))
            a, b, lists = batch.column(len(block)).to_pylist(), batch.column(len(block) + 1).to_pylist(), batch.column(len(block) + 2)
            ends, words = lists.offsets.to_numpy(), lists.values.dictionary_encode()
            code, spelled = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
            own, at, counts, i = None, [], [], 0
            while i < len(names):
                if names[i] != now:
                    now, known, number, own = names[i], {}, {}, None
                if b[i] is None:
                    if own is None:
                        own = np.full(len(spelled), -1, np.int32)
                    mine = code[ends[i]:ends[i + 1]]
                    for k in np.unique(mine[own[mine] < 0]):
                        own[k] = number.setdefault(spelled[k], len(number))
                    known[a[i]] = own[mine]
                    i += 1
                    continue
                last = i + 1
                while last < len(names) and last < i + 1024 and a[last] == a[i] and names[last] == now:
                    last += 1
                if len(seen) < len(number):
                    seen = np.zeros(2 * len(number), bool)
                x, others = known[a[i]], [known[y] for y in b[i:last]]
                size = np.array([len(y) for y in others])
                seen[x] = True
                common = np.add.reduceat(seen[np.concatenate(others)].astype(np.int32), np.cumsum(size) - size)
                seen[x] = False
                hit = np.flatnonzero(common * (num + den) > (len(x) + size) * num)
                at.append(i + hit)
                counts.append((common[hit], np.full(len(hit), len(x)), size[hit]))
                i = last
            if at:
                rows_of = pa.array(np.concatenate(at))
                mine = [batch.column(i).take(rows_of) for i in [*range(len(keys)), len(block), len(block) + 1]]
                yield pa.RecordBatch.from_arrays([*mine, *(pa.array(np.concatenate(v).astype(np.int32)) for v in zip(*counts))],
                                                 names=[*keys, "a", "b", "common", "size_a", "size_b"])

    return rows.mapInArrow(compared, ddl)


def similarity_links(sets: DataFrame, keys: Sequence[str], num: int, den: int,
                     hot: int = HOT_TOKEN_SETS, block: int = BLOCK_SETS) -> DataFrame:
    """Links (keys, a, b) whose connected components equal those of all similar pairs.

    Ordinary buckets are joined directly; hot ones see ``_hot_links``.
    """
    keys = list(keys)
    pre = cut(_prefixes(sets, keys, num, den))
    hot_buckets = cut(_hot_buckets(pre, keys, hot))
    if hot_buckets.isEmpty():
        return _verified(_meetings(pre, keys, num, den), sets, keys, num, den).select(*keys, "a", "b")
    cold = pre.join(hot_buckets, [*keys, "token"], "left_anti")
    links = cut(_verified(_meetings(cold, keys, num, den), sets, keys, num, den).select(*keys, "a", "b"))
    where = cut(pre.select(*keys, "token", "set_id").join(hot_buckets.drop("_in_bucket"), [*keys, "token"]))
    rows = cut(where.join(narrowed(sets.select(*keys, "set_id", "tokens"), where, [*keys, "set_id"]), [*keys, "set_id"])
               .select(*keys, "set_id", "token", "tokens"))
    return _hot_links(rows, links, keys, num, den, block)


def _hot_links(rows: DataFrame, links: DataFrame, keys: list[str], num: int, den: int,
               block: int) -> DataFrame:
    """Links within tokens shared by very many sets.  rows: keys, token, set_id, tokens.

    First, blocks of a bucket are linked inside, then one representative per component
    is, and so on while that at least halves their number: a group of near copies shrinks
    by the block size each time.  What this cannot settle are pairs between different
    components, so at the end every set outside a bucket's largest component meets all
    the others.  Near copies therefore cost work in proportion to their number, and a
    pair inside one component is never looked at again.
    """
    bucket = [*keys, "token"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"a {types['set_id']}", f"b {types['set_id']}"])

    def similar(x: frozenset, y: frozenset) -> bool:
        return len(x & y) * (num + den) > (len(x) + len(y)) * num

    def frame(pdf: pd.DataFrame, pairs: list) -> pd.DataFrame:
        out = pd.DataFrame(pairs, columns=["a", "b"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "a", "b"]]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        groups, pairs = [], []
        for y, words in zip(pdf["set_id"], pdf["tokens"]):
            me, joined = (y, frozenset(words)), None
            for g in list(groups):
                hit = next((x for x, w in g if similar(w, me[1])), None)
                if hit is None:
                    continue
                pairs.append((hit, y))
                if joined is None:
                    joined = g
                    g.append(me)
                else:
                    joined.extend(g)
                    groups.remove(g)
            if joined is None:
                groups.append([me])
        return frame(pdf, pairs)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        top = {}

        def find(r):
            while top.setdefault(r, r) != r:
                r = top[r]
            return r

        pairs, by_root = [], {}
        side = pdf[pdf["_side"] == 0]
        for i, w, r in zip(side["set_id"], side["tokens"], side["root"]):
            by_root.setdefault(r, []).append((i, frozenset(w)))
        other = pdf[pdf["_side"] == pdf["_side"].max()]
        for y, words, r in zip(other["set_id"], other["tokens"], other["root"]):
            mine = frozenset(words)
            for root, members in by_root.items():
                if find(root) == find(r):
                    continue
                hit = next((x for x, w in members if similar(w, mine)), None)
                if hit is not None:
                    pairs.append((hit, y))
                    top[find(root)] = find(r)
        return frame(pdf, pairs)

    def rooted(members: DataFrame) -> DataFrame:
        roots = components(links, keys).select(*keys, F.col("id").alias("set_id"), "root")
        return members.join(roots, [*keys, "set_id"], "left").withColumn(
            "root", F.coalesce("root", F.col("set_id")))

    current, left = rows, rows.count()
    while True:
        sized = current.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
        placed = current.join(sized, bucket).withColumn(
            "_b", F.pmod(F.xxhash64("set_id", F.lit(left)), F.col("_nb")))
        links = cut(links.unionByName(placed.groupBy(*bucket, "_b").applyInPandas(inside, schema)).distinct())
        reps = cut(rooted(current).groupBy(*bucket, "root").agg(
            F.min_by(F.struct("set_id", "tokens"), "set_id").alias("r")).select(*bucket, "r.*"))
        before, left, current = left, reps.count(), reps
        if left * 2 > before:
            break

    members = cut(rooted(rows))
    largest = (members.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("_n"))
               .groupBy(*bucket).agg(F.max_by("root", F.struct("_n", "root")).alias("_big")))
    sided = members.join(largest, bucket).withColumn("_minor", F.col("root") != F.col("_big"))
    blocks = sided.groupBy(*bucket).agg(
        F.ceil(F.count_if("_minor") / block).cast("int").alias("_nm"),
        F.ceil(F.count_if(~F.col("_minor")) / block).cast("int").alias("_nj")).filter("_nm > 0")
    sided = sided.join(blocks, bucket).withColumn("_b", F.pmod(
        F.xxhash64("set_id"), F.when(F.col("_minor"), F.col("_nm")).otherwise(F.col("_nj"))).cast("int"))
    # a minor block i meets every major block, and every minor block from i on
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meeting = lambda kind, i, j, side: F.struct(F.lit(kind).alias("_kind"), i.alias("_i"), j.alias("_j"),
                                                F.lit(side).alias("_side"))
    mine = F.col("_b")
    as_minor = F.concat(
        F.transform(spread("_nj"), lambda j: meeting(0, mine, j, 0)),
        F.transform(F.sequence(mine, F.col("_nm") - 1), lambda j: meeting(1, mine, j, 0)),
        F.filter(F.transform(spread("_nm"), lambda i: meeting(1, i, mine, 1)), lambda m: m["_i"] < mine))
    as_major = F.transform(spread("_nm"), lambda i: meeting(0, i, mine, 1))
    met = sided.select(*bucket, "set_id", "tokens", "root", F.explode(
        F.when(F.col("_minor"), as_minor).otherwise(as_major)).alias("m")).select(
        *bucket, "set_id", "tokens", "root", "m.*")
    last = met.groupBy(*bucket, "_kind", "_i", "_j").applyInPandas(across, schema)
    return links.unionByName(last).distinct()


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connected components of links (keys, a, b): keys, id, root (smallest id).

    Alternating star contraction: every round points the larger neighbours of a vertex at
    the smallest one, which halves paths instead of walking them.  Both sides aggregate
    before the shuffle, so a vertex with very many links is no bottleneck, and the round
    count grows with the logarithm of the longest path.  It goes on until a round leaves
    the edges as they were, which count and hash sums of the written edges tell.
    """
    keys = list(keys)
    edges = cut(links.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct())
    state = _state(edges)
    while True:
        large = _star(edges, keys, strict=True)
        edges = cut(_star(large, keys, strict=False))
        before, state = state, _state(edges)
        if state == before:
            break
    members = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("root"))
    roots = edges.select(*keys, F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return members.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and hashes of a set of edges: equal for equal sets, whatever their order."""
    h = F.xxhash64(*edges.columns)
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def _star(edges: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """One contraction step over edges (u > v).

    strict (large star): each vertex links its larger neighbours to its smallest
    neighbour or itself.  Otherwise (small star): each vertex links its smaller
    neighbours and itself to its smallest neighbour.
    """
    if strict:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = both.join(low, [*keys, "u"])
    if strict:
        moved = j.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = (j.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(*keys, "u", F.col("m").alias("v"))))
    return moved.filter("u <> v").distinct()


# ── vectors ───────────────────────────────────────────────────────────────

def cosine_pairs(vectors: DataFrame, keys: Sequence[str], gate: float,
                 block: int = 2048, size: int | None = None) -> DataFrame:
    """Pairs (keys, a, b, cos) of unit-scaled vectors with cos >= gate.

    vectors: keys, id, vec.  Vectors of a key are ranked by their angle to a fixed
    direction and cut into blocks.  Two vectors closer than the gate differ by at most
    acos(gate) in that angle, so only block pairs within that distance meet; each meeting
    is one matrix product in one task.
    """
    from .ordered import numbered
    import numpy as np

    keys = list(keys)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select(*keys, "id", F.transform("vec", lambda x: x / norm).alias("vec"))
    # angle to the direction (1, 1, ...) in whole nano-radians, to rank on an integer
    flat = (F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
            / F.sqrt(F.size("vec").cast("double")))
    angled = unit.withColumn("_angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), flat)))
                             ).withColumn("_nano", F.round(F.col("_angle") * 1e9).cast("bigint"))
    ranked = numbered(angled, keys, ["_nano", "id"], "_n", "_nano", (100_000,))
    placed = ranked.withColumn("_b", F.expr(f"(_n - 1) div {block}").cast("int"))
    # a block's angle range; blocks are few (rows / block)
    spans = placed.groupBy(*keys, "_b").agg(F.min("_angle").alias("lo"), F.max("_angle").alias("hi"))
    other = spans.select(*keys, F.col("_b").alias("_j"), F.col("lo").alias("lo_j"))
    reach = math.acos(max(-1.0, min(1.0, gate))) + 2e-9
    meetings = (spans.withColumnRenamed("_b", "_i").join(other, keys)
                .filter((F.col("_j") >= F.col("_i")) & (F.col("lo_j") - F.col("hi") <= reach))
                .select(*keys, "_i", "_j"))
    sides = meetings.select(*keys, "_i", "_j", F.explode(F.array_distinct(
        F.array("_i", "_j"))).alias("_b"))
    rows = placed.select(*keys, "id", "vec", "_b").join(sides, [*keys, "_b"])
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                           for f in vectors.schema if f.name in keys)
    id_type = vectors.schema["id"].dataType.simpleString()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left = pdf[pdf["_b"] == i]
        right = left if i == j else pdf[pdf["_b"] == j]
        x, y = np.vstack(left["vec"].to_numpy()), np.vstack(right["vec"].to_numpy())
        cos = x @ y.T
        r, c = np.nonzero(cos >= gate)
        a, b = left["id"].to_numpy()[r], right["id"].to_numpy()[c]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b, s = a[keep], b[keep], cos[r, c][keep]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cos": s})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "a", "b", "cos"]]

    return rows.groupBy(*keys, "_i", "_j").applyInPandas(
        meet, f"{key_schema}, a {id_type}, b {id_type}, cos double")
