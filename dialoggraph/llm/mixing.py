"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight.  A source whose share is above ``epochs`` times its
size is clamped there; what it leaves goes to the others by weight, until none is above.  A
source's target is then met by repetitions of all its documents as a whole, and by a fractional
repetition: documents in the order of a seeded hash, of which the last gives its first words
only.  So a source's words come within one word of its target.

Only column functions.  Word counts are formed once, in a narrow table.  The clamping rounds are
aggregates over one row per source.  The place where a fractional repetition ends is found
through hash buckets: a source of n documents has about sqrt(n) of them, whose running sums
(one window over sqrt(n) rows) leave one bucket of about sqrt(n) documents to be ordered.  No
task holds a source, however large.

Defined results: a null or empty text has size 0 and gives nothing; a null source is a source of
its own; rows that share id, source and size are copies and share what falls to them alike,
rounded down; documents with a null id count like others; no documents give no rows; weights
that are null or not above 0 count as 0.  Other columns do not matter unless ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, picked

_SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
# Hash values are below 2**60.
_DIGITS = 15


def word_count(text: Column) -> Column:
    """How many words: each, with the white space behind it, becomes one letter."""
    marks = F.regexp_replace(text, WORD + r"[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.ltrim(marks, F.lit(_SPACES))), F.lit(0)).cast("long")


def seeded(seed: int, doc_id: Column) -> Column:
    """A number below 2**60 for each id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, _DIGITS), 16, 10).cast("long")


def cycled(weights: Sequence[float]) -> Callable[[DataFrame], DataFrame]:
    """Weights for sources in the order of their code points, null last, repeating.

    Sources are dealt by range and numbered where they lie, so that no task sees all.
    """
    def weigh(sources: DataFrame) -> DataFrame:
        dealt = (sources.select("source").repartitionByRange(F.col("source").asc_nulls_last())
                 .sortWithinPartitions(F.col("source").asc_nulls_last())
                 .withColumn("at", F.monotonically_increasing_id()))
        dealt = cut(dealt).withColumn("part", F.shiftright("at", 33))
        # One row per partition.
        before = (dealt.groupBy("part").agg(F.count("*").alias("n"))
                  .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
        place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        k = (place % len(weights)).cast("int")
        return dealt.join(before, "part").select(
            "source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k + 1).alias("weight"))
    return weigh


def water_filled(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with ``target``: rounds of clamping, each one aggregate."""
    rows = sources.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    first = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, weight, clamped = share * (first["size"] or 0), first["weight"] or 0.0, 0
    level = budget / weight if weight else 0.0
    while weight:
        over = F.col("cap") < F.col("weight") * level
        r = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"),
                     F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == clamped:
            break
        clamped, weight = r["n"], r["weight"] or 0.0
        level = (budget - r["cap"]) / weight if weight else float("inf")
    share_of = F.when(F.col("weight") > 0, F.col("weight") * level).otherwise(0.0)
    return rows.withColumn("target", F.least("cap", share_of)).drop("cap")


def mix(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame], share: float = 1.5, epochs: float = 2.0,
        seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, weight, target (its source's),
    repeats (whole repetitions), part (words of one more), taken, and the columns of ``carry``.

    weigh: from rows (source, source_size) to rows (source, weight).
    """
    carried = [f"carried_{k}" for k in range(len(carry))]
    rows = picked(docs, "doc_id", "source", "text", *carry).toDF("doc_id", "source", "text", *carried)
    narrow = cut(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                             seeded(seed, F.col("doc_id")).alias("u"), *carried))
    sources = cut(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    weights = weigh(sources.select("source", "source_size")).toDF("source_", "weight")
    weighed = cut(sources.join(weights, F.col("source").eqNullSafe(F.col("source_")), "left").select(
        "source", "source_size", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")))
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long"))
    plan = cut(water_filled(weighed, share, epochs).select(
        "source", "source_size", "weight", "target", whole.alias("repeats"), (words - whole * F.col("source_size")).alias("wanted"),
        F.ceil(F.sqrt("n")).alias("buckets")))
    keyed = narrow.join(plan.withColumnRenamed("source", "source_"),
                        F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    keyed = keyed.withColumn("bucket", F.floor(F.col("u") / float(16**_DIGITS) * F.col("buckets")))

    # Where the fractional repetition of each source ends: its bucket, then its document.
    sums = keyed.filter("wanted > 0").groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    last = (sums.withColumn("upto", upto).filter("upto >= wanted and upto - words < wanted")
            .select("source", F.col("bucket").alias("last_bucket"), (F.col("wanted") - F.col("upto") + F.col("words")).alias("left")))
    last = cut(last).withColumnRenamed("source", "source_")
    keyed = keyed.join(last, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    copies = (keyed.filter("bucket = last_bucket").groupBy("source", "u", "doc_id", "size")
              .agg(F.count("*").alias("copies"), F.first("left").alias("left")))
    before = F.sum(F.col("size") * F.col("copies")).over(
        Window.partitionBy("source").orderBy("u", "doc_id", "size")) - F.col("size") * F.col("copies")
    room = F.least(F.greatest(F.col("left") - before, F.lit(0)), F.col("size") * F.col("copies"))
    ends = cut(copies.select("source", "u", "doc_id", "size", room.alias("room"), "copies")
               .filter("room > 0").select("source", "u", "doc_id", "size", F.expr("room div copies").alias("own")))
    ends = ends.toDF("source_", "u_", "doc_id_", "size_", "own")
    same = (F.col("u") == F.col("u_")) & (F.col("size") == F.col("size_"))
    for name in ("source", "doc_id"):
        same &= F.col(name).eqNullSafe(F.col(f"{name}_"))
    part = (F.when(F.col("bucket") < F.col("last_bucket"), F.col("size"))
            .when(F.col("bucket") == F.col("last_bucket"), F.coalesce("own", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return keyed.join(ends, same, "left").select(
        "doc_id", "source", "size", "source_size", "weight", "target", "repeats", part.alias("part"),
        (F.col("repeats") * F.col("size") + part).alias("taken"), *[F.col(a).alias(b) for a, b in zip(carried, carry)])


def repetitions(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: doc_id, repetition (from 1), text; from rows of ``mix`` that carry the text.

    The fractional repetition is the whole text, or its first ``part`` words joined by a space.
    """
    times = F.col("repeats") + (F.col("part") > 0).cast("long")
    begun = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    cut_short = (F.col("repetition") > F.col("repeats")) & (F.col("part") < F.col("size"))
    return (mixed.filter(times > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), times)))
            .select("doc_id", "repetition", F.when(cut_short, begun).otherwise(F.col(text)).alias("text")))
