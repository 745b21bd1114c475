"""A training-data pipeline over ``documents``: toxic texts go, one of each group of near copies
stays, texts with benchmark passages go, secrets are masked, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of docs.  Defined results: null texts pass the filters (they hold
nothing) and pack as the end id; rows with a null id are judged by their text alone and are
nobody's near copy; rows that share an id are one document and stay or go together as near
copies; other columns come back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoggraph.llm.decontaminate import with_leaks
from dialoggraph.llm.minhash import least_estimate, near_duplicates
from dialoggraph.llm.packing import pack
from dialoggraph.llm.secret_scan import masked, scan
from dialoggraph.llm.tables import crc_mod, table
from dialoggraph.llm.toxicity import toxicity as scored


def sheltered(docs: DataFrame) -> DataFrame:
    """docs with neutral names for all columns but doc_id and text, so that none clashes."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_kept_{k}" for k, c in enumerate(docs.columns)])


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``sheltered`` renamed, under their own names."""
    inner = sheltered(docs).columns
    return rows.select(*[F.col(a).alias(b) for a, b in zip(inner, docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    out = scored(sheltered(docs), table(spark, sf_dir, "labels"), train=crc_mod("doc_id", 4) != 2)
    return restored(out.filter("predicted = 0"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their runs of five words) the document with the smallest id stays."""
    rows = sheltered(docs)
    gone = near_duplicates(rows, num=80, den=100, estimate=least_estimate(80, 100)).filter("not kept").select("doc_id").distinct()
    # A merge join whatever the number of copies: one plan at every size.
    return restored(rows.join(gone.hint("merge"), "doc_id", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    out = with_leaks(sheltered(docs), table(spark, sf_dir, "benchmark"))
    return restored(out.filter(F.size("leaks") == 0), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay, with ``n_chars`` (where it is) of the new text."""
    rows = sheltered(docs)
    out = scan(rows).withColumn("text", masked(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        own = rows.columns[docs.columns.index("n_chars")]
        changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col(own))
        out = out.withColumn(own, changed)
    return restored(out, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return pack(docs, capacity=1024).withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

# Trained scores, signatures and token ids have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
