"""Checks of a produced graph: schema conformance, recall against a gold graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from .edges import validate


def conformance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations: session_id, kind, ref, detail."""
    def rows(df: DataFrame, kind: str, ref: str, detail) -> DataFrame:
        return df.select("session_id", F.lit(kind).alias("kind"), F.col(ref).alias("ref"),
                         detail.cast("string").alias("detail"))

    same = lambda a, b: F.sort_array(F.map_entries(a)) == F.sort_array(F.map_entries(b))
    gated = nodes.withColumn("_g", P.gate(F.col("label"), F.col("props"))).filter(
        ~same(F.col("props"), F.col("_g")))
    unnamed = nodes.filter((F.col("label") == "Intervention")
                           & (F.coalesce(P.get_prop(F.col("props"), "technique"), F.lit("")) == "other")
                           & ~F.map_contains_key("props", "techniqueLabel"))
    bad_edges = validate(edges, nodes).filter("drop_reason is not null")
    return (rows(nodes.filter(~F.col("label").isin(*O.LABELS)), "label", "node_id", F.col("label"))
            .unionByName(rows(gated, "gating", "node_id", F.col("label")))
            .unionByName(rows(unnamed, "technique_label", "node_id", F.col("label")))
            .unionByName(rows(bad_edges, "edge", "edge_id", F.col("drop_reason"))))


def recall(produced: DataFrame, gold: DataFrame, col: str) -> DataFrame:
    """Per value of ``col``: how much of the gold graph was produced (counts, capped)."""
    n = lambda df, name: df.groupBy("session_id", col).agg(F.count(F.lit(1)).alias(name))
    j = n(gold, "n_gold").join(n(produced, "n_produced"), ["session_id", col], "full_outer").na.fill(
        0, ["n_gold", "n_produced"])
    return j.groupBy(col).agg(
        F.sum("n_gold").cast("bigint").alias("n_gold"), F.sum("n_produced").cast("bigint").alias("n_produced"),
        F.sum(F.least("n_gold", "n_produced")).cast("bigint").alias("n_matched")).withColumn(
        "recall", F.round(F.try_divide("n_matched", "n_gold"), 6))


def distinct_categories(nodes: DataFrame) -> DataFrame:
    """Beliefs of one domain kept apart by category: session_id, domain, n_categories, n_nodes."""
    c = nodes.filter("label = 'CoreBelief'").select(
        "session_id", P.get_prop(F.col("props"), "domain").alias("domain"),
        P.get_prop(F.col("props"), "category").alias("category")).filter("category is not null")
    return c.groupBy("session_id", "domain").agg(
        F.count_distinct("category").alias("n_categories"), F.count(F.lit(1)).alias("n_nodes"))
