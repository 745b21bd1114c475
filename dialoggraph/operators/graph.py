"""The graph container shared by readers, builders, editors and queries.

Evidence is kept as rows, not arrays: one node may be supported by a third of all turns,
and a row per (owner, position) can be joined, counted and ranked without ever building
that array in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

NODE_COLS = ["session_id", "node_id", "label", "props", "status", "turn_acquired", "ord"]
EDGE_COLS = ["session_id", "edge_id", "subject_id", "predicate", "object_id", "props",
             "status", "ord"]
EVIDENCE_COLS = ["session_id", "owner_id", "pos", "turn_index"]


def edge_id(s: Column | str = "subject_id", p: Column | str = "predicate",
            o: Column | str = "object_id") -> Column:
    return F.concat_ws("__", s, p, o)


@dataclass(frozen=True)
class Graph:
    """nodes: NODE_COLS; edges: EDGE_COLS; *_evidence: EVIDENCE_COLS (owner = node / edge id)."""

    nodes: DataFrame
    edges: DataFrame
    node_evidence: DataFrame
    edge_evidence: DataFrame

    def found(self) -> "Graph":
        """Only what was actually found; placeholders are left out."""
        return replace(self, nodes=self.nodes.filter("status = 'found'"),
                       edges=self.edges.filter("status = 'found'"))


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


# Most evidence turns listed in one row of an exchange format.
EVIDENCE_ROW = 10_000


def evidence_arrays(owners: DataFrame, evidence: DataFrame, owner: str,
                    max_turns: int = EVIDENCE_ROW) -> DataFrame:
    """Owners with ordered ``evidence`` arrays, for exchange formats that need them.

    An owner with more turns than fit one array is repeated with the next ones; ``more``
    counts those repeats (0 on the first row).
    """
    placed = numbered(evidence, ["session_id", "owner_id"], ["pos", "turn_index"], "_n", "pos")
    arrays = (placed.groupBy("session_id", F.col("owner_id").alias(owner),
                             F.expr(f"(_n - 1) div {int(max_turns)}").alias("more"))
              .agg(F.sort_array(F.collect_list(F.struct("_n", "turn_index"))).alias("_e"))
              .select("session_id", owner, "more",
                      F.transform("_e", lambda x: x["turn_index"].cast("int")).alias("evidence")))
    return (owners.join(arrays, ["session_id", owner], "left")
            .withColumn("more", F.coalesce("more", F.lit(0)))
            .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>"))))
