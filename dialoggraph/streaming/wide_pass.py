"""The periodic wide pass: sessions that crossed a consolidation turn are built anew as a whole.

The pass is a batch job inside a stream, so it must stand being run again.  Three things see to that:
a graph is a function of the transcript up to the due turn; the sessions' graphs are replaced with one
pointer (``SessionStore``), nodes, edges and evidence together; and a ledger has one file for every
batch that is done, which is written last.  A batch that died anywhere before that is run again and
arrives at the same graphs; a batch that is in the ledger changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..sources.store import SessionStore, exists, write_once
from .turn_stream import transcripts_due


def stored_rows(graph: Graph) -> DataFrame:
    """A graph as one table, kinds told apart by ``part``; columns by name."""
    parts = {"node": graph.nodes, "edge": graph.edges, "node_evidence": graph.node_evidence, "edge_evidence": graph.edge_evidence}
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("part", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def stored_graph(rows: DataFrame) -> Graph:
    """The graph back from its table."""
    part = lambda name, *columns: rows.filter(F.col("part") == name).select("session_id", *columns)
    evidence = ("owner_id", "pos", "turn_index")
    return Graph(
        part("node", "node_id", "label", "props", "status", "turn_acquired", "ord"),
        part("edge", "edge_id", "subject_id", "predicate", "object_id", "props", "status", "ord"),
        part("node_evidence", *evidence), part("edge_evidence", *evidence))


@dataclass(frozen=True)
class WidePass:
    """To be given to ``start_turns``.

    transcripts: reads all turns stored so far (session_id, turn_index, speaker, text ...)
    build: turns -> Graph, such as ``plans.batch.whole_build`` with its answers
    """

    transcripts: Callable[[], DataFrame]
    build: Callable[[DataFrame], Graph]
    store: SessionStore
    ledger: str

    def __call__(self, due: DataFrame, batch_id: int) -> None:
        spark, done = self.store.spark, f"{self.ledger}/{batch_id:012d}.json"
        if exists(spark, done):
            return
        pointer = self.store.replace(stored_rows(self.build(transcripts_due(self.transcripts(), due))))
        write_once(spark, done, json.dumps({"batch": batch_id, "pointer": pointer}))

    def graph(self) -> Graph | None:
        rows = self.store.read()
        return None if rows is None else stored_graph(rows)
