"""Writers: graph documents, display shapes, property-graph tables, guard log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions.lookup import lookup
from ..functions.props import get_prop
from ..operators.graph import Graph, evidence_arrays
from ..operators.guard import log_rows
from ..operators.ordered import numbered

# Rows per exported document; a large session becomes several documents.
PART_ROWS = 5000


def graph_documents(graph: Graph, part_rows: int = PART_ROWS) -> DataFrame:
    """Found nodes and edges as JSON documents: session_id, part, doc.

    A session that fits is one document.  A larger one is several parts, each a valid
    document of its own, so no task has to hold a whole session.  A row whose evidence is
    very long is continued by rows with the same id and a ``more`` count.
    """
    g = graph.found()
    nodes = numbered(evidence_arrays(g.nodes, g.node_evidence, "node_id"), ["session_id"],
                     ["ord", "node_id", "more"], "_n", "ord")
    edges = numbered(evidence_arrays(g.edges, g.edge_evidence, "edge_id"), ["session_id"],
                     ["ord", "edge_id", "more"], "_n", "ord")
    more = F.nullif("more", F.lit(0)).alias("more")
    part = F.expr(f"cast((_n - 1) div {int(part_rows)} as int)")
    node = F.struct("_n", F.to_json(F.struct(
        F.col("node_id").alias("id"), "label", F.col("props").alias("properties"), "evidence", more)).alias("d"))
    lifted = F.nullif(get_prop(F.col("props"), "reportedIntensity"), F.lit(""))
    edge = F.struct("_n", F.to_json(F.struct(
        F.col("predicate").alias("type"), F.col("subject_id").alias("from"), F.col("object_id").alias("to"),
        "evidence", lifted.alias("reportedIntensity"), more)).alias("d"))
    listed = lambda rows, item, name: rows.groupBy("session_id", part.alias("part")).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["d"]), ",").alias(name))
    both = listed(nodes, node, "_nodes").join(listed(edges, edge, "_edges"), ["session_id", "part"], "full_outer")
    return both.select("session_id", "part", F.concat(
        F.expr("substring(to_json(struct(session_id, part)), 1, length(to_json(struct(session_id, part))) - 1)"),
        F.lit(',"nodes":['), F.coalesce("_nodes", F.lit("")), F.lit('],"edges":['),
        F.coalesce("_edges", F.lit("")), F.lit("]}")).alias("doc"))


def write_graph_json(graph: Graph, path: str) -> None:
    graph_documents(graph).select("doc").write.mode("overwrite").text(path)


def display_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes for a network view: label with a preview, type by layer or ``missing``."""
    keys = ["content", "description", "statement", "taskDescription", "text"]
    preview = F.substring(F.coalesce(*[F.nullif(get_prop(F.col("props"), k), F.lit("")) for k in keys],
                                     F.lit("")), 1, 25)
    layer = lookup(O.LAYER, F.col("label"), F.lit("field"))
    return nodes.select(
        "session_id", F.col("node_id").alias("id"),
        F.when((F.col("status") == "found") & (preview != ""),
               F.concat("label", F.lit("\n"), preview)).otherwise(F.col("label")).alias("label"),
        F.when(F.col("status") == "missing", "missing").otherwise(layer).alias("type"), "status",
        F.col("label").alias("raw_label"), "ord")


def display_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("status = 'found'").select(
        "session_id", F.col("edge_id").alias("id"), F.col("subject_id").alias("source"),
        F.col("object_id").alias("target"), F.col("predicate").alias("label"), "predicate", "status", "ord")


def canvas(graph: Graph, skip_scaffold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Editable view: no utterances (optionally no client / session), no loose edges."""
    hidden = O.SCAFFOLD_LABELS if skip_scaffold else ["Utterance"]
    nodes = graph.nodes.filter(~F.col("label").isin(*hidden))
    ids = nodes.select("session_id", "node_id")
    edges = graph.edges.filter("status = 'found'")
    for end in ("subject_id", "object_id"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), ["session_id", end], "left_semi")
    return nodes, edges.select(*graph.edges.columns)


def property_graph_tables(graph: Graph, ontology: O.Ontology) -> dict[str, DataFrame]:
    """Class and instance tables of a labelled property graph.

    classes (name), subclass_of (child, parent), instances, is_a, relations, evidenced_by,
    in_session; relation names are the upper-case types.
    """
    spark = graph.nodes.sparkSession
    g = graph.found()
    tree = ontology.hierarchy(spark)
    rel = lookup(O.REL_TYPE, F.col("predicate"))
    instances = g.nodes.select(
        "session_id", F.col("node_id").alias("id"), "label",
        F.map_filter("props", lambda k, v: v.isNotNull()).alias("props"), "turn_acquired")
    speech = g.nodes.filter("label = 'Utterance'")
    return {
        "classes": tree.select(F.col("label").alias("name")),
        "subclass_of": tree.filter("parent is not null").select(F.col("label").alias("child"), "parent"),
        "instances": instances,
        "is_a": g.nodes.select("session_id", F.col("node_id").alias("id"), F.col("label").alias("class")),
        "relations": g.edges.select("session_id", F.col("subject_id").alias("start_id"),
                                    rel.alias("rel_type"), F.col("object_id").alias("end_id"), "props"
                                    ).filter("rel_type is not null"),
        "evidenced_by": g.node_evidence.select(
            "session_id", F.col("owner_id").alias("start_id"),
            F.concat(F.lit("utt_"), F.col("turn_index").cast("string")).alias("end_id")).distinct(),
        "in_session": speech.select("session_id", F.col("node_id").alias("start_id"),
                                    F.lit("session_1").alias("end_id")),
    }


def write_property_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet folders; instances by class and relations by type, so scans prune."""
    split = {"instances": "label", "relations": "rel_type"}
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if name in split:
            w = w.partitionBy(split[name])
        w.parquet(f"{path}/{name}")


def write_guard_log(guarded: DataFrame, path: str) -> None:
    """Append one JSON row per reply with a removal or a crisis."""
    log_rows(guarded).withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ")
                                 ).write.mode("append").json(path)
