"""Readers: transcripts, exported graphs, property-graph tables, corrected graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions.lookup import lookup
from ..functions.props import get_prop
from ..functions.text import strip
from ..operators.graph import EVIDENCE_ROW, Graph, edge_id, empty_map
from ..operators.turns import normal_speaker

NODE_JSON = ("id string, node_id string, label string, status string, evidence array<string>, "
             "properties map<string,string>, props map<string,string>, more bigint")
EDGE_JSON = ("`type` string, predicate string, `from` string, subject_id string, `to` string, "
             "object_id string, status string, evidence array<string>, reportedIntensity string, "
             "props map<string,string>, more bigint")


def _session_of_file() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Files with one JSON array of {speaker, text} each: one session per file.

    The index is the position in the array, which a line-oriented JSON scan would lose.
    """
    files = spark.read.text(path, wholetext=True).withColumn("session_id", _session_of_file())
    items = files.select("session_id", F.posexplode(
        F.from_json("value", "array<struct<speaker:string,text:string>>")).alias("turn_index", "t"))
    return items.select("session_id", "turn_index", normal_speaker(F.col("t.speaker")).alias("speaker"),
                        strip(F.col("t.text")).alias("text"))


def _graph_rows(docs: DataFrame) -> Graph:
    """docs: session_id, part, g (parsed document); a session may span several parts."""
    n = docs.select("session_id", "part", F.posexplode("g.nodes").alias("i", "n"))
    ident = F.coalesce("n.id", "n.node_id")
    at = F.col("part") * F.lit(1 << 20) + F.col("i")
    nodes = n.filter(ident.isNotNull() & (ident != "")).select(
        "session_id", ident.alias("node_id"), F.coalesce("n.label", F.lit("None")).alias("label"),
        F.coalesce(F.when(F.size("n.properties") > 0, F.col("n.properties")), F.col("n.props"),
                   empty_map()).alias("props"),
        F.coalesce("n.status", F.lit("found")).alias("status"),
        F.lit(None).cast("int").alias("turn_acquired"), at.cast("bigint").alias("ord"),
        F.col("n.evidence").alias("_ev"), F.col("n.more").alias("_more"))
    e = docs.select("session_id", "part", F.posexplode("g.edges").alias("i", "e"))
    s, p, o = (F.coalesce("e.from", "e.subject_id"), F.coalesce("e.type", "e.predicate"),
               F.coalesce("e.to", "e.object_id"))
    lifted = F.nullif("e.reportedIntensity", F.lit(""))
    base = F.coalesce("e.props", empty_map())
    props = F.when(lifted.isNotNull(), F.map_concat(
        F.map_filter(base, lambda k, v: k != "reportedIntensity"),
        F.create_map(F.lit("reportedIntensity"), lifted))).otherwise(base)
    edges = e.filter(s.isNotNull() & o.isNotNull() & (s != "") & (o != "")).select(
        "session_id", edge_id(s, F.coalesce(p, F.lit("None")), o).alias("edge_id"), s.alias("subject_id"),
        F.coalesce(p, F.lit("None")).alias("predicate"), o.alias("object_id"), props.alias("props"),
        F.coalesce("e.status", F.lit("found")).alias("status"), at.cast("bigint").alias("ord"),
        F.col("e.evidence").alias("_ev"), F.col("e.more").alias("_more"))

    def evidence(rows: DataFrame, owner: str) -> DataFrame:
        ev = rows.select("session_id", F.col(owner).alias("owner_id"), F.coalesce("_more", F.lit(0)).alias("_more"),
                         F.posexplode("_ev").alias("pos", "t"))
        return ev.select("session_id", "owner_id", (F.col("_more") * EVIDENCE_ROW + F.col("pos")).cast("bigint").alias("pos"),
                         F.expr("try_cast(t as bigint)").alias("turn_index")).filter("turn_index is not null")

    first = lambda rows: rows.filter("_more is null").drop("_ev", "_more")
    return Graph(first(nodes), first(edges), evidence(nodes, "node_id"), evidence(edges, "edge_id"))


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """Exported graph documents.  Either one document per file (session = file name) or
    lines written by ``write_graph_json`` that carry session_id and part.

    Class-hierarchy sections of a document are ignored.
    """
    schema = f"session_id string, part int, nodes array<struct<{_colon(NODE_JSON)}>>, edges array<struct<{_colon(EDGE_JSON)}>>"
    files = spark.read.text(path, wholetext=True).withColumn("_file", _session_of_file())
    # a multi-document file has one document per line
    many = F.col("value").rlike(r'^\{"session_id"')
    lines = files.select("_file", F.explode(F.when(many, F.filter(
        F.split("value", "\n"), lambda l: l != "")).otherwise(F.array("value"))).alias("doc"))
    docs = lines.select("_file", F.from_json("doc", schema).alias("g")).select(
        F.coalesce("g.session_id", "_file").alias("session_id"), F.coalesce("g.part", F.lit(0)).alias("part"), "g")
    return _graph_rows(docs)


def _colon(ddl: str) -> str:
    """'a string, b int' -> 'a:string,b:int' for use inside a struct type."""
    out = []
    for f in ddl.split(", "):
        name, kind = f.split(" ", 1)
        out.append(f"{name}:{kind}")
    return ",".join(out)


def ingest_corrected(docs: DataFrame) -> Graph:
    """Corrected graphs (session_id, doc JSON) in either export shape.

    ``from`` / ``subject_id``, ``type`` / ``predicate``, ``properties`` / ``props`` are
    all understood; rows without ids are skipped.
    """
    schema = f"nodes array<struct<{_colon(NODE_JSON)}>>, edges array<struct<{_colon(EDGE_JSON)}>>"
    return _graph_rows(docs.select("session_id", F.lit(0).alias("part"), F.from_json("doc", schema).alias("g")))


def read_property_graph(nodes: DataFrame, rels: DataFrame) -> Graph:
    """Tables of a labelled property graph as a canonical graph.

    nodes: session_id, id, labels ARRAY, props MAP, ord; rels: session_id, start_id,
    rel_type, end_id, props MAP (``evidence`` as a comma list), ord.  The class is
    primaryLabel, else the first label that is not the instance marker, else Unknown;
    bookkeeping properties are dropped; evidence is the set of turns of the utterances
    linked by EVIDENCED_BY; unknown relation types are dropped.
    """
    other = F.filter("labels", lambda l: l != "ABox")
    label = F.coalesce(F.nullif(get_prop(F.col("props"), "primaryLabel"), F.lit("")),
                       F.get(other, F.lit(0)), F.lit("Unknown"))
    hidden = ["id", "primaryLabel", "turnAcquired"]
    out_nodes = nodes.select(
        "session_id", F.col("id").alias("node_id"), label.alias("label"),
        F.map_filter("props", lambda k, v: ~k.isin(*hidden) & v.isNotNull()).alias("props"),
        F.lit("found").alias("status"),
        get_prop(F.col("props"), "turnAcquired").try_cast("int").alias("turn_acquired"), "ord")
    spoken = nodes.filter(F.array_contains("labels", "Utterance")).select(
        "session_id", F.col("id").alias("end_id"),
        get_prop(F.col("props"), "turnIndex").try_cast("bigint").alias("turn_index"))
    evidence = (rels.filter("rel_type = 'EVIDENCED_BY'").join(spoken, ["session_id", "end_id"])
                .filter("turn_index is not null")
                .select("session_id", F.col("start_id").alias("owner_id"), F.col("turn_index").alias("pos"),
                        "turn_index").distinct())
    typed = rels.withColumn("predicate", lookup({r: p for p, r in O.REL_TYPE.items()}, F.col("rel_type"))).filter("predicate is not null")
    ident = edge_id("start_id", "predicate", "end_id")
    out_edges = typed.select(
        "session_id", ident.alias("edge_id"), F.col("start_id").alias("subject_id"), "predicate",
        F.col("end_id").alias("object_id"), F.map_filter("props", lambda k, v: k != "evidence").alias("props"),
        F.lit("found").alias("status"), "ord")
    edge_ev = (typed.select("session_id", ident.alias("owner_id"), F.posexplode(
        F.split(F.coalesce(get_prop(F.col("props"), "evidence"), F.lit("")), ",")).alias("pos", "t"))
        .select("session_id", "owner_id", F.col("pos").cast("bigint").alias("pos"),
                F.expr("try_cast(trim(t) as bigint)").alias("turn_index")).filter("turn_index is not null"))
    return Graph(out_nodes, out_edges, evidence, edge_ev)


def load_summary(graph: Graph) -> DataFrame:
    """Counts per class with session totals: session_id, label, n, total_nodes, total_edges."""
    per = graph.nodes.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("session_id").agg(F.sum("n").cast("bigint").alias("total_nodes"))
    edges = graph.edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_edges"))
    return per.join(totals, "session_id").join(edges, "session_id", "left").na.fill(0, ["total_edges"])


def summary_text(summary: DataFrame, source: str) -> DataFrame:
    """Summary per session as text; one line per class."""
    lines = summary.groupBy("session_id", "total_nodes", "total_edges").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("label", "n"))),
        lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["n"].cast("string"))), "\n").alias("_l"))
    return lines.select("session_id", F.concat(
        F.lit(f"Loaded **{source}** — "), F.col("total_nodes").cast("string"), F.lit(" nodes, "),
        F.col("total_edges").cast("string"), F.lit(" edges.\n\n"), "_l").alias("summary"))
