"""The five graph questions: list, trace, count, describe, summarize.

A question is a validated ``QuerySpec``; ``execute`` composes DataFrames from it over the
graphs of all sessions at once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions.props import get_prop, main_text, matches
from ..session import cut
from .graph import Graph
from .turns import transcript_view

INTENTS = ("list", "trace", "count", "describe", "summarize")
DESCRIBE_NODES = 5
CHAIN_EDGES = 8
TRACE_HOPS = 4


@dataclass(frozen=True)
class QuerySpec:
    intent: str = "summarize"
    node_labels: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    property_filters: Mapping[str, str] = field(default_factory=dict)
    free_text: str = ""

    @staticmethod
    def of(raw: Mapping | None, question: str = "") -> "QuerySpec":
        """Fill defaults, drop terms outside the vocabulary, unqualify filter keys."""
        raw = dict(raw or {})
        filters = raw.get("property_filters")
        filters = filters if isinstance(filters, Mapping) else {}
        bare = {str(k).rsplit(".", 1)[-1]: str(v) for k, v in filters.items()}
        return QuerySpec(
            raw.get("intent") or "summarize",
            tuple(l for l in raw.get("node_labels") or () if l in O.LABELS),
            tuple(p for p in raw.get("predicates") or () if p in O.PREDICATES),
            {k: v for k, v in bare.items() if k},
            raw.get("free_text") or question)


@dataclass(frozen=True)
class ResultSet:
    """What a question returns; parts that do not belong to the intent are None."""

    intent: str
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    counts: DataFrame | None = None
    chain: DataFrame | None = None
    transcript: DataFrame | None = None
    node_quotes: DataFrame | None = None
    edge_quotes: DataFrame | None = None


def utterance_index(nodes: DataFrame) -> DataFrame:
    """Spoken words by turn: session_id, turn_index, speaker, speaker_ord, text."""
    turn = get_prop(F.col("props"), "turnIndex").try_cast("int")
    speaker = F.coalesce(F.nullif(get_prop(F.col("props"), "speaker"), F.lit("")), F.lit("unknown"))
    return (nodes.filter("label = 'Utterance'")
            .select("session_id", turn.alias("turn_index"), speaker.alias("speaker"),
                    F.when(speaker == "client", 0).otherwise(1).alias("speaker_ord"),
                    get_prop(F.col("props"), "text").alias("text"), "ord")
            .filter(F.col("turn_index").isNotNull() & (F.coalesce("text", F.lit("")) != "")))


def quotes(owners: DataFrame, evidence: DataFrame, utts: DataFrame, owner: str) -> DataFrame:
    """Words behind each owner, in evidence order, client first within a turn.

    One row per (owner, quote); owners without quotes have no row.
    """
    wanted = evidence.join(owners.select("session_id", F.col(owner).alias("owner_id")),
                           ["session_id", "owner_id"], "left_semi")
    return wanted.join(utts.withColumnRenamed("ord", "utt_ord"), ["session_id", "turn_index"]).select(
        "session_id", F.col("owner_id").alias(owner), F.col("pos").alias("evidence_pos"),
        "turn_index", "speaker_ord", "speaker", "text", "utt_ord")


def node_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("session_id", "node_id", "label",
                        main_text(F.col("label"), F.col("props")).alias("text"), "props", "ord")


def edge_view(edges: DataFrame) -> DataFrame:
    return edges.select("session_id", "edge_id", "subject_id", "predicate", "object_id",
                        "props", "ord")


def matching_nodes(nodes: DataFrame, spec: QuerySpec) -> DataFrame:
    """Label and property filter; utterances only when asked for by name."""
    picked = (nodes.filter(F.col("label").isin(*spec.node_labels)) if spec.node_labels
              else nodes.filter("label <> 'Utterance'"))
    return picked.filter(matches(F.col("props"), dict(spec.property_filters)))


def count_labels(nodes: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """Nodes per session and label; requested labels appear even when there are none."""
    if not labels:
        return nodes.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("n"))
    wanted = list(dict.fromkeys(labels))
    per_session = nodes.groupBy("session_id").agg(
        *[F.count_if(F.col("label") == l).alias(l) for l in wanted])
    return per_session.unpivot("session_id", wanted, "label", "n")


def first_per_session(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per session in graph order (limited before the shuffle)."""
    w = Window.partitionBy("session_id").orderBy("ord")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ``ids`` (session_id, node_id), each once.

    ``ids`` is at most a few nodes per session; two semi-joins would read the edges
    twice, so both ends of an edge are offered to one semi-join instead.
    """
    ends = edges.withColumn("_end", F.explode(F.array_distinct(F.array("subject_id", "object_id"))))
    hit = ends.join(ids.select("session_id", F.col("node_id").alias("_end")),
                    ["session_id", "_end"], "left_semi")
    return hit.drop("_end").dropDuplicates(["session_id", "edge_id"])


def trace_levels(starts: DataFrame, nodes: DataFrame, edges: DataFrame,
                 hops: int = TRACE_HOPS) -> DataFrame:
    """Nodes reached along edges from ``starts``: session_id, node_id, level (0..hops).

    Every hop is one equi-join of the new frontier with the edges; the written frontier
    is the only thing the next hop depends on.
    """
    key = ["session_id", "node_id"]
    known = nodes.select(*key)
    step = edges.select("session_id", F.col("subject_id").alias("node_id"),
                        F.col("object_id").alias("_to"))
    frontier = cut(starts.select(*key).withColumn("level", F.lit(0)))
    reached = frontier
    for level in range(1, hops + 1):
        nxt = (frontier.join(step, key).select("session_id", F.col("_to").alias("node_id"))
               .distinct().join(known, key, "left_semi").join(reached, key, "left_anti")
               .withColumn("level", F.lit(level)))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def trace(spec: QuerySpec, nodes: DataFrame, edges: DataFrame,
          hops: int = TRACE_HOPS) -> tuple[DataFrame, DataFrame]:
    """Reached nodes with their level, and every edge that was walked."""
    if spec.predicates:
        edges = edges.filter(F.col("predicate").isin(*spec.predicates))
    levels = trace_levels(matching_nodes(nodes, spec), nodes, edges, hops)
    left = levels.filter(F.col("level") < hops).select(
        "session_id", F.col("node_id").alias("subject_id"))
    alive = nodes.select("session_id", F.col("node_id").alias("object_id"))
    walked = (edges.join(left, ["session_id", "subject_id"], "left_semi")
              .join(alive, ["session_id", "object_id"], "left_semi"))
    return nodes.join(levels, ["session_id", "node_id"]), walked


def chain_sample(nodes: DataFrame, edges: DataFrame, n: int = CHAIN_EDGES) -> DataFrame:
    """First ``n`` chain edges per session whose two ends exist, with both texts."""
    ends = nodes.select("session_id", "node_id", "label",
                        main_text(F.col("label"), F.col("props")).alias("text"))
    subj = ends.select("session_id", F.col("node_id").alias("subject_id"),
                       F.col("label").alias("subject_label"), F.col("text").alias("subject_text"))
    obj = ends.select("session_id", F.col("node_id").alias("object_id"),
                      F.col("label").alias("object_label"), F.col("text").alias("object_text"))
    chain = edges.filter(F.col("predicate").isin(*O.CHAIN_PREDICATES))
    alive = (chain.join(subj.select("session_id", "subject_id"), ["session_id", "subject_id"], "left_semi")
             .join(obj.select("session_id", "object_id"), ["session_id", "object_id"], "left_semi"))
    first = first_per_session(alive, n)
    return (first.join(subj, ["session_id", "subject_id"]).join(obj, ["session_id", "object_id"])
            .select("session_id", "ord", "subject_id", "subject_label", "subject_text", "predicate",
                    "object_id", "object_label", "object_text"))


def execute(spec: QuerySpec, graph: Graph) -> ResultSet:
    nodes, edges = graph.nodes, graph.edges
    if spec.intent == "count":
        return ResultSet("count", counts=count_labels(nodes, spec.node_labels))
    utts = utterance_index(nodes)
    if spec.intent == "summarize":
        return ResultSet("summarize", counts=count_labels(nodes),
                         chain=chain_sample(nodes, edges), transcript=transcript_view(utts))

    def quoted(intent: str, ns: DataFrame, es: DataFrame | None) -> ResultSet:
        return ResultSet(
            intent, nodes=node_view(ns), edges=None if es is None else edge_view(es),
            node_quotes=quotes(ns, graph.node_evidence, utts, "node_id"),
            edge_quotes=None if es is None else quotes(es, graph.edge_evidence, utts, "edge_id"))

    if spec.intent == "describe":
        picked = first_per_session(matching_nodes(nodes, spec), DESCRIBE_NODES)
        return quoted("describe", picked, touching(edges, picked))
    if spec.intent == "trace":
        ns, es = trace(spec, nodes, edges)
        return quoted("trace", ns, es)
    return quoted("list", matching_nodes(nodes, spec), None)


def result_sizes(result: ResultSet, sessions: DataFrame) -> DataFrame:
    """Nodes in the result per session; 0 for intents that return none."""
    if result.nodes is None:
        return sessions.select("session_id", F.lit(0).cast("bigint").alias("n_nodes"))
    n = result.nodes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sessions.select("session_id").join(n, "session_id", "left").select(
        "session_id", F.coalesce("n_nodes", F.lit(0)).cast("bigint").alias("n_nodes"))


def _joined(lines: DataFrame) -> DataFrame:
    """Lines (session_id, o1, o2, line) to one text per session; a fixed number per session."""
    return lines.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("o1", "o2", "line"))), lambda x: x["line"]), "\n").alias("answer"))


def render(result: ResultSet, sessions: DataFrame) -> DataFrame:
    """Plain-text answer per session: session_id, answer.

    Only bounded parts are rendered (counts per class, eight nodes with two quotes, eight
    chain edges), so the text of a session never depends on its size.
    """
    zero = F.lit(0).cast("bigint")
    if result.intent == "count":
        body = result.counts.groupBy("session_id").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("label", "n"))),
            lambda x: F.concat(x["label"], F.lit("="), x["n"].cast("string"))), ", ").alias("c"))
        body = body.select("session_id", F.concat(F.lit("Counts: "), "c").alias("answer"))
        empty = "Nothing matched in this session's graph."
    elif result.intent == "summarize":
        # one block text: heading, sorted counts, then the chain sample if there is one
        head = sessions.select("session_id", zero.alias("o1"), F.lit("").alias("o2"),
                               F.lit("Graph summary:").alias("line"))
        counts = result.counts.select(
            "session_id", (zero + 1).alias("o1"), F.col("label").alias("o2"),
            F.concat(F.lit("  - "), "label", F.lit(": "), F.col("n").cast("string")).alias("line"))
        chain_head = result.chain.select("session_id").distinct().select(
            "session_id", (zero + 2).alias("o1"), F.lit("").alias("o2"),
            F.lit("Sample cognitive chain edges:").alias("line"))
        chain = result.chain.select(
            "session_id", (zero + 3).alias("o1"), F.lpad(F.col("ord").cast("string"), 20, "0").alias("o2"),
            F.concat(F.lit("  "), "subject_label", F.lit("('"), F.substring("subject_text", 1, 30),
                     F.lit("') --["), "predicate", F.lit("]--> "), "object_label", F.lit("('"),
                     F.substring("object_text", 1, 30), F.lit("')")).alias("line"))
        body = _joined(head.unionByName(counts).unionByName(chain_head).unionByName(chain))
        empty = ""
    else:
        shown = first_per_session(result.nodes, 8)
        qw = Window.partitionBy("session_id", "node_id").orderBy(
            "evidence_pos", "speaker_ord", "utt_ord")
        quoted = (result.node_quotes.withColumn("_q", F.row_number().over(qw)).filter("_q <= 2")
                  .join(shown.select("session_id", "node_id", "ord"), ["session_id", "node_id"])
                  .select("session_id", F.col("ord").alias("o1"), F.col("_q").alias("o2"),
                          F.concat(F.lit("    turn "), F.col("turn_index").cast("string"), F.lit(" "),
                                   "speaker", F.lit(': "'), F.substring("text", 1, 120),
                                   F.lit('"')).alias("line")))
        rows = shown.select("session_id", F.col("ord").alias("o1"), F.lit(0).alias("o2"),
                            F.concat(F.lit("- "), "label", F.lit(" ("), "node_id", F.lit("): "),
                                     "text").alias("line"))
        body = _joined(rows.unionByName(quoted))
        empty = "This isn't in the session's graph."
    return sessions.select("session_id").join(body, "session_id", "left").select(
        "session_id", F.coalesce("answer", F.lit(empty)).alias("answer"))
