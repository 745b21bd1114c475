"""Transcripts to graphs: all stages of the batch route, each a table that a restart can go on from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..operators import candidates as C
from ..operators import edges as E
from ..operators import merge as M
from ..operators import turns as T
from ..operators.graph import Graph, empty_map
from ..operators.ordered import numbered
from ..session import cut
from .stages import StageGraph

Extractor = Callable[[DataFrame], DataFrame]
Asked = Callable[..., DataFrame] | None

CANDIDATE = ["session_id", "cand_id", "label", "text", "group_key", "props", "evidence", "turn_index", "seq"]
EDGE = ["session_id", "ord", "subject_id", "predicate", "object_id", "props", "turn_index"]
# Items of one rewording prompt.
REWORD_BATCH = 6


@dataclass(frozen=True)
class Answers:
    """What a model says at each stage, as tables; a stage without answers is passed over.

    session(turns, cands): prompt_id, session_id, target, raw, as ``candidates.session_candidates`` reads
    split(cands): session_id, cand_id, raw; reword(batches): session_id, label, batch, raw
    verdicts(cands), subclasses(cands), properties(cands): as ``candidates.judge`` and so on read
    edges(nodes, lists): as ``edges.assert_edges`` reads; reinforces(lists): session_id, ord, reaction, belief
    edge_verdicts(edges): session_id, edge_id, keep
    """

    session: Asked = None
    split: Asked = None
    reword: Asked = None
    verdicts: Asked = None
    subclasses: Asked = None
    properties: Asked = None
    edges: Asked = None
    reinforces: Asked = None
    edge_verdicts: Asked = None


@dataclass(frozen=True)
class Built:
    graph: Graph
    dropped_edges: DataFrame       # with drop_reason
    dropped_candidates: DataFrame  # session_id, cand_id, reason


def found_candidates(found: DataFrame) -> DataFrame:
    """Extracted candidates with ids in the order of their turns."""
    rows = found.select("session_id", "label", "text", F.col("turn_index").cast("bigint").alias("turn_index"), F.col("seq").cast("bigint").alias("seq"))
    # numbering reads its rows twice; the extractor runs once
    named = numbered(cut(rows), ["session_id"], ["turn_index", "seq", "label", "text"], "cand_id", "turn_index")
    return named.select(
        "session_id", "cand_id", "label", "text", F.lit(None).cast("string").alias("group_key"), empty_map().alias("props"),
        F.array("turn_index").alias("evidence"), "turn_index", "seq")


def with_session_pass(cands: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates of the turns, then those of the whole-session pass, at their first evidence turn."""
    one = items.groupBy("session_id", "prompt_id", "item", "label", "text").agg(
        F.sort_array(F.collect_set("turn_index")).alias("evidence"))
    more = one.select("session_id", F.lit(None).cast("bigint").alias("cand_id"), "label", "text",
                      F.lit(None).cast("string").alias("group_key"), empty_map().alias("props"), "evidence",
                      F.get("evidence", F.lit(0)).alias("turn_index"), F.lit((1 << 31) - 1).cast("bigint").alias("seq"), "prompt_id", "item")
    both = cands.withColumns({"prompt_id": F.lit(""), "item": F.lit(0)}).unionByName(more)
    return C.fresh_ids(both, ["turn_index", "prompt_id", "item"], "turn_index").select(*CANDIDATE)


def split_candidates(cands: DataFrame, raw: DataFrame) -> DataFrame:
    parts = C.atomise(cands, raw)
    return C.fresh_ids(parts, ["turn_index", "parent_id", "part"], "turn_index").select(*CANDIDATE)


def whole_build(turns: DataFrame, extractor: Extractor, answers: Answers = Answers(),
                stages: StageGraph | None = None, ontology: O.Ontology | None = None) -> Built:
    """Graph of every session.

    ``extractor`` maps turns to candidates (session_id, turn_index, label, text and a ``seq`` that
    orders the candidates of a turn).  Stages: turns, per-turn candidates, whole-session pass, splitting,
    rewording, repeats, verdicts, subclasses, properties, merge, edges (structure, reframing, answers,
    reinforcement), validation, repair, edge verdicts.
    """
    onto = ontology or O.Ontology.of()
    st = stages or StageGraph(turns.sparkSession)
    turns = st.table("turns", lambda: turns)
    cands, last = st.table("found", lambda: found_candidates(extractor(turns)), "turns"), "found"

    def stage(name: str, asked: Asked, make: Callable[[], DataFrame]) -> None:
        nonlocal cands, last
        if asked is not None:
            cands, last = st.table(name, make, last), name

    stage("session_pass", answers.session, lambda: with_session_pass(
        cands, C.session_candidates(answers.session(turns, cands), turns)))
    stage("split", answers.split, lambda: split_candidates(cands, answers.split(cands)))
    if answers.reword is not None:
        batches = st.table("batches", lambda: T.batches(cands, ["session_id", "label"], ["turn_index", "seq", "cand_id"], "turn_index", REWORD_BATCH), last)
        cands, last = st.table("reworded", lambda: C.normalise(batches, answers.reword(batches)).select(*CANDIDATE), "batches"), "reworded"
    # Chunks of the session pass overlap; what the turns said twice is evidence, not a repeat.
    stage("distinct", answers.session, lambda: C.drop_repeats(cands, ["session_id", "label"], "cand_id"))
    dropped = cands.limit(0).select("session_id", "cand_id", F.lit("").alias("reason"))
    if answers.verdicts is not None:
        given = st.table("verdicts", lambda: answers.verdicts(cands), last)
        dropped = st.table("dropped", lambda: C.judge(cands, given)[1].select("session_id", "cand_id", "reason"), last, "verdicts")
        cands, last = st.table("judged", lambda: C.judge(cands, given)[0].select(*CANDIDATE), last, "verdicts"), "judged"
    stage("subclassed", answers.subclasses, lambda: C.assign_discriminator(cands, answers.subclasses(cands), onto.enums))
    stage("classified", answers.properties, lambda: C.classify(cands, answers.properties(cands)).select(*CANDIDATE))

    # A number for every candidate, unique in its session, along turns; candidates as found have it as their id.
    def in_order() -> DataFrame:
        rows = C.prepared(with_subclass(cands))
        if last == "found":
            return rows.withColumn("ord", F.col("cand_id"))
        return numbered(rows, ["session_id"], ["turn_index", "seq", "cand_id"], "ord", "turn_index")

    ready = st.table("ordered", in_order, last)
    merged = M.merge(ready.select("session_id", "label", "ord", "text", "props", "turn_index"))
    nodes = st.table("nodes", lambda: merged.nodes.select(
        "session_id", "node_id", "label", "props", F.lit("found").alias("status"), "turn_acquired", "ord"), "ordered")
    evidence = st.table("evidence", lambda: all_evidence(merged, ready), "ordered")

    def asserted() -> DataFrame:
        none = F.lit(None).cast("bigint")
        rows = E.structure_edges(nodes).select(
            "session_id", none.alias("ord"), "subject_id", "predicate", "object_id", empty_map().alias("props"), none.alias("turn_index"))
        rows = rows.unionByName(E.reframe_edges(nodes, evidence).select(*EDGE))
        if answers.edges is not None:
            lists = st.table("lists", lambda: E.object_lists(nodes, onto.family_table(turns.sparkSession)), "nodes")
            rows = rows.unionByName(E.assert_edges(answers.edges(nodes, lists), lists).select(*EDGE))
        if answers.reinforces is not None:
            pairs = st.table("pairs", lambda: E.reinforces_lists(nodes), "nodes")
            rows = rows.unionByName(E.reinforces_edges(answers.reinforces(pairs), pairs, evidence).select(*EDGE))
        # What follows from the structure stands behind what was said.
        return rows.withColumn("ord", F.coalesce("ord", F.lit((1 << 63) - 1)))

    claims = st.table("claims", asserted, "nodes", "evidence")
    edges, edge_evidence = M.upsert_edges(claims)
    edges = st.table("edges", lambda: edges, "claims")
    edge_evidence = st.table("edge_evidence", lambda: edge_evidence, "claims")
    sessions = turns.select("session_id").distinct()
    fixed = M.scaffold_nodes(sessions, onto).filter(F.col("label").isin("Client", "Session")).withColumn("status", F.lit("found"))
    everything = st.table("graph_nodes", lambda: fixed.unionByName(nodes.withColumn("ord", F.col("ord") + 1000)).unionByName(
        T.utterance_nodes(turns).withColumn("ord", F.col("ord") + F.lit(1 << 55))), "turns", "nodes")
    checked = st.table("checked", lambda: E.validate(edges, everything, edge_evidence, turns, onto), "edges", "edge_evidence", "graph_nodes")
    valid = checked.filter("drop_reason is null").select(*edges.columns)
    fixed_edges = E.repair(checked.filter("drop_reason is not null"), everything).select(*edges.columns)
    # A repair may arrive at an edge that is there: it is that edge.
    kept = valid.unionByName(fixed_edges.join(valid.select("session_id", "edge_id"), ["session_id", "edge_id"], "left_anti")
                             .dropDuplicates(["session_id", "edge_id"]))
    if answers.edge_verdicts is not None:
        repaired = st.table("repaired", lambda: kept, "checked")
        kept = st.table("accepted", lambda: E.verdict_filter(repaired, answers.edge_verdicts(repaired)), "repaired")
    return Built(Graph(everything, kept, evidence, edge_evidence), checked.filter("drop_reason is not null"), dropped)


def with_subclass(cands: DataFrame) -> DataFrame:
    """The subclass under the property that tells subclasses of its class apart, unless that is set."""
    props = F.col("props")
    for label, prop in O.DISCRIMINATOR.items():
        given = (F.col("label") == label) & F.col("group_key").isNotNull() & ~F.map_contains_key("props", prop)
        props = F.when(given, F.map_concat("props", F.create_map(F.lit(prop), F.col("group_key")))).otherwise(props)
    return cands.withColumn("props", props)


def all_evidence(merged: M.Merged, ready: DataFrame) -> DataFrame:
    """Evidence of nodes: every evidence turn of every candidate, in order of first mention."""
    turns = ready.select("session_id", "label", "ord", F.explode("evidence").alias("turn_index"))
    owner = merged.assigned.select("session_id", "label", "ord", M.node_name(F.col("label"), F.col("node_no")).alias("owner_id"))
    return (turns.join(owner, ["session_id", "label", "ord"]).groupBy("session_id", "owner_id", "turn_index")
            .agg(F.min("ord").alias("pos")).select("session_id", "owner_id", "pos", "turn_index"))


def build_graph(turns: DataFrame, extractor: Extractor,
                answer_edges: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                ontology: O.Ontology | None = None) -> tuple[Graph, DataFrame]:
    """Graph of every session, and the edges dropped in validation, with answers for edges only."""
    built = whole_build(turns, extractor, Answers(edges=answer_edges), ontology=ontology)
    return built.graph, built.dropped_edges
