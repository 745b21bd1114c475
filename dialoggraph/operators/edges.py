"""Edges: numbered object lists, assertions, orphans, neighbourhoods, validation, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions import responses as R
from ..functions.text import strip, token_set
from ..session import cut
from .graph import edge_id, empty_map
from .ordered import TURN_BLOCKS, numbered
from .simjoin import distinct_sets


def object_lists(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Numbered candidate objects per (session, subject class, predicate).

    One list serves every subject of the class, so nothing is paired up here.  Objects
    are listed family by family, then in graph order.
    nodes: session_id, node_id, label, ord (found, content).
    """
    offered = nodes.join(F.broadcast(families), F.col("label") == F.col("object_label")).select(
        "session_id", "subject_label", "predicate", "family_ord", "ord", "node_id")
    # family first, then graph order: one BIGINT that grows along both
    pos = offered.withColumn("_pos", F.col("family_ord").cast("bigint") * (1 << 48) + F.col("ord"))
    return numbered(pos, ["session_id", "subject_label", "predicate"], ["_pos", "node_id"], "n",
                    "_pos", TURN_BLOCKS).select(
        "session_id", "subject_label", "predicate", "n", F.col("node_id").alias("object_id"), "ord")


def anchor_pairs(subjects: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidate objects of given subjects, numbered as the subject sees them.

    subjects: session_id, node_id, label: the new nodes of a turn, not whole sessions.
    A subject is left out of its own list, which moves later numbers up by one.
    """
    own = lists.select("session_id", "subject_label", "predicate", F.col("object_id").alias("subject_id"),
                       F.col("n").alias("_own"))
    s = subjects.select("session_id", F.col("node_id").alias("subject_id"),
                        F.col("label").alias("subject_label"))
    j = s.join(lists, ["session_id", "subject_label"]).join(
        own, ["session_id", "subject_label", "predicate", "subject_id"], "left")
    return j.filter(F.col("object_id") != F.col("subject_id")).select(
        "session_id", "subject_id", "predicate",
        (F.col("n") - F.when(F.col("n") > F.col("_own"), 1).otherwise(0)).cast("bigint").alias("n"),
        "object_id")


def parse_assertions(responses: DataFrame) -> DataFrame:
    """Model answers (session_id, subject_id, subject_label, turn_index, ord, raw) as rows."""
    items = responses.select("session_id", "subject_id", "subject_label", "turn_index", "ord",
                             F.posexplode(R.object_array(
                                 F.col("raw"), "relation string, object int, reportedIntensity string"))
                             .alias("item", "a"))
    return items.select("session_id", "subject_id", "subject_label", "turn_index", "ord", "item",
                        strip(F.col("a.relation")).alias("predicate"), F.col("a.object").alias("n"),
                        F.col("a.reportedIntensity").alias("reported_intensity"))


def assert_edges(assertions: DataFrame, lists: DataFrame) -> DataFrame:
    """Assertions (relation, number in the subject's list) as edge rows.

    The number is turned into a place in the shared list (one further down when the
    subject itself stands at or before it) and looked up by equi-join; bad relations and
    numbers out of range find nothing.  Intensity is kept on ``leadsTo`` only.
    """
    own = lists.select("session_id", "subject_label", "predicate", F.col("object_id").alias("subject_id"),
                       F.col("n").alias("_own"))
    at = (assertions.join(own, ["session_id", "subject_label", "predicate", "subject_id"], "left")
          .withColumn("_at", F.col("n") + F.when(F.col("n") >= F.col("_own"), 1).otherwise(0)))
    target = lists.select("session_id", "subject_label", "predicate", F.col("n").alias("_at"), "object_id")
    hit = at.join(target, ["session_id", "subject_label", "predicate", "_at"])
    intensity = strip(F.col("reported_intensity"))
    keep = ((F.col("predicate") == "leadsTo") & F.col("reported_intensity").isNotNull()
            & (F.lower(intensity) != "omit"))
    return hit.select(
        "session_id", "ord", "subject_id", "predicate", "object_id",
        F.when(keep, F.create_map(F.lit("reportedIntensity"), intensity)).otherwise(empty_map()).alias("props"),
        "turn_index")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Found nodes whose class may point somewhere but that point nowhere yet."""
    can = list(dict.fromkeys(s for s, _, _ in O.FAMILIES))
    preds = list(dict.fromkeys(p for _, p, _ in O.FAMILIES))
    pointing = edges.filter((F.col("status") == "found") & F.col("predicate").isin(*preds)).select(
        "session_id", F.col("subject_id").alias("node_id"))
    return nodes.filter((F.col("status") == "found") & F.col("label").isin(*can)).join(
        pointing, ["session_id", "node_id"], "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Found nodes that no found edge touches."""
    ends = edges.filter("status = 'found'").select(
        "session_id", F.explode(F.array("subject_id", "object_id")).alias("node_id"))
    return nodes.filter("status = 'found'").join(ends, ["session_id", "node_id"], "left_anti")


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` of each start over found edges in either direction.

    starts: session_id, start_id.  Out: session_id, start_id, node_id, hops; the start
    itself is not listed.
    """
    found = edges.filter("status = 'found'")
    both = found.select("session_id", F.col("subject_id").alias("node_id"), F.col("object_id").alias("_to")
                        ).unionByName(found.select("session_id", F.col("object_id").alias("node_id"),
                                                   F.col("subject_id").alias("_to"))).distinct()
    key = ["session_id", "start_id", "node_id"]
    frontier = cut(starts.select("session_id", "start_id", F.col("start_id").alias("node_id"),
                                 F.lit(0).alias("hops")))
    seen = frontier
    for h in range(1, hops + 1):
        nxt = (frontier.join(both, ["session_id", "node_id"])
               .select("session_id", "start_id", F.col("_to").alias("node_id")).distinct()
               .join(seen, key, "left_anti").withColumn("hops", F.lit(h)))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def retry_subjects(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame,
                   hops: int = 2) -> DataFrame:
    """Older orphans that one of this turn's new nodes may have unblocked.

    Pool per new node: what it reaches, plus isolated nodes; every node of the session
    when it reaches nothing.  Kept: orphans that are not new and whose class may point at
    the new node's class.  The pools are tested as semi-joins, never listed per new node:
    what matters is only which object classes each session offers in which pool.
    """
    full_map = [(s, o) for s, _, o in O.EDGE_MAP]
    fits = nodes.sparkSession.createDataFrame(
        list(dict.fromkeys(full_map)), "label string, new_label string")
    orphan = orphans(nodes, edges).join(new_nodes.select("session_id", "node_id"),
                                        ["session_id", "node_id"], "left_anti")
    starts = new_nodes.select("session_id", F.col("node_id").alias("start_id"),
                              F.col("label").alias("new_label"))
    near = cut(neighbourhood(starts, edges, hops))
    reached_starts = near.select("session_id", "start_id").distinct()
    new_labels = starts.join(reached_starts.withColumn("_hit", F.lit(True)),
                             ["session_id", "start_id"], "left").select(
        "session_id", "new_label", F.coalesce("_hit", F.lit(False)).alias("_hit")).distinct()
    # (a) reached from a new node of a fitting class
    via = (near.join(starts, ["session_id", "start_id"])
           .select("session_id", "node_id", "new_label").distinct()
           .join(orphan, ["session_id", "node_id"])
           .join(F.broadcast(fits), ["label", "new_label"]).select(*orphan.columns))
    # (b) isolated, with any fitting new node; (c) any orphan, with one that reaches nothing
    wanted = new_labels.join(F.broadcast(fits), "new_label").select("session_id", "label", "_hit").distinct()
    lonely = isolated(nodes, edges).select("session_id", "node_id")
    iso = (orphan.join(lonely, ["session_id", "node_id"], "left_semi")
           .join(wanted, ["session_id", "label"], "left_semi"))
    anyone = orphan.join(wanted.filter("not _hit"), ["session_id", "label"], "left_semi")
    return via.unionByName(iso).unionByName(anyone).dropDuplicates(["session_id", "node_id"])


def reinforces_lists(nodes: DataFrame) -> DataFrame:
    """Numbered reactions and beliefs per session; the two lists are not crossed."""
    pick = nodes.filter(F.col("label").isin("Reaction", "CoreBelief"))
    return numbered(pick, ["session_id", "label"], ["ord", "node_id"], "n", "ord", TURN_BLOCKS).select(
        "session_id", "label", "n", "node_id",
        P.main_text(F.col("label"), F.col("props")).alias("text"))


def reinforces_edges(answers: DataFrame, lists: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accepted (reaction, belief) numbers as edge rows with the evidence of both ends.

    answers: session_id, ord, reaction, belief.  One row per evidence turn.
    """
    r = lists.filter("label = 'Reaction'").select("session_id", F.col("n").alias("reaction"),
                                                  F.col("node_id").alias("subject_id"))
    b = lists.filter("label = 'CoreBelief'").select("session_id", F.col("n").alias("belief"),
                                                    F.col("node_id").alias("object_id"))
    hit = answers.join(r, ["session_id", "reaction"]).join(b, ["session_id", "belief"]).select(
        "session_id", "ord", "subject_id", F.lit("reinforces").alias("predicate"), "object_id",
        empty_map().alias("props"))
    return with_both_evidences(hit, evidence)


def with_both_evidences(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per distinct evidence turn of either end (turn_index NULL if none)."""
    ends = edges.select(*edges.columns, F.explode(F.array("subject_id", "object_id")).alias("owner_id"))
    return ends.join(evidence.select("session_id", "owner_id", "turn_index"),
                     ["session_id", "owner_id"], "left").select(*edges.columns, "turn_index").dropDuplicates(
        ["session_id", "ord", "subject_id", "predicate", "object_id", "turn_index"])


def reframe_links(nodes: DataFrame) -> DataFrame:
    """Best thought for every adaptive response: similarity strictly above 1/5.

    Copies of a text are compared once.  Texts meet through shared rare tokens (two texts
    above the threshold share one of the prefix tokens), are verified exactly, and the
    best is an aggregate: highest score, then the earlier node.
    Out: session_id, thought_id, response_id, common, total.
    """
    base = nodes.filter(F.col("label").isin("AdaptiveResponse", "AutomaticThought")).select(
        "session_id", "label", "node_id", "ord",
        token_set(P.main_text(F.col("label"), F.col("props"))).alias("tokens"))
    keyed = base.filter(F.size("tokens") > 0)
    sides = (keyed.groupBy("session_id", "label", "tokens")
             .agg(F.min("ord").alias("ord"), F.min_by("node_id", "ord").alias("node_id")))
    sides = cut(sides)
    occ = sides.select("session_id", "label", "ord", "tokens", F.explode("tokens").alias("token"))
    freq = occ.groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("_df"))
    ranked = (occ.join(freq, ["session_id", "token"]).groupBy("session_id", "label", "ord")
              .agg(F.sort_array(F.collect_list(F.struct("_df", "token"))).alias("_t")))
    size = F.size("_t")
    pre = ranked.select("session_id", "label", "ord", size.alias("size"), F.explode(F.transform(
        F.slice("_t", F.lit(1), size - F.floor(size / 5).cast("int")), lambda x: x["token"])).alias("token"))
    resp = pre.filter("label = 'AdaptiveResponse'").select(
        "session_id", "token", F.col("ord").alias("resp_ord"), F.col("size").alias("_sr"))
    thought = pre.filter("label = 'AutomaticThought'").select(
        "session_id", "token", F.col("ord").alias("at_ord"), F.col("size").alias("_sa"))
    lo, hi = F.least("_sr", "_sa"), F.greatest("_sr", "_sa")
    met = (resp.join(thought, ["session_id", "token"]).filter(lo * 5 > hi)
           .select("session_id", "resp_ord", "at_ord").distinct())
    rt = sides.filter("label = 'AdaptiveResponse'").select(
        "session_id", F.col("ord").alias("resp_ord"), F.col("tokens").alias("_tr"))
    at = sides.filter("label = 'AutomaticThought'").select(
        "session_id", F.col("ord").alias("at_ord"), F.col("tokens").alias("_ta"),
        F.col("node_id").alias("thought_id"))
    common = F.size(F.array_intersect("_tr", "_ta"))
    scored = (met.join(rt, ["session_id", "resp_ord"]).join(at, ["session_id", "at_ord"])
              .select("session_id", "_tr", "thought_id", "at_ord", common.alias("common"),
                      (F.size("_tr") + F.size("_ta") - common).alias("total"))
              .filter(F.col("common") * 5 > F.col("total")))
    best = scored.groupBy("session_id", F.col("_tr").alias("tokens")).agg(F.max_by(
        F.struct("thought_id", "common", "total"),
        F.struct(F.col("common") / F.col("total"), -F.col("at_ord"))).alias("b"))
    responses = keyed.filter("label = 'AdaptiveResponse'").select(
        "session_id", "tokens", F.col("node_id").alias("response_id"))
    return responses.join(best, ["session_id", "tokens"]).select(
        "session_id", "b.thought_id", "response_id", "b.common", "b.total")


def reframe_edges(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    links = reframe_links(nodes).select(
        "session_id", F.lit(0).cast("bigint").alias("ord"), F.col("thought_id").alias("subject_id"),
        F.lit("hasAdaptiveResponse").alias("predicate"), F.col("response_id").alias("object_id"),
        empty_map().alias("props"))
    return with_both_evidences(links, evidence)


def structure_edges(nodes: DataFrame, client_id: str = "client_1",
                    session_node_id: str = "session_1") -> DataFrame:
    """Edges that follow from the structure alone: session_id, subject_id, predicate, object_id.

    Goal -> Problem is by definition every goal with every problem of the session, so it
    is a join of the two (already merged) node sets on the session.
    """
    found = nodes.filter("status = 'found'")
    sessions = found.select("session_id").distinct()
    base = sessions.select("session_id", F.lit(client_id).alias("subject_id"),
                           F.lit("hasSession").alias("predicate"), F.lit(session_node_id).alias("object_id"))
    pred = (F.when(F.col("label") == "Problem", "hasProblem")
            .when(F.col("label") == "Intervention", "hasIntervention")
            .when(F.col("label") == "Homework", "hasHomework"))
    held = found.filter(pred.isNotNull()).select(
        "session_id", F.lit(session_node_id).alias("subject_id"), pred.alias("predicate"),
        F.col("node_id").alias("object_id"))
    goals = found.filter("label = 'Goal'").select("session_id", F.col("node_id").alias("subject_id"))
    problems = found.filter("label = 'Problem'").select("session_id", F.col("node_id").alias("object_id"))
    aims = goals.join(problems, "session_id").select(
        "session_id", "subject_id", F.lit("targetsProblem").alias("predicate"), "object_id")
    return base.unionByName(held).unionByName(aims)


# ── validation ────────────────────────────────────────────────────────────

def classified(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the classes of their ends (NULL where the end does not exist)."""
    s = nodes.select("session_id", F.col("node_id").alias("subject_id"), F.col("label").alias("subject_label"))
    o = nodes.select("session_id", F.col("node_id").alias("object_id"), F.col("label").alias("object_label"))
    return edges.join(s, ["session_id", "subject_id"], "left").join(o, ["session_id", "object_id"], "left")


def _triple_in(triples) -> "F.Column":
    """Whether the classified edge is one of a fixed list of triples."""
    key = F.concat_ws("|", "subject_label", "predicate", "object_label")
    return key.isin(*["|".join(t) for t in triples])


def validate(edges: DataFrame, nodes: DataFrame, evidence: DataFrame | None = None,
             turns: DataFrame | None = None, ontology: O.Ontology | None = None) -> DataFrame:
    """Every edge with the reason it must be dropped, NULL for valid ones.

    Checked in order: an end is missing, the pair is forbidden, the signature is unknown,
    an evidence turn lies outside the transcript.  The rule lists are constants, so they
    are expressions; only the ends and the evidence need joins.
    """
    onto = ontology or O.Ontology.of()
    known = [e for e in O.EDGE_MAP if e in onto.families or e == O.REINFORCES or e not in O.FAMILIES]
    c = classified(edges, nodes)
    forbidden = F.lit(False)
    for s, p, o in O.DISJOINT:
        hit = (F.col("subject_label") == s) & (F.col("object_label") == o)
        forbidden |= hit if p == "*" else hit & (F.col("predicate") == p)
    outside = F.lit(False)
    if evidence is not None and turns is not None:
        stray = (evidence.join(turns.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"))
                               .distinct(), ["session_id", "turn_index"], "left_anti")
                 .select("session_id", F.col("owner_id").alias("edge_id")).distinct()
                 .withColumn("_stray", F.lit(True)))
        c = c.join(stray, ["session_id", "edge_id"], "left")
        outside = F.coalesce("_stray", F.lit(False))
    reason = (F.when(F.col("subject_label").isNull() | F.col("object_label").isNull(), "dangling")
              .when(forbidden, "disjoint")
              .when(~_triple_in(known), "signature")
              .when(outside, "evidence"))
    return c.withColumn("drop_reason", reason).select(
        *edges.columns, "subject_label", "object_label", "drop_reason")


def repair(dropped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Signature misses whose wrong-class end has exactly one alternative.

    The subject is kept and the object replaced by the only node of the session whose
    class the predicate allows for it; failing that, the object is kept and the subject
    replaced.  Classes with several nodes are no alternative, so per session and class
    only the number of nodes and one id are needed.
    """
    only = (nodes.groupBy("session_id", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min("node_id").alias("_id")))
    fam = nodes.sparkSession.createDataFrame(
        [t for t in O.SIGNATURES], "subject_label string, predicate string, object_label string")
    miss = dropped.filter("drop_reason = 'signature'").drop("drop_reason")

    def alternatives(keep: str, swap: str) -> DataFrame:
        want = F.broadcast(fam.select(f"{keep}_label", "predicate", F.col(f"{swap}_label").alias("label")))
        options = (miss.join(want, [f"{keep}_label", "predicate"])
                   .join(only, ["session_id", "label"])
                   .groupBy("session_id", "edge_id").agg(F.sum("_n").alias("_n"), F.min("_id").alias("_id")))
        return options.filter("_n = 1").select("session_id", "edge_id", F.col("_id").alias(f"_{swap}"))

    j = (miss.join(alternatives("subject", "object"), ["session_id", "edge_id"], "left")
         .join(alternatives("object", "subject"), ["session_id", "edge_id"], "left")
         .filter(F.col("_object").isNotNull() | F.col("_subject").isNotNull()))
    new_s = F.when(F.col("_object").isNotNull(), F.col("subject_id")).otherwise(F.col("_subject"))
    new_o = F.coalesce("_object", F.col("object_id"))
    return j.withColumn("subject_id", new_s).withColumn("object_id", new_o).withColumn(
        "old_edge_id", F.col("edge_id")).withColumn("edge_id", edge_id()).withColumn(
        "repaired", F.lit(True)).drop("_object", "_subject", "subject_label", "object_label")


def verdict_filter(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges not rejected by verdicts (session_id, edge_id, keep); structural ones pass."""
    rejected = verdicts.filter("not keep").select("session_id", "edge_id")
    structural = F.col("predicate").isin(*O.STRUCTURAL_PREDICATES)
    return edges.filter(structural).unionByName(
        edges.filter(~structural).join(rejected, ["session_id", "edge_id"], "left_anti"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def class_rollup(nodes: DataFrame, ontology: O.Ontology) -> DataFrame:
    """Node counts for every class and superclass; counted once, then rolled up."""
    counts = nodes.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    up = F.broadcast(ontology.ancestry(nodes.sparkSession).select("label", "ancestor"))
    return counts.join(up, "label").groupBy("session_id", F.col("ancestor").alias("class")).agg(
        F.sum("_n").cast("bigint").alias("n"))
