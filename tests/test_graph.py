import json
import random

import pytest
from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.operators import edges as E
from dialoggraph.operators import evaluate as V
from dialoggraph.operators import query as Q
from dialoggraph.operators import versions as VS
from dialoggraph.operators.graph import Graph
from dialoggraph.operators.turns import utterance_nodes
from dialoggraph.sources import readers as RD
from dialoggraph.sources import writers as W

from helpers import trace

NODE = "session_id string, node_id string, label string, props map<string,string>, status string, turn_acquired int, ord bigint"
EDGE = "session_id string, edge_id string, subject_id string, predicate string, object_id string, props map<string,string>, status string, ord bigint"
EV = "session_id string, owner_id string, pos bigint, turn_index bigint"


def edge(s, p, o, ord_, props=None, status="found", session="s"):
    return (session, f"{s}__{p}__{o}", s, p, o, props or {}, status, ord_)


@pytest.fixture(scope="module")
def seeded(spark):
    nodes = [("s", "prob_1", "Problem", {"description": "exam anxiety", "domain": "academic"}, "found", 1, 0),
             ("s", "sit_1", "Situation", {"description": "exam tomorrow", "kind": "externalSituation"}, "found", 1, 1),
             ("s", "at_1", "AutomaticThought", {"content": "I will fail", "modality": "verbal", "distortionType": "catastrophizing"}, "found", 1, 2),
             ("s", "react_1", "Reaction", {"content": "anxious", "channel": "emotional", "valence": "negative"}, "found", 1, 3)]
    edges = [edge("sit_1", "triggers", "at_1", 0), edge("at_1", "leadsTo", "react_1", 1, {"reportedIntensity": "8/10"})]
    ev = [("s", n[1], 0, 1) for n in nodes]
    eev = [("s", e[1], 0, 1) for e in edges]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE),
                 spark.createDataFrame(ev, EV), spark.createDataFrame(eev, EV))


@pytest.fixture(scope="module")
def spoken(spark, seeded):
    t = spark.createDataFrame([("s", 1, "client", "I have an exam tomorrow and I will fail."), ("s", 1, "therapist", "What goes through your mind then?")],
                              "session_id string, turn_index int, speaker string, text string")
    return Graph(seeded.nodes.unionByName(utterance_nodes(t)), seeded.edges, seeded.node_evidence, seeded.edge_evidence)


ids = lambda df: sorted(r.node_id for r in df.collect())


def test_spec():
    s = Q.QuerySpec.of({"node_labels": ["Problem", "Ship"], "predicates": ["triggers", "flies"], "property_filters": {"Problem.domain": "work"}}, "q?")
    assert (s.intent, s.node_labels, s.predicates, dict(s.property_filters), s.free_text) == ("summarize", ("Problem",), ("triggers",), {"domain": "work"}, "q?")
    assert dict(Q.QuerySpec.of({"property_filters": ["x"]}).property_filters) == {}


def test_intents(spark, seeded, spoken):
    run = lambda g, **k: Q.execute(Q.QuerySpec.of(k), g)
    assert {r.label: r.n for r in run(seeded, intent="count", node_labels=["AutomaticThought", "Goal"]).counts.collect()} == {"AutomaticThought": 1, "Goal": 0}
    for key in ("distortionType", "AutomaticThought.distortionType"):
        assert ids(run(seeded, intent="list", node_labels=["AutomaticThought"], property_filters={key: "Catastrophizing"}).nodes) == ["at_1"]
    t = run(seeded, intent="trace", node_labels=["Situation"], predicates=["triggers", "leadsTo"])
    assert ids(t.nodes) == ["at_1", "react_1", "sit_1"] and t.edges.count() == 2
    assert ids(run(spoken, intent="list").nodes) == ["at_1", "prob_1", "react_1", "sit_1"]
    assert ids(run(spoken, intent="list", node_labels=["Utterance"]).nodes) == ["utt_1", "utt_1_t"]
    q = run(spoken, intent="list", node_labels=["AutomaticThought"])
    assert [r.speaker for r in q.node_quotes.orderBy("evidence_pos", "speaker_ord").collect()] == ["client", "therapist"]
    assert run(seeded, intent="list", node_labels=["AutomaticThought"]).node_quotes.count() == 0
    d = run(seeded, intent="describe", node_labels=["AutomaticThought"])
    assert d.nodes.count() == 1 and d.edges.count() == 2
    assert run(seeded, intent="wonder", node_labels=["Problem"]).intent == "list"
    s = run(spoken, intent="summarize")
    assert s.transcript.count() == 2 and s.chain.count() == 2


def test_rendering(spark, seeded, spoken):
    s = spark.createDataFrame([("s",)], "session_id string")
    text = lambda g, **k: Q.render(Q.execute(Q.QuerySpec.of(k), g), s).first().answer
    assert text(seeded, intent="count", node_labels=["Problem"]) == "Counts: Problem=1"
    assert text(seeded, intent="list", node_labels=["Goal"]) == "This isn't in the session's graph."
    assert text(spoken, intent="list", node_labels=["Problem"]) == (
        "- Problem (prob_1): exam anxiety\n    turn 1 client: \"I have an exam tomorrow and I will fail.\"\n"
        "    turn 1 therapist: \"What goes through your mind then?\"")
    assert text(seeded, intent="summarize").splitlines()[-1] == "  AutomaticThought('I will fail') --[leadsTo]--> Reaction('anxious')"


def test_trace_equals_walking(spark):
    rng = random.Random(6)
    nodes, edges, want_n, want_e = [], [], set(), set()
    for s in range(12):
        n = [f"n{i}" for i in range(12)]
        nodes += [(f"s{s}", x, rng.choice(["Goal", "Problem"]), {}, "found", 1, i) for i, x in enumerate(n)]
        mine = []
        for i in range(18):
            a, b = rng.choice(n), rng.choice(n + ["gone"])
            e = edge(a, f"p{i}", b, i, session=f"s{s}")
            edges.append(e)
            mine.append((e[1], a, b))
        starts = [x[1] for x in nodes if x[0] == f"s{s}" and x[2] == "Goal"]
        level, walked = trace(starts, set(n), mine, 4)
        want_n |= {(f"s{s}", x, l) for x, l in level.items()}
        want_e |= {(f"s{s}", x) for x in walked}
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([], EV), spark.createDataFrame([], EV))
    ns, es = Q.trace(Q.QuerySpec("trace", ("Goal",)), g.nodes, g.edges)
    assert {(r.session_id, r.node_id, r.level) for r in ns.collect()} == want_n
    assert {(r.session_id, r.edge_id) for r in es.collect()} == want_e


def test_anchor_numbers_skip_the_subject(spark):
    n = spark.createDataFrame([("s", f"react_{i}", "Reaction", {}, "found", 1, i) for i in (1, 2, 3)] + [("s", "sit_1", "Situation", {}, "found", 1, 9)], NODE)
    lists = E.object_lists(n, O.Ontology.of().family_table(spark))
    pairs = {(r.predicate, r.n): r.object_id for r in E.anchor_pairs(n.filter("node_id = 'react_2'"), lists).collect()}
    assert pairs == {("leadsTo", 1): "react_1", ("leadsTo", 2): "react_3", ("becomesSituation", 1): "sit_1"}
    raw = json.dumps([{"relation": "leadsTo", "object": 2, "reportedIntensity": " 7 "}, {"relation": "leadsTo", "object": 3},
                      {"relation": "becomesSituation", "object": 1, "reportedIntensity": "9"}, {"relation": "leadsTo", "object": 1, "reportedIntensity": "OMIT"}])
    resp = spark.createDataFrame([("s", "react_2", "Reaction", 4, 1, raw)],
                                 "session_id string, subject_id string, subject_label string, turn_index bigint, ord bigint, raw string")
    got = {(r.predicate, r.object_id): dict(r.props) for r in E.assert_edges(E.parse_assertions(resp), lists).collect()}
    assert got == {("leadsTo", "react_3"): {"reportedIntensity": "7"}, ("becomesSituation", "sit_1"): {}, ("leadsTo", "react_1"): {}}


def test_retry_pools(spark):
    n = spark.createDataFrame([("s", "prob_1", "Problem", {}, "found", 1, 0), ("s", "sit_1", "Situation", {}, "found", 1, 1),
                               ("s", "at_1", "AutomaticThought", {}, "found", 1, 2), ("s", "ib_1", "IntermediateBelief", {}, "found", 1, 3),
                               ("s", "sit_2", "Situation", {}, "found", 2, 4)], NODE)
    e = spark.createDataFrame([edge("sit_1", "triggers", "at_1", 0), edge("ib_1", "influencesPerceptionOf", "sit_1", 1)], EDGE)
    new = n.filter("node_id = 'sit_2'")
    assert ids(E.retry_subjects(n, e, new)) == ["prob_1"]  # nothing reachable: any orphan that may point at a situation
    assert ids(E.orphans(n, e)) == ["at_1", "prob_1", "sit_2"]
    assert ids(E.isolated(n, e)) == ["prob_1", "sit_2"]
    near = {(r.node_id, r.hops) for r in E.neighbourhood(spark.createDataFrame([("s", "at_1")], "session_id string, start_id string"), e).collect()}
    assert near == {("sit_1", 1), ("ib_1", 2)}


def test_reframe_prefers_score_then_order(spark):
    n = spark.createDataFrame([("s", "at_1", "AutomaticThought", {"content": "I always fail exams"}, "found", 1, 1), ("s", "at_2", "AutomaticThought", {"content": "fail exams always I"}, "found", 1, 2),
                               ("s", "at_3", "AutomaticThought", {"content": "nothing shared"}, "found", 1, 3), ("s", "ad_1", "AdaptiveResponse", {"content": "I passed most exams"}, "found", 1, 4),
                               ("s", "ad_2", "AdaptiveResponse", {"content": "quite different words"}, "found", 1, 5),
                               ("s", "ad_3", "AdaptiveResponse", {"content": "a b c d nothing"}, "found", 1, 6)], NODE)
    got = {r.response_id: (r.thought_id, r.common, r.total) for r in E.reframe_links(n).collect()}
    assert got == {"ad_1": ("at_1", 2, 6)}  # ad_3 shares 1 of 6 words: not above 1/5


def test_validation_and_repair(spark):
    n = spark.createDataFrame([("s", "goal_1", "Goal", {}, "found", 1, 0), ("s", "prob_1", "Problem", {}, "found", 1, 1), ("s", "sit_1", "Situation", {}, "found", 1, 2),
                               ("s", "sit_2", "Situation", {}, "found", 1, 3), ("s", "at_1", "AutomaticThought", {}, "found", 1, 4), ("s", "at_2", "AutomaticThought", {}, "found", 1, 5),
                               ("s", "intv_1", "Intervention", {}, "found", 1, 6)], NODE)
    e = spark.createDataFrame([edge("goal_1", "targetsProblem", "prob_1", 0), edge("goal_1", "targetsProblem", "sit_1", 1), edge("at_1", "leadsTo", "at_2", 2),
                               edge("sit_1", "triggers", "gone", 3), edge("intv_1", "appliedTo", "goal_1", 4), edge("sit_2", "triggers", "at_1", 5), edge("prob_1", "triggers", "at_1", 6)], EDGE)
    ev = spark.createDataFrame([("s", "sit_2__triggers__at_1", 0, 99)], EV)
    turns = spark.createDataFrame([("s", 1)], "session_id string, turn_index bigint")
    v = E.validate(e, n, ev, turns)
    assert [r.drop_reason for r in v.orderBy("ord").collect()] == [None, "signature", "disjoint", "dangling", "disjoint", "evidence", "signature"]
    fixed = {r.old_edge_id: r.edge_id for r in E.repair(v, n).collect()}
    assert fixed == {"goal_1__targetsProblem__sit_1": "goal_1__targetsProblem__prob_1"}  # two situations: no single alternative


def test_structure_and_reinforces(spark):
    n = spark.createDataFrame([("s", "goal_1", "Goal", {}, "found", 1, 0), ("s", "prob_1", "Problem", {}, "found", 1, 1), ("s", "prob_2", "Problem", {}, "found", 1, 2),
                               ("s", "hw_1", "Homework", {}, "found", 1, 3), ("s", "intv_1", "Intervention", {}, "missing", 1, 4),
                               ("s", "react_1", "Reaction", {}, "found", 1, 5), ("s", "cb_1", "CoreBelief", {}, "found", 1, 6)], NODE)
    got = sorted((r.subject_id, r.predicate, r.object_id) for r in E.structure_edges(n).collect())
    assert got == [("client_1", "hasSession", "session_1"), ("goal_1", "targetsProblem", "prob_1"), ("goal_1", "targetsProblem", "prob_2"),
                   ("session_1", "hasHomework", "hw_1"), ("session_1", "hasProblem", "prob_1"), ("session_1", "hasProblem", "prob_2")]
    ev = spark.createDataFrame([("s", "react_1", 0, 5), ("s", "cb_1", 0, 2), ("s", "cb_1", 1, 5)], EV)
    ans = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 1, 2)], "session_id string, ord bigint, reaction bigint, belief bigint")
    rows = E.reinforces_edges(ans, E.reinforces_lists(n), ev).collect()
    assert sorted(r.turn_index for r in rows) == [2, 5] and {r.object_id for r in rows} == {"cb_1"}


def test_transcript_and_graph_files(spark, tmp_path, seeded):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "sess_a.json").write_text(json.dumps([{"speaker": "Patient", "text": " hi\n"}, {"speaker": " Therapist ", "text": "go on"}, {"speaker": "observer", "text": ""}]), encoding="utf-8")
    got = [(r.session_id, r.turn_index, r.speaker, r.text) for r in RD.read_transcripts(spark, str(tmp_path / "t")).orderBy("turn_index").collect()]
    assert got == [("sess_a", 0, "client", "hi"), ("sess_a", 1, "therapist", "go on"), ("sess_a", 2, "observer", "")]
    doc = {"meta": {}, "tbox_nodes": [{"name": "x"}], "nodes": [{"id": "sit_1", "label": "Situation", "parent": "CognitiveModel", "properties": {"description": "d"}, "evidence": [2, 1]},
           {"id": "at_1", "label": "AutomaticThought", "properties": None, "evidence": None}],
           "edges": [{"type": "triggers", "from": "sit_1", "to": "at_1", "evidence": [1], "reportedIntensity": "8/10"}, {"type": "triggers", "from": "sit_1", "to": "at_1", "reportedIntensity": ""}]}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "one.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    g = RD.read_graph_json(spark, str(tmp_path / "g"))
    assert {(r.session_id, r.node_id, r.label) for r in g.nodes.collect()} == {("one", "sit_1", "Situation"), ("one", "at_1", "AutomaticThought")}
    assert [r.turn_index for r in g.node_evidence.orderBy("pos").collect()] == [2, 1]
    assert [dict(r.props) for r in g.edges.orderBy("ord").collect()] == [{"reportedIntensity": "8/10"}, {}]
    W.write_graph_json(seeded, str(tmp_path / "out"))
    back = RD.read_graph_json(spark, str(tmp_path / "out"))
    key = lambda x: {(r.session_id, r.node_id, r.label, tuple(sorted(r.props.items()))) for r in x.nodes.collect()}
    assert key(back) == key(seeded)
    assert {(r.edge_id, tuple(r.props.items())) for r in back.edges.collect()} == {(r.edge_id, tuple(r.props.items())) for r in seeded.edges.collect()}
    assert RD.summary_text(RD.load_summary(seeded), "JSON: one").first().summary.startswith("Loaded **JSON: one** — 4 nodes, 2 edges.\n\n- AutomaticThought: 1")


def test_property_graph_tables(spark, tmp_path, spoken):
    t = W.property_graph_tables(spoken, O.Ontology.of())
    assert t["classes"].count() == 17 and t["subclass_of"].count() == 16 and t["in_session"].count() == 2
    assert sorted(r.rel_type for r in t["relations"].collect()) == ["LEADS_TO", "TRIGGERS"]
    W.write_property_graph(t, str(tmp_path / "pg"))
    assert spark.read.parquet(str(tmp_path / "pg" / "instances")).filter("label = 'Problem'").count() == 1


def test_displays(spark, spoken):
    rows = {r.id: (r.label, r.type) for r in W.display_nodes(spoken.nodes).collect()}
    assert rows["sit_1"] == ("Situation\nexam tomorrow", "cognitive") and rows["utt_1"][1] == "provenance"
    n, e = W.canvas(spoken)
    assert n.count() == 4 and e.count() == 2 and W.display_edges(spoken.edges).count() == 2


def test_overlay_round_trip_and_order(spark, seeded):
    from dialoggraph.operators.merge import flip, scaffold_edges, scaffold_nodes
    onto, s = O.Ontology.of(), spark.createDataFrame([("s",)], "session_id string")
    nodes = flip(scaffold_nodes(s, onto), seeded.nodes, "node_id")
    edges = flip(scaffold_edges(s, onto), seeded.edges, "edge_id")
    found_n, found_e = nodes.filter("status = 'found'"), edges.filter("status = 'found'")
    n2, e2 = VS.overlay(nodes, edges, found_n, found_e)
    order = lambda df, k: [(r[k], r.status) for r in df.orderBy("ord").collect()]
    assert order(n2, "node_id") == order(nodes, "node_id") and order(e2, "edge_id") == order(edges, "edge_id")
    kept = found_n.filter("node_id <> 'sit_1'")
    new = spark.createDataFrame([("s", "sit_99", "Situation", {"description": "by hand"}, "found", None, 0)], NODE)
    n3, e3 = VS.overlay(nodes, edges, kept.unionByName(new), found_e.limit(0))
    got = [r.node_id for r in n3.orderBy("ord").collect()]
    assert "sit_1" not in got and got[-1] == "sit_99"
    assert [i for i in got if i != "sit_99"] == [i for i, _ in order(nodes, "node_id") if i != "sit_1"]
    assert all("sit_1" not in (r.subject_id, r.object_id) for r in e3.collect())


def test_edits_and_branches(spark, seeded):
    n, e = VS.delete_nodes(seeded.nodes, seeded.edges, spark.createDataFrame([("s", "at_1")], "session_id string, node_id string"))
    assert n.count() == 3 and e.count() == 0
    ch = spark.createDataFrame([("s", "zzz", 1, None, "Goal", None)], "session_id string, node_id string, op_no int, props map<string,string>, label string, status string")
    assert VS.update_nodes(seeded.nodes, ch)[1].count() == 1
    t = spark.createDataFrame([("s", "m", 1, "client", "I froze in the meeting."), ("s", "m", 2, "client", "It happened again Tuesday.")],
                              "session_id string, branch_id string, turn_index bigint, speaker string, text string")
    edits = spark.createDataFrame([("s", "m", "b", 2, "Actually Tuesday went well."), ("s", "m", "c", 99, "x")],
                                  "session_id string, branch_id string, new_branch_id string, turn_index bigint, message string")
    branches, own, rejected = VS.rewrite_turns(t, edits)
    assert rejected.count() == 1
    assert {r.branch_id: (r.label, r.active) for r in branches.collect()} == {"m": ("turn 2: It happened again Tuesday.", False), "b": ("turn 2: Actually Tuesday went well.", True)}
    lines = {}
    for r in VS.branch_timeline(t.unionByName(own), branches).orderBy("turn_index").collect():
        lines.setdefault(r.branch_id, []).append(r.text)
    assert lines == {"m": ["I froze in the meeting.", "It happened again Tuesday."], "b": ["I froze in the meeting.", "Actually Tuesday went well."]}
    back = VS.switch_branch(branches, spark.createDataFrame([("s", "m")], "session_id string, branch_id string"))
    assert {r.branch_id: r.active for r in back.collect()} == {"m": True, "b": False}
    assert sorted(r.turn_index for r in VS.editable_turns(t).collect()) == [1, 2]


def test_replacing_write(spark, tmp_path, seeded):
    path = str(tmp_path / "nodes")
    two = seeded.nodes.unionByName(seeded.nodes.withColumn("session_id", F.lit("t")))
    VS.write_replacing(two, path)
    now = VS.replace_graph(spark.read.parquet(path).drop("bucket"), two.filter("session_id = 't' and label = 'Problem'"))
    assert {r.session_id: r["count"] for r in now.groupBy("session_id").count().collect()} == {"s": 4, "t": 1}


def test_conformance_and_recall(spark, seeded):
    assert V.conformance(seeded.nodes, seeded.edges).count() == 0
    bad = seeded.nodes.unionByName(spark.createDataFrame([("s", "cb_1", "CoreBelief", {"domain": "world", "category": "helpless"}, "found", 1, 8),
                                                          ("s", "x_1", "Ship", {}, "found", 1, 9)], NODE))
    assert sorted((r.kind, r.ref) for r in V.conformance(bad, seeded.edges).collect()) == [("gating", "cb_1"), ("label", "x_1")]
    rec = {r.label: r.recall for r in V.recall(seeded.nodes, bad, "label").collect()}
    assert rec["CoreBelief"] == 0 and rec["Problem"] == 1


def test_long_evidence_is_continued(spark, seeded, tmp_path):
    """A node with more evidence than one row holds comes back whole and in order."""
    from dialoggraph.operators import graph as GR
    n = 25_000
    long_ev = spark.range(n).select(F.lit("s").alias("session_id"), F.lit("at_1").alias("owner_id"), F.col("id").alias("pos"), (F.lit(n) - F.col("id")).alias("turn_index"))
    W.write_graph_json(Graph(seeded.nodes, seeded.edges, long_ev, seeded.edge_evidence), str(tmp_path / "g"))
    back = RD.read_graph_json(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 4
    ev = back.node_evidence.filter("owner_id = 'at_1'")
    assert ev.count() == n and ev.filter(F.col("pos") + F.col("turn_index") != n).count() == 0
    assert GR.EVIDENCE_ROW < n
