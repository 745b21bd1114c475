from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.operators import candidates as C
from dialoggraph.operators import edges as E
from dialoggraph.operators import evaluate as V
from dialoggraph.operators import prompts as PR
from dialoggraph.operators import query as Q
from dialoggraph.operators import turns as T
from dialoggraph.plans.batch import Answers, build_graph, whole_build
from dialoggraph.plans.stages import StageGraph

TURNS = [("s", 1, "client", "Situation: exam tomorrow\nAutomaticThought: I will fail"), ("s", 1, "therapist", "What then?"),
         ("s", 2, "client", "Situation: exam tomorrow morning\nReaction: so anxious\nGoal: pass"), ("s", 2, "therapist", ""),
         ("s", 3, "client", "Problem: exams\nAdaptiveResponse: I will not fail"), ("t", 1, "client", "nothing to note")]


def turns(spark):
    return spark.createDataFrame(TURNS, "session_id string, turn_index bigint, speaker string, text string")


def test_build_and_ask(spark):
    def lines(t):
        return C.line_candidates(t).withColumn("seq", F.col("line_no"))

    def answers(nodes, lists):
        s = nodes.filter("label = 'Situation'")
        return s.select("session_id", F.col("node_id").alias("subject_id"), F.col("label").alias("subject_label"),
                        F.lit(2).cast("bigint").alias("turn_index"), "ord", F.lit("triggers").alias("predicate"),
                        F.explode(F.array(F.lit(1), F.lit(2), F.lit(9))).alias("n"), F.lit(None).cast("string").alias("reported_intensity"))

    g, dropped = build_graph(turns(spark), lines, answers)
    ids = {(r.session_id, r.node_id) for r in g.nodes.collect()}
    assert ("s", "sit_1") in ids and ("s", "sit_2") not in ids and ("t", "utt_1") in ids and ("t", "client_1") in ids
    assert {r.edge_id for r in g.edges.filter("session_id = 's'").collect()} == {
        "client_1__hasSession__session_1", "session_1__hasProblem__prob_1", "goal_1__targetsProblem__prob_1",
        "sit_1__triggers__at_1", "sit_1__triggers__react_1", "at_1__hasAdaptiveResponse__adapt_1"}
    assert dropped.count() == 0 and V.conformance(g.nodes, g.edges).count() == 0
    r = Q.execute(Q.QuerySpec.of({"intent": "list", "node_labels": ["Situation"]}), g)
    assert r.nodes.first().text == "exam tomorrow morning"
    assert sorted((q.turn_index, q.speaker) for q in r.node_quotes.collect()) == [(1, "client"), (1, "therapist"), (2, "client")]
    assert {q.turn_index for q in r.node_quotes.collect()} == {1, 2}


def test_prompts(spark):
    t = turns(spark)
    p = {r.prompt_id: r.prompt for r in PR.extract_prompts(t, T.recent_exchanges(T.exchanges(t), 2)).collect()}
    assert len(p) == 4 and "Earlier exchange:\n(none)" in p["extract/s/1"]
    assert "C: Situation: exam tomorrow\nAutomaticThought: I will fail\nT: What then?" in p["extract/s/3"]
    n = spark.createDataFrame([("s", "at_1", "AutomaticThought", {"content": "I fail"}, 0), ("s", "react_1", "Reaction", {"content": "sad"}, 1),
                               ("s", "cb_1", "CoreBelief", {"content": "bad"}, 2)], "session_id string, node_id string, label string, props map<string,string>, ord bigint")
    lists = E.object_lists(n, O.Ontology.of().family_table(spark))
    pairs = E.anchor_pairs(n.filter("node_id = 'at_1'"), lists)
    e = PR.edge_prompts(pairs, n, spark.createDataFrame([("s", "C: hi")], "session_id string, context string")).first().prompt
    assert "Subject: I fail" in e and "leadsTo:\n  1. sad\nstemsFrom:\n  1. bad" in e
    r = PR.reinforces_prompts(E.reinforces_lists(n)).first().prompt
    assert "Reactions:\n  1. sad" in r and "Beliefs:\n  1. bad" in r
    c = spark.createDataFrame([("s", 1, "CoreBelief", "a b"), ("s", 2, "Goal", "g")], "session_id string, cand_id bigint, label string, text string")
    assert PR.atomise_prompts(c).count() == 1
    chunks = spark.createDataFrame([("s", 0, "turn 0 | C: x")], "session_id string, chunk bigint, transcript string")
    ev = spark.createDataFrame([("s", "cb_1", 0, 3), ("s", "cb_1", 1, 1)], "session_id string, owner_id string, pos bigint, turn_index bigint")
    prior = C.prior_lines(n, ev, O.Ontology.of().adjacent(spark))
    sp = {r.target: r.prompt for r in PR.session_prompts(chunks, prior).collect()}
    assert len(sp) == 7 and "Known already:\n  - 'bad' (turns [1, 3])" in sp["CoreBelief"] and "'I fail'" in sp["CoreBelief"]
    q = spark.createDataFrame([("s", "what {happened}?")], "session_id string, question string")
    assert "Question: what {happened}?" in PR.question_prompts(q, O.Ontology.of()).first().prompt
    a = spark.createDataFrame([("s", "Counts: Goal=1")], "session_id string, answer string")
    assert "Result:\nCounts: Goal=1" in PR.answer_prompts(q, a).first().prompt


def lines(t):
    return C.line_candidates(t).withColumn("seq", F.col("line_no"))


def model(spark):
    """Answers for every stage, from tables."""
    frame = spark.createDataFrame
    first = lambda df, cond, *cols: df.filter(cond).select("session_id", *cols)
    return Answers(
        session=lambda turns, cands: frame([("p0", "s", "CoreBelief", '[{"label": "CoreBelief", "text": "never enough", "evidence_turns": [1, 3, 99]}]'),
                                            ("p1", "s", "CoreBelief", '[{"label": "CoreBelief", "text": "Never enough", "evidence_turns": [3, 1]}]'),
                                            ("p2", "s", "Intervention", '[{"label": "Intervention", "text": "asks what then", "evidence_turns": [1]}]')],
                                           "prompt_id string, session_id string, target string, raw string"),
        split=lambda c: first(c, "text = 'I will fail'", "cand_id", F.lit('["I will fail maths", "so I am stupid"]').alias("raw")),
        reword=lambda b: first(b, "label = 'Intervention'", "label", "batch", F.lit('[{"item": 1, "description": "guided discovery"}]').alias("raw")),
        verdicts=lambda c: first(c, F.col("text").isin("pass", "so I am stupid"), "cand_id", F.when(F.col("text") == "pass", "drop").otherwise("reclassify").alias("verdict"),
                                 F.lit("CoreBelief").alias("new_label"), F.lit("vague").alias("reason")),
        subclasses=lambda c: first(c, "label = 'CoreBelief'", "cand_id", F.lit("self").alias("subclass")),
        properties=lambda c: first(c, "text = 'so anxious'", "cand_id", F.lit("channel").alias("prop"), F.lit("emotional").alias("value"), F.lit("").alias("technique_label")),
        edges=lambda n, l: n.filter("label = 'AutomaticThought'").select(
            "session_id", F.col("node_id").alias("subject_id"), F.col("label").alias("subject_label"), F.lit(1).cast("bigint").alias("turn_index"), "ord",
            F.lit("stemsFrom").alias("predicate"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), F.lit(None).cast("string").alias("reported_intensity")),
        reinforces=lambda l: l.filter("label = 'Reaction'").select("session_id", F.lit(1).cast("bigint").alias("ord"), F.col("n").alias("reaction"), F.lit(2).cast("bigint").alias("belief")),
        edge_verdicts=lambda e: e.filter("edge_id = 'at_1__stemsFrom__cb_2'").select("session_id", "edge_id", F.lit(False).alias("keep")))


def test_whole_build_goes_through_every_stage(spark):
    b = whole_build(turns(spark), lines, model(spark))
    got = {r.node_id: r for r in b.graph.nodes.filter("session_id = 's'").collect()}
    text = lambda i: got[i].props[O.TEXT_PROP[got[i].label]]
    assert text("at_1") == "I will fail maths" and text("intv_1") == "guided discovery"
    assert {text("cb_1"), text("cb_2")} == {"so I am stupid", "never enough"} and "cb_3" not in got
    assert got["cb_1"].props["domain"] == "self" and got["react_1"].props["channel"] == "emotional"
    assert [(r.session_id, r.reason) for r in b.dropped_candidates.collect()] == [("s", "vague")] and "goal_1" not in got
    belief = next(i for i in ("cb_1", "cb_2") if text(i) == "never enough")
    assert {r.turn_index for r in b.graph.node_evidence.filter(F.col("owner_id") == belief).collect()} == {1, 3}
    edges = {r.edge_id for r in b.graph.edges.filter("session_id = 's'").collect()}
    assert {"at_1__stemsFrom__cb_1", "react_1__reinforces__cb_2", "session_1__hasIntervention__intv_1"} <= edges
    assert "at_1__stemsFrom__cb_2" not in edges
    assert V.conformance(b.graph.nodes, b.graph.edges).count() == 0


def test_build_goes_on_behind_the_last_complete_stage(spark, tmp_path):
    folder = str(tmp_path / "build")
    good = model(spark)

    def lost(c):
        raise RuntimeError("the model is gone")

    first = StageGraph(spark, folder, "v1")
    with pytest.raises(RuntimeError):
        whole_build(turns(spark), lines, replace(good, subclasses=lost), first)
    assert first.made[-1] == "judged" and not first.reused
    second = StageGraph(spark, folder, "v1")
    again = whole_build(turns(spark), lines, good, second)
    assert second.reused == first.made and second.made[0] == "subclassed"
    third = StageGraph(spark, folder, "v1")
    once_more = whole_build(turns(spark), lines, good, third)
    assert not third.made
    rows = lambda b: sorted(map(str, b.graph.nodes.collect())) + sorted(map(str, b.graph.edges.collect()))
    assert rows(again) == rows(once_more) == rows(whole_build(turns(spark), lines, good))
    fourth = StageGraph(spark, folder, "v2")
    fourth.table("turns", lambda: turns(spark))
    assert fourth.made == ["turns"]


def test_written_tables_are_broadcast_by_their_rows(spark):
    """Files of ids are far smaller than their rows; only what is small in memory goes to the driver."""
    from dialoggraph.session import cut
    wide = spark.range(300_000).selectExpr("'session' AS session_id", "id")
    plan = lambda a, b: a.join(b, ["session_id", "id"])._jdf.queryExecution().executedPlan().toString()
    many, few = cut(wide), cut(wide.limit(100))
    assert "BroadcastHashJoin" not in plan(many, many.groupBy("session_id", "id").count())
    assert "BroadcastHashJoin" in plan(many.filter("id > 5"), few.drop("x").hint("broadcast"))
    assert "BroadcastHashJoin" in plan(few, few.groupBy("session_id", "id").count())


def test_the_extractor_runs_once(spark):
    """Every candidate is extracted once, however often its number is looked at, and counts along the turns."""
    calls = spark.sparkContext.accumulator(0)

    def seen(text):
        calls.add(1)
        return text != ""

    extractor = lambda t: lines(t).filter(F.udf(seen, "boolean").asNondeterministic()(F.col("text")))
    stages = StageGraph(spark)
    built = whole_build(turns(spark), extractor, stages=stages)
    n = lines(turns(spark)).count()
    assert calls.value == n
    again = stages.table("ordered", lambda: None, "found")
    assert [r.ord for r in again.orderBy("turn_index", "seq").collect()] == list(range(1, n + 1))
    assert built.graph.nodes.filter(F.col("label").isin("Situation", "Goal", "Problem")).count() == 3


def test_rules_look_at_sentences_of_their_speaker(spark):
    from dialoggraph.plans.adapters import Rule
    t = spark.createDataFrame([("s", 1, "client", "I SAW that. And the rest"), ("s", 1, "therapist", "The end! that"), ("s", 2, None, "that the")],
                              "session_id string, turn_index bigint, speaker string, text string")
    got = C.rule_candidates(t, [Rule("Problem", "client", "that", 1), Rule("Goal", "therapist", "the", 2), Rule("Situation", None, "that|rest", 3)])
    assert {(r.turn_index, r.speaker, r.sent_no, r.label, r.text) for r in got.collect()} == {
        (1, "client", 0, "Problem", "I SAW that."), (1, "client", 0, "Situation", "I SAW that."), (1, "client", 1, "Situation", "And the rest"),
        (1, "therapist", 0, "Goal", "The end!"), (1, "therapist", 1, "Situation", "that"), (2, None, 0, "Situation", "that the")}
