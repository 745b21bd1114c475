from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.functions import props as P
from dialoggraph.functions import responses as R
from dialoggraph.functions.lexicon import temporality, valence
from dialoggraph.operators import candidates as C


def test_ontology_sizes():
    assert len(O.LABELS) == 13 and len(O.CONTENT_LABELS) == 10
    assert len(O.FAMILIES) == 22 and len(O.SIGNATURES) == 23 and len(O.EDGE_MAP) == 38 and len(O.PREDICATES) == 20
    assert len(O.ENUMS[("AutomaticThought", "distortionType")]) == 11 and len(O.ENUMS[("Intervention", "technique")]) == 13
    assert len(O.PROBLEM_DOMAINS) == 7 and len(O.ENUMS[("Homework", "taskType")]) == 7
    assert O.REL_TYPE["hasAdaptiveResponse"] == "HAS_ADAPTIVE_RESPONSE" and O.REL_TYPE["targets"] == "TARGETS"
    assert ("AutomaticThought", "leadsTo", "Reaction") in O.SIGNATURES and O.REINFORCES in O.SIGNATURES


def test_ontology_versions(spark):
    live, batch = O.Ontology.of(), O.Ontology.of("batch")
    assert len(batch.families) == 21 and "personal" in batch.enums[("Problem", "domain")]
    assert batch.text_prop["Intervention"] == "techniqueLabel" and "Utterance" not in batch.id_prefix
    assert live.edge_map(spark).count() == 38 and batch.signatures(spark).count() == 22
    assert live.ancestry(spark).filter("label = 'Reaction'").count() == 3
    assert "- Problem: description=string; domain=academic | work" in live.render()
    assert "Utterance" not in live.render()


def test_gating(spark):
    cases = [("CoreBelief", {"domain": "world", "category": "helpless"}, {"domain": "world"}),
             ("CoreBelief", {"domain": "self", "category": "unlovable"}, {"domain": "self", "category": "unlovable"}),
             ("Reaction", {"channel": "behavioral", "valence": "negative"}, {"channel": "behavioral"}),
             ("Reaction", {"channel": "emotional", "valence": "negative"}, {"channel": "emotional", "valence": "negative"}),
             ("Intervention", {"technique": "realityTesting", "techniqueLabel": "x"}, {"technique": "realityTesting"}),
             ("Intervention", {"technique": "other", "techniqueLabel": "my custom"}, {"technique": "other", "techniqueLabel": "my custom"}),
             ("AutomaticThought", {"content": "I'll fail"}, {"content": "I'll fail", "modality": "verbal"}),
             ("Homework", {"taskDescription": "write a diary"}, {"taskDescription": "write a diary", "isOptional": "false"}),
             ("Goal", {}, {})]
    df = spark.createDataFrame(cases, "label string, props map<string,string>, want map<string,string>")
    for r in df.select("label", "want", P.gate(F.col("label"), F.col("props")).alias("got")).collect():
        assert dict(r.got) == dict(r.want), r.label


def test_lexicons(spark):
    cases = [("yesterday I was sad", "past", "negative"), ("I feel glad", None, "positive"), ("crusade", None, "negative"),
             ("nothing here", None, None), ("RIGHT NOW I am Happy but sad", "present", "negative"), ("เมื่อวาน เศร้า", "past", "negative"),
             ("พรุ่งนี้ ดีใจ", "anticipated", "positive"), ("tomorrow, not yesterday", "past", None), ("yesterday ตอนนี้", "present", None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = [(r.t, r.a, r.b) for r in df.select("t", temporality(F.col("t")).alias("a"), valence(F.col("t")).alias("b")).collect()]
    assert got == cases


def test_main_text(spark):
    cases = [("Goal", {"statement": "g"}, "g", "g"), ("Goal", {"content": "c", "description": "d"}, "d", "d"),
             ("Goal", {"statement": "", "text": "t"}, "", "t"), ("Utterance", {"text": "u"}, "u", "u"), ("Client", {}, "", "")]
    df = spark.createDataFrame([(l, p) for l, p, _, _ in cases], "label string, props map<string,string>")
    got = [(r.a, r.b) for r in df.select(P.main_text(F.col("label"), F.col("props")).alias("a"),
                                         P.main_text(F.col("label"), F.col("props"), skip_empty=True).alias("b")).collect()]
    assert got == [(a, b) for _, _, a, b in cases]


def test_line_extractor(spark):
    text = "Situation: exam tomorrow\nAutomaticThought: I will fail\r\n  Goal :  rest  \nClient: x\nJust: words\nno label\nX: y"
    df = spark.createDataFrame([("s", 1, text)], "session_id string, turn_index int, text string")
    got = [(r.label, r.text) for r in C.line_candidates(df).orderBy("line_no").collect()]
    assert got == [("Situation", "exam tomorrow"), ("AutomaticThought", "I will fail"), ("Goal", "rest")]


def test_response_arrays(spark):
    cases = [('<think>[1]</think>[{"label":"Goal","text":"g"}]', 1), ('Sure: [{"label":"Goal","text":"g"}, 3, "x"] done', 1),
             ("no brackets", None), ("[]", 0), ('[{"label":', None), ("[{]", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: r.n for r in df.select("i", F.size(R.object_array(F.col("raw"), "label string, text string")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}
    texts = spark.createDataFrame([('["a", " ", 5, null, {"x": 1}, " b "]',), ("oops",), ("[]",)], "raw string")
    assert [r[0] for r in texts.select(R.string_array(F.col("raw"))).collect()] == [["a", "b"], None, []]


def test_reply_objects(spark):
    cases = [('{"response": "hi", "technique": "t"}', ("hi", "t")), ('```json\n{"response": "hi"}\n```', ("hi", None)),
             ('{\\"response\\": \\"hi\\"}', ("hi", None)), ('draft {x} then {"response": "hi", "technique": "t"} end', ("hi", "t")),
             ('{"response": "a"} and {"response": "b"} end', ("b", None)), ('broken "response": "hi there", "technique', ("hi there", None)),
             ("only prose", ("only prose", None))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: (r.r.response, r.r.technique) for r in df.select("i", R.reply_object(F.col("raw")).alias("r")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_infer_runs_in_batches_and_survives_failures(spark):
    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)], "prompt_id string, prompt string").coalesce(1)
    ok = {r.prompt_id: r.raw for r in C.infer(df, lambda ps: [p.upper() for p in ps]).collect()}
    assert ok == {str(i): f"P{i}" for i in range(5)}

    def broken(prompts):
        raise ValueError("down")
    assert {r.raw for r in C.infer(df, broken).collect()} == {None}


CAND = "session_id string, cand_id bigint, label string, text string, group_key string, props map<string,string>"


def test_atomise_and_fresh_ids(spark):
    df = spark.createDataFrame([("s", 1, "CoreBelief", "a and b", "self", {"k": "v"}), ("s", 2, "CoreBelief", "rambling", None, {}),
                                ("s", 3, "Goal", "untouched", None, {}), ("s", 4, "CoreBelief", "kept", None, {}), ("s", 5, "CoreBelief", "same", None, {})], CAND)
    resp = spark.createDataFrame([("s", 1, '["a", "b"]'), ("s", 2, '["short"]'), ("s", 3, '["x","y"]'), ("s", 4, "?"), ("s", 5, '["same"]')],
                                 "session_id string, cand_id bigint, raw string")
    out = C.fresh_ids(C.atomise(df, resp).withColumn("_o", F.col("parent_id") * 10 + F.col("part")), ["_o"], "_o")
    got = {r.cand_id: (r.text, r.parent_id, r.group_key, dict(r.props)) for r in out.collect()}
    assert got == {6: ("a", 1, None, {"sourceText": "a and b"}), 7: ("b", 1, None, {"sourceText": "a and b"}),
                   2: ("short", 2, None, {"sourceText": "rambling"}), 3: ("untouched", 3, None, {}),
                   4: ("kept", 4, None, {"sourceText": "kept"}), 5: ("same", 5, None, {})}


def test_judge_and_discriminators(spark):
    df = spark.createDataFrame([("s", i, "Problem" if i < 3 else "CoreBelief", f"t{i}", "home" if i == 1 else None, {}) for i in range(6)], CAND)
    v = spark.createDataFrame([("s", 0, "DROP ", "", ""), ("s", 1, "reclassify", "Goal", ""), ("s", 2, "reclassify", "AutomaticThought", ""),
                               ("s", 3, "reclassify", "CoreBelief", ""), ("s", 4, "maybe", "", "")],
                              "session_id string, cand_id bigint, verdict string, new_label string, reason string")
    kept, dropped = C.judge(df, v)
    assert {r.cand_id: r.label for r in kept.collect()} == {1: "Problem", 2: "AutomaticThought", 3: "CoreBelief", 4: "CoreBelief", 5: "CoreBelief"}
    assert [(r.cand_id, r.reason) for r in dropped.collect()] == [(0, "(no reason)")]
    a = spark.createDataFrame([("s", 2, "work"), ("s", 3, "self"), ("s", 4, "moon")], "session_id string, cand_id bigint, subclass string")
    got = {r.cand_id: r.group_key for r in C.assign_discriminator(df, a).collect()}
    assert got == {0: "other", 1: "other", 2: "work", 3: "self", 4: None, 5: None}


def test_prepared(spark):
    df = spark.createDataFrame([("s", 1, "Reaction", "so sad", None, {"channel": "emotional"}), ("s", 2, "Situation", "exam tomorrow", None, {}),
                                ("s", 3, "AutomaticThought", "I fail", None, {"content": "kept"})], CAND)
    got = {r.cand_id: dict(r.props) for r in C.prepared(df).collect()}
    assert got == {1: {"channel": "emotional", "valence": "negative", "content": "so sad"},
                   2: {"temporality": "anticipated", "kind": "externalSituation", "description": "exam tomorrow"},
                   3: {"content": "kept", "modality": "verbal"}}


def test_repeats(spark):
    df = spark.createDataFrame([("s", 1, "A b ", [2, 1]), ("s", 2, "a B", [1, 2]), ("s", 3, "a b", [1])], "session_id string, at int, text string, evidence array<int>")
    assert sorted(r.at for r in C.drop_repeats(df, ["session_id"], "at").collect()) == [1, 3]
