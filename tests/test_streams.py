import os
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.operators import guard as X
from dialoggraph.operators import merge as M
from dialoggraph.operators import phases as H
from dialoggraph.streaming.guard_stream import start_guard
from dialoggraph.streaming.turn_stream import TURN_SCHEMA, Utterances, latest, start_turns, transcripts_due, utterance_stream, with_row_state

TURNS = [("s", 1, [("Problem", "work stress")], None, None), ("s", 2, [], "Assessment", None),
         ("s", 3, [("Situation", "exam tomorrow")], None, "Technique"), ("s", 4, [("Situation", "exam tomorrow morning")], None, None),
         ("s", 5, [("AutomaticThought", "I will fail"), ("Problem", "no sleep")], "realityTesting", None),
         ("s", 6, [("Situation", "tomorrow morning exam hall")], None, None),
         ("t", 1, [("Goal", "rest")], None, None), ("t", 2, [("Goal", "rest")], None, None)]


def test_turn_stream_out_of_order_and_repeated(spark, tmp_path):
    """Turns arrive late, early and twice; the result is that of the ordered batch."""
    src = tmp_path / "in"
    arrival = [[5, 1, 7], [3, 6, 1], [0, 2, 4]]  # positions in TURNS per file
    for i, part in enumerate(arrival):
        spark.createDataFrame([TURNS[p] for p in part], TURN_SCHEMA).coalesce(1).write.mode("append").parquet(str(src / f"f={i}"))
    stream = (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src)))
    due_seen = []
    q = start_turns(stream, str(tmp_path / "out"), str(tmp_path / "ck"),
                    wide_pass=lambda due, _: due_seen.extend((r.session_id, r.turn_index) for r in due.collect()))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r.session_id, r.turn_index, r.phase, r.technique, r.n_before, r.node_id or "") for r in rows.collect())
    rb, ass, rt = O.INITIAL_TECHNIQUE, "Assessment", "realityTesting"
    assert got == [("s", 1, "Rapport", rb, 0, "prob_1"), ("s", 2, "Exploration", ass, 1, ""), ("s", 3, "Exploration", ass, 1, "sit_1"),
                   ("s", 4, "Exploration", ass, 2, "sit_1"), ("s", 5, "Technique", rt, 2, "at_1"), ("s", 5, "Technique", rt, 2, "prob_2"),
                   ("s", 6, "Technique", rt, 4, "sit_1"), ("t", 1, "Rapport", rb, 0, "goal_1"), ("t", 2, "Rapport", rb, 1, "goal_1")]
    assert due_seen == [("s", 6)]
    flat = spark.createDataFrame([(s, t, l, x) for s, t, c, _, _ in TURNS for l, x in c], "session_id string, turn_index bigint, label string, text string")
    batch = M.merge(flat.withColumn("ord", F.col("turn_index")).withColumn("props", F.create_map().cast("map<string,string>")))
    assert ({(r.session_id, r.node_id) for r in batch.nodes.collect()}
            == {(s, n) for s, *_, n in got if n})
    turns = spark.createDataFrame(TURNS, TURN_SCHEMA)
    phases = {(r.session_id, r.turn_index): r.phase for r in H.phase_timeline(turns.select("session_id", "turn_index", "model_phase"), flat).collect()}
    assert phases == {(s, t): p for s, t, p, *_ in got}


def test_guard_stream_equals_batch(spark, tmp_path):
    cfg = X.GuardConfig()
    rows = [(1, "Call 12345 now. Breathe.", ""), (2, "What helped last week?", ""), (3, "I am here.", "I want to die")]
    df = spark.createDataFrame(rows, "reply_id int, text string, user_message string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start_guard(stream, cfg, str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "ck"), user_message="user_message").awaitTermination()
    want = X.outward(X.sanitise(df, cfg, user_message="user_message"), cfg)
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda d: sorted((r.reply_id, r.clean, r.outward, tuple(r.removed), r.crisis) for r in d.collect())
    assert key(got) == key(want)
    assert sorted(r.reply_id for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 3]


def test_guard_stream_deals_the_rows_of_one_file(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("reply_id"), F.concat(F.lit("Call 12345 now. Reply "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start_guard(stream, X.GuardConfig(), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert len(list((tmp_path / "out" / "batch=0").glob("*.parquet"))) >= 4
    logged = spark.read.json(str(tmp_path / "log"))
    assert logged.count() == 400 and logged.select("reply_id").distinct().count() == 400


def _files(spark, path, schema, parts):
    """One file per part, in order of arrival."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / f"f={i}"))
        os.utime(next((path / f"f={i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path)))


def test_utterance_stream_keeps_the_last_row_of_each_id(spark, tmp_path):
    schema = "session_id string, turn_index bigint, speaker string, text string, arrived timestamp"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [[("s", 1, "client", "a", at(0)), ("s", 1, "therapist", "b", at(0)), ("s", 1, "client", "b", at(1))],
             [("s", 1, "client", "c", at(2)), ("s", 1, "therapist", "b", at(2))], [("t", 1, "client", "z", at(200))],
             [("t", 1, "client", "z", at(201))], [("s", 1, "client", "new", at(202))]]
    stream = utterance_stream(_files(spark, tmp_path / "in", schema, parts), keep="1 hour")
    with with_row_state(spark):
        q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    # Forgotten after an hour: the last text of s starts anew at version 1.
    assert sorted((r.session_id, r.node_id, r.text, r.version) for r in rows.collect()) == [
        ("s", "utt_1", "b", 1), ("s", "utt_1", "c", 2), ("s", "utt_1", "new", 1), ("s", "utt_1_t", "b", 1), ("t", "utt_1", "z", 1)]
    kept = latest(rows.filter("text <> 'new'"))
    assert sorted((r.session_id, r.node_id, r.text) for r in kept.collect()) == [("s", "utt_1", "c"), ("s", "utt_1_t", "b"), ("t", "utt_1", "z")]


FULL = ("session_id string, turn_index bigint, arrived timestamp, closes boolean, "
        "candidates array<struct<label:string,text:string,props:map<string,string>>>, "
        "links array<struct<subject:int,predicate:string,object_label:string,object:int,reported_intensity:string>>, "
        "technique string, model_phase string")


def test_turn_stream_gaps_late_turns_properties_and_edges(spark, tmp_path):
    """First number from the data, a gap flushed by its timer, a late turn as a correction, repeats ignored."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    belief = lambda t, c: ("CoreBelief", t, {"domain": "self", "category": c})
    turn = lambda s, n, m, cands=(), links=(), closes=False: (s, n, at(m), closes, list(cands), list(links), None, None)
    parts = [
        [turn("s", 0, 0, [("Situation", "exam tomorrow", {"kind": ""})]), turn("s", 2, 1, [belief("I am a failure", "worthless")]),
         turn("g", 5, 0, [("Goal", "rest", {})])],
        [turn("s", 3, 2, [("AutomaticThought", "I will fail", {})], [(1, "stemsFrom", "CoreBelief", 1, None), (1, "stemsFrom", "CoreBelief", 9, None),
                                                                    (1, "triggers", "CoreBelief", 1, None)])],
        [turn("x", 1, 30)], [turn("x", 1, 31)],  # half an hour later: the gap at 1 has had its time
        [turn("s", 1, 31, [belief("I am a failure today", "unlovable"), ("Reaction", "sad", {"channel": "behavioral", "valence": "negative"})]),
         turn("s", 2, 31, [("Problem", "again", {})])],
        [turn("s", 4, 32, [("Situation", "exam tomorrow morning", {"kind": "memory"})], [(1, "triggers", "AutomaticThought", 1, "8/10")]),
         turn("s", 6, 32, [("Problem", "late", {})], closes=True), turn("x", 1, 33, closes=True)],
    ]
    stream = _files(spark, tmp_path / "in", FULL, parts)
    start_turns(stream, str(tmp_path / "out"), str(tmp_path / "ck"), first=0).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r.session_id, r.place, r.turn_index, r.late, r.kind, r.label or "", r.node_id or "", r.object_id or "") for r in rows)
    assert got == [
        ("g", 1, 5, False, "node", "Goal", "goal_1", ""),
        ("s", 1, 0, False, "node", "Situation", "sit_1", ""), ("s", 2, 2, False, "node", "CoreBelief", "cb_1", ""),
        ("s", 3, 3, False, "edge", "stemsFrom", "at_1", "cb_1"), ("s", 3, 3, False, "node", "AutomaticThought", "at_1", ""),
        ("s", 4, 1, True, "node", "CoreBelief", "cb_2", ""), ("s", 4, 1, True, "node", "Reaction", "react_1", ""),
        ("s", 5, 4, False, "edge", "triggers", "sit_1", "at_1"), ("s", 5, 4, False, "node", "Situation", "sit_1", ""),
        ("s", 6, 6, False, "node", "Problem", "prob_1", ""), ("x", 1, 1, False, "turn", "", "", "")]
    props = {(r.node_id, r.turn_index): r.props for r in rows if r.kind == "node"}
    assert props["sit_1", 0] == {} and props["sit_1", 4] == {"kind": "memory"}
    assert props["cb_2", 1] == {"domain": "self", "category": "unlovable"}
    assert props["at_1", 3] == {"modality": "verbal"} and props["react_1", 1] == {"channel": "behavioral"}


def test_transcripts_due(spark):
    turns = spark.createDataFrame([("s", i) for i in range(1, 9)] + [("t", 1)], "session_id string, turn_index bigint")
    due = spark.createDataFrame([("s", 6)], "session_id string, turn_index bigint")
    assert transcripts_due(turns, due).count() == 6


def test_state_is_looked_into_as_little_as_possible():
    """A new session asks once; a repeated turn reads neither nodes nor edges and writes no head."""
    from types import SimpleNamespace

    from dialoggraph.streaming.turn_stream import _Session

    calls = []

    def table(name, rows=(), value=None):
        log = lambda what, back=None: (lambda *a: calls.append((name, what)) or back)
        return SimpleNamespace(get=log("get", value), exists=log("exists", value is not None), update=log("update"),
                               updateValue=log("updateValue"), removeKey=log("removeKey"), iterator=log("iterator", iter(rows)))

    def session(head):
        calls.clear()
        p = SimpleNamespace(head=table("head", value=head), first=1, patience=0, signatures=set(),
                            **{n: table(n) for n in ("nodes", "edges", "early", "gaps")})
        return _Session(p)

    session(None)
    assert calls == [("head", "get")]
    known = session((5, 5, 0, "none"))
    known.take(3, (0, [], [], None, None))
    assert list(known.run(("s",), None)) == []
    assert sorted(calls) == [("early", "iterator"), ("gaps", "iterator"), ("head", "get")]


def test_utterances_of_a_few_turns_look_into_the_state_once():
    calls = []

    class State:
        value = None
        get = lambda self: calls.append("get") or self.value
        exists = lambda self: calls.append("exists") or self.value is not None
        update = lambda self, v: calls.append("update") or setattr(self, "value", v)

    class Handle:
        getValueState = lambda self, *a: State()
        registerTimer = lambda self, at: calls.append(at)

    p = Utterances(1000)
    p.init(Handle())
    row = lambda node, at, text: Row(node_id=node, turn_index=1, speaker="client", text=text, arrived_ms=at)
    got = list(p.handleInputRows(("s", 0), iter([row("utt_1", 5, "a"), row("utt_1", 5, "b"), row("utt_2", 5, "c")]), None))
    assert [(r.node_id, r.text, r.version) for r in got] == [("utt_1", "b", 1), ("utt_2", "c", 1)]
    assert calls == ["get", "update", 1005]
    got = list(p.handleInputRows(("s", 0), iter([row("utt_1", 4, "x"), row("utt_2", 6, "d")]), None))
    assert [(r.node_id, r.text, r.version) for r in got] == [("utt_2", "d", 2)]


def _kept_state(first=0):
    """A processor's state as plain dictionaries, with the calls that were made."""
    import json
    from types import SimpleNamespace

    calls = []

    class Table(dict):
        def __init__(self, name):
            self.name = name

        def iterator(self):
            calls.append((self.name, "iterator"))
            return iter(list(self.items()))

        def updateValue(self, key, value):
            calls.append((self.name, "write"))
            self[key] = value

        def removeKey(self, key):
            calls.append((self.name, "write"))
            del self[key]

    head = SimpleNamespace(value=None)
    head.get = lambda: calls.append(("head", "get")) or head.value
    head.update = lambda v: calls.append(("head", "write")) or setattr(head, "value", v)
    p = SimpleNamespace(head=head, first=first, patience=10, signatures={("Situation", "triggers", "AutomaticThought")},
                        handle=SimpleNamespace(registerTimer=lambda at: calls.append(("timer", at))),
                        **{n: Table(n) for n in ("nodes", "edges", "early", "gaps")})

    def said(turn):
        label = "Situation" if turn % 2 else "AutomaticThought"
        link = {"subject": 1, "predicate": "triggers", "object_label": "AutomaticThought", "object": 1, "reported_intensity": f"{turn}/10"}
        return json.dumps({"candidates": [{"label": label, "text": f"n{turn % 14} m{turn % 14}", "props": None}], "links": [link], "technique": None, "model_phase": None})

    return p, calls, said


def test_a_new_session_writes_pages_not_rows():
    from dialoggraph.streaming.turn_stream import _Session

    p, calls, said = _kept_state()
    s = _Session(p)
    for turn in [*range(30), *range(31, 60)]:
        s.take(turn, (5, said(turn)))
    assert len(list(s.run(("s",), None))) == 30 + 15 and p.head.value[0] == 29
    # 14 nodes, 7 edges, 29 turns that wait behind a gap, the numbers before 0: six rows of state and one timer
    assert sorted(calls) == [("early", "write")] * 2 + [("edges", "write"), ("gaps", "write"), ("head", "get"), ("head", "write"),
                                                        ("nodes", "write"), ("timer", 15)]


def test_pages_hold_what_one_call_would(monkeypatch):
    """Turns out of order, twice, behind a gap and late, over tiny pages: calls with few turns end as the plain order does."""
    import random

    from dialoggraph.streaming import turn_stream as T

    for name in ("PAGE", "TURN_PAGE", "GAP_PAGE"):
        monkeypatch.setattr(T, name, 2)
    for seed in range(6):
        rng = random.Random(seed)
        p, calls, said = _kept_state()
        turns = [t for t in range(40) if t % 9 != 5]
        order, out = sorted(turns + rng.sample(turns, 8), key=lambda t: t + rng.randrange(6)), []
        while order:
            part, order = order[:4], order[4:]
            s = T._Session(p)
            for t in part:
                s.take(t, (1, said(t)))
            out += s.run(("s",), None if order else 1 << 62)
        applied = [r["turn_index"] for r in out if r["kind"] == "node"]
        assert applied == turns and [r["place"] for r in out if r["kind"] == "node"] == list(range(1, len(turns) + 1))
        late = T._Session(p)
        late.take(14, (2, said(14)))
        late.take(13, (2, said(13)))
        out += late.run(("s",), None)
        assert [(r["turn_index"], r["late"], r["kind"]) for r in out if r["late"]] == [(14, True, "node")] and not p.early
        q, _, _ = _kept_state()
        whole = T._Session(q)
        for t in turns:
            whole.take(t, (1, said(t)))
        want = list(whole.run(("s",), 1 << 62))
        assert out[:len(want)] == want
        again = T._Session(p)
        assert {(n.label, n.number): n.text for n in again.order} == {(r["label"], int(r["node_id"].split("_")[1])): r["text"] for r in out if r["kind"] == "node"}
        assert list(again.edges.items()) == list(late.edges.items()) and len(again.edges) > 2
        assert sorted(again.gaps) == sorted(late.gaps) and 14 not in again.gaps
