import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.operators import phases as H
from dialoggraph.operators import turns as T
from dialoggraph.operators.ordered import numbered, one_block, run_states, running

from helpers import bisect_chunks, phases


def rows(seed, sessions=4, n=60):
    rng = random.Random(seed)
    return [(f"s{s}", p, rng.choice([None, 1, 2, 3])) for s in range(sessions) for p in rng.sample(range(200), n)]


def test_running_equals_a_plain_window(spark):
    """One to three levels of blocks give what one window per key gives."""
    df = spark.createDataFrame(rows(1), "k string, p bigint, v bigint")
    aggs = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "last": ("last", "v")}
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("k", "p", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.min("v").over(w).alias("lo"),
                         F.max("v").over(w).alias("hi"), F.last("v", ignorenulls=True).over(w).alias("last"))
        for sizes in ((), (7,), (7, 3), (5, 3, 2)):
            got = running(df, ["k"], ["p"], aggs, "p", sizes, inclusive)
            got = got.select("k", "p", F.coalesce("s", F.lit(0)).alias("s"), "lo", "hi", "last")
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, (sizes, inclusive)


def test_one_huge_key_is_spread_over_blocks(spark):
    """Two thirds of all rows under one key: the window partitions on key and block."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.col("id").alias("p"))
    out = numbered(df, ["k"], ["p"], "n", "p", (100,))
    assert out.filter("k = 'hot'").agg(F.max("n")).first()[0] == 2000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_blk1" in plan and "hashpartitioning(k#" in plan


def test_run_states(spark):
    rng = random.Random(2)
    data, want = [], {}
    for s in range(3):
        cur = 0
        for p in range(1, 80):
            f = [rng.randrange(3) for _ in range(3)]
            cur = f[cur]
            want[(f"s{s}", p)] = cur
            data.append((f"s{s}", p, f))
    df = spark.createDataFrame(data, "k string, p bigint, f array<int>")
    for sizes in ((1000,), (9,), (9, 4)):
        got = {(r.k, r.p): r.state for r in run_states(df, ["k"], "p", "f", 3, "state", sizes=sizes).collect()}
        assert got == want, sizes


def test_phase_timeline_equals_stepping(spark):
    rng = random.Random(4)
    turns, nodes, want = [], [], {}
    for s in range(25):
        n = rng.randint(1, 25)
        model = {t: rng.choice([None, None, "Technique", "Consolidation", "Rapport", "Nonsense"]) for t in range(1, n + 1)}
        found = {c: rng.randint(1, 25) for c in H.REQUIRED if rng.random() < 0.85}
        turns += [(f"s{s}", t, m) for t, m in model.items()]
        nodes += [(f"s{s}", c, t) for c, t in found.items()]
        idx = {p: i for i, p in enumerate(O.PHASES)}
        want |= {(f"s{s}", t): O.PHASES[i] for t, i in phases([(t, idx.get(m, -1)) for t, m in model.items()], found).items()}
    td = spark.createDataFrame(turns, "session_id string, turn_index bigint, model_phase string")
    nd = spark.createDataFrame(nodes, "session_id string, label string, turn_index bigint")
    got = {(r.session_id, r.turn_index): r.phase for r in H.phase_timeline(td, nd).collect()}
    assert got == want
    # without proposals the closed form names the same entry turns
    quiet = td.withColumn("model_phase", F.lit(None).cast("string"))
    stepped = H.phase_timeline(quiet, nd).groupBy("session_id").agg(*[
        F.min(F.when(F.col("phase") == p, F.col("turn_index"))).alias(f"{p.lower()}_turn") for p in O.PHASES[1:]])
    closed = H.phase_entry_turns(nd, td)
    assert stepped.exceptAll(closed.select(*stepped.columns)).count() == 0


def test_phase_gate_examples(spark):
    cases = [("Exploration", "Rapport", [], 5, "Rapport"), ("Exploration", "Rapport", ["Problem"], 2, "Exploration"),
             ("Technique", "Exploration", ["Problem"], 10, "Exploration"),
             ("Technique", "Exploration", ["Problem", "Situation", "AutomaticThought"], 5, "Technique"),
             ("Consolidation", "Technique", ["Problem", "Situation", "AutomaticThought"], 12, "Technique"),
             ("Consolidation", "Technique", ["Problem", "Situation", "AutomaticThought", "AdaptiveResponse"], 12, "Consolidation"),
             ("Rapport", "Rapport", [], 0, "Rapport"), ("Rapport", "Technique", [], 0, "Rapport"), ("Lunch", "Technique", [], 9, "Technique")]
    df = spark.createDataFrame(cases, "proposed string, current string, found array<string>, turn int, want string")
    bad = df.filter(H.allowed_phase(F.col("proposed"), F.col("current"), F.col("found"), F.col("turn")) != F.col("want"))
    assert bad.count() == 0


def test_chunks_equal_plain_bisection(spark):
    rng = random.Random(8)
    data, want = [], {}
    for s, n in enumerate([1, 5, 12, 40, 90]):
        texts = ["x" * rng.randint(1, 60) for _ in range(n)]
        data += [(f"s{s}", i, "client" if i % 2 else "therapist", t) for i, t in enumerate(texts)]
        lens = [len(f"turn {i} | C: {t}") for i, t in enumerate(texts)]
        want[f"s{s}"] = bisect_chunks(lens, 400, 2)
    df = spark.createDataFrame(data, "session_id string, turn_index bigint, speaker string, text string")
    ranges = T.chunk_ranges(df, 400, 2)
    got = {}
    for r in ranges.orderBy("session_id", "chunk").collect():
        got.setdefault(r.session_id, []).append((r.lo, r.hi))
    assert got == want
    texts = {(r.session_id, r.chunk): r.transcript for r in T.render_chunks(df, ranges).collect()}
    first = ranges.filter("session_id = 's2' and chunk = 0").first()
    assert len(texts[("s2", 0)]) == first.chars and texts[("s2", 0)].startswith("turn 0 | T: x")


def test_client_turn_numbers(spark):
    chat = lambda s, roles: [(s, i, r) for i, r in enumerate(roles)]
    df = spark.createDataFrame(chat("a", ["assistant", "user", "assistant", "user", "assistant"]) + chat("b", ["assistant", "user", "user", "assistant"]),
                               "session_id string, pos bigint, role string")
    got = {(r.session_id, r.pos): r.client_turn for r in T.client_turn_numbers(df).collect()}
    assert got[("a", 3)] == 2 and got[("b", 2)] == 2 and got[("a", 0)] == 0


def test_speaker_names(spark):
    df = spark.createDataFrame([("Patient",), (" Therapist ",), ("observer",), ("CLIENT\n",), (" Observer ",)], "s string")
    assert [r[0] for r in df.select(T.normal_speaker(F.col("s"))).collect()] == ["client", "therapist", "observer", "client", " Observer "]


def test_windows_and_views(spark):
    turns = spark.createDataFrame([("s", 1, "client", "a"), ("s", 2, "therapist", "b"), ("s", 5, "other", "c")],
                                  "session_id string, turn_index bigint, speaker string, text string")
    ev = spark.createDataFrame([("s", "n1", 1), ("s", "n1", 2), ("s", "n2", 4), ("s", "n3", 9)], "session_id string, owner_id string, turn_index bigint")
    texts = {r.owner_id: r.context for r in T.render_windows(T.evidence_window(ev, turns, 1), ev.select("session_id", "owner_id").distinct()).collect()}
    assert texts == {"n1": "turn 1 | C: a\nturn 2 | T: b", "n2": "turn 5 | C: c", "n3": "(none)"}
    many = spark.range(1, 71).select(F.lit("s").alias("session_id"), F.col("id").alias("turn_index"), F.lit("client").alias("speaker"),
                                     F.repeat(F.lit("y"), F.lit(401)).alias("text"))
    view = T.transcript_view(many)
    assert view.count() == 60 and view.agg(F.min("turn_index")).first()[0] == 11
    assert view.first().text == "y" * 400 + "…"


def test_sparse_keys_are_one_block(spark):
    """Blocks of time only for keys with many rows; the numbers are the same, and so are those of a null key."""
    rng = random.Random(4)
    made = [(k, rng.randrange(10 ** 9), i) for k, n in (("big", 90), ("small", 12), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(made, "k string, at bigint, id int").withColumn("pos", F.col("at"))
    placed = one_block(df, ["k"], "pos", most=20)
    assert placed.columns == df.columns and placed.count() == len(made)
    blocks = {r.k: r.n for r in placed.groupBy("k").agg(F.count_distinct("pos").alias("n")).collect()}
    assert blocks["small"] == 1 and blocks["big"] > 80 and blocks[None] > 30
    got = {(r.k, r.id): r.n for r in numbered(placed, ["k"], ["at", "id"], "n", "pos", (10 ** 7,)).collect() if r.k}
    assert got == {(k, i): n for k in ("big", "small") for n, (_, i) in enumerate(sorted((p, i) for x, p, i in made if x == k), 1)}
