import random

import pytest
from pyspark.sql import functions as F

from dialoggraph import ontology as O
from dialoggraph.functions import props as P
from dialoggraph.functions.text import jaccard, token_set
from dialoggraph.operators import merge as M
from dialoggraph.operators import simjoin as S

from helpers import fold_props, merge_in_order
from helpers import jaccard as plain_jaccard

CANDS = "session_id string, label string, ord bigint, text string, props map<string,string>, turn_index bigint"


def cands(spark, rows):
    return spark.createDataFrame([(s, l, o, t, p, o) for s, l, o, t, p in rows], CANDS)


def test_merge_examples(spark):
    m = M.merge(cands(spark, [
        ("s1", "Situation", 1, "exam tomorrow", {}), ("s1", "Situation", 2, "exam tomorrow morning", {}),
        ("s1", "Situation", 3, "tomorrow morning exam hall", {}),
        ("s2", "Situation", 1, "exam tomorrow", {}), ("s2", "Situation", 2, "fight with friend", {}),
        ("s3", "Goal", 1, "a b c d e", {}), ("s3", "Goal", 2, "a b c x", {}),  # 3 of 6
        ("s3", "Goal", 3, "p q r s", {}), ("s3", "Goal", 4, "p q r t", {}),    # 3 of 5: not above 3/5
        ("s4", "CoreBelief", 1, "I am bad", {"domain": "self", "category": "worthless"}),
        ("s4", "CoreBelief", 2, "I am bad", {"domain": "self", "category": "unlovable"}),
        ("s4", "CoreBelief", 3, "I am bad", {"domain": "self"}),
        ("s5", "Problem", 1, "", {}), ("s5", "Problem", 2, "", {}),
    ]))
    got = {(r.session_id, r.node_id): (r.turn_acquired, r.text) for r in m.nodes.select(
        "session_id", "node_id", "turn_acquired", P.main_text(F.col("label"), F.col("props")).alias("text")).collect()}
    assert got == {
        ("s1", "sit_1"): (3, "tomorrow morning exam hall"), ("s2", "sit_1"): (1, "exam tomorrow"),
        ("s2", "sit_2"): (2, "fight with friend"), ("s3", "goal_1"): (1, "a b c d e"), ("s3", "goal_2"): (2, "a b c x"),
        ("s3", "goal_3"): (3, "p q r s"), ("s3", "goal_4"): (4, "p q r t"), ("s4", "cb_1"): (3, "I am bad"),
        ("s4", "cb_2"): (2, "I am bad"), ("s5", "prob_1"): (1, ""), ("s5", "prob_2"): (2, "")}
    ev = {(r.session_id, r.owner_id): r.t for r in m.evidence.groupBy("session_id", "owner_id").agg(
        F.sort_array(F.collect_list("turn_index")).alias("t")).collect()}
    assert ev[("s1", "sit_1")] == [1, 2, 3] and ev[("s4", "cb_1")] == [1, 3]


def random_rows(seed, n, words, label_pool, sessions=3):
    rng = random.Random(seed)
    base = [[rng.choice(words) for _ in range(rng.randint(2, 7))] for _ in range(12)]
    rows = []
    for s in range(sessions):
        for o in range(n):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w.append(rng.choice(words))
            p = {}
            if rng.random() < 0.7:
                p["domain"] = rng.choice(["self", "self", "world"])
            if rng.random() < 0.6:
                p["category"] = rng.choice(["helpless", "unlovable", "worthless"])
            rows.append((f"s{s}", rng.choice(label_pool), o, " ".join(w), p))
    return rows


@pytest.mark.parametrize("fold_rows,hot", [(50_000, None), (7, 3)])
def test_merge_equals_plain_fold(spark, fold_rows, hot):
    """Random texts; with tiny limits the state hand-over and the hot-token blocks are used."""
    rows = random_rows(11, 60, [f"w{i}" for i in range(14)], ["CoreBelief", "Situation"])
    got = {(r.session_id, r.label, r.ord): r.head for r in M.assign_nodes(
        cands(spark, rows), fold_rows=fold_rows, hot=hot).collect()}
    want = {}
    for s in sorted({r[0] for r in rows}):
        one = [(o, l, t, p.get("domain"), p.get("category")) for x, l, o, t, p in rows if x == s]
        want |= {(s, l, o): h for (l, o), h in merge_in_order(one).items()}
    assert got == want


def test_copies_of_one_text_are_one_row_of_work(spark):
    """A session in which one text makes up most rows: pairs and folds see it once."""
    rows = [("s", "Goal", i, "same words here", {}) for i in range(300)]
    rows += [("s", "Goal", 300 + i, f"lonely {i}", {}) for i in range(20)]
    df = cands(spark, rows)
    sets = S.distinct_sets(df.withColumn("tokens", token_set(F.col("text"))), ["session_id", "label"], "tokens", "ord")
    assert sets.count() == 21
    heads = [r.head for r in M.assign_nodes(df).collect()]
    assert heads.count(0) == 300 and len(set(heads)) == 21


def test_folded_props_equal_stepwise_gating(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for label, key, prop in [("CoreBelief", "domain", "category"), ("Reaction", "channel", "valence"),
                             ("Intervention", "technique", "techniqueLabel"), ("AutomaticThought", "distortionType", "modality"),
                             ("Homework", "taskType", "isOptional")]:
        for node in range(25):
            steps = []
            for o in range(rng.randint(1, 7)):
                p = {}
                if rng.random() < 0.6:
                    p[key] = rng.choice(["self", "emotional", "other", "x", ""])
                if rng.random() < 0.6:
                    p[prop] = rng.choice(["a", "b", ""])
                p["content"] = f"t{o}"
                steps.append((o, p))
                rows.append((f"{label}-{node}", label, o, p))
            want[f"{label}-{node}"] = fold_props(steps, label)
    df = spark.createDataFrame(rows, "node string, label string, ord bigint, props map<string,string>")
    got = {r.node: dict(r.props) for r in M.fold_props(df, ["node"]).collect()}
    assert got == want


def test_jaccard(spark):
    pairs = [("exam tomorrow", "exam tomorrow morning"), ("A b", "a B"), ("", "x"), ("a a b", "b c"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(jaccard(token_set(F.col("a")), token_set(F.col("b")))).collect()]
    assert got == pytest.approx([plain_jaccard(a, b) for a, b in pairs])


def test_similar_pairs_are_complete(spark):
    rng = random.Random(3)
    sets = {i: sorted({f"t{rng.randrange(15)}" for _ in range(rng.randint(1, 9))}) for i in range(150)}
    distinct = {}
    for i, s in sets.items():
        distinct.setdefault(tuple(s), i)
    df = spark.createDataFrame([("k", list(s), i) for s, i in distinct.items()], "k string, tokens array<string>, set_id bigint")
    for num, den in [(3, 5), (1, 5), (1, 2)]:
        got = {(r.a, r.b) for r in S.similar_pairs(df, ["k"], num, den).collect()}
        want = {(i, j) for s, i in distinct.items() for t, j in distinct.items() if i < j
                and len(set(s) & set(t)) * den > len(set(s) | set(t)) * num}
        assert got == want


def test_links_of_a_hot_token_connect_the_same_groups(spark):
    """Hundreds of near copies share their rare token; links stay linear and connect alike."""
    rows = [("k", sorted({"stamp", "alpha", "beta", "gamma", f"n{i}"}), i) for i in range(200)]
    rows += [("k", sorted({"stamp", f"x{i}", f"y{i}", f"z{i}"}), 1000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, tokens array<string>, set_id bigint")
    links = S.similarity_links(df, ["k"], 3, 5, hot=20, block=32)
    comp = {r.id: r.root for r in S.components(links, ["k"]).collect()}
    assert comp == {i: 0 for i in range(200)}
    assert links.count() < 200 * 30  # far below the 19,900 similar pairs


def test_components(spark):
    rng = random.Random(9)
    edges = [("a", i, i + 1) for i in range(40)] + [("b", rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [("c", 0, i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "k string, a bigint, b bigint")
    got = {(r.k, r.id): r.root for r in S.components(df, ["k"]).collect()}
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for k, a, b in edges:
        if a != b:
            x, y = find((k, a)), find((k, b))
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x)[1] for x in parent}


@pytest.mark.parametrize("gate", [0.0, 0.3, 0.8, 0.97])
def test_cosine_pairs_equal_brute_force(spark, gate):
    import numpy as np
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    vecs = [base[i % 6] + rng.normal(size=8) * 0.4 for i in range(90)]
    rows = [("p" if i % 3 else "q", i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "k string, id bigint, vec array<double>")
    got = {(r.k, r.a, r.b) for r in S.cosine_pairs(df, ["k"], gate, block=16).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(k, i, j) for k, i, v in rows for l, j, w in rows if k == l and i < j and cos(v, w) >= gate}
    assert got == want


def test_resolution(spark):
    rows = [("k", 1, [1.0, 0.0]), ("k", 2, [1.0, 0.1]), ("k", 3, [0.0, 1.0]), ("k", 4, [0.6, 0.8]), ("j", 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, id bigint, vec array<double>")
    yes = spark.createDataFrame([("k", 3, 4, True)], "k string, a bigint, b bigint, same boolean")
    members = {r.id: r.survivor for r in M.resolve_entities(df, ["k"], 0.5, 0.9, yes).members.collect()}
    assert members == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_scaffold_and_flip(spark):
    onto = O.Ontology.of()
    s = spark.createDataFrame([("a",), ("b",)], "session_id string")
    nodes, edges = M.scaffold_nodes(s, onto), M.scaffold_edges(s, onto)
    assert nodes.count() == 26 and edges.count() == 2 * 38
    found = spark.createDataFrame([("a", "sit_1", "Situation", {"description": "x"}, "found", 1, 5), ("a", "sit_2", "Situation", {}, "found", 1, 6)],
                                  "session_id string, node_id string, label string, props map<string,string>, status string, turn_acquired int, ord bigint")
    out = {(r.session_id, r.node_id): (r.status, r.ord) for r in M.flip(nodes, found, "node_id").collect()}
    assert len(out) == 27 and out[("a", "sit_1")] == ("found", 9) and out[("a", "sit_2")][0] == "found"
    assert out[("b", "sit_1")] == ("missing", 9)


def test_suffix_and_context(spark):
    n = spark.createDataFrame([("s", "prob_7", "Problem"), ("s", "prob_x", "Problem"), ("s", "odd", "Goal")],
                              "session_id string, node_id string, label string")
    assert {r.label: r.last_no for r in M.highest_suffix(n).collect()} == {"Problem": 7, "Goal": 0}
    rows = [("s", "Goal", {"statement": f"g{i}"}, i) for i in range(7)] + [("s", "Problem", {"description": "p" * 100}, 9)]
    nodes = spark.createDataFrame(rows, "session_id string, label string, props map<string,string>, ord bigint")
    state = spark.createDataFrame([("s", "Rapport", "Assessment"), ("t", "Rapport", "x")], "session_id string, phase string, technique string")
    got = {r.session_id: r.context for r in M.context_summary(nodes, state).collect()}
    assert got["s"] == ("Session phase: Rapport\nActive technique: Assessment\nWhat's emerged in the graph so far:\n  Problem: "
                        + "p" * 80 + "\n  Goal: g0 | g1 | g2 | g3 | g4 (+2 more)")
    assert got["t"].endswith("  (nothing yet — still rapport)")


def test_edge_upsert(spark):
    a = spark.createDataFrame([("s", 1, "x", "leadsTo", "y", {"reportedIntensity": "3"}, 4), ("s", 2, "x", "leadsTo", "y", {"reportedIntensity": "8"}, 2),
                               ("s", 3, "x", "leadsTo", "y", {}, 4)],
                              "session_id string, ord bigint, subject_id string, predicate string, object_id string, props map<string,string>, turn_index bigint")
    edges, ev = M.upsert_edges(a)
    e = edges.collect()
    assert len(e) == 1 and e[0].edge_id == "x__leadsTo__y" and e[0].props == {"reportedIntensity": "8"}
    assert [r.turn_index for r in ev.orderBy("pos").collect()] == [4, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_links_equal_all_pairs(spark, seed):
    """Tiny limits put almost every token on the hot path, with several components each."""
    rng = random.Random(seed)
    base = [[f"b{i}_{j}" for j in range(5)] for i in range(5)]
    sets = {}
    for i in range(120):
        s = tuple(sorted(set(rng.choice(base)[:rng.randint(3, 5)] + [f"x{rng.randrange(12)}" for _ in range(rng.randint(0, 3))])))
        sets.setdefault(s, i)
    df = spark.createDataFrame([("k", list(s), i) for s, i in sets.items()], "k string, tokens array<string>, set_id bigint")
    as_comp = lambda links: {r.id: r.root for r in S.components(links, ["k"]).collect()}
    pairs = S.similar_pairs(df, ["k"], 3, 5).select("k", "a", "b")
    assert as_comp(S.similarity_links(df, ["k"], 3, 5, hot=2, block=4)) == as_comp(pairs)


@pytest.mark.parametrize("num,den", [(3, 5), (1, 2), (4, 5)])
def test_sets_meet_in_small_rows(spark, num, den):
    """Pairs equal those of all sets; prefixes are rows of a fixed size, dealt once for both sides,
    and what meets is close to the result, though every set holds frequent words."""
    rng = random.Random(num * 10 + den)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows, sets = [], {}
    for i in range(260):
        if i % 4 and i > 8:
            w = list(rows[rng.randrange(i // 2)][2])
            w = [x for x in w if rng.random() > 0.08] + rng.choices(words, k=rng.randint(0, len(w) // 6 + 1))
        else:
            w = rng.choices(words, weights, k=rng.choice([1, 2, 3, 5, 40, 90]))
        rows.append(("s" if i % 5 else "t", i, sorted(set(w))))
    df = spark.createDataFrame([r for r in rows if r[2]], "k string, ord bigint, tokens array<string>")
    distinct = S.distinct_sets(df, ["k"], "tokens", "ord").cache()
    for r in distinct.collect():
        sets[(r.k, r.set_id)] = set(r.tokens)
    want = {(k, a, b) for (k, a), x in sets.items() for (q, b), y in sets.items()
            if k == q and a < b and len(x & y) * den > len(x | y) * num}
    got = S.similar_pairs(distinct, ["k"], num, den)
    assert {(r.k, r.a, r.b) for r in got.collect()} == want and want
    prefixes = S._prefixes(distinct, ["k"], num, den)
    assert all(kind in ("string", "bigint", "int") for _, kind in prefixes.dtypes)
    met = S._meetings(prefixes, ["k"], num, den)
    assert len(want) <= met.count() <= 2 * len(want) + 50


def test_short_sets_meet_by_their_rare_word_alone(spark):
    """Two-word texts of one class share its word; none of them is similar, so none is a row of the join."""
    sets = spark.createDataFrame([("s", ["error", f"k{i}"], i) for i in range(300)], "k string, tokens array<string>, set_id bigint")
    assert S._prefixes(sets, ["k"], 3, 5).count() == 0
    words = [["a", f"b{i % 40}", f"c{i % 7}", f"d{i}"] for i in range(120)] + [["a", f"b{i}", "c0", "x", f"y{i % 3}"] for i in range(40)]
    mixed = spark.createDataFrame([("s", w, i) for i, w in enumerate(words)], "k string, tokens array<string>, set_id bigint")
    for num, den in [(3, 5), (1, 3)]:
        want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words)
                if i < j and len(set(x) & set(y)) * den > len(set(x) | set(y)) * num}
        assert {(r.a, r.b) for r in S.similar_pairs(mixed, ["k"], num, den).collect()} == want and want


def test_merge_reads_the_candidates_before_its_tables_only(spark):
    """Nodes and evidence are aggregates of one written table: what made the candidates is not run again for each."""
    rows = random_rows(3, 40, [f"w{i}" for i in range(14)], ["CoreBelief", "Situation"], sessions=2)
    made = cands(spark, rows).withColumn("text", F.udf(lambda t: t, "string")(F.col("text")))
    m = M.merge(made, fold_rows=9)
    for table in (m.assigned, m.nodes, m.evidence):
        assert "EvalPython" not in table._jdf.queryExecution().toString()
    heads = {}
    for s in ("s0", "s1"):
        one = [(o, l, t, p.get("domain"), p.get("category")) for x, l, o, t, p in rows if x == s]
        heads |= {(s, l, o): h for (l, o), h in merge_in_order(one).items()}
    want = {}
    for s, l, o, t, p in sorted(rows, key=lambda r: r[2]):
        want.setdefault((s, l, heads[(s, l, o)]), []).append((o, {**p, O.TEXT_PROP[l]: t}))
    got = {(r.session_id, r.label, r.ord): (dict(r.props), r.turn_acquired) for r in m.nodes.collect()}
    assert got == {k: (fold_props(steps, k[1]), max(o for o, _ in steps)) for k, steps in want.items()}
    n_ev = {(r.session_id, r.owner_id): r["count"] for r in m.evidence.groupBy("session_id", "owner_id").count().collect()}
    assert sorted(n_ev.values()) == sorted(len(v) for v in want.values())


def test_words_of_near_copies_are_dealt_once_for_all_their_pairs(spark):
    """60 near copies are 1,770 pairs; their words go to one block, so to one place for each set."""
    rows = [("k", sorted([f"w{j}" for j in range(40)] + [f"own{i}"]), i) for i in range(60)] + [("k", [f"x{i}", "w1"], 100 + i) for i in range(40)]
    sets = spark.createDataFrame(rows, "k string, tokens array<string>, set_id bigint")
    met = S._meetings(S._prefixes(sets, ["k"], 3, 5), ["k"], 3, 5)
    blocks = S._blocks(met, ["k"])
    dealt = blocks.select("_g", "_i", "_j", F.explode(F.array("a", "b")).alias("id")).distinct()
    assert blocks.count() == 1770 and dealt.count() == 60
    kept = {r.set_id for r in S.narrowed(sets, dealt.select(F.lit("k").alias("k"), F.col("id").alias("set_id")), ["k", "set_id"]).collect()}
    assert set(range(60)) <= kept and len(kept) < 70
    got = S.similar_pairs(sets, ["k"], 3, 5)
    assert {(r.a, r.b, r.common, r.size_a, r.size_b) for r in got.collect()} == {(a, b, 40, 41, 41) for a in range(60) for b in range(a + 1, 60)}


def test_blocks_of_many_words_are_parted(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TOKENS", 100)
    rng = random.Random(5)
    sets = {i: sorted({f"w{rng.randrange(14)}" for _ in range(12)}) for i in range(60)}
    first = {}
    for i, s in sets.items():
        first.setdefault(tuple(s), i)
    df = spark.createDataFrame([("k", list(s), i) for s, i in first.items()], "k string, tokens array<string>, set_id bigint")
    want = {(i, j) for s, i in first.items() for t, j in first.items() if i < j and len(set(s) & set(t)) * 5 > len(set(s) | set(t)) * 3}
    assert {(r.a, r.b) for r in S.similar_pairs(df, ["k"], 3, 5).collect()} == want and len(want) > 100


def test_distinct_sets_are_dealt_as_text_only_if_it_tells_them_apart(spark):
    rows = [["a", "b"], ["a b"], ["a", "b c"], ["a b", "c"], ["a", "b"], [""], ["", "a"], ["x" * 9]]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate([*rows, []])], "k string, ord bigint, tokens array<string>")
    out = S.distinct_sets(df, ["k"], "tokens", "ord")
    want = {}
    for i, t in enumerate(rows):
        want.setdefault(tuple(t), []).append(i)
    assert {(tuple(r.tokens), r.set_id, r.n) for r in out.collect()} == {(t, i[0], len(i)) for t, i in want.items()}
    # the usual set is one text in the shuffle, not an array
    assert "array_join" in out._jdf.queryExecution().executedPlan().toString()
