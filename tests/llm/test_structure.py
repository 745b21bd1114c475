"""Periodic runs, source mixing and conversation repair: whole small tables, random cases, edges."""

import random

import duckdb
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dialoggraph.llm import mixing, periodic, repair

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, Text string, size long, u string"


def test_periodic_runs_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op11_periodic_runs"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == plain.periodic(rows)


def random_words(rng):
    n, letters = rng.choice([0, 1, 5, 12, 13, 30, 120]), rng.choice([1, 2, 3, 20])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, n - a + 1)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("chunk", [7, 1 << 21])
@pytest.mark.parametrize("shortest", [4, 12])
def test_runs_equal_brute_force(monkeypatch, chunk, shortest):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    rng = random.Random(shortest)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        values, rows = [], [0]
        for k, w in enumerate(texts):
            values += [x + len(texts) for x in w] + [k]
            rows.append(len(values))
        got = periodic.runs(np.array(values), np.array(rows), shortest).tolist()
        assert got == [[k, *r] for k, w in enumerate(texts) for r in plain.word_runs(w, shortest)]


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 5):
        values = np.r_[rng.integers(1, letters + 1, 200), 0]
        common = periodic.Extensions(values)
        i, j = np.array([(i, j) for i in range(200) for j in range(200) if i != j]).T
        want = [next(k for k in range(201) if values[a + k] != values[b + k]) for a, b in zip(i, j)]
        assert (common(i, j) == want).all()


def test_periodic_edges(spark):
    word = "a b c " * 20
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, word), (4, word), (4, word), (5, "é " * 70_000), (6, "x y " * 6)]
    docs = spark.createDataFrame([(i, t, None, "other", 3, "") for i, t in rows], DOCS)
    got = sorted(map(tuple, periodic.periodic_runs(docs).select(
        "doc_id", "n_words", F.transform("runs", lambda r: F.array(r["start"], r["length"], r["period"])),
        "kept_text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    abc = (60, [[0, 60, 3]], "a b c")
    assert got == [(None, *abc), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *abc), (4, *abc),
                   (5, 70_000, [[0, 70_000, 1]], "é"), (6, 6, [], " ".join(["x y"] * 6))]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op12_source_mixing"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["op12_source_mixing"](spark, SMALL).collect()) == want


def test_mixing_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "q " * 7, None), (4, "one two", "y"), (4, "one two", "y"),
            (4, "one two", "y"), (5, "w " * 50_000, "z"), (6, " lead and trail\n", "x"), (7, "", "none")]
    docs = spark.createDataFrame([(i, t, s, "other", 3, "") for i, t, s in rows], DOCS)
    out = mixing.mix(docs, mixing.cycled((3, 1, 2)), seed=5, carry=("text",))
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted(
        (i or 0, len(plain.words(t))) for i, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["repeats"] * r["size"] + r["part"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    assert sum(own[0]["target"] for own in by.values()) == pytest.approx(1.5 * total)
    for own in by.values():
        copies = max(sum(r["doc_id"] == x["doc_id"] for r in own) for x in own)
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) < max(copies, 1)
    written = mixing.repetitions(out).collect()
    assert sum(len(plain.words(r["text"])) for r in written) == sum(r["taken"] for r in got)
    again = mixing.mix(docs.repartition(3), mixing.cycled((3, 1, 2)), seed=5, carry=("text",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0), mixing.cycled((1,))).count() == 0


def test_water_filling_by_hand(spark):
    sources = spark.createDataFrame([("a", 10, 1.0), ("b", 10, 1.0), ("c", 100, 1.0), ("d", 100, 2.0), ("e", 0, 5.0)],
                                    "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_filled(sources, 1.0, 2.0).collect()}
    # 220 words: e is clamped at 0, a and b at 20, then c and d share 180 as 1 to 2.
    assert got == {"a": 20.0, "b": 20.0, "c": 60.0, "d": 120.0, "e": 0.0}


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_conversation_repair"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain.conversation_repair(rows))


@pytest.mark.parametrize("grow", [1, 3, 64])
def test_repair_equals_brute_force(spark, grow):
    """Long conversations over many blocks, ties, copies, nulls, odd roles, clashing columns."""
    rng, rows = random.Random(grow), []
    texts = ["Hi.", "a b", "", "Yes!", None, " \n", "same. \n", "no ", "x" * 100 + "a", "x" * 100 + "b"]
    for c in [None, 1, 2, 3, 4, 5]:
        for t in range(rng.choice([1, 3, 50, 200])):
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((c, None if rng.random() < 0.05 else t + rng.choice([0, 0, 3]),
                             rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]),
                             rng.choice([*texts, f"q?{t}", f"no {t}", f"yes {t}."]), "x", 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Role string, key long")
    report, repaired = repair.repair(df, grow=grow)
    lines = {}
    for r in repaired.orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = plain.repairs([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows])
    got = {r["conv_id"]: (*tuple(r)[1:], lines.get(r["conv_id"], [])) for r in report.collect()}
    assert got == want


def test_repair_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repair.repair(empty)
    assert report.count() == repaired.count() == 0
