"""Repeated, loose and late model answers; deep branches; replaced sessions; streamed tables."""

import pytest
from pyspark.sql import functions as F

from dialoggraph.functions import responses as R
from dialoggraph.operators import candidates as C
from dialoggraph.operators import guard as X
from dialoggraph.operators import turns as T
from dialoggraph.operators import versions as V
from dialoggraph.sources.store import ConcurrentWrite, SessionStore

CANDS = ("session_id string, cand_id long, label string, text string, group_key string, props map<string,string>, "
         "batch int, item int")


@pytest.fixture(scope="module")
def cands(spark):
    return spark.createDataFrame([("s", 1, "CoreBelief", "t", None, {}, 0, 0), ("s", 2, "Homework", "u", None, {}, 0, 1)], CANDS)


def test_the_last_answer_counts_once(spark, cands):
    v = spark.createDataFrame([("s", 1, "keep", None, None, 0), ("s", 1, "drop", None, "twice", 1)],
                              "session_id string, cand_id long, verdict string, new_label string, reason string, answer_no int")
    kept, dropped = C.judge(cands, v)
    assert [r["cand_id"] for r in kept.collect()] == [2] and [r["reason"] for r in dropped.collect()] == ["twice"]
    a = spark.createDataFrame([("s", 1, "x"), ("s", 1, "x")], "session_id string, cand_id long, subclass string")
    assert C.assign_discriminator(cands, a).count() == 2
    p = spark.createDataFrame([("s", 1, "domain", "self", None, 2), ("s", 1, "domain", "world", None, 1)],
                              "session_id string, cand_id long, prop string, value string, technique_label string, answer_no int")
    got = {r["cand_id"]: r["props"] for r in C.classify(cands, p).collect()}
    assert got[1]["domain"] == "self" and len(got) == 2
    r = spark.createDataFrame([("s", 1, '["a"]'), ("s", 1, '["a"]')], "session_id string, cand_id long, raw string")
    assert C.atomise(cands, r).count() == 2


def test_strict_arrays_and_turn_numbers(spark):
    raw = ['[1, "a"]', "['a']", '["a"] and [b]', "no array", 'text ["a", 2, "b"] tail', "] ["]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string")
    got = [r["v"] for r in df.select("k", R.string_array(F.col("raw")).alias("v")).orderBy("k").collect()]
    assert got == [["a"], None, None, None, ["a", "b"], None]
    turns = spark.createDataFrame([("3",), (" 4 ",), ("1.5",), ("1e3",), ("x",), (None,)], "t string")
    assert [r[0] for r in turns.select(C.whole_number(F.col("t"))).collect()] == [3, 4, None, None, None, None]


def test_the_last_reply_of_a_turn(spark):
    t = spark.createDataFrame([("s", 0, "client", "hi", 0), ("s", 0, "therapist", "z first", 1), ("s", 0, "therapist", "a last", 2)],
                              "session_id string, turn_index int, speaker string, text string, pos int")
    assert [r["reply"] for r in T.exchanges(t).collect()] == ["a last"]


def test_branches_of_any_depth(spark):
    depth = 12
    rows = [("s", f"b{k}", f"b{k - 1}" if k else None, k) for k in range(depth)]
    b = spark.createDataFrame(rows, "session_id string, branch_id string, parent_branch_id string, fork_turn long")
    assert V.lineage(b).filter(f"branch_id = 'b{depth - 1}'").count() == depth
    t = spark.createDataFrame([("s", "b0", 0, "client", "x"), ("other", "main", 0, "client", "y")],
                              "session_id string, branch_id string, turn_index int, speaker string, text string")
    assert {r["session_id"] for r in V.branch_timeline(t, b).collect()} == {"s", "other"}
    loop = spark.createDataFrame([("s", "a", "b", 1), ("s", "b", "a", 1)], b.schema)
    with pytest.raises(ValueError):
        V.lineage(loop)


def test_other_sessions_stay_stored(spark, tmp_path):
    path = str(tmp_path / "store")
    V.write_replacing(spark.range(500).select(F.col("id").cast("string").alias("session_id"), F.lit(1).alias("v")), path)
    V.write_replacing(spark.createDataFrame([("7", 2), ("new", 3)], "session_id string, v int"), path)
    got = {r["session_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 501 and got["7"] == 2 and got["new"] == 3 and sum(v == 1 for v in got.values()) == 499


def test_no_nouns_means_the_default_nouns(spark):
    df = spark.createDataFrame([(0, "Contact the Northern Crisis Listening Centre.")], "reply_id int, text string")
    assert [r["removed"] for r in X.sanitise(df, X.GuardConfig(nouns=[])).collect()] != [[]]


def test_a_further_column_loses_no_session(spark, tmp_path):
    path = str(tmp_path / "store")
    V.write_replacing(spark.range(2000).select(F.col("id").cast("string").alias("session_id"), F.lit(1).alias("v")), path)
    V.write_replacing(spark.createDataFrame([("7", 2, "x")], "session_id string, v int, extra string"), path)
    got = {r["session_id"]: (r["v"], r["extra"]) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert len(got) == 2000 and got["7"] == (2, "x") and got["8"] == (1, None)


def test_session_store_keeps_the_old_sessions_when_a_write_fails(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"), buckets=8)
    assert store.read() is None
    rows = spark.range(300).select(F.col("id").cast("string").alias("session_id"), F.lit(1).alias("v"))
    assert store.replace(rows) == 1
    with pytest.raises(Exception, match="lost"):
        store.replace(rows.withColumn("v", F.when(F.col("session_id") == "5", F.raise_error(F.lit("lost"))).otherwise(2)))
    assert {r["v"] for r in store.read().collect()} == {1} and store.read().count() == 300
    assert store.replace(spark.createDataFrame([("5", 2, "x"), ("5", 3, "y")], "session_id string, v int, extra string")) == 2
    got = store.read().collect()
    assert len(got) == 301 and sorted((r["v"], r["extra"]) for r in got if r["session_id"] == "5") == [(2, "x"), (3, "y")]
    with pytest.raises(ConcurrentWrite):
        store._point(2, {})
    assert store.read().count() == 301
