"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from dialoggraph.llm import brown, decontaminate, minhash, packing, quality, secret_scan, substrings, topk, toxicity, windows
from dialoggraph.llm.tables import crc_mod

SCHEMA = "doc_id long, text string, lang string, score double, base string, leaks string, rid long, train int"
PASSAGE = " ".join(f"word{k}" for k in range(30))
TEXTS = [
    (1, PASSAGE + " one"), (2, PASSAGE + " two"), (3, None), (4, ""), (5, "   \n\t "), (6, "a"), (7, PASSAGE + " one"),
    (8, "é 日本 " + PASSAGE), (9, "lang " * 30_000), (10, "x" * 200_000), (11, "password = abcdefgh1234"), (11, "password = abcdefgh1234"),
    (None, PASSAGE), (12, "<|endoftext|> end"), (13, "stupid men"), (14, "A a A a A a A a A a A a A a A a A a A a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, 1.0, "b", "l", 5, 1) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i == 13)) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, "a b c d")], "item_id long, text string")


def unique_rows():
    return sorted({(i, t) for i, t in TEXTS if i is not None}, key=lambda r: r[0])


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=16).collect()
    for i in {i for i, _ in TEXTS}:
        own = [r for r in rows if r["doc_id"] == i]
        copies = sum(j == i for j, _ in TEXTS)
        assert sum(r["length"] for r in own) == copies * own[0]["doc_tokens"]
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack(empty).count() == 0


def test_packing_takes_the_cheapest_sequence_with_room():
    import numpy as np

    placed = packing.pack_lengths(np.array([9, 7, 5, 3, 8]), 16, 1.0)
    assert sorted((d, sum(n for e, _, n, _ in placed if e == d)) for d in range(5)) == [(0, 9), (1, 7), (2, 5), (3, 3), (4, 8)]
    assert len({s for *_, s in placed}) == 2 and placed[0][:3] == (0, 0, 9) and placed[1][0] == 4
    assert placed[0][3] != placed[1][3]


def test_secret_scan(docs, empty, spark):
    rows = secret_scan.scan(docs).withColumn("m", secret_scan.masked(F.col("text"), F.col("spans"))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert [tuple(s) for s in r["base"]] == plain.base_spans(r["text"])
    assert {r["m"] for r in rows if r["doc_id"] == 11} == {"[secret]"} and {r["m"] for r in rows if r["doc_id"] == 3} == {None}
    assert secret_scan.scan(empty).count() == 0


def test_random_tokens_are_told_from_words(spark):
    import base64
    import random

    r = random.Random(5)
    keys = [base64.b64encode(r.randbytes(33)).decode() for _ in range(40)]
    plain_tokens = ["".join(r.choice(["inter", "nation", "al", "ize", "comm", "unic", "ation", "er"]) for _ in range(9)) for _ in range(400)]
    plain_tokens += ["0123456789" * 5, "a" * 60, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz"]
    rows = [(k, f"see {t} there") for k, t in enumerate(keys + plain_tokens)]
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = [x for x in out if not x["base"]]
    hit = {x["doc_id"] for x in out if x["spans"]}
    assert len(hit & set(range(40))) >= 36 and not hit - set(range(40))
    assert all([tuple(s) for s in x["spans"]] == [(4, 3, len(rows[x["doc_id"]][1]) - 6)] for x in out if x["spans"])


@pytest.mark.parametrize("make", [toxicity.toxicity, quality.quality])
def test_classifiers(docs, empty, labels, make):
    out = make(docs, labels, F.lit(True))
    rows = out.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert {"lang", "base", "score", "predicted"} <= set(out.columns)
    assert make(empty, labels, F.lit(True)).count() == 0
    assert all(r["score"] < 1e-9 for r in make(docs, labels.limit(0), F.lit(True)).collect())


def test_swapped_mentions_score_alike(spark):
    import random

    r = random.Random(2)
    filler = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        group = r.choice(["women", "women", "men"]) if bad else r.choice(["men", "men", "men", "women"])
        rows.append((k, " ".join(r.sample(filler, 8) + [group] + (["awful"] if bad and k % 8 else []))))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1000, "w1 w2 women"), (1001, "w1 w2 men")], "doc_id long, text string")

    def gap(penalty):
        got = {x["doc_id"]: x["score"] for x in toxicity.toxicity(docs.union(probe), lab, F.lit(True), penalty=penalty).collect()}
        return abs(got[1000] - got[1001])

    assert gap(20.0) < 0.5 * gap(0.0)


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, 2.0]), (5, None), (7, [1.0, None]), (8, [float("nan"), 1.0]),
            (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (11, [-1.0]), (3, [1.0, 2.0]), (40, []), (12, [0.5, 100000.0])]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], schema)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect())
    big = 64 * 32 + 128 * 6400000
    assert got == [(0, 1, 12, big), (0, 2, 3, 64 * 64 + 128 * 128), (0, 3, 20, 64 * 64 + 128 * 128),
                   (20, 1, 12, big), (20, 2, 0, 64 * 64 + 128 * 128), (20, 3, 3, 64 * 64 + 128 * 128),
                   (40, 1, 0, 0), (40, 2, 3, 0), (40, 3, 11, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_near_dedup(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    want = {r[0]: r for r in plain.near_dedup(unique_rows())}
    for r in got:
        assert tuple(r) == (want[r["doc_id"]] if r["doc_id"] is not None else (None, 26, None, True))
    assert minhash.near_duplicates(empty).count() == 0


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(minhash, "BIT_BLOCK", 8)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    r = random.Random(1)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(120)] = f"u{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == plain.near_dedup(rows)


def test_decontamination(docs, empty, benchmark):
    got = decontaminate.with_leaks(docs, benchmark).collect()
    assert len(got) == len(TEXTS)
    assert {r["doc_id"] for r in got if r["leaks"]} == {1, 2, 7, 8, None}
    assert all([x["item_id"] for x in r["leaks"]] in ([], [1]) for r in got)
    assert all(not r["leaks"] for r in decontaminate.with_leaks(docs, benchmark.limit(0)).collect())
    assert decontaminate.with_leaks(empty, benchmark).count() == 0


def test_rewordings_are_found(spark, benchmark):
    w = PASSAGE.split()
    changed = [x if k % 6 else "other" for k, x in enumerate(w)]
    far = [x if k % 2 else f"other{k}" for k, x in enumerate(w)]
    rows = [(1, "so " * 50 + " ".join(changed)), (2, " ".join(far)), (3, " ".join(w[:8]) + " tail" * 40)]
    got = decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {r["doc_id"] for r in got if r["leaks"]} == {1}


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: r for r in substrings.without_repeated_strings(docs).collect()}
    for i, n, removed, runs, digest in plain.substring_dedup(unique_rows()):
        r = got[i]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"])) == (n, removed, runs)
        assert plain.sha(bytes(r["kept_bytes"])) == digest
    assert bytes(got[None]["kept_bytes"]).decode() == PASSAGE
    assert substrings.without_repeated_strings(empty).count() == 0


def test_brown(docs, empty):
    rows = brown.score(docs, crc_mod("doc_id", 7) != 2, heads=16, classes=4, frequent=32).collect()
    assert len(rows) == len(TEXTS) and all(r["score"] < 0 for r in rows)
    pair = [r for r in rows if r["doc_id"] == 11]
    assert pair[0] == pair[1]
    assert brown.score(empty, F.lit(True)).count() == 0
    none = brown.score(docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and {r["n_known"] for r in none} == {0}


def test_window_dedup(docs, empty):
    got = {r["doc_id"]: r for r in windows.without_repeated_windows(docs).collect()}
    for i, n, removed, digest in plain.window_dedup(unique_rows()):
        r = got[i]
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["removed"])) == (n, removed)
        assert plain.sha(r["kept_text"].encode()) == digest
    assert got[None]["kept_text"] == PASSAGE
    assert windows.without_repeated_windows(empty).count() == 0


def test_a_full_sketch_changes_nothing(docs):
    small = windows.without_repeated_windows(docs, max_cells=1 << 16).collect()
    assert sorted(map(str, small)) == sorted(map(str, windows.without_repeated_windows(docs).collect()))


def test_pipeline_keeps_columns(spark, docs, empty, tmp_path):
    import corpus_pipeline

    from_ = "/root/testdata/sf0.001"
    for rows in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, rows, from_).columns == docs.columns
        out = corpus_pipeline.packing(spark, corpus_pipeline.secrets(spark, rows, from_), from_)
        assert (out.count() > 0) == (rows is docs)


def test_an_item_in_a_third_of_all_rows_is_found(spark):
    import random

    r = random.Random(7)
    words = [f"v{k}" for k in range(40)] + [f"z{k}" for k in range(4000)]
    items = [[f"hot{k}" for k in range(20)], [f"cold{k}" for k in range(20)]]
    rows = []
    for i in range(900):
        own = r.choices(words, k=120)
        if i % 3 == 0:
            own[50:50] = items[0]
        if i == 7:
            own[50:50] = items[1]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.with_leaks(docs, bench).collect()
    assert {(r["doc_id"], x["item_id"]) for r in got for x in r["leaks"]} == {(i, 0) for i in range(0, 900, 3)} | {(7, 1)}


def test_pipeline_takes_near_copies_from_four_fifths_on(spark):
    import corpus_pipeline

    # Two words changed: 86 of 106 shingles are common (0.81); three: 81 of 111 (0.73).
    base = [f"p{k}" for k in range(100)]
    two = [x if k not in (20, 60) else "new" for k, x in enumerate(base)]
    three = [f"q{k}" for k in range(100)], [f"q{k}" if k not in (20, 50, 80) else "new" for k in range(100)]
    rows = [(i, " ".join(x)) for i, x in enumerate([base, two, *three])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
    assert minhash.least_estimate(80, 100) < 0.56


def test_labelled_samples_are_bounded_rows_with_texts(spark):
    """Labels without documents use up nothing; an id that repeats gives one text."""
    from dialoggraph.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(20)] + [(7, "a text", "x")] * 500,
                                 "doc_id long, text string, Text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    sample, totals = labelled_sample(docs, labels, "quality", F.lit(True), (6, 20))
    rows = sample.collect()
    assert totals.tolist() == [10, 10]
    assert [sum(r["y"] == k for r in rows) for k in (0, 1)] == [6, 10]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert [r["text"] for r in rows if r["doc_id"] == 7] == ["a text"]


def test_the_driver_gets_each_sum_of_the_latent_space_once(spark, monkeypatch):
    """However many tasks the passages are dealt to."""
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"w{w}" for w in rng.integers(0, 200, 40))) for k in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(8)
    words = np.unique(np.concatenate([decontaminate.text_words(t) for _, t in items]))
    rows, frame = [], type(bench)
    real = frame.toLocalIterator
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a: iter(rows.extend(got := list(real(self, *a))) or got))
    space = decontaminate.latent_space(bench, 0, 23, decontaminate.Lookup(words), np.ones(len(words)), 8)
    terms, r = len(words), 8 + decontaminate.OVERSAMPLING
    sizes = [len(x) for row in rows for x in row if isinstance(x, (bytes, bytearray))]
    assert sum(sizes) == 8 * (terms * r + r * (r + terms))
    assert np.allclose(space.T @ space, np.eye(8))
