"""Every llm query on small whole tables against brute force, a round trip or held-out accuracy."""

import collections
import zlib

import duckdb
import numpy as np
import plain
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def run(spark, name, sf_dir=SMALL):
    return entry.queries()[name](spark, sf_dir)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def check_packing(pieces, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = np.array(ids[i][at:at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(part), len(ids[i]))
            at += p["length"]
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing(spark, rows):
    check_packing(run(spark, "op1_packing").collect(), rows)


def test_secret_scan(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op2_secret_scan").collect()}
    for i, t in rows:
        spans = plain.base_spans(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        own = got[i]
        assert own["base_sha256"] == plain.sha(text.encode())
        assert [own[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(own["spans"].split(","))


@pytest.mark.parametrize("name, label, m, held", [("op3_toxicity", "toxic", 4, 2), ("op6_quality", "quality", 3, 1)])
def test_classifiers_on_held_out_rows(spark, name, label, m, held):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    got = run(spark, name, LABELLED).collect()
    limit = 0.3 if label == "toxic" else 0.5
    assert all(r["held_out"] == (plain.fold(r["doc_id"], m) == held) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit) for r in got)
    own = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    high, low = [s for s, y in own if y], [s for s, y in own if not y]
    wins = np.mean([(a > b) + (a == b) / 2 for a in high for b in low])
    assert wins > 0.8


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op4_exact_top_k"]).fetchall())
    assert sorted(tuple(r) for r in run(spark, "op4_exact_top_k").collect()) == want


def test_near_dedup(spark, rows):
    assert sorted(tuple(r) for r in run(spark, "op5_minhash_dedup").collect()) == plain.near_dedup(rows)


def test_decontamination(spark, rows):
    items = {r["item_id"]: plain.words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in rows for k, w in items.items() if w and f" {' '.join(w)} " in f" {' '.join(plain.words(t))} "}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op7_latent_decontamination").collect()}
    assert want and want <= got
    for i, k in got - want:  # a part or a rewording: most of the item's words are there
        own = set(plain.words(dict(rows)[i]))
        assert sum(w in own for w in items[k]) >= 0.6 * len(items[k])


def test_substring_dedup(spark, rows):
    assert sorted(tuple(r) for r in run(spark, "op8_substring_dedup").collect()) == plain.substring_dedup(rows)


def test_brown_scores(spark, rows):
    want = plain.unigram_base(rows)
    got = run(spark, "op9_brown_lm").collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_window_dedup(spark, rows):
    assert sorted(tuple(r) for r in run(spark, "op10_window_dedup").collect()) == plain.window_dedup(rows)


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {r["doc_id"] for r in run(spark, "op3_toxicity").filter("predicted = 1").collect()}
    assert set(texts[0]) == {i for i, _ in rows} - toxic
    assert set(texts[1]) == {i for i, _, _, kept in plain.near_dedup(sorted(texts[0].items()), num=80) if kept}
    leaks = {r["doc_id"] for r in run(spark, "op7_latent_decontamination").collect()}
    assert set(texts[2]) == set(texts[1]) - leaks
    assert set(texts[3]) == set(texts[2]) and not any(plain.base_spans(t) for t in texts[3].values())
    check_packing(docs.collect(), list(texts[3].items()))
