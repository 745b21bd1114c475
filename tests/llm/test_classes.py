"""Class-based scores against sums over whole texts, and how they hang on the rows alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoggraph.llm import brown
from dialoggraph.llm.words import Block, words

import plain


def corpus(seed, n):
    """Texts of a small grammar: kinds of words follow each other, most words are rare."""
    rng = random.Random(seed)
    kinds = [[f"{c}{'x' * (k % 7)}{k}" for k in range(m)] for c, m in (("the", 2), ("noun", 30), ("verb", 25), ("Adj-", 20))]
    out = []
    for i in range(n):
        t = []
        for _ in range(rng.randint(0, 9)):
            t += [rng.choice(kinds[0]), rng.choice(kinds[3]), rng.choice(kinds[1]), rng.choice(kinds[2])][rng.randint(0, 1):]
        out.append((i, " ".join(t)))
    return out + [(n, None), (n + 1, "Neu über alles! 12345")]


def hash_of(word):
    b = word.encode()
    block = Block(np.frombuffer(b, np.uint8), np.array([0, len(b)]), None)
    return int(words(block, lower=True).hash.view(np.int64)[0])


@pytest.mark.parametrize("seed,heads,classes,frequent,least", [(1, 6, 3, 24, 2), (2, 10, 4, 10, 3), (3, 5, 2, 500, 1)])
def test_scores_equal_plain_sums(spark, seed, heads, classes, frequent, least):
    rows = corpus(seed, 60)
    learn = {i for i, _ in rows if i % 4}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in brown.score(
        df, F.col("doc_id") % 4 != 0, heads=heads, classes=classes, frequent=frequent, sweeps=2, least=least).collect()}
    hashes, _, count = brown.frequent_words(df.filter("doc_id % 4 <> 0"), frequent, 3)
    names = {hash_of(w): w for _, t in rows for w in plain.words((t or "").lower())}
    order = [names[int(h)] for h in hashes.view(np.int64)]
    assert list(count) == sorted(count, reverse=True)
    want = plain.brown_scores(rows, learn, order, heads, classes, 2, least)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_single_exchange_raises_the_likelihood(seed):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(rng.gamma(0.5, 4, (14, 14)))
    x = lambda n: (n * np.log(np.maximum(n, 1))).sum()

    def likelihood(klass):
        member = np.eye(klass.max() + 1)[klass]
        pair = member.T @ counts @ member
        return x(pair) - x(pair.sum(0)) - x(pair.sum(1))

    klass = brown.exchange(counts, 10, 3, 50)
    for w in range(10):
        for c in range(3):
            other = klass.copy()
            other[w] = c
            assert likelihood(other) <= likelihood(klass) + 1e-6


def test_words_beyond_the_heads_get_classes(spark):
    """Held-out texts of rare words are likelier once these words have classes."""
    df = spark.createDataFrame(corpus(5, 400), "doc_id long, text string")
    held = lambda least: brown.score(df, F.col("doc_id") % 4 != 0, heads=8, classes=4, frequent=16, least=least).filter(
        "doc_id % 4 = 0").agg(F.sum("score")).first()[0]
    assert held(2) > 0.97 * held(1 << 40)


def test_split_changes_nothing(spark):
    df = spark.createDataFrame(corpus(7, 120), "doc_id long, text string")
    one, many = (sorted(tuple(r) for r in brown.score(
        df.repartition(n), F.col("doc_id") % 4 != 0, heads=8, classes=4, frequent=20).collect()) for n in (1, 16))
    assert one == many
