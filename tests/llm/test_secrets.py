"""Random keys among ordinary tokens, and the battery against a plain form of it."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from dialoggraph.llm import secret_scan as S

WORDS = ("get user name value index table order count merge graph session window token stream build check filter group "
         "parse write read batch stage record number column result label source target middle handler factory service").split()
BASE62 = string.ascii_letters + string.digits


def identifiers(rng, n):
    return ["".join(w.capitalize() for w in rng.sample(WORDS, rng.randrange(4, 8))) + str(rng.randrange(1000)) for _ in range(n)]


@pytest.mark.parametrize("size, found_at_least", [(32, 15), (40, 19), (64, 20)])
def test_keys_among_a_hundred_thousand_identifiers(spark, size, found_at_least):
    rng = random.Random(size)
    plain = identifiers(rng, 100_000)
    keys = ["".join(rng.choices(BASE62, k=size)) for _ in range(20)]
    lines = [(k, " ".join(plain[k * 100:k * 100 + 100])) for k in range(1000)] + [(1000 + k, f"see {key} there") for k, key in enumerate(keys)]
    rows = S.scan(spark.createDataFrame(lines, "doc_id long, text string").repartition(4)).select(
        "doc_id", S.number_of("spans", 3).alias("n")).filter("n > 0").collect()
    assert not [r["doc_id"] for r in rows if r["doc_id"] < 1000]
    assert len([r for r in rows if r["doc_id"] >= 1000]) >= found_at_least


def plain_level(token):
    """The battery in plain Python: encoding, and ten times -log10 of the combined p-value."""
    import re

    e = next(k for k, x in enumerate(S.ENCODINGS) if re.fullmatch(x[1].strip("^$") if x[1] != "^.*$" else ".*", token))
    _, _, alphabet, concentration, rate = S.ENCODINGS[e]
    n, kappa = len(token), concentration / alphabet
    tail = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    pairs = n * (n - 1) / 2
    coincidence = sum(token.count(c) ** 2 - token.count(c) for c in set(token)) / (n * (n - 1))
    spread = math.sqrt(kappa * (1 - kappa) / pairs + (n - 2) * kappa ** 2 / (4 * pairs) * 2)
    kind = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    runs = ((n - 1) * rate + 0.5 - changes) / math.sqrt((n - 1) * rate * (1 - rate))
    value = [int(c) if c.isdigit() else ord(c) - 87 if c.islower() else (ord(c) - (29 if e >= 3 else 55)) if c.isupper() else 63 for c in token]
    mean = sum(value) / n
    own = sum((v - mean) ** 2 for v in value)
    r = abs(sum((a - mean) * (b - mean) for a, b in zip(value, value[1:])) / own) if own else 1.0
    serial = (r - S.CORRELATION) * math.sqrt(n) / (1 - S.CORRELATION ** 2)
    parts = [tail((coincidence - kappa) / spread), tail(serial)] + ([tail(runs)] if len(set(kind)) > 1 else [])
    y = -sum(math.log(max(p, 2.7e-33)) for p in parts)
    p = math.exp(-y) * (1 + y + (y * y / 2 if len(parts) == 3 else 0))
    return e, max(0.0, -10 * math.log10(p))


def test_levels_equal_the_plain_form(spark):
    rng = random.Random(5)
    alphabets = [BASE62, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", BASE62 + "-_", BASE62 + "+/", string.ascii_lowercase, "a", "aB"]
    tokens = ["".join(rng.choices(a, k=rng.randrange(20, 31))) for a in alphabets for _ in range(12)] + identifiers(rng, 40)
    tokens = [t for t in tokens if len(t) >= 20]
    df = spark.createDataFrame(list(enumerate(tokens)), "k int, text string")
    rows = df.select("k", F.explode(S.tested(S.found(F.col("text"), S.TOKEN))).alias("t")).select("k", "t.*").collect()
    assert len(rows) == len(tokens)
    for r in rows:
        e, level = plain_level(tokens[r["k"]])
        assert r["stratum"] // (len(S.LENGTHS) + 1) == e
        assert abs(r["level"] - level) <= 1.5  # classes, and the tail's polynomial
