"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

All of it is column expressions: a row's text never leaves it.  Long tokens get an encoding by
the characters they use, and three tests against what ordinary tokens of that encoding are
like:

* chi-squared uniformity: ordinary tokens repeat their characters ``concentration`` times as
  often as a uniform alphabet would (the statistic is the index of coincidence, to which the
  chi-squared value of the alphabet is linear);
* runs: the kind of character (digit, capital, small, sign) seldom changes;
* serial correlation: neighbouring characters depend on each other.

Their p-values are combined by Fisher's rule; a token of one kind of character has no runs to
test and combines two.  What ordinary tokens are like differs from corpus to corpus (identifiers in
camel case change kinds more often than prose), so the combined evidence is set against that of the
corpus's own tokens of the same encoding and length: an empirical null, whose centre and spread come
from the lower half of the stratum and are bounded, so that a stratum full of keys does not take
keys for ordinary.  Both chances must be small.  False discoveries are controlled over the whole corpus by Benjamini and
Hochberg's rule per stratum.  One aggregate of counts by stratum and evidence class, of fixed size,
gives every stratum's limit.

Defined results: a null text is empty and has no spans; a null id stays null; repeated rows
are scanned alike; extra columns are kept, but for those named like an output.
Places are code points, the end is exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

# name, characters, alphabet size, concentration of ordinary tokens, share of kind changes in them
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16, 1.6, 0.15),
    ("base32", r"^[A-Z2-7]+$", 32, 2.1, 0.15),
    ("base36", r"^([A-Z0-9]+|[a-z0-9]+)$", 36, 2.4, 0.15),
    ("base62", r"^[A-Za-z0-9]+$", 62, 4.1, 0.2),
    ("base64", r"^[A-Za-z0-9+/]+$", 64, 4.2, 0.2),
    ("base64url", r"^.*$", 64, 4.2, 0.2),
)
LENGTHS = (24, 32, 40, 64)
CORRELATION = 0.5
# Combined p-values are counted in classes of a tenth of a power of ten, down to 1e-40.
CLASSES = 400
# Of ordinary tokens, in classes: the highest centre, the least and the highest spread.
CENTRE, SPREAD = 45.0, (6.0, 14.0)

SPANS = "array<struct<start:int,end:int,body:string>>"


def found(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, body)."""
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(bodies)), bodies,
                       lambda g, b: F.struct(F.length(g).alias("gap"), b.alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + F.length(x["body"])
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(
            F.struct(lo.alias("start"), hi.alias("end"), x["body"].alias("body")))).alias("out"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(pairs, start, step)["out"]).otherwise(
        F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """array of (start, kind, end) of the fixed patterns; kind is its place in KINDS."""
    assign = F.filter(found(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 2)) >= 8)
    parts = [assign, found(text, ACCESS), found(text, HEX)]
    def of_kind(matches: Column, k: int) -> Column:
        return F.transform(matches, lambda m: F.struct(
            m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of_kind(p, k) for k, p in enumerate(parts)]))


def number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def lower_tail(z: Column) -> Column:
    """P(standard normal < z), by the usual polynomial in 1 / (1 + 0.2316419 |z|)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def log_p(z: Column) -> Column:
    """-ln of the lower tail, 75 at most."""
    return -F.log(F.greatest(lower_tail(z), F.lit(2.7e-33)))


def fisher(total: Column, tests: Column) -> Column:
    """-log10 of the chance that three (or two) uniform p-values have -ln adding up to ``total`` or more."""
    more = F.when(tests == 3, 1 + total + total * total / 2).otherwise(1 + total)
    return (total - F.log(more)) / 2.302585092994046


def by_encoding(e: Column, place: int) -> Column:
    return reduce(lambda c, k: c.when(e == k, F.lit(ENCODINGS[k][place])), range(1, len(ENCODINGS)),
                  F.when(e == 0, F.lit(ENCODINGS[0][place])))


def tested(tokens: Column) -> Column:
    """Tokens with encoding, stratum and p-value class."""
    def encoded(t: Column) -> Column:
        kind = F.coalesce(*[F.when(F.rlike(t["body"], F.lit(e[1])), F.lit(k)) for k, e in enumerate(ENCODINGS)])
        codes = F.transform(F.filter(F.split(t["body"], ""), lambda c: c != ""), F.ascii)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), kind.alias("encoding"), codes.alias("codes"),
                        F.length(t["body"]).cast("double").alias("n"))

    def measured(t: Column) -> Column:
        mixed = t["encoding"] >= 3
        kinds = F.transform(t["codes"], lambda c: F.when(c.between(48, 57), 0).when(c.between(65, 90), 1)
                            .when(c.between(97, 122), 2).otherwise(3))
        values = F.transform(t["codes"], lambda c: (
            F.when(c.between(48, 57), c - 48).when(c.between(97, 122), c - 87)
            .when(c.between(65, 90), F.when(mixed, c - 29).otherwise(c - 55)).otherwise(63)).cast("double"))
        squares = F.aggregate(F.array_distinct(t["codes"]), F.lit(0.0), lambda s, c: s + F.pow(
            F.size(F.filter(t["codes"], lambda x: x == c)).cast("double"), F.lit(2.0)))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"),
                        t["n"].alias("n"), squares.alias("squares"), kinds.alias("kinds"), values.alias("values"))

    def one_kind(kinds: Column) -> Column:
        return F.array_min(kinds) == F.array_max(kinds)

    def summed(t: Column) -> Column:
        m = F.size(t["kinds"]) - 1
        changes = F.aggregate(F.zip_with(F.slice(t["kinds"], 1, m), F.slice(t["kinds"], 2, m),
                                         lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        mean = F.aggregate(t["values"], F.lit(0.0), lambda s, x: s + x) / t["n"]
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"),
                        t["n"].alias("n"), t["squares"].alias("squares"), changes.alias("changes"),
                        F.when(one_kind(t["kinds"]), 2).otherwise(3).alias("tests"),
                        t["values"].alias("values"), mean.alias("mean"))

    def centred(t: Column) -> Column:
        # The mean is a field by now; as an expression it would be formed anew for every value.
        return F.struct(*[t[c].alias(c) for c in ("start", "end", "encoding", "n", "squares", "changes", "tests")],
                        F.transform(t["values"], lambda v: v - t["mean"]).alias("off"))

    def judged(t: Column) -> Column:
        n, m = t["n"], F.size(t["off"]) - 1
        pairs = n * (n - 1) / 2
        kappa = by_encoding(t["encoding"], 3) / by_encoding(t["encoding"], 2)
        coincidence = (t["squares"] - n) / (n * (n - 1))
        # Variance of the share of equal pairs; triples add a quarter of the squared concentration.
        spread = F.sqrt(kappa * (1 - kappa) / pairs + (n - 2) * kappa * kappa / (4 * pairs) * 2)
        rate = by_encoding(t["encoding"], 4)
        runs = ((n - 1) * rate + 0.5 - t["changes"]) / F.sqrt((n - 1) * rate * (1 - rate))
        own = F.aggregate(t["off"], F.lit(0.0), lambda s, x: s + x * x)
        next_ = F.aggregate(F.zip_with(F.slice(t["off"], 1, m), F.slice(t["off"], 2, m), lambda a, b: a * b),
                            F.lit(0.0), lambda s, x: s + x)
        r = F.when(own > 0, F.abs(next_ / own)).otherwise(1.0)
        serial = (r - CORRELATION) * F.sqrt(n) / (1 - CORRELATION ** 2)
        total = (log_p((coincidence - kappa) / spread) + log_p(serial)
                 + F.when(t["tests"] == 3, log_p(runs)).otherwise(0.0))
        band = sum((F.when(n >= b, 1).otherwise(0) for b in LENGTHS), F.lit(0))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"),
                        (t["encoding"] * (len(LENGTHS) + 1) + band).alias("stratum"), total.alias("total"), t["tests"].alias("tests"))

    def classed(t: Column) -> Column:
        level = F.greatest(F.lit(0), F.least(F.lit(CLASSES), F.floor(10 * fisher(t["total"], t["tests"]))))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["stratum"].alias("stratum"),
                        level.cast("int").alias("level"))

    return reduce(F.transform, (encoded, measured, summed, centred, judged, classed), tokens)


def limits(docs: DataFrame, rate: float, text: Column) -> dict[int, int]:
    """For each stratum the least evidence class (10 * -log10 p) that is a discovery.

    A class is a discovery if tokens * its chance <= rate * tokens at least as extreme; its
    chance is the combined p-value, or that of ordinary tokens to reach it if that is larger.
    """
    rows = (docs.select(F.explode(tested(found(text, TOKEN))).alias("t"))
            .groupBy("t.stratum", "t.level").count().collect())
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in rows}:
        own = sorted(((r["level"], r["count"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, beyond = sum(c for _, c in own), 0
        centre, spread = ordinary(own[::-1], total)
        for level, count in own:
            beyond += count
            chance = max(10 ** (-level / 10), math.erfc((level - centre) / spread / math.sqrt(2)) / 2)
            if total * chance <= rate * beyond:
                out[stratum] = level
    return out


def ordinary(counts: list[tuple[int, int]], total: int) -> tuple[float, float]:
    """Centre and spread of the evidence of ordinary tokens: median, and median less the 16th percentile."""
    def quantile(q: float) -> float:
        upto = 0
        for level, count in counts:
            upto += count
            if upto >= q * total:
                return float(level)
        return 0.0

    middle = quantile(0.5)
    return min(middle, CENTRE), min(max(middle - quantile(0.16), SPREAD[0]), SPREAD[1])


def scan(docs: DataFrame, rate: float = 0.01, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end), kind a place in KINDS.

    ``spans`` has the base spans and random tokens that overlap none of them.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    limit = limits(docs, rate, whole)
    none = F.lit(CLASSES + 1)
    least = F.create_map(*[F.lit(x) for kv in sorted(limit.items()) for x in kv]) if limit else None

    def random_spans(tokens: Column, base: Column) -> Column:
        lowest = lambda t: F.coalesce(F.element_at(least, t["stratum"]), none) if limit else none
        kept = F.filter(tokens, lambda t: (t["level"] >= lowest(t)) & ~F.exists(
            base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        return F.transform(kept, lambda t: F.struct(
            t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))

    rows = docs.withColumn("base", base_spans(whole)).withColumn("_tokens", tested(found(whole, TOKEN)))
    return rows.withColumn("spans", F.array_sort(F.concat("base", random_spans(F.col("_tokens"), F.col("base"))))
                           ).drop("_tokens")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (in order of start; they may overlap) replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), new.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text) - done["at"])))
