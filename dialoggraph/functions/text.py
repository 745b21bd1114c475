"""Text primitives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence boundary: whitespace after . ! ?, or line breaks.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n+"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """Non-empty sentences in order; an unterminated tail is one of them."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: s != "")


def lines(c: Column) -> Column:
    return F.split(c, r"\R")


def token_set(c: Column) -> Column:
    """Distinct lower-cased whitespace tokens, sorted."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+")
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: w != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def cut_text(c: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
