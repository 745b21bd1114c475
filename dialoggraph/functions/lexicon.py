"""Word-list functions: time markers and emotion words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ontology as O


def temporality(c: Column) -> Column:
    """past / present / anticipated by the first marker contained, else NULL."""
    def first(low: Column) -> Column:
        return F.coalesce(*[F.when(c.contains(m), F.lit(v)) for m, v in O.TIME_MARKERS_TH.items()],
                          *[F.when(low.contains(m), F.lit(v)) for m, v in O.TIME_MARKERS_EN.items()])

    return _with_lower(c, first)


def _with_lower(c: Column, f) -> Column:
    """``f(lower(c))`` with the lower-cased text computed once per row."""
    return F.get(F.transform(F.array(F.lower(c)), f), F.lit(0))


def _any_of(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= c.contains(w)
    return out


def valence(c: Column) -> Column:
    """negative before positive; plain substring match, so parts of words count."""
    return _with_lower(c, lambda low: (
        F.when(_any_of(c, O.NEGATIVE_TH) | _any_of(low, O.NEGATIVE_EN), "negative")
        .when(_any_of(c, O.POSITIVE_TH) | _any_of(low, O.POSITIVE_EN), "positive")))
