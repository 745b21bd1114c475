"""Property-map functions: main text, gating, deterministic defaults, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ontology as O
from .lookup import lookup
from .lexicon import temporality, valence

# Property kept only while another one has the given value.
GATES = [
    ("CoreBelief", "category", "domain", "self"),
    ("Reaction", "valence", "channel", "emotional"),
    ("Intervention", "techniqueLabel", "technique", "other"),
]
# Properties that are never left unset.
DEFAULTS = [("AutomaticThought", "modality", "verbal"), ("Homework", "isOptional", "false")]


def text_prop(label: Column, mapping: dict[str, str] | None = None) -> Column:
    return lookup(mapping or O.TEXT_PROP, label)


def get_prop(props: Column, key: str | Column) -> Column:
    return F.try_element_at(props, key if isinstance(key, Column) else F.lit(key))


def main_text(label: Column, props: Column, skip_empty: bool = False) -> Column:
    """Text of a node: the class property, else the first non-empty fallback, else ''.

    A stored class property is used even when empty; with ``skip_empty`` an empty one
    falls through to the fallbacks (the form used while edges are resolved).
    """
    own = F.try_element_at(props, text_prop(label))
    if skip_empty:
        own = F.nullif(own, F.lit(""))
    rest = [F.nullif(get_prop(props, k), F.lit("")) for k in O.FALLBACK_TEXT_PROPS]
    return F.coalesce(own, *rest, F.lit(""))


def set_default(props: Column, key: str, value: Column, when: Column) -> Column:
    """Add ``key`` where ``when`` holds, the value is not NULL and the key is missing."""
    missing = when & value.isNotNull() & ~F.map_contains_key(props, key)
    return F.map_concat(props, F.when(missing, F.create_map(F.lit(key), value)).otherwise(empty()))


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def assign(props: Column, values: dict[str, Column]) -> Column:
    """Set every key whose value is not NULL; all keys in one pass over the map."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
                                 for k, v in values.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.concat(
        F.filter(F.map_entries(props), lambda e: ~F.exists(entries, lambda n: n["key"] == e["key"])),
        entries))


def gate(label: Column, props: Column) -> Column:
    """Drop properties whose gate is closed and fill the two defaults."""
    closed = F.lit(False)
    shut = {}
    for lab, prop, key, value in GATES:
        shut[prop] = (label == lab) & (F.coalesce(get_prop(props, key), F.lit("")) != value)
        closed |= shut[prop]

    def dropped(k: Column) -> Column:
        out = F.lit(False)
        for prop, cond in shut.items():
            out |= (k == prop) & cond
        return out

    kept = F.when(closed, F.map_filter(props, lambda k, v: ~dropped(k))).otherwise(props)
    fill = empty()
    for lab, key, value in DEFAULTS:
        fill = F.when((label == lab) & ~F.map_contains_key(props, key),
                      F.create_map(F.lit(key), F.lit(value))).otherwise(fill)
    return F.map_concat(kept, fill)


def lexicon_props(label: Column, props: Column, text: Column) -> Column:
    """Properties that follow from the wording alone."""
    feeling = (label == "Reaction") & (get_prop(props, "channel") == "emotional")
    unset = lambda key: ~F.map_contains_key(props, key)
    return assign(props, {
        "valence": F.when(feeling, valence(text)),
        "temporality": F.when(label == "Situation", temporality(text)),
        "kind": F.when((label == "Situation") & unset("kind"), F.lit("externalSituation")),
        "modality": F.when((label == "AutomaticThought") & unset("modality"), F.lit("verbal")),
    })


def matches(props: Column, filters: dict[str, str]) -> Column:
    """All filters equal, compared lower-cased; a missing property counts as ''."""
    cond = F.lit(True)
    for k, v in filters.items():
        cond &= F.lower(F.coalesce(get_prop(props, k), F.lit(""))) == F.lit(str(v).lower())
    return cond
