"""Entity candidates: rules, model responses, validation, splitting, properties.

Candidate rows: session_id, cand_id, label, text, group_key, props, plus one row per
supporting turn in a separate evidence table where a candidate can have several turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions import responses as R
from ..functions.text import lines, sentences, strip
from .ordered import numbered

MAX_SPLITS = 4
# Turns covered by one bullet of prior evidence.
PRIOR_TURNS = 65_536


# ── from text ─────────────────────────────────────────────────────────────

def line_candidates(turns: DataFrame) -> DataFrame:
    """Lines of the form ``Label: text`` whose label is an extractable class."""
    rows = turns.select("session_id", "turn_index",
                        F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    form = r"^\s*([A-Za-z][A-Za-z]+)\s*:\s*(.+?)\s*$"
    return (rows.select("session_id", "turn_index", "line_no",
                        F.regexp_extract("line", "(?U)" + form, 1).alias("label"),
                        F.regexp_extract("line", "(?U)" + form, 2).alias("text"))
            .filter(F.col("label").isin(*O.CONTENT_LABELS) & (F.col("text") != "")))


def rule_candidates(turns: DataFrame, rules: Sequence) -> DataFrame:
    """Sentences matched by a rule pack: one row per (sentence, label) by best priority.

    The pack is a small constant, so it becomes one constant expression per rule instead
    of a join; a sentence is read once and never shuffled.
    """
    sents = turns.select("session_id", "turn_index", "speaker",
                         F.posexplode(sentences(F.col("text"))).alias("sent_no", "sentence"))
    sents = sents.withColumn("_low", F.lower("sentence"))
    # a rule is a column of its own, so that it is compiled; the pattern is looked for in sentences of its speaker
    said = lambda r: (F.lit(True) if r.speaker is None else F.col("speaker") == r.speaker)
    hits = {f"_hit{i}": F.when(said(r) & F.col("_low").rlike(r.pattern),
                               F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority")))
            for i, r in enumerate(rules)}
    found = sents.withColumns(hits).select("session_id", "turn_index", "speaker", "sent_no", "sentence",
                                           F.explode(F.array_compact(F.array(*hits))).alias("h"))
    if len({r.label for r in rules}) == len(list(rules)):
        best = found.select("*", "h.*").drop("h")
    else:
        best = (found.groupBy("session_id", "turn_index", "speaker", "sent_no", "sentence",
                              F.col("h.label").alias("label"))
                .agg(F.min("h.priority").alias("priority")))
    return best.select("session_id", "turn_index", "speaker", "sent_no", "label", "priority",
                       F.col("sentence").alias("text"))


# ── prompts and responses ─────────────────────────────────────────────────

def fill(template: str, **values: Column) -> Column:
    """Prompt column from a ``{slot}`` template; templates are plain data."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        slot, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[slot].cast("string"), F.lit("")))
    return F.concat(*parts)


def infer(prompts: DataFrame, fn: Callable[[Iterable[str]], Iterable[str]]) -> DataFrame:
    """Run a batch text function over prompts: prompt_id, prompt -> prompt_id, raw.

    The function sees Arrow batches inside the tasks; a call that raises leaves NULL for
    its batch, which every consumer treats as "could not be parsed".
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                raw = list(fn(b["prompt"].tolist()))
            except Exception:
                raw = [None] * len(b)
            yield pd.DataFrame({"prompt_id": b["prompt_id"], "raw": raw})

    return prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id string, raw string")


def extracted(responses: DataFrame) -> DataFrame:
    """Valid candidates of the per-turn extraction: keys of ``responses`` kept.

    Known label, non-blank text; a blank or literal "null" group key counts as none.
    """
    items = responses.select(*[c for c in responses.columns if c != "raw"], F.posexplode(
        R.object_array(F.col("raw"), "label string, text string, group_key string")).alias("item", "c"))
    key = strip(F.col("c.group_key"))
    return (items.withColumn("label", F.col("c.label")).withColumn("text", strip(F.col("c.text")))
            .withColumn("group_key", F.when((key != "") & (F.lower(key) != "null"), key))
            .filter(F.col("label").isin(*O.CONTENT_LABELS) & (F.coalesce("text", F.lit("")) != ""))
            .drop("c"))


def whole_number(t: Column) -> Column:
    """A turn number as written: digits with an optional sign; "1.5" and "1e3" are none."""
    return F.when(t.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(t).try_cast("bigint"))


def _session_items(responses: DataFrame, turns: DataFrame, schema: str) -> DataFrame:
    """Items of whole-session passes with one row per valid evidence turn.

    Items whose turns are all outside the session disappear.
    """
    items = responses.select("prompt_id", "session_id", "target", F.posexplode(
        R.object_array(F.col("raw"), schema)).alias("item", "c"))
    rows = items.select("prompt_id", "session_id", "target", "item", "c",
                        F.explode(F.transform("c.evidence_turns", whole_number)).alias("turn_index"))
    valid = turns.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index")).distinct()
    return (rows.filter(F.col("turn_index").isNotNull()).dropDuplicates(
        ["session_id", "prompt_id", "item", "turn_index"])
        .join(valid, ["session_id", "turn_index"], "left_semi"))


def session_candidates(responses: DataFrame, turns: DataFrame) -> DataFrame:
    """Whole-session candidates; the label must be the one that was asked for."""
    rows = _session_items(responses, turns,
                          "label string, text string, evidence_turns array<string>")
    text = strip(F.col("c.text"))
    return (rows.filter((strip(F.col("c.label")) == F.col("target"))
                        & (F.coalesce(text, F.lit("")) != ""))
            .select("prompt_id", "session_id", "item", F.col("target").alias("label"),
                    text.alias("text"), "turn_index"))


def reaction_candidates(responses: DataFrame, turns: DataFrame) -> DataFrame:
    """Recovered reactions; the channel is only kept as a hint when it is a known one."""
    rows = _session_items(responses, turns,
                          "text string, channel string, evidence_turns array<string>")
    text, channel = strip(F.col("c.text")), F.lower(strip(F.col("c.channel")))
    return (rows.filter(F.coalesce(text, F.lit("")) != "")
            .select("prompt_id", "session_id", "item", F.lit("Reaction").alias("label"),
                    text.alias("text"),
                    F.when(channel.isin(*O.ENUMS[("Reaction", "channel")]), channel)
                    .alias("channel_hint"), "turn_index"))


def drop_repeats(cands: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per (keys, case-free text, evidence): overlap between chunks repeats rows.

    ``min_by`` pre-aggregates before the shuffle, so many copies cost one row per task.
    """
    folded = F.lower(strip(F.col("text")))
    ev = F.sort_array(F.array_distinct("evidence")).cast("string")
    kept = cands.groupBy(*keys, folded.alias("_t"), ev.alias("_e")).agg(
        F.min_by(F.struct(*cands.columns), order).alias("_row"))
    return kept.select("_row.*")


# ── splitting, rewriting, judging ─────────────────────────────────────────

def last_answers(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the answer with the largest ``answer_no``, where answers are numbered.

    Equal numbers, and answers without numbers, are settled by the largest values, so a
    repeated answer never doubles a candidate and never depends on the order of rows.
    """
    rest = [c for c in answers.columns if c not in (*keys, "answer_no")]
    number = F.col("answer_no") if "answer_no" in answers.columns else F.lit(0)
    return (answers.groupBy(*keys).agg(F.max(F.struct(number.alias("_no"), *rest)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


def atomise(cands: DataFrame, responses: DataFrame) -> DataFrame:
    """Apply split responses (cand_id, raw) to thoughts and beliefs.

    No usable answer keeps the candidate; one string rewrites it in place; several
    become children with fresh ids (``part`` > 0, ``cand_id`` NULL until allocated).
    ``sourceText`` records the original wording where it changed or was kept unread.
    """
    parts = last_answers(responses, ["session_id", "cand_id"]).select(
        "session_id", "cand_id", F.slice(R.string_array(F.col("raw")), 1, MAX_SPLITS).alias("_parts"))
    j = cands.join(parts, ["session_id", "cand_id"], "left")
    splittable = F.col("label").isin(*O.ATOMISE_CLASSES)
    n = F.when(splittable, F.coalesce(F.size("_parts"), F.lit(0))).otherwise(-1)
    unread = F.col("_n") <= 0
    j = j.withColumn("_n", n)
    texts = F.when(F.col("_n") >= 1, F.col("_parts")).otherwise(F.array("text"))
    j = j.withColumn("_src", F.col("text")).withColumn("_props", F.col("props"))
    out = j.select("*", F.posexplode(texts).alias("_i", "_new"))
    source = (F.when(F.col("_n") == 0, F.col("_src"))
              .when((F.col("_n") == 1) & (F.col("_new") != F.col("_src")), F.col("_src"))
              .when(F.col("_n") > 1, F.col("_src")))
    child = F.col("_n") > 1
    base = F.when(child, F.create_map().cast("map<string,string>")).otherwise(F.col("_props"))
    return out.select(
        *[c for c in cands.columns if c not in ("cand_id", "text", "props", "group_key")],
        F.when(child, F.lit(None)).otherwise(F.col("cand_id")).cast("bigint").alias("cand_id"),
        F.col("cand_id").alias("parent_id"), F.when(child, F.col("_i") + 1).otherwise(0).alias("part"),
        F.when(unread, F.col("_src")).otherwise(F.col("_new")).alias("text"),
        F.when(child, F.lit(None).cast("string")).otherwise(F.col("group_key")).alias("group_key"),
        P.set_default(base, "sourceText", source, F.lit(True)).alias("props"))


def normalise(cands: DataFrame, responses: DataFrame) -> DataFrame:
    """Apply rewordings (session_id, label, batch, item, raw per batch) to actions.

    ``cands`` carries batch and item; only changed texts get a ``sourceText``.
    """
    items = last_answers(responses, ["session_id", "label", "batch"]).select(
        "session_id", "label", "batch",
        F.posexplode(R.object_array(F.col("raw"), "item int, description string")).alias("_pos", "c"))
    new = (items.select("session_id", "label", "batch", "_pos", F.col("c.item").alias("item"),
                        strip(F.col("c.description")).alias("_new"))
           .filter(F.coalesce("_new", F.lit("")) != "")
           .groupBy("session_id", "label", "batch", "item").agg(F.max_by("_new", "_pos").alias("_new")))
    j = cands.join(new, ["session_id", "label", "batch", "item"], "left")
    changed = (F.col("label").isin(*O.NORMALISE_CLASSES) & F.col("_new").isNotNull()
               & (F.col("_new") != F.col("text")))
    return (j.withColumn("props", P.set_default(F.col("props"), "sourceText", F.col("text"), changed))
            .withColumn("text", F.when(changed, F.col("_new")).otherwise(F.col("text")))
            .select(*cands.columns))


def judge(cands: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply verdicts (session_id, cand_id, verdict, new_label, reason): kept, dropped.

    Anything that is not a clear drop or a valid move keeps the candidate as it is.
    """
    v = last_answers(verdicts, ["session_id", "cand_id"]).select(
        "session_id", "cand_id", F.lower(strip(F.col("verdict"))).alias("_verdict"),
        strip(F.col("new_label")).alias("_to"), strip(F.col("reason")).alias("_why"))
    j = cands.join(v, ["session_id", "cand_id"], "left")
    drop = F.coalesce(F.col("_verdict") == "drop", F.lit(False))
    move = F.coalesce((F.col("_verdict") == "reclassify") & F.col("_to").isin(*O.RECLASSIFY_TARGETS)
                      & (F.col("_to") != F.col("label")), F.lit(False))
    kept = (j.filter(~drop).withColumn("label", F.when(move, F.col("_to")).otherwise(F.col("label")))
            .select(*cands.columns))
    dropped = j.filter(drop).select(
        "session_id", "cand_id", "label", "text",
        F.coalesce(F.nullif("_why", F.lit("")), F.lit("(no reason)")).alias("reason"))
    return kept, dropped


def enum_member(label: Column, value: Column, prop_of: dict[str, str],
                enums: dict | None = None) -> Column:
    """Whether ``value`` is allowed for the property ``prop_of[label]``."""
    out = F.lit(False)
    for l, p in prop_of.items():
        out = F.when(label == l, value.isin(*(enums or O.ENUMS)[(l, p)])).otherwise(out)
    return F.coalesce(out, F.lit(False))


def assign_discriminator(cands: DataFrame, answers: DataFrame, enums: dict | None = None) -> DataFrame:
    """Subclass answers (session_id, cand_id, subclass) into ``group_key``.

    A valid answer wins over the guess; what stays unresolved becomes ``other`` where the
    class has that value.
    """
    enums = enums or O.ENUMS
    a = last_answers(answers, ["session_id", "cand_id"]).select(
        "session_id", "cand_id", strip(F.col("subclass")).alias("_sub"))
    j = cands.join(a, ["session_id", "cand_id"], "left")
    label = F.col("label")
    valid = F.when(enum_member(label, F.col("_sub"), O.DISCRIMINATOR, enums), F.col("_sub"))
    guess = F.when(enum_member(label, F.col("group_key"), O.DISCRIMINATOR, enums), F.col("group_key"))
    has_other = label.isin(*[l for l, p in O.DISCRIMINATOR.items() if "other" in enums[(l, p)]])
    resolved = F.coalesce(valid, guess, F.when(has_other, F.lit("other")))
    # without a catch-all an unrecognised guess is left as it was
    key = F.when(label.isin(*O.DISCRIMINATOR), F.coalesce(resolved, F.col("group_key"))).otherwise(
        F.col("group_key"))
    return j.withColumn("group_key", key).select(*cands.columns)


def classify(cands: DataFrame, answers: DataFrame) -> DataFrame:
    """Apply property answers (session_id, cand_id, prop, value, technique_label).

    Values outside their enumeration are ignored; ``category`` only counts on beliefs
    about the self; ``techniqueLabel`` only with technique ``other``; ``isOptional`` must
    be a boolean and defaults to false.
    """
    a = (last_answers(answers, ["session_id", "cand_id", "prop"])
         .select("session_id", "cand_id", "prop", strip(F.col("value")).alias("value"),
                 strip(F.col("technique_label")).alias("technique_label"))
         .groupBy("session_id", "cand_id").agg(F.map_from_entries(F.collect_set(
             F.struct("prop", "value"))).alias("_a"),
             F.max("technique_label").alias("_tl")))
    j = cands.join(a, ["session_id", "cand_id"], "left").withColumn(
        "_a", F.coalesce("_a", F.create_map().cast("map<string,string>")))
    label = F.col("label")
    answer = lambda prop: P.get_prop(F.col("_a"), prop)
    given: dict[str, list] = {}
    for lab, prop in O.PROPERTY_PASSES:
        if prop in ("category", "isOptional"):
            continue
        ok = (label == lab) & answer(prop).isin(*O.ENUMS[(lab, prop)])
        given.setdefault(prop, []).append(F.when(ok, answer(prop)))
    values = {prop: F.coalesce(*options) for prop, options in given.items()}
    domain = F.coalesce(values["domain"], P.get_prop(F.col("props"), "domain"))
    values["category"] = F.when(
        (label == "CoreBelief") & (domain == "self")
        & answer("category").isin(*O.ENUMS[("CoreBelief", "category")]), answer("category"))
    values["techniqueLabel"] = F.when(values["technique"] == "other", F.nullif(F.col("_tl"), F.lit("")))
    values["isOptional"] = F.when(label == "Homework", F.coalesce(
        F.when(answer("isOptional").isin("true", "false"), answer("isOptional")),
        P.get_prop(F.col("props"), "isOptional"), F.lit("false")))
    return j.withColumn("props", P.assign(F.col("props"), values)).select(*cands.columns)


def prepared(cands: DataFrame) -> DataFrame:
    """Text into its class property, wording-based properties added."""
    label, text = F.col("label"), F.col("text")
    own = P.text_prop(label)
    withtext = F.map_concat(F.map_filter("props", lambda k, v: k != own), F.map_from_arrays(
        F.array(own), F.array(F.coalesce(F.try_element_at("props", own), text))))
    return cands.withColumn("props", P.lexicon_props(label, F.col("props"), text)).withColumn(
        "props", withtext)


# ── prompt context ────────────────────────────────────────────────────────

def prior_lines(nodes: DataFrame, evidence: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Bullets of prior entities per (session, target class), same class and adjacent ones.

    One row per bullet: session_id, target, kind, prior_ord, label, ord, piece, line.  An
    entity supported over a very long stretch has one bullet per stretch of turns.
    """
    turns = (evidence.groupBy("session_id", F.col("owner_id").alias("node_id"),
                              F.expr(f"turn_index div {PRIOR_TURNS}").alias("piece"))
             .agg(F.array_join(F.transform(F.sort_array(F.collect_set("turn_index")),
                                           lambda t: t.cast("string")), ", ").alias("_turns")))
    base = nodes.join(turns, ["session_id", "node_id"], "left").select(
        "session_id", "label", "ord", F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"),
        F.concat(F.lit("  - '"), P.main_text(F.col("label"), F.col("props")), F.lit("' (turns ["),
                 F.coalesce("_turns", F.lit("")), F.lit("])")).alias("line"))
    same = base.filter(F.col("label").isin(*O.SESSION_PASS_CLASSES)).select(
        "session_id", F.col("label").alias("target"), F.lit("same").alias("kind"),
        F.lit(0).alias("prior_ord"), "label", "ord", "piece", "line")
    near = base.join(F.broadcast(adjacency.select(F.col("label").alias("target"), "prior_ord",
                                                  F.col("prior_label").alias("label"))), "label").select(
        "session_id", "target", F.lit("adjacent").alias("kind"), "prior_ord", "label", "ord", "piece", "line")
    return same.unionByName(near)


def fresh_ids(cands: DataFrame, order: list[str], pos: str) -> DataFrame:
    """Ids above the session's current maximum for rows whose ``cand_id`` is NULL."""
    top = cands.groupBy("session_id").agg(F.coalesce(F.max("cand_id"), F.lit(0)).alias("_max"))
    new = numbered(cands.filter("cand_id is null"), ["session_id"], order, "_n", pos)
    new = new.join(top, "session_id").withColumn("cand_id", F.col("_max") + F.col("_n"))
    return cands.filter("cand_id is not null").unionByName(new.select(*cands.columns))


def property_population(nodes: DataFrame) -> DataFrame:
    """How many nodes of each class carry each property."""
    return (nodes.select("label", F.explode(F.map_keys("props")).alias("prop"))
            .groupBy("label", "prop").agg(F.count(F.lit(1)).alias("n")))
