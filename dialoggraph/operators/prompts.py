"""Prompt tables: one row per model call, built from canonical tables.

The templates are our own wording and plain data; callers may pass others with the same
slots.  Every builder returns prompt_id, stage, session_id, prompt plus the keys its
answers are applied by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions.lookup import lookup
from .candidates import fill

ONLY_ARRAY = "Answer with a JSON array and nothing else; [] if there is nothing."
TEMPLATES = {
    "extract": ("Find graph entities in one turn of a counselling dialogue ({language}).\nClasses:\n{classes}\n"
                "Usual for this speaker: {prior}\nEarlier exchange:\n{context}\nTurn {turn} ({speaker}): {text}\n"
                "Give objects with label, text and group_key. " + ONLY_ARRAY),
    "session": ("Find every {label} the whole dialogue supports ({language}).\n{label}: {gloss}\nKnown already:\n{same}\n"
                "Related:\n{adjacent}\nDialogue:\n{transcript}\nGive objects with label, text and evidence_turns. " + ONLY_ARRAY),
    "atomise": ("Rewrite this {label} as one to {most} plain first-person statements ({language}).\n{label}: {gloss}\n"
                "Text: {text}\nGive strings. " + ONLY_ARRAY),
    "property": ("Choose {field} for each item ({language}).\nValues: {values}\nItems:\n{items}\n"
                 "Give objects with item and {field}. " + ONLY_ARRAY),
    "edge": ("Which relations does this {label} have ({language})?\nSubject: {text}\nEarlier exchange:\n{context}\n{lists}\n"
             "Give objects with relation and object number. " + ONLY_ARRAY),
    "reinforces": ("Which reactions keep which beliefs going ({language})?\nReactions:\n{reactions}\nBeliefs:\n{beliefs}\n"
                   "Give objects with reaction and belief numbers. " + ONLY_ARRAY),
    "question": ("Turn a question about a dialogue graph into a query.\nClasses: {classes}\nRelations: {predicates}\n"
                 "Properties:\n{ontology}\nQuestion: {question}\nGive one JSON object with intent, node_labels, predicates, "
                 "property_filters and free_text."),
    "answer": "Answer only from the result.\nQuestion: {question}\nResult:\n{result}",
}


def _table(rows: DataFrame, stage: str, ident, keys: list[str], **slots) -> DataFrame:
    return rows.select(F.concat_ws("/", F.lit(stage), *ident).alias("prompt_id"), F.lit(stage).alias("stage"),
                       *keys, fill(TEMPLATES[stage], **slots).alias("prompt"))


def _numbered_lines(rows: DataFrame, keys: list[str], n: str, text: str, name: str) -> DataFrame:
    """Lines '  n. text' per key; callers keep the lists bounded (one turn, one batch)."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col(n).alias("n"), F.col(text).alias("t")))),
        lambda x: F.concat(F.lit("  "), x["n"].cast("string"), F.lit(". "), x["t"])), "\n").alias(name))


def extract_prompts(turns: DataFrame, windows: DataFrame, language: str = "English") -> DataFrame:
    """One prompt per client turn; windows: recent exchanges (turn_index, prior_*)."""
    said = F.concat(F.lit("C: "), "prior_client", F.lit("\nT: "), "prior_reply")
    ctx = windows.groupBy("session_id", "turn_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("prior_turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("_ctx"))
    j = turns.filter("speaker = 'client'").join(ctx, ["session_id", "turn_index"], "left")
    classes = "\n".join(f"- {l}: {O.CLASS_GLOSS[l]}" for l in O.CONTENT_LABELS)
    return _table(j, "extract", ["session_id", "turn_index"], ["session_id", "turn_index"],
                  language=F.lit(language), classes=F.lit(classes), prior=F.lit(", ".join(O.SPEAKER_PRIOR["client"])),
                  context=F.coalesce("_ctx", F.lit("(none)")), turn=F.col("turn_index"), speaker=F.col("speaker"),
                  text=F.col("text"))


def session_prompts(chunks: DataFrame, priors: DataFrame, language: str = "English") -> DataFrame:
    """One prompt per (chunk, class of the whole-session pass).

    chunks: session_id, chunk, transcript; priors: lines of ``candidates.prior_lines``.
    """
    def lines(kind: str, name: str) -> DataFrame:
        return priors.filter(F.col("kind") == kind).groupBy("session_id", F.col("target").alias("label")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prior_ord", "ord", "line"))),
                                     lambda x: x["line"]), "\n").alias(name))
    asked = chunks.withColumn("label", F.explode(F.array(*[F.lit(l) for l in O.SESSION_PASS_CLASSES])))
    j = asked.join(lines("same", "_same"), ["session_id", "label"], "left").join(
        lines("adjacent", "_near"), ["session_id", "label"], "left")
    return _table(j, "session", ["session_id", "chunk", "label"], ["session_id", "chunk", F.col("label").alias("target")],
                  language=F.lit(language), label=F.col("label"), gloss=lookup(O.CLASS_GLOSS, F.col("label")),
                  same=F.coalesce("_same", F.lit("(none)")), adjacent=F.coalesce("_near", F.lit("(none)")),
                  transcript=F.col("transcript"))


def atomise_prompts(cands: DataFrame, language: str = "English") -> DataFrame:
    c = cands.filter(F.col("label").isin(*O.ATOMISE_CLASSES))
    return _table(c, "atomise", ["session_id", "cand_id"], ["session_id", "cand_id"], label=F.col("label"),
                  gloss=lookup(O.CLASS_GLOSS, F.col("label")), text=F.col("text"), most=F.lit(4), language=F.lit(language))


def property_prompts(batched: DataFrame, language: str = "English") -> DataFrame:
    """One prompt per (batch, property) of a class; batched carries batch and item."""
    passes = {l: [p for x, p in O.PROPERTY_PASSES if x == l] for l, _ in O.PROPERTY_PASSES}
    values = {f"{l}.{p}": ", ".join(O.ENUMS.get((l, p), ["true", "false"])) for l, p in O.PROPERTY_PASSES}
    lists = _numbered_lines(batched.filter(F.col("label").isin(*passes)), ["session_id", "label", "batch"], "item", "text", "_items")
    fields = F.try_element_at(F.create_map(*[x for l, ps in passes.items() for x in (
        F.lit(l), F.array(*[F.lit(p) for p in ps]))]), F.col("label"))
    j = lists.withColumn("prop", F.explode(fields))
    return _table(j, "property", ["session_id", "label", "prop", "batch"], ["session_id", "label", "prop", "batch"],
                  field=F.col("prop"), items=F.col("_items"), language=F.lit(language),
                  values=lookup(values, F.concat_ws(".", "label", "prop")))


def edge_prompts(pairs: DataFrame, nodes: DataFrame, contexts: DataFrame, language: str = "English") -> DataFrame:
    """One prompt per subject; pairs: ``edges.anchor_pairs`` of a turn's new nodes.

    contexts: session_id, context.
    """
    text = nodes.select("session_id", F.col("node_id").alias("object_id"), P.main_text(
        F.col("label"), F.col("props"), skip_empty=True).alias("_t"))
    lists = _numbered_lines(pairs.join(text, ["session_id", "object_id"]), ["session_id", "subject_id", "predicate"], "n", "_t", "_l")
    blocks = lists.groupBy("session_id", "subject_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("predicate", "_l"))), lambda x: F.concat(x["predicate"], F.lit(":\n"), x["_l"])), "\n").alias("_lists"))
    subj = nodes.select("session_id", F.col("node_id").alias("subject_id"), "label", P.main_text(
        F.col("label"), F.col("props"), skip_empty=True).alias("_t"))
    j = blocks.join(subj, ["session_id", "subject_id"]).join(contexts, "session_id", "left")
    return _table(j, "edge", ["session_id", "subject_id"], ["session_id", "subject_id"], label=F.col("label"), text=F.col("_t"),
                  context=F.coalesce("context", F.lit("(none)")), lists=F.col("_lists"), language=F.lit(language))


def reinforces_prompts(lists: DataFrame, per_prompt: int = 200, language: str = "English") -> DataFrame:
    """Reactions and beliefs of a session, ``per_prompt`` of each at most in one prompt.

    A session with more of either gets one prompt per pair of pages, so numbers stay those
    of the lists and no prompt holds a whole session.
    """
    paged = lists.withColumn("page", F.expr(f"(n - 1) div {per_prompt}"))
    side = lambda label, name: _numbered_lines(paged.filter(F.col("label") == label), ["session_id", "page"], "n", "text", f"_{name}"
                                               ).withColumnRenamed("page", f"page_{name}")
    j = side("Reaction", "r").join(side("CoreBelief", "b"), "session_id")
    return _table(j, "reinforces", ["session_id", "page_r", "page_b"], ["session_id"], reactions=F.col("_r"),
                  beliefs=F.col("_b"), language=F.lit(language))


def question_prompts(questions: DataFrame, ontology: O.Ontology) -> DataFrame:
    """questions: session_id, question."""
    return _table(questions, "question", ["session_id"], ["session_id"], classes=F.lit(", ".join(sorted(O.LABELS))),
                  predicates=F.lit(", ".join(sorted(O.PREDICATES))), ontology=F.lit(ontology.render()), question=F.col("question"))


def answer_prompts(questions: DataFrame, rendered: DataFrame) -> DataFrame:
    """rendered: session_id, answer (``query.render``), the result to narrate."""
    return _table(questions.join(rendered, "session_id"), "answer", ["session_id"], ["session_id"],
                  question=F.col("question"), result=F.col("answer"))
