"""Registered queries for prompt tables and the whole build."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology as O
from ..operators import candidates as C
from ..operators import edges as E
from ..operators import prompts as PR
from ..operators import turns as T
from . import adapters as A
from . import graphs as G
from .batch import build_graph
from .registry import query


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _template_sql(stage: str, **slots: str) -> str:
    """SQL expression of a filled template; slots are SQL expressions."""
    parts, rest = [], PR.TEMPLATES[stage]
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append("'" + _sql(head) + "'")
        if not brace:
            break
        slot, _, rest = tail.partition("}")
        parts.append(f"CAST({slots[slot]} AS VARCHAR)")
    return " || ".join(parts)


_CLASSES = "\n".join(f"- {l}: {O.CLASS_GLOSS[l]}" for l in O.CONTENT_LABELS)


@query("E3 T4", f"""
WITH {G.TURNS_SQL},
pairs AS (SELECT session_id, turn_index, max(CASE WHEN speaker = 'client' THEN text END) AS c, coalesce(max(CASE WHEN speaker = 'therapist' THEN text END), '') AS r FROM turns GROUP BY ALL),
w AS (SELECT p.session_id, p.turn_index, q.turn_index AS t, 'C: ' || q.c || chr(10) || 'T: ' || q.r AS s, row_number() OVER (PARTITION BY p.session_id, p.turn_index ORDER BY q.turn_index DESC) AS rn
  FROM pairs p JOIN pairs q ON p.session_id = q.session_id AND q.turn_index < p.turn_index AND q.r <> '' AND q.c IS NOT NULL WHERE p.c IS NOT NULL),
ctx AS (SELECT session_id, turn_index, string_agg(s, chr(10) ORDER BY t) AS ctx FROM w WHERE rn <= 2 GROUP BY ALL)
SELECT 'extract/' || t.session_id || '/' || t.turn_index AS prompt_id, md5({_template_sql("extract", language="'English'", classes="'" + _sql(_CLASSES) + "'",
    prior="'" + ", ".join(O.SPEAKER_PRIOR["client"]) + "'", context="coalesce(ctx, '(none)')", turn="t.turn_index", speaker="speaker", text="text")}) AS prompt_md5
FROM turns t LEFT JOIN ctx USING (session_id, turn_index) WHERE speaker = 'client'""")
def extract_prompts(spark, d):
    turns = A.client_turns(spark, d)
    p = PR.extract_prompts(turns, T.recent_exchanges(T.exchanges(turns), 2))
    return p.select("prompt_id", F.md5("prompt").alias("prompt_md5"))


@query("E3 T11", f"""
WITH {G.CANDS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY turn_index, speaker, sent_no) AS k FROM cands WHERE label IN ('Problem', 'Situation')),
l AS (SELECT session_id, label, (k - 1) // 6 AS batch, string_agg('  ' || ((k - 1) % 6 + 1) || '. ' || text, chr(10) ORDER BY k) AS items FROM n GROUP BY ALL)
SELECT 'property/' || session_id || '/' || label || '/' || p || '/' || batch AS prompt_id, md5({_template_sql("property", field="p", language="'English'", values="v", items="items")}) AS prompt_md5
FROM l JOIN (VALUES ('Problem', 'domain', '{", ".join(O.ENUMS[("Problem", "domain")])}'), ('Situation', 'kind', '{", ".join(O.ENUMS[("Situation", "kind")])}')) f(label, p, v) USING (label)""")
def property_prompts(spark, d):
    c = G.dialogue_candidates(spark, d).filter(F.col("label").isin("Problem", "Situation"))
    b = T.batches(c, ["session_id", "label"], ["turn_index", "speaker", "sent_no"], "turn_index", 6)
    return PR.property_prompts(b).select("prompt_id", F.md5("prompt").alias("prompt_md5"))


@query("U1 M2 G2 G8 G9 R1")
def built_graph(spark, d):
    """The whole build over all conversations: nodes and edges per kind.

    Candidates come from the rule pack; the stand-in for the model links every subject to
    the first object of each of its lists.
    """
    turns = A.client_turns(spark, d)

    def rules(t):
        c = C.rule_candidates(t, A.FIXTURE_RULES)
        return c.withColumn("seq", F.when(F.col("speaker") == "client", 0).otherwise(30000) + F.col("sent_no"))

    def first_of_each(nodes, lists):
        heads = lists.filter("n = 1").select("session_id", "subject_label", "predicate")
        return nodes.select("session_id", F.col("node_id").alias("subject_id"), F.col("label").alias("subject_label"),
                            F.col("turn_acquired").cast("bigint").alias("turn_index"), "ord").join(
            heads, ["session_id", "subject_label"]).select("*", F.lit(1).alias("n"), F.lit("omit").alias("reported_intensity"))

    g, dropped = build_graph(turns, rules, first_of_each)
    n = g.nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("what")).agg(F.count(F.lit(1)).alias("n"))
                         ).unionByName(dropped.groupBy(F.lit("dropped").alias("kind"), F.col("drop_reason").alias("what")).agg(
                             F.count(F.lit(1)).alias("n")))
