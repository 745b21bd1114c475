"""Registered queries over candidate extraction, parsing, validation and properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions import responses as R
from ..functions.lexicon import temporality, valence
from ..functions.text import sentences
from ..operators import candidates as C
from . import adapters as A
from . import graphs as G
from .registry import query


def _cands(spark, d):
    """Dialogue candidates with an id that is unique in the session."""
    c = G.dialogue_candidates(spark, d)
    cid = (F.col("turn_index") * 1_000_000 + F.when(F.col("speaker") == "client", 0).otherwise(500_000)
           + F.col("sent_no") * 100 + F.col("priority"))
    return c.select("session_id", cid.cast("bigint").alias("cand_id"), "label", "text", "turn_index",
                    F.lit(None).cast("string").alias("group_key"), G.empty_map().alias("props"))


CID_SQL = G.CANDS_SQL + """,
cc AS (SELECT *, turn_index * 1000000 + CASE speaker WHEN 'client' THEN 0 ELSE 500000 END + sent_no * 100 + priority AS cand_id FROM cands)
"""


@query("E2 X1", f"WITH {G.CANDS_SQL} SELECT session_id, turn_index, speaker, sent_no, label, priority, text FROM cands")
def rule_candidates(spark, d):
    return G.dialogue_candidates(spark, d)


@query("E1", f"""
WITH {G.EVENTS_SQL} SELECT session_id, turn_index, CAST(0 AS INTEGER) AS line_no, label, text FROM ev2 WHERE label <> 'Goal'
UNION ALL SELECT session_id, turn_index, 3, 'Goal', 'reach ' || text FROM ev2
UNION ALL SELECT session_id, turn_index, 2, 'Situation', ' ' FROM ev2""")
def line_candidates(spark, d):
    ev = A.events(spark, d)
    head = F.when(F.col("label") == "Goal", F.lit("Client")).otherwise(F.col("label"))
    text = F.concat(head, F.lit(":  "), "text", F.lit("  \nnote: "), "text", F.lit("\nSituation:   \n  Goal : reach "), "text")
    return C.line_candidates(ev.select("session_id", "turn_index", text.alias("text")))


@query("E9", f"""
WITH {G.CANDS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, label, lower(text), turn_index ORDER BY speaker, sent_no) AS rn FROM cands)
SELECT session_id, label, turn_index, text FROM r WHERE rn = 1""")
def candidate_dedup(spark, d):
    c = G.dialogue_candidates(spark, d).select(
        "session_id", "label", "text", F.array(F.col("turn_index").cast("int")).alias("evidence"), "turn_index",
        F.struct("speaker", "sent_no").alias("at"))
    return C.drop_repeats(c, ["session_id", "label"], "at").select("session_id", "label", "turn_index", "text")


def _lex_sql(words: list[str], col: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_TIME_SQL = "CASE " + " ".join(
    [f"WHEN contains(sentence, '{m}') THEN '{v}'" for m, v in O.TIME_MARKERS_TH.items()]
    + [f"WHEN contains(lower(sentence), '{m}') THEN '{v}'" for m, v in O.TIME_MARKERS_EN.items()]) + " END"
_VAL_SQL = (f"CASE WHEN {_lex_sql(O.NEGATIVE_TH, 'sentence')} OR {_lex_sql(O.NEGATIVE_EN, 'lower(sentence)')} THEN 'negative' "
            f"WHEN {_lex_sql(O.POSITIVE_TH, 'sentence')} OR {_lex_sql(O.POSITIVE_EN, 'lower(sentence)')} THEN 'positive' END")


@query("E17 E18", f"""
WITH {G.sentences_sql("documents", "doc_id, lang")}
SELECT lang, coalesce({_VAL_SQL}, '-') AS valence, coalesce({_TIME_SQL}, '-') AS temporality, count(*) AS n FROM sents GROUP BY ALL""")
def valence_temporality(spark, d):
    s = A.documents(spark, d).select("lang", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("lang", F.coalesce(valence(F.col("s")), F.lit("-")).alias("valence"),
                     F.coalesce(temporality(F.col("s")), F.lit("-")).alias("temporality")).agg(
        F.count(F.lit(1)).alias("n"))


def _gate_case(spark, d):
    """Event rows as nodes of the gated classes, with props that open or close the gate."""
    ev = A.events(spark, d)
    k = F.col("k").cast("int")
    label = (F.when(F.col("event_type") == "click", "CoreBelief").when(F.col("event_type") == "view", "Reaction")
             .when(F.col("event_type") == "error", "Intervention").when(F.col("event_type") == "purchase", "AutomaticThought")
             .otherwise("Homework"))
    props = (F.when(label == "CoreBelief", F.create_map(
        F.lit("domain"), F.when(k % 3 == 0, "self").otherwise("world"), F.lit("category"), F.lit("helpless")))
        .when(label == "Reaction", F.create_map(
            F.lit("channel"), F.when(k % 2 == 0, "emotional").otherwise("behavioral"), F.lit("valence"), F.lit("negative")))
        .when(label == "Intervention", F.create_map(
            F.lit("technique"), F.when(k % 5 == 0, "other").otherwise("realityTesting"), F.lit("techniqueLabel"), F.lit("free")))
        .when((label == "AutomaticThought") & (k % 4 == 0), F.create_map(F.lit("modality"), F.lit("image")))
        .otherwise(G.empty_map()))
    return ev.select("event_id", label.alias("label"), props.alias("props"))


@query("E20", """
WITH ev AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE event_type
  WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'category=helpless;domain=self' ELSE 'domain=world' END
  WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'channel=emotional;valence=negative' ELSE 'channel=behavioral' END
  WHEN 'error' THEN CASE WHEN k % 5 = 0 THEN 'technique=other;techniqueLabel=free' ELSE 'technique=realityTesting' END
  WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'modality=image' ELSE 'modality=verbal' END
  ELSE 'isOptional=false' END AS props FROM ev""")
def gated_props(spark, d):
    return _gate_case(spark, d).select("event_id", props_text(P.gate(F.col("label"), F.col("props"))).alias("props"))


def props_text(props):
    """Properties as one sorted string, for results that must be scalar."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(props)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("E19", f"""
WITH {G.CANDS_SQL}, p AS (SELECT session_id, label, turn_index, speaker, sent_no, text AS sentence FROM cands
  WHERE label IN ('Reaction', 'Situation', 'AutomaticThought'))
SELECT session_id, label, turn_index, speaker, sent_no, CASE label
  WHEN 'AutomaticThought' THEN 'modality=verbal'
  WHEN 'Situation' THEN 'kind=externalSituation' || coalesce(';temporality=' || {_TIME_SQL}, '')
  ELSE 'channel=emotional' || coalesce(';valence=' || {_VAL_SQL}, '') END AS props FROM p""")
def wording_props(spark, d):
    c = G.dialogue_candidates(spark, d).filter(F.col("label").isin("Reaction", "Situation", "AutomaticThought"))
    start = F.when(F.col("label") == "Reaction", F.create_map(F.lit("channel"), F.lit("emotional"))).otherwise(G.empty_map())
    return c.select("session_id", "label", "turn_index", "speaker", "sent_no",
                    props_text(P.lexicon_props(F.col("label"), start, F.col("text"))).alias("props"))


def _json_str(c):
    """JSON string literal of a text column."""
    j = F.to_json(F.struct(c.alias("t")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


@query("E3 E4 E6 U2", f"""
WITH {CID_SQL}
SELECT session_id, cand_id, label, text, CASE WHEN sent_no % 2 = 0 THEN 'self' END AS group_key FROM cc
WHERE sent_no % 5 <> 4""")
def parsed_candidates(spark, d):
    """Prompts to responses to candidates, with a deterministic stand-in for the model.

    The stand-in wraps an array of objects in a thought block and prose; every fifth
    sentence answers without an array.  Unknown classes, blank texts, non-objects and
    "null" group keys are part of every answer.
    """
    c = G.dialogue_candidates(spark, d)
    cid = (F.col("turn_index") * 1_000_000 + F.when(F.col("speaker") == "client", 0).otherwise(500_000)
           + F.col("sent_no") * 100 + F.col("priority")).cast("bigint")
    body = F.concat(F.lit('{"label": "'), "label", F.lit('", "text": '), _json_str(F.concat(F.lit("  "), "text", F.lit(" "))),
                    F.lit(', "group_key": '), F.when(F.col("sent_no") % 2 == 0, F.lit('" self "')).otherwise(F.lit('"NULL"')), F.lit("}"))
    answer = F.when(F.col("sent_no") % 5 == 4, F.lit("nothing to extract")).otherwise(F.concat(
        F.lit("Here you are: ["), body,
        F.lit(', {"label": "Client", "text": "x"}, {"label": "Goal", "text": "  "}, 7, "Goal"] as asked.')))
    prompts = c.select("session_id", cid.alias("cand_id"),
                       C.fill("Label what is said. Sentence: {text}\nANSWER {answer}", text=F.col("text"), answer=answer).alias("prompt"))
    prompts = prompts.withColumn("prompt_id", F.concat_ws("/", "session_id", "cand_id"))

    def stand_in(batch):
        return ["<think>[]</think>" + p.split("\nANSWER ", 1)[1] for p in batch]

    raw = C.infer(prompts, stand_in)
    j = raw.select(F.split_part("prompt_id", F.lit("/"), F.lit(1)).alias("session_id"),
                   F.split_part("prompt_id", F.lit("/"), F.lit(2)).cast("bigint").alias("cand_id"), "raw")
    return C.extracted(j).select("session_id", "cand_id", "label", "text", "group_key")


@query("E5", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, CASE turn % 4 WHEN 3 THEN 'raw words ' || turn ELSE 'reply ' || turn END AS response,
  CASE turn % 4 WHEN 0 THEN 'Assessment' WHEN 2 THEN 'Assessment' END AS technique,
  CASE turn % 4 WHEN 2 THEN 'Technique' END AS phase FROM conversations""")
def reply_objects(spark, d):
    m = A.messages(spark, d)
    n = F.col("pos").cast("string")
    raw = (F.when(F.col("pos") % 4 == 0, F.concat(F.lit('```json\n{"response": "reply '), n, F.lit('", "technique": "Assessment"}\n```')))
           .when(F.col("pos") % 4 == 1, F.concat(F.lit('{\\"response\\": \\"reply '), n, F.lit('\\"}')))
           .when(F.col("pos") % 4 == 2, F.concat(F.lit('Let me think {draft} first. {"response": "reply '), n,
                                                 F.lit('", "technique": "Assessment", "phase": "Technique"} ok')))
           .otherwise(F.concat(F.lit("raw words "), n)))
    return m.select("session_id", F.col("pos").alias("turn"), R.reply_object(raw).alias("r")).select(
        "session_id", "turn", "r.response", "r.technique", "r.phase")


@query("E7", f"""
WITH {CID_SQL}, t AS (SELECT DISTINCT session_id, turn_index FROM turns),
e AS (SELECT session_id, label, cand_id, text, unnest([turn_index, turn_index + 1, 999999]) AS turn_index FROM cc
  WHERE label IN ('CoreBelief', 'Goal', 'Problem'))
SELECT e.session_id, e.label, e.cand_id, e.text, e.turn_index FROM e JOIN t USING (session_id, turn_index)""")
def session_candidates(spark, d):
    c = _cands(spark, d).filter(F.col("label").isin("CoreBelief", "Goal", "Problem"))
    t = F.col("turn_index").cast("string")
    raw = F.concat(F.lit('[{"label": "'), "label", F.lit('", "text": '), _json_str(F.col("text")), F.lit(', "evidence_turns": ['), t,
                   F.lit(', "'), (F.col("turn_index") + 1).cast("string"), F.lit('", 999999, "x", '), t,
                   F.lit(']}, {"label": "Other", "text": "y", "evidence_turns": [1]}, {"label": "'), "label",
                   F.lit('", "text": "z", "evidence_turns": [999999]}]'))
    resp = c.select(F.concat_ws("/", "session_id", "cand_id").alias("prompt_id"), "session_id",
                    F.col("label").alias("target"), raw.alias("raw"))
    return C.session_candidates(resp, A.client_turns(spark, d)).select(
        "session_id", "label", F.split_part("prompt_id", F.lit("/"), F.lit(2)).cast("bigint").alias("cand_id"),
        "text", "turn_index")


@query("E8", f"""
WITH {CID_SQL}
SELECT session_id, cand_id, text, turn_index, CASE sent_no % 2 WHEN 0 THEN 'behavioral' END AS channel_hint FROM cc WHERE label = 'Reaction'""")
def reaction_candidates(spark, d):
    c = G.dialogue_candidates(spark, d).filter("label = 'Reaction'")
    cid = (F.col("turn_index") * 1_000_000 + F.col("sent_no") * 100 + F.col("priority")).cast("bigint")
    raw = F.concat(F.lit('[{"text": '), _json_str(F.col("text")), F.lit(', "channel": "'),
                   F.when(F.col("sent_no") % 2 == 0, " Behavioral ").otherwise("mental"), F.lit('", "evidence_turns": ['),
                   F.col("turn_index").cast("string"), F.lit("]}]"))
    resp = c.select(cid.cast("string").alias("prompt_id"), "session_id", F.lit("Reaction").alias("target"), raw.alias("raw"))
    return C.reaction_candidates(resp, A.client_turns(spark, d)).select(
        "session_id", F.col("prompt_id").cast("bigint").alias("cand_id"), "text", "turn_index", "channel_hint")


@query("E10 E16", f"""
WITH {CID_SQL},
s AS (SELECT *, CASE WHEN label NOT IN ('AutomaticThought', 'CoreBelief', 'IntermediateBelief') THEN -1
    WHEN sent_no % 4 = 3 THEN 0 WHEN sent_no % 4 = 0 THEN 1 WHEN sent_no % 4 = 1 THEN 2 ELSE 4 END AS n FROM cc),
parts AS (SELECT *, unnest(CASE WHEN n < 2 THEN [0] WHEN n = 2 THEN [1, 2] ELSE [1, 2, 3, 4] END) AS part FROM s),
mx AS (SELECT session_id, max(cand_id) AS m FROM parts WHERE part = 0 GROUP BY session_id),
named AS (SELECT p.*, CASE WHEN part = 0 THEN cand_id ELSE coalesce(m, 0) + row_number() OVER (
    PARTITION BY p.session_id, part = 0 ORDER BY cand_id, part) END AS new_id FROM parts p LEFT JOIN mx USING (session_id))
SELECT session_id, new_id AS cand_id, cand_id AS parent_id, label,
  CASE WHEN n = 1 THEN 'short ' || cand_id WHEN part > 0 THEN 'part ' || part || ' of ' || cand_id ELSE text END AS text,
  CASE WHEN n >= 0 THEN text END AS source_text FROM named""")
def atomised(spark, d):
    c = _cands(spark, d)
    cid, k = F.col("cand_id").cast("string"), F.expr("(cand_id div 100) % 5000")
    part = lambda i: F.concat(F.lit(f'"  part {i} of '), cid, F.lit('"'))
    raw = (F.when(k % 4 == 3, F.when(k % 8 == 3, "no array").otherwise("[]"))
           .when(k % 4 == 0, F.concat(F.lit('["", "short '), cid, F.lit('", 5]')))
           .when(k % 4 == 1, F.concat(F.lit("["), part(1), F.lit(", "), part(2), F.lit(", null, {}]")))
           .otherwise(F.concat(F.lit("["), F.concat_ws(",", *[part(i) for i in range(1, 7)]), F.lit("]"))))
    out = C.atomise(c, c.select("session_id", "cand_id", raw.alias("raw")))
    named = C.fresh_ids(out.withColumn("_o", F.col("parent_id") * 10 + F.col("part")), ["_o"], "_o")
    return named.select("session_id", "cand_id", "parent_id", "label", "text",
                        P.get_prop(F.col("props"), "sourceText").alias("source_text"))


@query("E11", f"""
WITH {CID_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY cand_id) AS k FROM cc WHERE label IN ('Intervention', 'Homework'))
SELECT session_id, cand_id, CASE WHEN (k - 1) % 6 + 1 <= 2 THEN 'clear ' || ((k - 1) % 6 + 1) ELSE text END AS text,
  CASE WHEN (k - 1) % 6 + 1 <= 2 THEN text END AS source_text FROM n""")
def normalised(spark, d):
    from ..operators.turns import batches
    c = batches(_cands(spark, d).filter(F.col("label").isin(*O.NORMALISE_CLASSES)), ["session_id", "label"],
                ["cand_id"], "cand_id", 6)
    answers = c.select("session_id", "label", "batch").distinct().withColumn("raw", F.lit(
        '[{"item": 1, "description": " clear 1"}, {"item": 2, "description": "clear 2"}, {"item": 3, "description": ""},'
        ' {"item": 99, "description": "nowhere"}]'))
    return C.normalise(c, answers).select("session_id", "cand_id", "text",
                                          P.get_prop(F.col("props"), "sourceText").alias("source_text"))


@query("E12", """
WITH c AS (SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 0 THEN 'reclassify' ELSE 'keep' END AS v,
    l.doc_id IS NULL AS unjudged FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id AS cand_id, CASE WHEN unjudged THEN 'Problem' WHEN v = 'drop' THEN 'dropped' WHEN v = 'reclassify' THEN 'CoreBelief' ELSE 'Problem' END AS label,
  CASE WHEN NOT unjudged AND v = 'drop' THEN 'toxic' END AS reason FROM c""")
def judged(spark, d):
    """Documents as candidates, their labels as verdicts."""
    c = A.documents(spark, d).select(F.col("lang").alias("session_id"), F.col("doc_id").alias("cand_id"),
                                     F.lit("Problem").alias("label"), "text")
    v = A.table(spark, d, "labels").join(c.select("session_id", F.col("cand_id").alias("doc_id")), "doc_id").select(
        "session_id", F.col("doc_id").alias("cand_id"),
        F.when(F.col("toxic") == 1, " Drop").when(F.col("quality") == 0, "reclassify").otherwise("keep").alias("verdict"),
        F.when(F.col("quality") == 0, "CoreBelief").otherwise("").alias("new_label"),
        F.when(F.col("toxic") == 1, "toxic").alias("reason"))
    kept, dropped = C.judge(c, v)
    return kept.select("cand_id", "label", F.lit(None).cast("string").alias("reason")).unionByName(
        dropped.select("cand_id", F.lit("dropped").alias("label"), "reason"))


@query("E13", f"""
WITH {CID_SQL}
SELECT session_id, cand_id, CASE WHEN label NOT IN ('Problem', 'CoreBelief', 'IntermediateBelief', 'Reaction') THEN NULL
  WHEN sent_no % 3 = 0 THEN CASE label WHEN 'Problem' THEN 'work' WHEN 'CoreBelief' THEN 'self' WHEN 'IntermediateBelief' THEN 'rule' ELSE 'emotional' END
  WHEN label = 'Problem' THEN 'other' END AS group_key FROM cc""")
def discriminators(spark, d):
    c = _cands(spark, d)
    k = F.expr("(cand_id div 100) % 5000")
    good = (F.when(F.col("label") == "Problem", " work").when(F.col("label") == "CoreBelief", "self")
            .when(F.col("label") == "IntermediateBelief", "rule").otherwise("emotional"))
    a = c.filter(k % 3 != 2).select("session_id", "cand_id", F.when(k % 3 == 0, good).otherwise("nonsense").alias("subclass"))
    return C.assign_discriminator(c, a).select("session_id", "cand_id", "group_key")


@query("E14", f"""
WITH {CID_SQL}, s AS (SELECT *, sent_no % 3 AS r FROM cc)
SELECT session_id, cand_id, CASE label
  WHEN 'CoreBelief' THEN CASE r WHEN 0 THEN 'category=helpless;domain=self' WHEN 1 THEN 'domain=world' ELSE '' END
  WHEN 'Intervention' THEN CASE r WHEN 0 THEN 'technique=other;techniqueLabel=free form' WHEN 1 THEN 'technique=realityTesting' ELSE '' END
  WHEN 'Homework' THEN CASE r WHEN 0 THEN 'isOptional=true;taskType=reading' ELSE 'isOptional=false' END
  ELSE '' END AS props FROM s""")
def classified_props(spark, d):
    c = _cands(spark, d)
    r = F.expr("(cand_id div 100) % 5000") % 3
    none = F.lit(None).cast("string")
    one = lambda prop, value, extra=none: F.struct(F.lit(prop).alias("prop"), value.alias("value"), extra.alias("technique_label"))
    answers = c.select("session_id", "cand_id", F.explode(F.array(
        one("domain", F.when(r == 0, "self").when(r == 1, "world").otherwise("mars")),
        one("category", F.lit("helpless")),
        one("technique", F.when(r == 0, "other").when(r == 1, "realityTesting").otherwise("magic"), F.lit(" free form ")),
        one("taskType", F.when(r == 0, "reading").otherwise("cooking")),
        one("isOptional", F.when(r == 0, "true").when(r == 1, "maybe")))).alias("a"), F.col("label").alias("l")).filter(
        F.col("l").isin("CoreBelief", "Intervention", "Homework")).select("session_id", "cand_id", "a.*")
    return C.classify(c, answers).select("session_id", "cand_id", props_text(F.col("props")).alias("props"))


_ADJ_SQL = " UNION ALL ".join(f"SELECT '{l}' AS target, {i} AS prior_ord, '{p}' AS label"
                              for l, ps in O.ADJACENT.items() for i, p in enumerate(ps))


@query("E15", f"""
WITH {G.EVENTS_SQL}, adj AS ({_ADJ_SQL}),
b AS (SELECT n.session_id, n.label, n.ord, '  - ''' || n.text || ''' (turns [' ||
    (SELECT string_agg(CAST(e.turn_index AS VARCHAR), ', ' ORDER BY e.turn_index) FROM en e
     WHERE e.session_id = n.session_id AND e.node_id = n.node_id) || '])' AS line FROM nodes n),
r AS (SELECT session_id, label AS target, 'same' AS kind, 0 AS prior_ord, label, ord, line FROM b
   WHERE label IN ({', '.join(repr(x) for x in O.SESSION_PASS_CLASSES)})
 UNION ALL SELECT session_id, target, 'adjacent', prior_ord, b.label, ord, line FROM b JOIN adj USING (label))
SELECT session_id, target, kind, prior_ord, label, ord, line FROM r""")
def prior_blocks(spark, d):
    g = G.event_graph(spark, d)
    return C.prior_lines(g.nodes, g.node_evidence, O.Ontology.of().adjacent(spark)).select(
        "session_id", "target", "kind", "prior_ord", "label", "ord", "line")


@query("E21", f"WITH {G.STAR_SQL} SELECT node_id, label, text FROM nodes")
def main_texts(spark, d):
    n = G.star_graph(spark, d).nodes
    return n.select("node_id", "label", P.main_text(F.col("label"), F.col("props")).alias("text"))


@query("E22", f"""
WITH {G.EVENTS_SQL}, p AS (SELECT label, unnest(CASE WHEN prop IS NULL THEN [1] ELSE [1, 2] END) AS i FROM nodes)
SELECT label, CASE i WHEN 1 THEN CASE label WHEN 'Problem' THEN 'description' WHEN 'Situation' THEN 'description' WHEN 'Goal' THEN 'statement' ELSE 'content' END
  ELSE CASE label WHEN 'Problem' THEN 'domain' WHEN 'Situation' THEN 'kind' ELSE 'distortionType' END END AS prop, count(*) AS n FROM p GROUP BY ALL""")
def property_population(spark, d):
    return C.property_population(G.event_graph(spark, d).nodes)
