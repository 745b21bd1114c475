"""Registered queries over the referral guard and the two streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..operators import candidates as C
from ..operators import guard as X
from ..session import ensure_checkpoint_dir
from ..sources.store import SessionStore
from ..streaming.guard_stream import start_guard
from ..streaming.turn_stream import LINK, latest, start_turns, with_row_state
from ..streaming.turn_stream import utterance_stream as versions_of
from ..streaming.wide_pass import WidePass
from . import adapters as A
from . import graphs as G
from .batch import whole_build
from .registry import query

CFG = X.GuardConfig(
    header="Help is near:", generic="Someone you trust, or the people who handle urgent calls where you live, can be with you.",
    upstream=["You matter, so please talk to the people who handle urgent calls where you live before you do anything else."])


def _sql(s: str) -> str:
    return s.replace("'", "''")


def _ascii(p: str) -> str:
    """Pattern for an engine whose classes are ASCII: letters and digits spelled out."""
    return _sql(p.replace(r"[\w'’-]", r"[\p{L}\p{N}_'’-]"))


_NUMS = ", ".join(f"'{n}'" for n in CFG.number_keys())
_DOMAINS = ", ".join(f"'{x}'" for x in CFG.known_domains)
_UP = _sql(CFG.upstream[0].lower())
_FOUND_SQL = rf"""
{G.sentences_sql("replies", "reply_id")},
m1 AS (SELECT *, regexp_replace(sentence, '{_ascii(X.URL)}', chr(1), 'gi') AS no_urls,
   trim(lower(regexp_replace(sentence, '\s+', ' ', 'g'))) AS norm FROM sents),
m2 AS (SELECT *, regexp_replace(no_urls, '{_ascii(X.STRONG_PHONE)}', chr(1), 'g') AS no_strong,
   regexp_matches(sentence, '{_ascii(CFG.vocabulary_pattern())}', 'i') AS vocab FROM m1),
ents AS (
  SELECT reply_id, sent_no, sentence, 'upstream_line' AS kind, sentence AS value, true AS known FROM m2 WHERE length(norm) >= 40 AND (contains('{_UP}', norm) OR contains(norm, '{_UP}'))
  UNION ALL SELECT reply_id, sent_no, sentence, 'url', u, regexp_replace(lower(split_part(regexp_replace(u, '^https?://', '', 'i'), '/', 1)), '^www\.', '') IN ({_DOMAINS})
    FROM (SELECT *, rtrim(unnest(regexp_extract_all(sentence, '{_ascii(X.URL)}', 0, 'i')), '.,;:!?)') AS u FROM m2)
  UNION ALL SELECT reply_id, sent_no, sentence, 'phone', v, regexp_replace(v, '\D', '', 'g') IN ({_NUMS})
    FROM (SELECT *, rtrim(unnest(regexp_extract_all(no_urls, '{_ascii(X.STRONG_PHONE)}')), '.,;:!?-( )') AS v FROM m2)
  UNION ALL SELECT reply_id, sent_no, sentence, 'phone', v, regexp_replace(v, '\D', '', 'g') IN ({_NUMS})
    FROM (SELECT *, unnest(regexp_extract_all(no_strong, '{_ascii(X.SHORT_CODE)}')) AS v FROM m2) WHERE vocab OR v IN ({_NUMS})
  UNION ALL SELECT reply_id, sent_no, sentence, 'org', trim(unnest(regexp_extract_all(sentence, '{_ascii(CFG.org_pattern())}'))), false FROM m2
  UNION ALL SELECT reply_id, sent_no, sentence, 'placeholder', v, false FROM (SELECT *, unnest(regexp_extract_all(sentence, '{_ascii(X.PLACEHOLDER)}')) AS v FROM m2)
    WHERE regexp_matches(v, '{_ascii(X.PLACEHOLDER_HINT)}', 'i'))
"""
_DOCS_SQL = "replies AS (SELECT doc_id AS reply_id, text, CASE WHEN doc_id % 7 = 0 THEN 'I want to die' ELSE 'fine' END AS user_message FROM documents)"
_CLEAN_SQL = rf"""
flag AS (SELECT s.reply_id, s.sent_no, s.sentence, EXISTS (SELECT 1 FROM ents e WHERE e.reply_id = s.reply_id AND e.sent_no = s.sent_no) AS bad FROM sents s),
fst AS (SELECT reply_id, min(sent_no) AS f, count(*) AS n FROM flag WHERE bad GROUP BY reply_id),
kept AS (SELECT g.reply_id, string_agg(CASE WHEN NOT bad THEN sentence ELSE '{_sql(CFG.canonical)}' END, ' ' ORDER BY sent_no) AS t
  FROM flag g LEFT JOIN fst USING (reply_id) WHERE NOT bad OR sent_no = f GROUP BY g.reply_id),
g AS (SELECT r.reply_id, coalesce(trim(regexp_replace(k.t, '\s{{2,}}', ' ', 'g')), '') AS clean, coalesce(f.n, 0) AS n_removed,
   regexp_matches(r.text, '{_ascii(X.CRISIS)}', 'i') OR regexp_matches(r.user_message, '{_ascii(X.CRISIS)}', 'i') AS crisis
  FROM replies r LEFT JOIN kept k USING (reply_id) LEFT JOIN fst f USING (reply_id))
"""


def _replies(spark, d):
    """Documents as replies; every seventh answers a message in crisis."""
    return A.documents(spark, d).select(
        F.col("doc_id").alias("reply_id"), "text",
        F.when(F.col("doc_id") % 7 == 0, "I want to die").otherwise("fine").alias("user_message"))


@query("X1 X2 X3 X4 X5 X6", f"WITH {_DOCS_SQL}, {_FOUND_SQL} SELECT reply_id, sent_no, kind, value, known FROM ents")
def guard_entities(spark, d):
    return X.sentence_entities(_replies(spark, d), CFG, ["reply_id"]).select("reply_id", "sent_no", "kind", "value", "known")


@query("X7", f"""
WITH replies AS (SELECT page_id AS reply_id, CASE page_id % 3 WHEN 0 THEN 'I hear you. {_sql(CFG.upstream[0])}' WHEN 1 THEN 'talk to the people who handle URGENT   calls where you live before' ELSE 'I hear you.' END AS text FROM pages), {_FOUND_SQL}
SELECT reply_id, sent_no, kind, value, known FROM ents""")
def upstream_lines(spark, d):
    k = F.col("page_id") % 3
    r = A.table(spark, d, "pages").select(F.col("page_id").alias("reply_id"), F.when(k == 0, F.lit("I hear you. " + CFG.upstream[0])).when(
        k == 1, F.lit("talk to the people who handle URGENT   calls where you live before")).otherwise(F.lit("I hear you.")).alias("text"))
    return X.sentence_entities(r, CFG, ["reply_id"]).select("reply_id", "sent_no", "kind", "value", "known")


@query("X8 X9 X10", f"WITH {_DOCS_SQL}, {_FOUND_SQL}, {_CLEAN_SQL} SELECT reply_id, md5(clean) AS clean_md5, n_removed, crisis, crisis OR n_removed > 0 AS needs_footer FROM g")
def guard_clean(spark, d):
    g = X.sanitise(_replies(spark, d), CFG, user_message="user_message")
    return g.select("reply_id", F.md5("clean").alias("clean_md5"), F.size("removed").cast("bigint").alias("n_removed"),
                    "crisis", "needs_footer")


@query("X11 X10", f"""
WITH {_DOCS_SQL}, {_FOUND_SQL}, {_CLEAN_SQL}
SELECT reply_id, md5(clean) AS stored_md5, md5(CASE WHEN NOT (crisis OR n_removed > 0) THEN clean WHEN clean = '' THEN '{_sql(CFG.footer())}' ELSE clean || chr(10) || chr(10) || '{_sql(CFG.footer())}' END) AS outward_md5 FROM g""")
def outward_replies(spark, d):
    g = X.outward(X.sanitise(_replies(spark, d), CFG, user_message="user_message"), CFG)
    return g.select("reply_id", F.md5("clean").alias("stored_md5"), F.md5("outward").alias("outward_md5"))


@query("S9", f"WITH {_DOCS_SQL}, {_FOUND_SQL}, {_CLEAN_SQL} SELECT reply_id, n_removed FROM g WHERE crisis OR n_removed > 0")
def guard_log(spark, d):
    g = X.log_rows(X.sanitise(_replies(spark, d), CFG, user_message="user_message"))
    return g.select("reply_id", F.size("removed").cast("bigint").alias("n_removed"))


@query("X17", f"WITH {_DOCS_SQL}, {_FOUND_SQL} SELECT kind, known, count(*) AS n_entities, count(DISTINCT reply_id) AS n_replies FROM ents GROUP BY kind, known")
def guard_rates(spark, d):
    return X.removal_rates(X.sanitise(_replies(spark, d), CFG))


@query("X12", f"""
SELECT doc_id AS reply_id, md5(CASE WHEN doc_id % 2 = 0 AND (regexp_matches(text, '{_ascii(X.URL)}', 'i') OR regexp_matches(text, '{_ascii(X.STRONG_PHONE)}')
  OR regexp_matches(text, '{_ascii(X.PLACEHOLDER)}') OR {' OR '.join(f"contains(text, '{n}')" for n in CFG.nouns)}) THEN '{_sql(CFG.canonical)}' ELSE text END) AS text_md5 FROM documents""")
def coarse_fallback(spark, d):
    """Detection taken as failed for every other reply."""
    r = _replies(spark, d)
    return r.select("reply_id", F.md5(X.coarse_fallback(F.col("text"), F.col("reply_id") % 2 == 0, CFG)).alias("text_md5"))


@query("S12", """
SELECT c_custkey AS entry, CASE WHEN c_custkey % 5 = 0 THEN 'no line' WHEN c_custkey % 3 = 0 THEN 'no source' WHEN c_custkey % 2 = 0 THEN 'no date' END AS reason
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def footer_contract(spark, d):
    """Resource entries built from customers, some without text, source or date."""
    k = F.col("c_custkey")
    r = A.table(spark, d, "customer").select(k.alias("entry"), F.lit("XX").alias("region"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("line"), F.when(k % 3 != 0, "https://example.org").alias("source_url"),
        F.when(k % 2 == 0, "July 2026").otherwise("2026-07-30").alias("checked_on"))
    return X.footer_violations(r, True).select("entry", "reason")


_SPLIT_WS = r"regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), '\x1e')"


@query("X13", rf"""
WITH r AS (SELECT doc_id AS reply_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
h AS (SELECT reply_id, t, regexp_matches(t, '{_ascii(X.SERVICE_NUMBER)}') AS hit FROM r)
SELECT reply_id, hit AS modified, md5(CASE WHEN hit THEN regexp_replace(regexp_replace(array_to_string(list_filter({_SPLIT_WS}, lambda s: NOT regexp_matches(s, '{_ascii(X.SERVICE_NUMBER)}')), ' '), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE t END) AS text_md5 FROM h""")
def number_sentences(spark, d):
    r = _replies(spark, d).select("reply_id", X.strip_number_sentences(F.col("text")).alias("s"))
    return r.select("reply_id", "s.modified", F.md5("s.text").alias("text_md5"))


@query("X9 X14 X16", f"""
WITH m AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' Are you a real person?' WHEN 1 THEN ' I see no reason to go on.' WHEN 2 THEN ' is this a bot' ELSE '' END AS t,
   CASE doc_id % 4 WHEN 0 THEN 'none' ELSE 'Question' END AS strategy, regexp_matches(text, '{_ascii(X.SERVICE_NUMBER)}') AS filtered FROM documents),
f AS (SELECT *, regexp_matches(t, '{_ascii(X.SERVICE_CRISIS)}', 'i') AS crisis, regexp_matches(t, '{_ascii(X.IDENTITY)}', 'i') AS identity FROM m)
SELECT doc_id AS reply_id, crisis, identity, CASE WHEN crisis THEN 'crisis_guard' WHEN strategy = 'none' THEN 'none' WHEN filtered THEN 'steered_filtered' WHEN identity THEN 'identity_guard' ELSE 'steered' END AS status FROM f""")
def reply_status(spark, d):
    k = F.col("doc_id") % 6
    m = A.documents(spark, d).select("doc_id", F.concat("text", F.when(k == 0, " Are you a real person?").when(
        k == 1, " I see no reason to go on.").when(k == 2, " is this a bot").otherwise("")).alias("t"),
        F.when(F.col("doc_id") % 4 == 0, "none").otherwise("Question").alias("strategy"),
        X.strip_number_sentences(F.col("text"))["modified"].alias("filtered"))
    f = m.select("doc_id", "strategy", "filtered", X.service_crisis(F.col("t")).alias("crisis"), X.identity_question(F.col("t")).alias("identity"))
    return f.select(F.col("doc_id").alias("reply_id"), "crisis", "identity", X.reply_status(
        F.col("crisis"), F.col("strategy"), F.col("filtered"), F.col("identity")).alias("status"))


@query("X15", rf"""
WITH r AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') || ' and then' AS t FROM documents),
h AS (SELECT doc_id, t, regexp_replace(regexp_extract(t, '(?s)^(.*[.!?…]["'')\]]?)(?:\s|$)', 1), '^\s+|\s+$', '', 'g') AS head FROM r)
SELECT doc_id AS reply_id, md5(CASE WHEN head <> '' AND len(list_filter(regexp_split_to_array(head, '\s+'), lambda w: w <> '')) >= 6 THEN head ELSE t END) AS text_md5 FROM h""")
def trimmed_replies(spark, d):
    """Documents with an unfinished ending, cut back to the last whole sentence."""
    r = A.documents(spark, d)
    from ..functions.text import strip
    return r.select(F.col("doc_id").alias("reply_id"), F.md5(X.trim_to_sentence(
        F.concat(strip(F.col("text")), F.lit(" and then")))).alias("text_md5"))


# ── streams ───────────────────────────────────────────────────────────────

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("R5 S9", f"WITH {_DOCS_SQL}, {_FOUND_SQL}, {_CLEAN_SQL} SELECT reply_id, md5(clean) AS clean_md5, n_removed, crisis FROM g")
def guard_stream(spark, d):
    """The guard as a stream over the documents file; equal to the batch form."""
    schema = A.documents(spark, d).schema
    # A pattern, since a stream takes one file only by a pattern; the table may also be a folder.
    src = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    replies = src.select(F.col("doc_id").alias("reply_id"), "text",
                         F.when(F.col("doc_id") % 7 == 0, "I want to die").otherwise("fine").alias("user_message"))
    out, log, ck = (_folder(spark, n) for n in ("guarded", "guard-log", "guard-offsets"))
    start_guard(replies, CFG, out, log, ck, user_message="user_message").awaitTermination()
    g = spark.read.parquet(out)
    return g.select("reply_id", F.md5("clean").alias("clean_md5"), F.size("removed").cast("bigint").alias("n_removed"), "crisis")


# In half of the sessions every twentieth number is passed over; in half some turns come two hours late; some turns come again.
_NUMBER = "turn_index - 1 + CASE WHEN CAST(session_id AS BIGINT) % 4 >= 2 THEN {div} ELSE 0 END"
_DELAYED = "(CAST(session_id AS BIGINT) % 2 = 1 AND (turn_index - 1) % 17 = 9)"
_AGAIN = "(turn_index - 1) % 11 = 2"
# Class -> predicate and class of the node (number 1) that a turn links its candidate to.
_LINKS = {"Situation": ("triggers", "AutomaticThought"), "AutomaticThought": ("associatedWith", "Problem"), "Goal": ("targetsProblem", "Problem")}
_LINKS_SQL = ", ".join(f"('{s}', '{p}', '{o}')" for s, (p, o) in _LINKS.items())


@query("R1 R2", f"""
WITH {G.EVENTS_SQL},
o AS (SELECT session_id, label, text, {_NUMBER.format(div="(turn_index - 1) // 20")} AS turn_index, {_DELAYED} AS delayed FROM ev2),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY delayed, turn_index) AS place,
    max(CASE WHEN NOT delayed THEN turn_index END) OVER (PARTITION BY session_id) AS upto FROM o),
h AS (SELECT session_id, label, text, min(place) AS head FROM p GROUP BY ALL),
nn AS (SELECT *, {G._PREFIX_CASE} || '_' || row_number() OVER (PARTITION BY session_id, label ORDER BY head) AS node_id FROM h),
t AS (SELECT p.session_id, p.turn_index, place, delayed AND turn_index < coalesce(upto, -1) AS late,
    CAST(sum(CASE WHEN head = place THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY place) - CASE WHEN head = place THEN 1 ELSE 0 END AS BIGINT) AS n_before,
    label, node_id FROM p JOIN nn USING (session_id, label, text)),
fst AS (SELECT session_id, label AS object_label, min_by(node_id, head) AS object_id, min(head) AS since FROM nn GROUP BY ALL)
SELECT session_id, turn_index, place, late, n_before, 'node' AS kind, label, node_id, CAST(NULL AS VARCHAR) AS object_id FROM t
UNION ALL
SELECT session_id, turn_index, place, late, n_before, 'edge', predicate, node_id, f.object_id
FROM t JOIN (VALUES {_LINKS_SQL}) l(label, predicate, object_label) USING (label) JOIN fst f USING (session_id, object_label) WHERE since < place""")
def turn_stream(spark, d):
    """Every event as a streamed turn with a candidate and a link: numbers from 0 with gaps, turns
    that come late and turns that come again."""
    ev = A.events(spark, d)
    link = lambda p, o: F.array(F.struct(F.lit(1).alias("subject"), F.lit(p).alias("predicate"), F.lit(o).alias("object_label"),
                                         F.lit(1).alias("object"), F.lit("omit").alias("reported_intensity")))
    links = F.lit(None).cast(f"array<{LINK}>")
    for label, (predicate, target) in _LINKS.items():
        links = F.when(F.col("label") == label, link(predicate, target)).otherwise(links)
    k = F.col("k").cast("int") % 10
    turns = ev.select(
        "session_id", F.expr(_NUMBER.format(div="(turn_index - 1) div 20")).alias("turn_index"), F.array(F.struct("label", "text")).alias("candidates"),
        links.alias("links"), F.lit(None).cast("string").alias("technique"),
        F.when(k == 3, "Technique").when(k == 7, "Consolidation").alias("model_phase"),
        F.expr(_DELAYED).alias("delayed"), F.expr(_AGAIN).alias("again"))
    out, ck, src = (_folder(spark, n) for n in ("turn-out", "turn-offsets", "turns"))
    on_time, late = turns.filter("not delayed"), turns.filter("delayed")
    waves = [(on_time.unionByName(on_time.filter("again")), 0, False), (on_time.filter("again"), 1, False),
             (late.unionByName(on_time.filter("again")), 2, True)]
    for wave, hour, closes in waves:
        at = F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp")
        rows = wave.drop("delayed", "again").withColumns({"arrived": at, "closes": F.lit(closes)})
        rows.write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        start_turns(stream, out, ck, first=0).awaitTermination()
    return spark.read.parquet(out).select("session_id", "turn_index", "place", "late", "n_before", "kind", "label", "node_id", "object_id")


@query("R4", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, 'utt_' || turn || CASE role WHEN 'user' THEN '' ELSE '_t' END AS node_id, md5(text || ' (said again)') AS text_md5
FROM conversations""")
def utterance_stream(spark, d):
    """All messages as a stream of utterances: first as they are, an hour later with more words; the last row counts."""
    said = A.positioned_turns(spark, d)
    out, ck, src = (_folder(spark, n) for n in ("utterances", "utterance-offsets", "messages"))
    for hour, text in enumerate((F.col("text"), F.concat("text", F.lit(" (said again)")))):
        rows = said.withColumns({"text": text, "arrived": F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp")})
        rows.write.mode("append").parquet(src)
        with with_row_state(spark):
            versions = versions_of(spark.readStream.schema(rows.schema).parquet(src))
            q = (versions.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                 .trigger(availableNow=True).start())
        q.awaitTermination()
    return latest(spark.read.parquet(out)).select("session_id", "node_id", F.md5("text").alias("text_md5"))


@query("R3", f"""
WITH {G.EVENTS_SQL},
due AS (SELECT session_id, max(turn_index) // {O.CONSOLIDATE_EVERY} * {O.CONSOLIDATE_EVERY} AS upto FROM ev2 GROUP BY session_id HAVING max(turn_index) >= {O.CONSOLIDATE_EVERY}),
seen AS (SELECT e.* FROM ev2 e JOIN due USING (session_id) WHERE turn_index <= upto),
h AS (SELECT session_id, label, text, min(turn_index) AS head, count(*) AS n_evidence FROM seen GROUP BY ALL)
SELECT session_id, {G._PREFIX_CASE} || '_' || row_number() OVER (PARTITION BY session_id, label ORDER BY head) AS node_id, label, text, n_evidence FROM h""")
def wide_pass(spark, d):
    """Every event as a streamed turn; sessions that cross a sixth turn are built anew from their
    transcript so far.  The last batch is handed in again at the end and must change nothing."""
    ev = A.events(spark, d)
    said = ev.select("session_id", "turn_index", F.lit("client").alias("speaker"), F.concat("label", F.lit(": "), "text").alias("text"))
    out, ck, src, kept, ledger = (_folder(spark, n) for n in ("wide-out", "wide-offsets", "wide-turns", "wide-store", "wide-ledger"))

    def build(turns):
        found = lambda t: C.line_candidates(t).withColumn("seq", F.col("line_no"))
        return whole_build(turns, found).graph

    work = WidePass(lambda: said, build, SessionStore(spark, kept, buckets=16), ledger)

    rows = ev.select("session_id", "turn_index", F.array(F.struct("label", "text")).alias("candidates"),
                     F.lit(None).cast("string").alias("technique"), F.lit(None).cast("string").alias("model_phase"))
    for part in (rows.filter("turn_index <= 9"), rows.filter("turn_index > 9")):
        part.write.mode("append").parquet(src)
        start_turns(spark.readStream.schema(rows.schema).parquet(src), out, ck, wide_pass=work).awaitTermination()
    before = work.store._pointer()[0]
    work(spark.createDataFrame([], "session_id string, turn_index bigint"), 0)
    if work.store._pointer()[0] != before:
        raise AssertionError("a batch that is done was done again")
    g = work.graph()
    n = g.node_evidence.groupBy("session_id", F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    content = g.nodes.filter(F.col("label").isin(*O.CONTENT_LABELS))
    return content.join(n, ["session_id", "node_id"]).select(
        "session_id", "node_id", "label", P.main_text(F.col("label"), F.col("props")).alias("text"), "n_evidence")
