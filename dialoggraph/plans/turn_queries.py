"""Registered queries over turns, windows and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import turns as T
from . import adapters as A
from . import graphs as G
from .registry import query

CHUNK_BUDGET, CHUNK_OVERLAP = 1500, 1


@query("T9", f"WITH {G.TURNS_SQL} SELECT speaker, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
             "round(avg(length(text)), 4) AS mean_chars FROM turns GROUP BY speaker")
def turns_profile(spark, d):
    return T.corpus_profile(A.client_turns(spark, d))


@query("T1", """
WITH m AS (SELECT CASE role WHEN 'user' THEN CASE turn % 3 WHEN 0 THEN ' Patient ' WHEN 1 THEN 'CLIENT' ELSE 'client' END
  WHEN 'assistant' THEN 'Therapist ' ELSE 'Observer' END AS s FROM conversations)
SELECT CASE lower(trim(s)) WHEN 'patient' THEN 'client' WHEN 'client' THEN 'client' WHEN 'therapist' THEN 'therapist'
  ELSE s END AS speaker, count(*) AS n FROM m GROUP BY 1""")
def speaker_names(spark, d):
    spelled = (F.when((F.col("role") == "user") & (F.col("pos") % 3 == 0), " Patient ")
               .when((F.col("role") == "user") & (F.col("pos") % 3 == 1), "CLIENT")
               .when(F.col("role") == "user", "client")
               .when(F.col("role") == "assistant", "Therapist ").otherwise("Observer"))
    return A.messages(spark, d).groupBy(T.normal_speaker(spelled).alias("speaker")).agg(
        F.count(F.lit(1)).alias("n"))


@query("T7", "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) "
             "OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS client_turn FROM conversations")
def client_turn_number(spark, d):
    return T.client_turn_numbers(A.messages(spark, d)).select("session_id", "pos", "client_turn")


@query("T2 T3", f"""
WITH {G.CANDS_SQL},
turnsp AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, role, text FROM conversations),
ev AS (SELECT DISTINCT session_id, label, turn_index FROM cands),
want AS (SELECT DISTINCT e.session_id, e.label, t.turn_index, CASE t.role WHEN 'assistant' THEN 'T' ELSE 'C' END AS tag, t.text
  FROM ev e JOIN turnsp t ON t.session_id = e.session_id AND t.turn_index BETWEEN e.turn_index - 1 AND e.turn_index + 1),
txt AS (SELECT session_id, label, string_agg('turn ' || turn_index || ' | ' || tag || ': ' || text, chr(10) ORDER BY turn_index) AS context
  FROM want GROUP BY session_id, label)
SELECT session_id, label AS owner_id, CAST(0 AS BIGINT) AS piece, md5(context) AS context_md5, length(context) AS n_chars FROM txt""")
def evidence_window(spark, d):
    ev = G.dialogue_candidates(spark, d).select(
        "session_id", F.col("label").alias("owner_id"), F.col("turn_index").cast("bigint").alias("turn_index")).distinct()
    turns = A.positioned_turns(spark, d)
    texts = T.render_windows(T.evidence_window(ev, turns, 1), ev.select("session_id", "owner_id").distinct())
    return texts.select("session_id", "owner_id", "piece", F.md5("context").alias("context_md5"),
                        F.length("context").cast("bigint").alias("n_chars"))


@query("T4", f"""
WITH {G.TURNS_SQL},
pairs AS (SELECT session_id, turn_index, max(CASE WHEN speaker = 'client' THEN text END) AS c,
    coalesce(max(CASE WHEN speaker = 'therapist' THEN text END), '') AS r FROM turns GROUP BY ALL),
done AS (SELECT * FROM pairs WHERE r <> '' AND c IS NOT NULL),
j AS (SELECT p.session_id, p.turn_index, q.turn_index AS prior_turn, q.c, q.r,
    row_number() OVER (PARTITION BY p.session_id, p.turn_index ORDER BY q.turn_index DESC) AS rn
  FROM pairs p JOIN done q ON p.session_id = q.session_id AND q.turn_index < p.turn_index WHERE p.c IS NOT NULL)
SELECT session_id, turn_index, prior_turn, md5(c) AS client_md5, md5(r) AS reply_md5 FROM j WHERE rn <= 2""")
def recent_exchanges(spark, d):
    r = T.recent_exchanges(T.exchanges(A.client_turns(spark, d)), 2)
    return r.select("session_id", "turn_index", "prior_turn", F.md5("prior_client").alias("client_md5"),
                    F.md5("prior_reply").alias("reply_md5"))


@query("T6", f"WITH {G.TURNS_SQL} SELECT session_id, node_id, turn_index, speaker, text FROM utts")
def utterance_nodes(spark, d):
    return T.utterances(A.client_turns(spark, d)).select("session_id", "node_id", "turn_index", "speaker", "text")


@query("T8", f"""
WITH {G.TURNS_SQL}
SELECT session_id, turn_index * 2 + CASE speaker WHEN 'client' THEN 0 ELSE 1 END AS msg_ord,
  CASE speaker WHEN 'client' THEN 'user' ELSE 'assistant' END AS role, text AS content FROM turns
WHERE speaker = 'client' OR text <> ''
UNION ALL SELECT DISTINCT session_id, CAST(-1 AS BIGINT), 'system', 'listen first' FROM turns""")
def chat_messages(spark, d):
    return T.chat_messages(A.client_turns(spark, d), "listen first")


@query("T10", f"""
WITH {G.TURNS_SQL},
r AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS dr FROM utts WHERE text <> '')
SELECT session_id, turn_index, speaker, CASE speaker WHEN 'client' THEN 0 ELSE 1 END AS speaker_ord,
  CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END AS text FROM r WHERE dr <= 3""")
def transcript_view(spark, d):
    return T.transcript_view(T.utterances(A.client_turns(spark, d)), 3, 120)


@query("T5", f"""
WITH RECURSIVE {G.sentences_sql("conversations", "conv_id, turn, role")},
t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sent_no) - 1 AS i,
    length('turn ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, sent_no) - 1) || ' | C: ' || sentence) AS len FROM sents),
pre AS (SELECT session_id, i, sum(len) OVER (PARTITION BY session_id ORDER BY i) AS s FROM t),
r AS (
  SELECT session_id, '' AS path, CAST(0 AS BIGINT) AS lo, max(i) + 1 AS hi, CAST(sum(len) + max(i) AS BIGINT) AS chars FROM t GROUP BY session_id
  UNION ALL
  SELECT h.session_id, h.path, h.lo, h.hi, CAST(b.s - coalesce(a.s, 0) + h.hi - h.lo - 1 AS BIGINT)
  FROM (SELECT session_id, path || side AS path,
          CASE side WHEN '0' THEN lo ELSE lo + greatest(0, (hi - lo) // 2 - {CHUNK_OVERLAP}) END AS lo,
          CASE side WHEN '0' THEN least(lo + (hi - lo) // 2 + {CHUNK_OVERLAP}, hi) ELSE hi END AS hi
        FROM r, (VALUES ('0'), ('1')) v(side)
        WHERE chars > {CHUNK_BUDGET} AND hi - lo > {2 * CHUNK_OVERLAP + 1}) h
  JOIN pre b ON b.session_id = h.session_id AND b.i = h.hi - 1
  LEFT JOIN pre a ON a.session_id = h.session_id AND a.i = h.lo - 1)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS chunk, lo, hi, chars FROM r
WHERE NOT (chars > {CHUNK_BUDGET} AND hi - lo > {2 * CHUNK_OVERLAP + 1})""")
def chunk_ranges(spark, d):
    """Sentences of a conversation as its turns, so that conversations are long enough to split."""
    s = A.messages(spark, d).select("session_id", "pos", F.posexplode(sentences(F.col("text"))).alias("sent_no", "text"))
    from ..operators.ordered import numbered
    t = numbered(s.withColumn("_p", F.col("pos") * 100000 + F.col("sent_no")), ["session_id"], ["_p"], "_i", "_p",
                 (100000 * 65536,)).select(
        "session_id", (F.col("_i") - 1).alias("turn_index"), F.lit("client").alias("speaker"), "text")
    return T.chunk_ranges(t, CHUNK_BUDGET, CHUNK_OVERLAP)


@query("T11", f"""
WITH {G.CANDS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY turn_index, speaker, sent_no) AS k FROM cands)
SELECT session_id, label, turn_index, speaker, sent_no, (k - 1) // 6 AS batch, CAST((k - 1) % 6 + 1 AS INTEGER) AS item FROM n""")
def item_batches(spark, d):
    c = G.dialogue_candidates(spark, d)
    return T.batches(c, ["session_id", "label"], ["turn_index", "speaker", "sent_no"], "turn_index", 6).select(
        "session_id", "label", "turn_index", "speaker", "sent_no", "batch", "item")


@query("T12", "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, md5(text) AS text_md5 FROM conversations WHERE turn < 3")
def first_turns(spark, d):
    return T.first_turns(A.positioned_turns(spark, d), 3).select("session_id", "turn_index", F.md5("text").alias("text_md5"))
