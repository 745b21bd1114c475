"""Registered queries for the five graph questions, editing and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..operators import query as Q
from ..operators import versions as V
from ..operators.graph import Graph, edge_id, empty_map
from ..session import cut, ensure_checkpoint_dir
from ..sources import readers as RD
from ..sources import writers as W
from ..sources.store import SessionStore
from . import adapters as A
from . import graphs as G
from .registry import query


# ── the five intents ──────────────────────────────────────────────────────

@query("Q1 Q3", f"WITH {G.STAR_SQL} SELECT 'star' AS session_id, l.label, (SELECT count(*) FROM nodes n WHERE n.label = l.label) AS n "
                "FROM (VALUES ('Situation'), ('CoreBelief'), ('Goal')) l(label)")
def count_labels(spark, d):
    """Requested labels are counted even when absent; filters and unknown labels are ignored."""
    spec = Q.QuerySpec.of({"intent": "count", "node_labels": ["Situation", "CoreBelief", "Goal", "Spaceship"],
                           "property_filters": {"kind": "P"}})
    return Q.execute(spec, G.star_graph(spark, d)).counts


@query("Q2 Q4 Q10", f"WITH {G.STAR_SQL} SELECT node_id, label, text, ord FROM nodes WHERE label = 'Situation' AND prop = 'P'")
def list_filtered(spark, d):
    spec = Q.QuerySpec.of({"intent": "list", "node_labels": ["Situation"], "property_filters": {"Situation.kind": "p"}})
    return Q.execute(spec, G.star_graph(spark, d)).nodes.select("node_id", "label", "text", "ord")


@query("Q4 Q8 Q9", f"""
WITH {G.DIALOGUE_NODES_SQL}
SELECT n.session_id, n.node_id, n.label, n.text, u.turn_index, u.speaker, u.text AS quote
FROM nodes n JOIN utts u ON u.session_id = n.session_id AND u.turn_index = n.turn_index WHERE u.text <> ''""")
def list_quotes(spark, d):
    """Every node of every session with the words said on its turns."""
    r = Q.execute(Q.QuerySpec.of({"intent": "list"}), G.dialogue_nodes(spark, d))
    q = r.node_quotes.select("session_id", "node_id", "turn_index", "speaker", F.col("text").alias("quote"))
    return r.nodes.select("session_id", "node_id", "label", "text").join(q, ["session_id", "node_id"]).select(
        "session_id", "node_id", "label", "text", F.col("turn_index").cast("bigint").alias("turn_index"), "speaker", "quote")


@query("Q4 Q8", f"WITH {G.TURNS_SQL} SELECT session_id, node_id, text FROM utts")
def list_utterances(spark, d):
    """Utterances, which are only listed when asked for by name."""
    r = Q.execute(Q.QuerySpec.of({"intent": "list", "node_labels": ["Utterance"]}), G.dialogue_nodes(spark, d))
    return r.nodes.select("session_id", "node_id", "text")


@query("Q5", f"""
WITH {G.EVENTS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM nodes WHERE label = 'Situation' AND prop = 'image'),
p AS (SELECT * FROM f WHERE rn <= 5)
SELECT session_id, 'node' AS kind, node_id AS id FROM p
UNION ALL SELECT e.session_id, 'edge', e.edge_id FROM edges e WHERE EXISTS (SELECT 1 FROM p WHERE p.session_id = e.session_id AND p.node_id IN (e.subject_id, e.object_id))""")
def describe_first5(spark, d):
    spec = Q.QuerySpec.of({"intent": "describe", "node_labels": ["Situation"], "property_filters": {"kind": "image"}})
    r = Q.execute(spec, G.event_graph(spark, d))
    return r.nodes.select("session_id", F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(
        r.edges.select("session_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


_TRACE_SQL = """
start_ AS (SELECT node_id FROM nodes WHERE label = 'Situation' AND prop = 'P'),
r AS (SELECT node_id, 0 AS level FROM start_ UNION SELECT e.object_id, r.level + 1 FROM r JOIN edges e ON e.subject_id = r.node_id WHERE r.level < 4),
lv AS (SELECT node_id, min(level) AS level FROM r GROUP BY node_id)
"""


@query("Q6", f"WITH RECURSIVE {G.STAR_SQL}, {_TRACE_SQL} SELECT node_id, level FROM lv")
def trace_nodes(spark, d):
    """Nodes reached from the pending orders, one session holding the whole graph."""
    g = G.star_graph(spark, d)
    spec = Q.QuerySpec.of({"intent": "trace", "node_labels": ["Situation"], "property_filters": {"kind": "P"}})
    nodes, _ = Q.trace(spec, g.nodes, g.edges)
    return nodes.select("node_id", "level")


@query("Q6", f"""
WITH RECURSIVE {G.STAR_SQL}, {_TRACE_SQL}
SELECT e.edge_id, e.predicate FROM edges e JOIN lv ON lv.node_id = e.subject_id WHERE lv.level <= 3""")
def trace_edges(spark, d):
    g = G.star_graph(spark, d)
    spec = Q.QuerySpec.of({"intent": "trace", "node_labels": ["Situation"], "property_filters": {"kind": "P"}})
    return Q.execute(spec, g).edges.select("edge_id", "predicate")


@query("Q6", f"""
WITH RECURSIVE {G.EVENTS_SQL}, es AS (SELECT * FROM edges WHERE predicate IN ('triggers', 'manifestsAs')),
r AS (SELECT session_id, node_id, 0 AS level FROM nodes WHERE label = 'Problem' UNION
  SELECT r.session_id, e.object_id, r.level + 1 FROM r JOIN es e ON e.session_id = r.session_id AND e.subject_id = r.node_id WHERE r.level < 4)
SELECT session_id, node_id, min(level) AS level FROM r GROUP BY ALL""")
def trace_predicates(spark, d):
    """Trace along two predicates only, in every session at once."""
    g = G.event_graph(spark, d)
    spec = Q.QuerySpec.of({"intent": "trace", "node_labels": ["Problem"], "predicates": ["triggers", "manifestsAs", "flies"]})
    nodes, _ = Q.trace(spec, g.nodes, g.edges)
    return nodes.select("session_id", "node_id", "level")


@query("Q7", f"WITH {G.STAR_SQL} SELECT 'star' AS session_id, label, count(*) AS n FROM nodes GROUP BY label")
def summarize_counts(spark, d):
    return Q.execute(Q.QuerySpec.of({}), G.star_graph(spark, d)).counts


@query("Q7", f"""
WITH {G.EVENTS_SQL}, c AS (SELECT e.*, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM edges e WHERE predicate IN ('triggers', 'leadsTo', 'stemsFrom'))
SELECT c.session_id, c.ord, c.predicate, s.text AS subject_text, o.text AS object_text FROM c
JOIN nodes s ON s.session_id = c.session_id AND s.node_id = c.subject_id JOIN nodes o ON o.session_id = c.session_id AND o.node_id = c.object_id WHERE rn <= 8""")
def summarize_chain(spark, d):
    g = G.event_graph(spark, d)
    return Q.chain_sample(g.nodes, g.edges).select("session_id", "ord", "predicate", "subject_text", "object_text")


@query("Q7 T10", f"""
WITH {G.TURNS_SQL}
SELECT session_id, turn_index, speaker, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '…' ELSE text END AS text FROM utts WHERE text <> ''""")
def summarize_transcript(spark, d):
    r = Q.execute(Q.QuerySpec.of({"intent": "summarize"}), G.dialogue_nodes(spark, d))
    return r.transcript.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"), "speaker", "text")


@query("Q11", f"""
WITH {G.EVENTS_SQL},
c AS (SELECT session_id, string_agg('  - ' || label || ': ' || n, chr(10) ORDER BY label) AS t FROM (SELECT session_id, label, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY session_id),
e AS (SELECT e.*, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM edges e WHERE predicate IN ('triggers', 'leadsTo', 'stemsFrom')),
ch AS (SELECT e.session_id, string_agg('  ' || s.label || '(''' || substring(s.text, 1, 30) || ''') --[' || e.predicate || ']--> ' || o.label || '(''' || substring(o.text, 1, 30) || ''')', chr(10) ORDER BY e.ord) AS t
  FROM e JOIN nodes s ON s.session_id = e.session_id AND s.node_id = e.subject_id JOIN nodes o ON o.session_id = e.session_id AND o.node_id = e.object_id WHERE rn <= 8 GROUP BY e.session_id)
SELECT c.session_id, 'Graph summary:' || chr(10) || c.t || coalesce(chr(10) || 'Sample cognitive chain edges:' || chr(10) || ch.t, '') AS answer FROM c LEFT JOIN ch USING (session_id)""")
def rendered_summary(spark, d):
    g = G.event_graph(spark, d)
    return Q.render(Q.execute(Q.QuerySpec.of({}), g), g.nodes.select("session_id").distinct())


@query("Q11", f"""
WITH {G.DIALOGUE_NODES_SQL}, s AS (SELECT DISTINCT session_id FROM turns),
n8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS rn FROM nodes WHERE label = 'AutomaticThought') WHERE rn <= 8),
q AS (SELECT n.session_id, n.node_id, string_agg('    turn ' || u.turn_index || ' ' || u.speaker || ': "' || substring(u.text, 1, 120) || '"', chr(10) ORDER BY u.speaker) AS t
  FROM n8 n JOIN utts u ON u.session_id = n.session_id AND u.turn_index = n.turn_index WHERE u.text <> '' GROUP BY ALL),
l AS (SELECT n.session_id, string_agg('- ' || n.label || ' (' || n.node_id || '): ' || n.text || coalesce(chr(10) || q.t, ''), chr(10) ORDER BY n.ord) AS t
  FROM n8 n LEFT JOIN q ON q.session_id = n.session_id AND q.node_id = n.node_id GROUP BY n.session_id)
SELECT s.session_id, coalesce(l.t, 'This isn''t in the session''s graph.') AS answer FROM s LEFT JOIN l USING (session_id)""")
def rendered_list(spark, d):
    g = G.dialogue_nodes(spark, d)
    spec = Q.QuerySpec.of({"intent": "list", "node_labels": ["AutomaticThought"]})
    return Q.render(Q.execute(spec, g), g.nodes.select("session_id").distinct())


@query("Q11 Q3", f"""
WITH {G.EVENTS_SQL} SELECT session_id, 'Counts: ' || string_agg(label || '=' || n, ', ' ORDER BY label) AS answer
FROM (SELECT session_id, label, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY session_id""")
def rendered_counts(spark, d):
    g = G.event_graph(spark, d)
    return Q.render(Q.execute(Q.QuerySpec.of({"intent": "count"}), g), g.nodes.select("session_id").distinct())


@query("Q12", f"""
WITH {G.EVENTS_SQL}, s AS (SELECT DISTINCT session_id FROM ev)
SELECT s.session_id, (SELECT count(*) FROM nodes n WHERE n.session_id = s.session_id AND label = 'Problem' AND prop = 'work') AS n_nodes FROM s""")
def result_size(spark, d):
    g = G.event_graph(spark, d)
    spec = Q.QuerySpec.of({"intent": "list", "node_labels": ["Problem"], "property_filters": {"domain": "WORK"}})
    return Q.result_sizes(Q.execute(spec, g), g.nodes.select("session_id").distinct())


# ── editing and versions ──────────────────────────────────────────────────

@query("V1", f"""
WITH {G.STAR_SQL}
SELECT node_id, CASE WHEN label = 'Intervention' AND (ord % 3) = 0 THEN 'Homework' ELSE label END AS label,
  CASE WHEN label = 'Intervention' AND (ord % 3) = 0 THEN 'missing' ELSE 'found' END AS status,
  CASE WHEN label = 'Intervention' AND (ord % 3) <> 1 THEN 'rewritten' ELSE text END AS text FROM nodes""")
def updated_nodes(spark, d):
    """Supplier nodes edited: text for two thirds, then class and status for one third."""
    n = G.star_graph(spark, d).nodes
    s = n.filter("label = 'Intervention'")
    none = F.lit(None)
    first = s.filter(F.col("ord") % 3 != 1).select("session_id", "node_id", F.lit(1).alias("op_no"),
        F.create_map(F.lit("text"), F.lit("rewritten")).alias("props"), none.cast("string").alias("label"), F.lit("").alias("status"))
    second = s.filter(F.col("ord") % 3 == 0).select("session_id", "node_id", F.lit(2).alias("op_no"),
        none.cast("map<string,string>").alias("props"), F.lit("Homework").alias("label"), F.lit("missing").alias("status"))
    done, _ = V.update_nodes(n, first.unionByName(second))
    return done.select("node_id", "label", "status", P.main_text(F.col("label"), F.col("props")).alias("text"))


@query("V2", f"""
WITH {G.STAR_SQL}, gone AS (SELECT 'at_' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT 'node' AS kind, label AS what, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT id FROM gone) GROUP BY ALL
UNION ALL SELECT 'edge', predicate, count(*) FROM edges WHERE subject_id NOT IN (SELECT id FROM gone) AND object_id NOT IN (SELECT id FROM gone) GROUP BY ALL""")
def delete_cascade(spark, d):
    """Customers in debt are deleted; their orders' edges go with them."""
    g = G.star_graph(spark, d)
    gone = A.table(spark, d, "customer").filter("c_acctbal < 0").select(
        F.lit("star").alias("session_id"), F.concat(F.lit("at_"), F.col("c_custkey").cast("string")).alias("node_id"))
    n, e = V.delete_nodes(g.nodes, g.edges, gone)
    return n.groupBy(F.lit("node").alias("kind"), F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        e.groupBy(F.lit("edge").alias("kind"), F.col("predicate").alias("what")).agg(F.count(F.lit(1)).alias("n")))


@query("V3", f"WITH {G.STAR_SQL} SELECT predicate, count(*) AS n, count(DISTINCT object_id) AS n_objects FROM edges WHERE ord % 10 <> 0 GROUP BY predicate")
def deleted_edges(spark, d):
    """Every tenth edge removed by id, and the ids taken apart again."""
    e = G.star_graph(spark, d).edges
    left = V.delete_edges(e, e.filter(F.col("ord") % 10 == 0))
    return left.select(V.split_edge_id(F.col("edge_id")).alias("p")).groupBy("p.predicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("p.object_id").alias("n_objects"))


@query("V4", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, count(*) AS n, count(*) FILTER (label = 'Goal') AS n_goals FROM nodes
WHERE CAST(session_id AS BIGINT) % 2 = 0 OR label <> 'Goal' GROUP BY session_id""")
def replaced_graphs(spark, d):
    """Sessions with an odd number get a corrected graph without goals."""
    n = G.event_graph(spark, d).nodes
    odd = n.filter((F.col("session_id").cast("bigint") % 2 == 1) & (F.col("label") != "Goal"))
    return V.replace_graph(n, odd).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "Goal").alias("n_goals"))


@query("V4", """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, md5(text) AS text_md5, conv_id FROM conversations)
SELECT session_id, turn_index, text_md5, CASE WHEN conv_id % 3 = 0 THEN 'second' END AS note FROM t WHERE conv_id % 3 <> 0 OR turn_index > 0
UNION ALL SELECT DISTINCT session_id || '/new', CAST(0 AS BIGINT), md5('opened'), 'second' FROM t WHERE conv_id % 5 = 0""")
def replaced_store(spark, d):
    """All turns stored; every third session replaced by one without its first turn, and new sessions
    opened, by rows with a further column; a write that fails in between changes nothing."""
    turns = A.positioned_turns(spark, d).select("session_id", "turn_index", F.md5("text").alias("text_md5"))
    store = SessionStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", buckets=16)
    store.replace(turns)
    number = F.col("session_id").cast("bigint")
    broken = turns.withColumn("text_md5", F.when(F.col("turn_index") >= 0, F.raise_error(F.lit("the writer is lost"))))
    try:
        store.replace(broken.select("session_id", "turn_index", F.col("text_md5").cast("string").alias("text_md5")))
    except Exception as e:  # noqa: BLE001 - whatever the writer died of, the store must not show it
        if "the writer is lost" not in str(e):
            raise
    third = turns.filter((number % 3 == 0) & (F.col("turn_index") > 0))
    opened = turns.filter(number % 5 == 0).select(
        F.concat("session_id", F.lit("/new")).alias("session_id"), F.lit(0).cast("bigint").alias("turn_index"),
        F.md5(F.lit("opened")).alias("text_md5")).distinct()
    store.replace(third.unionByName(opened).withColumn("note", F.lit("second")))
    return store.read().select("session_id", "turn_index", "text_md5", "note")


@query("V5", f"""
WITH {G.EVENTS_SQL},
old AS (SELECT session_id, node_id, CASE WHEN last_turn % 3 = 0 THEN 'missing' ELSE 'found' END AS status, ord FROM nodes),
inc AS (SELECT session_id, node_id, 1 AS fresh FROM old WHERE status = 'found' AND ord % 2 = 0),
fresh AS (SELECT DISTINCT session_id, 'sit_new' AS node_id FROM old),
m AS (SELECT session_id, node_id, 'found' AS status FROM inc UNION ALL SELECT *, 'found' FROM fresh
  UNION ALL SELECT session_id, node_id, status FROM old o WHERE status = 'missing' AND NOT EXISTS (SELECT 1 FROM inc i WHERE i.session_id = o.session_id AND i.node_id = o.node_id)),
o2 AS (SELECT session_id, max(ord) AS tail FROM old GROUP BY session_id)
SELECT m.session_id, m.node_id, m.status, coalesce(o.ord, o2.tail + 1 + 7) AS ord FROM m LEFT JOIN old o ON o.session_id = m.session_id AND o.node_id = m.node_id JOIN o2 ON o2.session_id = m.session_id""")
def overlay_nodes(spark, d):
    """Half of the found nodes resubmitted with one new node, over a graph with placeholders."""
    g = G.event_graph(spark, d)
    # placeholder status by last turn, so old and corrected graph differ
    old = g.nodes.withColumn("status", F.when(F.col("turn_acquired") % 3 == 0, "missing").otherwise("found"))
    inc = old.filter((F.col("status") == "found") & (F.col("ord") % 2 == 0))
    fresh = old.select("session_id").distinct().select(
        "session_id", F.lit("sit_new").alias("node_id"), F.lit("Situation").alias("label"), empty_map().alias("props"),
        F.lit("found").alias("status"), F.lit(None).cast("int").alias("turn_acquired"), F.lit(7).cast("bigint").alias("ord"))
    n, _ = V.overlay(old, g.edges, inc.unionByName(fresh), g.edges)
    return n.select("session_id", "node_id", "status", "ord")


@query("V5", f"""
WITH {G.EVENTS_SQL},
olde AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 'missing' ELSE 'found' END AS status FROM edges),
live AS (SELECT session_id, node_id FROM nodes WHERE label <> 'Goal')
SELECT session_id, edge_id, status FROM olde e WHERE (status = 'found' AND ord % 3 = 0)
 OR (status = 'missing' AND EXISTS (SELECT 1 FROM live l WHERE l.session_id = e.session_id AND l.node_id = e.subject_id)
   AND EXISTS (SELECT 1 FROM live l WHERE l.session_id = e.session_id AND l.node_id = e.object_id))""")
def overlay_edges(spark, d):
    """Placeholder edges survive a correction without goals unless an end is gone."""
    g = G.event_graph(spark, d)
    old_edges = g.edges.withColumn("status", F.when(F.col("ord") % 2 == 0, "missing").otherwise("found"))
    _, e = V.overlay(g.nodes, old_edges, g.nodes.filter("label <> 'Goal'"),
                     old_edges.filter((F.col("status") == "found") & (F.col("ord") % 3 == 0)))
    return e.select("session_id", "edge_id", "status")


@query("V6", f"""
WITH {G.EVENTS_SQL},
cust AS (SELECT 'at_' || c_custkey AS id, c_custkey AS k, c_name FROM customer),
o AS (SELECT 'sit_' || o_orderkey AS id, 'at_' || o_custkey AS cid, o_orderkey AS k, o_custkey AS ck FROM orders),
n AS (SELECT id, CASE WHEN k % 5 = 1 THEN 'again' WHEN k % 3 = 0 THEN 'edited' ELSE c_name END AS text FROM cust WHERE NOT (k % 5 = 2))
SELECT 'node' AS kind, id, text AS detail FROM n
UNION ALL SELECT 'edge', o.id || '__triggers__' || o.cid, CASE WHEN o.ck % 5 = 1 THEN 'new' ELSE 'old' END FROM o
WHERE CASE WHEN o.ck % 5 = 2 THEN false WHEN o.ck % 5 = 1 THEN o.k % 2 = 0 ELSE o.k % 7 <> 0 END""")
def op_replay(spark, d):
    """Customers and their orders under a log of edits.

    Op 1 edits every third customer, op 2 deletes two fifths of them, op 3 brings half of
    those back, op 4 restores their even orders' edges, op 5 deletes every seventh edge of
    the untouched customers.
    """
    g = G.star_graph(spark, d)
    nodes = g.nodes.filter("label = 'AutomaticThought'")
    edges = g.edges.filter("predicate = 'triggers'")
    k = F.col("ord") - F.lit(2 << 40)
    none = lambda t="string": F.lit(None).cast(t)
    node_op = lambda df, no, op, text=None: df.select(
        "session_id", F.lit(no).cast("bigint").alias("op_no"), F.lit(op).alias("op"), "node_id",
        (F.lit("AutomaticThought") if op == "add_node" else none()).alias("label"),
        (none("map<string,string>") if text is None else F.create_map(F.lit("content"), F.lit(text))).alias("props"),
        none().alias("subject_id"), none().alias("predicate"), none().alias("object_id"))
    edge_op = lambda df, no, op, props: df.select(
        "session_id", F.lit(no).cast("bigint").alias("op_no"), F.lit(op).alias("op"), none().alias("node_id"),
        none().alias("label"), props.alias("props"), "subject_id", "predicate", "object_id")
    ck = F.substr("object_id", F.lit(4)).cast("bigint")
    ok = F.col("ord") - F.lit(4 << 40)
    ops = (node_op(nodes.filter(k % 3 == 0), 1, "update_node", "edited")
           .unionByName(node_op(nodes.filter((k % 5).isin(1, 2)), 2, "delete_node"))
           .unionByName(node_op(nodes.filter(k % 5 == 1), 3, "add_node", "again"))
           .unionByName(edge_op(edges.filter((ck % 5 == 1) & (ok % 2 == 0)), 4, "add_edge", F.create_map(F.lit("v"), F.lit("new"))))
           .unionByName(edge_op(edges.filter(~(ck % 5).isin(1, 2) & (ok % 7 == 0)), 5, "delete_edge", none("map<string,string>"))))
    n, e = V.replay_ops(nodes, edges, ops)
    return n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"),
                    P.main_text(F.col("label"), F.col("props")).alias("detail")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"),
                 F.coalesce(P.get_prop(F.col("props"), "v"), F.lit("old")).alias("detail")))


@query("V7", f"""
WITH {G.EVENTS_SQL}, c AS (SELECT session_id, turn_index FROM (SELECT session_id, turn_index, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS rn FROM ev) WHERE rn <= 40),
p AS (SELECT session_id, min(turn_index) AS b FROM c GROUP BY session_id)
SELECT p.session_id, p.b AS before_turn, count(e.turn_index) AS n_rows FROM p LEFT JOIN ev e ON e.session_id = p.session_id AND e.turn_index < p.b GROUP BY ALL HAVING count(e.turn_index) > 0""")
def oldest_checkpoint(spark, d):
    """State before the oldest of the forty checkpoints of a session."""
    ev = A.events(spark, d)
    points = V.checkpoints(ev).groupBy("session_id").agg(F.min("turn_index").alias("before_turn"))
    return V.as_of(ev.select("session_id", "turn_index"), points).groupBy("session_id", "before_turn").agg(
        F.count(F.lit(1)).alias("n_rows"))


def _edits(turns):
    """Second client turn rewritten everywhere, then once more in the rewritten branch."""
    second = turns.filter("turn_index = 2 and speaker = 'client'").select("session_id", "turn_index")
    third = turns.filter("turn_index = 3 and speaker = 'client'").select("session_id", "turn_index")
    first = second.select("session_id", F.lit("main").alias("branch_id"), F.lit("b1").alias("new_branch_id"), "turn_index",
                          F.lit("  Actually   that went well.  ").alias("message"))
    bad = second.select("session_id", F.lit("main").alias("branch_id"), F.lit("bx").alias("new_branch_id"),
                        F.lit(99).cast("bigint").alias("turn_index"), F.lit("too late").alias("message"))
    late = third.select("session_id", F.lit("main").alias("branch_id"), F.lit("b3").alias("new_branch_id"), "turn_index",
                        F.lit("").alias("message"))
    return first.unionByName(bad).unionByName(late)


@query("V8 V9", f"""
WITH {G.TURNS_SQL}, c2 AS (SELECT session_id FROM utts WHERE turn_index = 2 AND speaker = 'client'), c3 AS (SELECT session_id FROM utts WHERE turn_index = 3 AND speaker = 'client'),
m AS (SELECT session_id, turn_index, speaker, text FROM utts),
b1 AS (SELECT m.* FROM m JOIN c2 USING (session_id) WHERE m.turn_index < 2 UNION ALL SELECT session_id, 2, 'client', '  Actually   that went well.  ' FROM c2),
b2 AS (SELECT * FROM b1 WHERE turn_index < 2 UNION ALL SELECT session_id, 2, 'client', 'Or not.' FROM c2),
b3 AS (SELECT m.* FROM m JOIN c3 USING (session_id) WHERE m.turn_index < 3 UNION ALL SELECT session_id, 3, 'client', '' FROM c3)
SELECT session_id, 'main' AS branch_id, turn_index, speaker, md5(text) AS text_md5 FROM m
UNION ALL SELECT session_id, 'b1', turn_index, speaker, md5(text) FROM b1 UNION ALL SELECT session_id, 'b2', turn_index, speaker, md5(text) FROM b2
UNION ALL SELECT session_id, 'b3', turn_index, speaker, md5(text) FROM b3""")
def branch_timeline(spark, d):
    """Timelines of a session, its rewrites and the rewrite of a rewrite."""
    from ..operators.turns import utterances
    t = utterances(A.client_turns(spark, d)).select("session_id", F.lit("main").alias("branch_id"), "turn_index", "speaker", "text")
    branches, own, _ = V.rewrite_turns(t, _edits(t))
    t2 = t.unionByName(own)
    again = own.filter("branch_id = 'b1'").select("session_id", "branch_id", F.lit("b2").alias("new_branch_id"), "turn_index",
                                                  F.lit("Or not.").alias("message"))
    more, own2, _ = V.rewrite_turns(own, again)
    forks = branches.unionByName(more.filter("parent_branch_id is not null"))
    return V.branch_timeline(t2.unionByName(own2), forks.dropDuplicates(["session_id", "branch_id"])).select(
        "session_id", "branch_id", "turn_index", "speaker", F.md5("text").alias("text_md5"))


@query("V9", rf"""
WITH {G.TURNS_SQL}, t AS (SELECT session_id, turn_index, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM utts WHERE speaker = 'client' AND turn_index IN (2, 3)),
old AS (SELECT session_id, 'main' AS branch_id, turn_index AS fork_turn, 'turn ' || turn_index || CASE WHEN x = '' THEN '' ELSE ': ' || CASE WHEN length(x) > 48 THEN substring(x, 1, 48) || '…' ELSE x END END AS label FROM t)
SELECT * FROM old UNION ALL SELECT session_id, 'b1', 2, 'turn 2: Actually that went well.' FROM t WHERE turn_index = 2
UNION ALL SELECT session_id, 'b3', 3, 'turn 3' FROM t WHERE turn_index = 3""")
def branch_list(spark, d):
    from ..operators.turns import utterances
    t = utterances(A.client_turns(spark, d)).select("session_id", F.lit("main").alias("branch_id"), "turn_index", "speaker", "text")
    branches, _, _ = V.rewrite_turns(t, _edits(t))
    return branches.select("session_id", "branch_id", "fork_turn", "label")


@query("V10 M5", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, status, count(*) AS n FROM (SELECT session_id, 'found' AS status FROM nodes WHERE CAST(session_id AS BIGINT) % 3 <> 0
 UNION ALL SELECT session_id, 'missing' FROM (SELECT DISTINCT session_id FROM ev) s, range({len(O.LABELS)}) WHERE CAST(session_id AS BIGINT) % 3 = 0) GROUP BY ALL""")
def reset_sessions(spark, d):
    from ..operators.merge import scaffold_nodes
    n = G.event_graph(spark, d).nodes
    sessions = n.select("session_id").distinct()
    third = sessions.filter(F.col("session_id").cast("bigint") % 3 == 0)
    return V.reset_sessions(n, third, scaffold_nodes(sessions, O.Ontology.of())).groupBy("session_id", "status").agg(
        F.count(F.lit(1)).alias("n"))


# ── sources and sinks ─────────────────────────────────────────────────────

def _stored(g: Graph) -> Graph:
    return Graph(cut(g.nodes), cut(g.edges), cut(g.node_evidence), cut(g.edge_evidence))


@query("S2 S5", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, 'node' AS kind, node_id AS id, (SELECT count(*) FROM en e WHERE e.session_id = n.session_id AND e.node_id = n.node_id) AS n_evidence FROM nodes n
UNION ALL SELECT session_id, 'edge', subject_id || '__' || predicate || '__' || object_id, count(*) FROM links GROUP BY ALL""")
def graph_roundtrip(spark, d):
    """Event graphs as JSON documents of at most thirty rows, read back."""
    docs = W.graph_documents(_stored(G.event_graph(spark, d)), 30)
    schema = (f"nodes array<struct<{RD._colon(RD.NODE_JSON)}>>, edges array<struct<{RD._colon(RD.EDGE_JSON)}>>")
    back = RD._graph_rows(cut(docs).select("session_id", "part", F.from_json("doc", schema).alias("g")))
    count = lambda rows, ev, kind, key: rows.join(
        ev.groupBy("session_id", F.col("owner_id").alias(key)).agg(F.count(F.lit(1)).alias("n_evidence")),
        ["session_id", key]).select("session_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), "n_evidence")
    return count(back.nodes, back.node_evidence, "node", "node_id").unionByName(
        count(back.edges, back.edge_evidence, "edge", "edge_id"))


@query("S3 S11", f"""
WITH {G.EVENTS_SQL}, f AS (SELECT * FROM nodes WHERE last_turn % 3 <> 0), c AS (SELECT session_id, label, count(*) AS n FROM f GROUP BY ALL)
SELECT c.session_id, c.label, c.n, CAST(sum(c.n) OVER (PARTITION BY c.session_id) AS BIGINT) AS total_nodes,
  (SELECT count(*) FROM edges e WHERE e.session_id = c.session_id AND e.ord % 2 = 1) AS total_edges FROM c""")
def load_summary(spark, d):
    """Found part of a graph with placeholders, summarised as on loading."""
    g = G.event_graph(spark, d)
    live = Graph(g.nodes.withColumn("status", F.when(F.col("turn_acquired") % 3 == 0, "missing").otherwise("found")),
                 g.edges.withColumn("status", F.when(F.col("ord") % 2 == 0, "missing").otherwise("found")),
                 g.node_evidence, g.edge_evidence)
    return RD.load_summary(live.found()).select("session_id", "label", "n", "total_nodes", "total_edges")


@query("S6", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, node_id AS id, CASE WHEN last_turn % 3 = 0 THEN label ELSE label || chr(10) || substring(text, 1, 25) END AS label,
  CASE WHEN last_turn % 3 = 0 THEN 'missing' WHEN label IN ('Problem', 'Goal') THEN 'session_structure' ELSE 'cognitive' END AS type FROM nodes""")
def display_nodes(spark, d):
    n = G.event_graph(spark, d).nodes
    n = n.withColumn("status", F.when(F.col("turn_acquired") % 3 == 0, "missing").otherwise("found"))
    return W.display_nodes(n).select("session_id", "id", "label", "type")


@query("S7", f"""
WITH {G.DIALOGUE_NODES_SQL}, e AS (SELECT session_id, node_id, turn_index, label FROM nodes)
SELECT session_id, 'node' AS kind, count(*) AS n FROM e GROUP BY session_id
UNION ALL SELECT a.session_id, 'edge', count(*) FROM e a JOIN e b ON a.session_id = b.session_id AND a.turn_index = b.turn_index AND a.label = 'AutomaticThought' AND b.label = 'Problem' GROUP BY a.session_id""")
def canvas_view(spark, d):
    """Utterances and the edges to them are hidden; edges within a turn stay."""
    g = G.dialogue_nodes(spark, d)
    to_words = g.node_evidence.select("session_id", F.col("owner_id").alias("subject_id"), F.lit("evidencedBy").alias("predicate"),
                                      F.concat(F.lit("utt_"), F.col("turn_index").cast("string")).alias("object_id"))
    same = (g.nodes.filter("label = 'AutomaticThought'").select("session_id", "turn_acquired", F.col("node_id").alias("subject_id"))
            .join(g.nodes.filter("label = 'Problem'").select("session_id", "turn_acquired", F.col("node_id").alias("object_id")),
                  ["session_id", "turn_acquired"]).select("session_id", "subject_id", F.lit("associatedWith").alias("predicate"), "object_id"))
    edges = to_words.unionByName(same).select("session_id", edge_id().alias("edge_id"), "subject_id", "predicate", "object_id",
                                              empty_map().alias("props"), F.lit("found").alias("status"), F.lit(0).cast("bigint").alias("ord"))
    n, e = W.canvas(Graph(g.nodes, edges, g.node_evidence, g.edge_evidence), skip_scaffold=True)
    return n.groupBy("session_id", F.lit("node").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        e.groupBy("session_id", F.lit("edge").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


_REL_CASE = "CASE predicate " + " ".join(f"WHEN '{p}' THEN '{r}'" for p, r in O.REL_TYPE.items()) + " END"


@query("S4 S8", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, 'node' AS kind, node_id AS id, label AS what, (SELECT count(*) FROM en e WHERE e.session_id = n.session_id AND e.node_id = n.node_id) AS n_evidence FROM nodes n
UNION ALL SELECT session_id, 'rel', subject_id || '>' || object_id, {_REL_CASE}, 0 FROM edges""")
def property_graph_roundtrip(spark, d):
    """Event graph as property-graph tables and back; relation types are checked on the way."""
    g = _stored(G.event_graph(spark, d))
    t = W.property_graph_tables(g, O.Ontology.of())
    turns = g.node_evidence.select("session_id", "turn_index").distinct().select(
        "session_id", F.concat(F.lit("utt_"), F.col("turn_index").cast("string")).alias("id"), F.array(F.lit("ABox"), F.lit("Utterance")).alias("labels"),
        F.create_map(F.lit("turnIndex"), F.col("turn_index").cast("string")).alias("props"), F.lit(0).cast("bigint").alias("ord"))
    nodes = t["instances"].select("session_id", "id", F.array(F.lit("ABox"), "label").alias("labels"),
                                  "props", F.lit(0).cast("bigint").alias("ord")).unionByName(turns)
    rels = t["relations"].withColumn("ord", F.lit(0).cast("bigint")).unionByName(
        t["evidenced_by"].select("session_id", "start_id", F.lit("EVIDENCED_BY").alias("rel_type"), "end_id",
                                 empty_map().alias("props"), F.lit(0).cast("bigint").alias("ord")))
    back = RD.read_property_graph(nodes, rels)
    n_ev = back.node_evidence.groupBy("session_id", F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    return (back.nodes.filter("label <> 'Utterance'").join(n_ev, ["session_id", "node_id"])
            .select("session_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("label").alias("what"), "n_evidence")
            .unionByName(t["relations"].select("session_id", F.lit("rel").alias("kind"), F.concat_ws(">", "start_id", "end_id").alias("id"),
                                               F.col("rel_type").alias("what"), F.lit(0).cast("bigint").alias("n_evidence"))))


@query("S10", """
SELECT CAST(c_custkey AS VARCHAR) AS session_id, 'node' AS kind, 'at_1' AS id, c_name AS detail FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'edge', 'at_1__stemsFrom__cb_' || c_nationkey, CASE c_custkey % 2 WHEN 0 THEN '8/10' ELSE '' END FROM customer""")
def corrected_ingest(spark, d):
    """Corrected documents in both shapes; rows without ids are skipped."""
    c = A.table(spark, d, "customer")
    nat = F.concat(F.lit("cb_"), F.col("c_nationkey").cast("string"))
    one = F.to_json(F.struct(
        F.array(F.struct(F.lit("at_1").alias("id"), F.lit("AutomaticThought").alias("label"), F.create_map(F.lit("content"), F.col("c_name")).alias("properties"))).alias("nodes"),
        F.array(F.struct(F.lit("stemsFrom").alias("type"), F.lit("at_1").alias("from"), nat.alias("to"), F.lit("8/10").alias("reportedIntensity"))).alias("edges")))
    two = F.to_json(F.struct(
        F.array(F.struct(F.lit("at_1").alias("id"), F.lit("AutomaticThought").alias("label"), F.create_map(F.lit("content"), F.col("c_name")).alias("props")),
                F.struct(F.lit("").alias("id"), F.lit("Goal").alias("label"), F.create_map(F.lit("statement"), F.lit("x")).alias("props"))).alias("nodes"),
        F.array(F.struct(F.lit("stemsFrom").alias("predicate"), F.lit("at_1").alias("subject_id"), nat.alias("object_id"), F.lit("").alias("reportedIntensity")),
                F.struct(F.lit("stemsFrom").alias("predicate"), F.lit("").alias("subject_id"), nat.alias("object_id"), F.lit("").alias("reportedIntensity"))).alias("edges")))
    docs = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_custkey") % 2 == 0, one).otherwise(two).alias("doc"))
    g = RD.ingest_corrected(docs)
    return g.nodes.select("session_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"),
                          P.main_text(F.col("label"), F.col("props")).alias("detail")).unionByName(
        g.edges.select("session_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"),
                       F.coalesce(P.get_prop(F.col("props"), "reportedIntensity"), F.lit("")).alias("detail")))
