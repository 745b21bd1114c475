"""Registered queries over merging, edges, phases and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions.text import sentences, token_set
from ..operators import edges as E
from ..operators import evaluate as V
from ..operators import merge as M
from ..operators import phases as H
from ..operators import simjoin as S
from ..operators.graph import edge_id, empty_map
from ..session import cut
from . import adapters as A
from . import graphs as G
from .candidate_queries import props_text
from .registry import query

COSINE_GATE, COSINE_AUTO = 0.3, 0.4

# Token sets of whole documents per language; copies collapsed.
_SETS_SQL = r"""
tok AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS s FROM documents),
sets AS (SELECT lang, s, min(doc_id) AS id, count(*) AS copies, len(s) AS n FROM tok WHERE len(s) > 0 GROUP BY lang, s),
words AS (SELECT lang, id, n, copies, unnest(s) AS w FROM sets),
common AS (SELECT a.lang, a.id AS a, b.id AS b, a.n AS na, b.n AS nb, a.copies AS ca, b.copies AS cb, count(*) AS c
  FROM words a JOIN words b ON a.lang = b.lang AND a.w = b.w AND a.id < b.id AND a.n * 5 > b.n * 3 AND b.n * 5 > a.n * 3
  GROUP BY ALL),
pairs AS (SELECT *, c / (na + nb - c) AS j FROM common WHERE c * 5 > (na + nb - c) * 3)
"""


@query("M1", f"WITH {_SETS_SQL} SELECT lang, a, b, ca AS copies_a, cb AS copies_b, round(j, 6) AS similarity FROM pairs")
def jaccard_pairs(spark, d):
    """Distinct whole texts of a language with similarity above 3/5; copies are counted, not paired."""
    docs = A.documents(spark, d).select("lang", "doc_id", token_set(F.col("text")).alias("tokens"))
    sets = cut(S.distinct_sets(docs, ["lang"], "tokens", "doc_id"), "zstd")
    pairs = S.similar_pairs(sets, ["lang"], 3, 5)
    n = sets.select("lang", "set_id", "n")
    return (pairs.join(n.select("lang", F.col("set_id").alias("a"), F.col("n").alias("copies_a")), ["lang", "a"])
            .join(n.select("lang", F.col("set_id").alias("b"), F.col("n").alias("copies_b")), ["lang", "b"])
            .select("lang", "a", "b", "copies_a", "copies_b", F.round(
                F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("similarity")))


@query("M2 M6", f"""
WITH RECURSIVE {_SETS_SQL},
sim AS (SELECT lang, a AS id, b AS other FROM pairs UNION ALL SELECT lang, b, a FROM pairs UNION ALL SELECT lang, id, id FROM sets),
nb AS (SELECT lang, id, list(other) AS others FROM sim GROUP BY lang, id),
docs AS (SELECT t.lang, t.doc_id, coalesce(s.id, -1 - t.doc_id) AS id, row_number() OVER (PARTITION BY t.lang ORDER BY t.doc_id) AS pos
   FROM tok t LEFT JOIN sets s ON s.lang = t.lang AND s.s = t.s),
w AS (SELECT DISTINCT lang, CAST(0 AS BIGINT) AS pos, [CAST(NULL AS STRUCT(head BIGINT, cur BIGINT))][1:0] AS st, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS head FROM docs
  UNION ALL
  SELECT x.lang, x.pos, CASE WHEN x.at IS NULL THEN list_append(x.st, {{'head': x.doc_id, 'cur': x.id}})
      ELSE list_concat(list_append(x.st[1:x.at - 1], {{'head': x.st[x.at].head, 'cur': x.id}}), x.st[x.at + 1:len(x.st)]) END,
    x.doc_id, coalesce(x.st[x.at].head, x.doc_id)
  FROM (SELECT w.lang, d.pos, w.st, d.doc_id, d.id,
          list_position(list_transform(w.st, lambda c: list_contains(nb.others, c.cur)), true) AS at
        FROM w JOIN docs d ON d.lang = w.lang AND d.pos = w.pos + 1 LEFT JOIN nb ON nb.lang = d.lang AND nb.id = d.id) x),
a AS (SELECT lang, doc_id, head FROM w WHERE pos > 0),
n AS (SELECT lang, head, row_number() OVER (PARTITION BY lang ORDER BY head) AS node_no FROM a WHERE doc_id = head)
SELECT a.lang AS session_id, a.doc_id, a.head AS first_doc, n.node_no FROM a JOIN n USING (lang, head)""")
def greedy_merge(spark, d):
    """Ordered merge of whole documents within a language (one session and class per language)."""
    c = A.documents(spark, d).select(F.col("lang").alias("session_id"), F.lit("Problem").alias("label"),
                                     F.col("doc_id").alias("ord"), "text", empty_map().alias("props"))
    a = M.assign_nodes(c)
    no = M.number_nodes(a)
    return a.join(no, ["session_id", "label", "head"]).select(
        "session_id", F.col("ord").alias("doc_id"), F.col("head").alias("first_doc"), "node_no")


@query("M2 M4 M6 R1", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, label, node_id, text, last_turn AS turn_acquired, ord,
  (SELECT count(*) FROM en e WHERE e.session_id = n.session_id AND e.node_id = n.node_id) AS n_evidence FROM nodes n""")
def merged_nodes(spark, d):
    """The general merge over every event as a candidate, with nodes, properties and evidence."""
    ev = A.events(spark, d)
    c = ev.select("session_id", "label", F.col("turn_index").alias("ord"), "text", empty_map().alias("props"), "turn_index")
    m = M.merge(c)
    n_ev = m.evidence.groupBy("session_id", F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    return m.nodes.join(n_ev, ["session_id", "node_id"]).select(
        "session_id", "label", "node_id", P.main_text(F.col("label"), F.col("props")).alias("text"),
        F.col("turn_acquired").cast("bigint").alias("turn_acquired"), "ord", "n_evidence")


@query("M3 M4 E20", """
WITH ev AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT user_id, t, CASE WHEN k % 3 = 0 THEN 'self' WHEN k % 3 = 1 THEN 'world' END AS domain,
    CASE WHEN k % 4 = 0 THEN 'helpless' WHEN k % 4 = 1 THEN 'unlovable' END AS category, event_type AS content FROM ev),
closed AS (SELECT user_id, max(t) AS c FROM r WHERE domain = 'world' GROUP BY user_id),
opened AS (SELECT r.user_id, min(t) AS o FROM r LEFT JOIN closed USING (user_id) WHERE domain = 'self' AND t > coalesce(c, 0) GROUP BY r.user_id)
SELECT CAST(r.user_id AS VARCHAR) AS session_id,
  coalesce('category=' || arg_max(category, t) FILTER (category IS NOT NULL AND t >= o) || ';', '')
  || 'content=' || arg_max(content, t) || coalesce(';domain=' || arg_max(domain, t) FILTER (domain IS NOT NULL), '') AS props
FROM r LEFT JOIN opened USING (user_id) GROUP BY r.user_id""")
def folded_props(spark, d):
    """Newest-wins properties of one belief per session, gated after every candidate."""
    k = F.col("k").cast("int")
    ev = A.events(spark, d).select(
        "session_id", F.lit("CoreBelief").alias("label"), F.lit(1).alias("head"), F.col("turn_index").alias("ord"),
        P.assign(F.create_map(F.lit("content"), F.col("event_type")), {
            "domain": F.when(k % 3 == 0, "self").when(k % 3 == 1, "world").otherwise(""),
            "category": F.when(k % 4 == 0, "helpless").when(k % 4 == 1, "unlovable")}).alias("props"))
    return M.fold_props(ev, ["session_id", "head"]).select("session_id", props_text(F.col("props")).alias("props"))


_SCAFFOLD = "(VALUES " + ", ".join(f"('{l}', '{O.ID_PREFIX[l]}_1')" for l in O.LABELS) + ") c(label, node_id)"
_EDGE_SCAFFOLD = "(VALUES " + ", ".join(
    f"('{O.ID_PREFIX[s]}_1__{p}__{O.ID_PREFIX[o]}_1')" for s, p, o in O.EDGE_MAP) + ") m(edge_id)"


@query("M5 M6 M7", f"""
WITH {G.EVENTS_SQL}, s AS (SELECT DISTINCT session_id FROM ev)
SELECT session_id, 'node' AS kind, label AS what, status, count(*) AS n FROM (
  SELECT session_id, node_id, label, 'found' AS status FROM nodes
  UNION ALL SELECT s.session_id, c.node_id, c.label, 'missing' FROM s, {_SCAFFOLD}
    WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.session_id = s.session_id AND n.node_id = c.node_id)) GROUP BY ALL
UNION ALL
SELECT session_id, 'edge', predicate, status, count(*) FROM (
  SELECT session_id, edge_id, predicate, 'found' AS status FROM edges
  UNION ALL SELECT s.session_id, m.edge_id, split_part(m.edge_id, '__', 2), 'missing' FROM s, {_EDGE_SCAFFOLD}
    WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.session_id = s.session_id AND e.edge_id = m.edge_id)) GROUP BY ALL""")
def scaffold_state(spark, d):
    """Found rows over the placeholder scaffold, counted per class and predicate."""
    g = G.event_graph(spark, d)
    onto = O.Ontology.of()
    sessions = g.nodes.select("session_id").distinct()
    nodes = M.flip(M.scaffold_nodes(sessions, onto), g.nodes, "node_id")
    edges = M.flip(M.scaffold_edges(sessions, onto), g.edges, "edge_id")
    n = nodes.groupBy("session_id", F.lit("node").alias("kind"), F.col("label").alias("what"), "status").agg(
        F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges.groupBy("session_id", F.lit("edge").alias("kind"), F.col("predicate").alias("what"),
                                       "status").agg(F.count(F.lit(1)).alias("n")))


@query("M7", f"""
WITH {G.EVENTS_SQL}, l AS (SELECT *, subject_id || '__' || predicate || '__' || object_id AS edge_id FROM links)
SELECT session_id, edge_id, min(ord) AS ord, count(DISTINCT ord) AS n_evidence, 'last=' || max(ord) || CASE WHEN max(CASE WHEN ord % 2 = 0 THEN ord END) IS NULL
  THEN '' ELSE ';even=' || max(CASE WHEN ord % 2 = 0 THEN ord END) END AS props FROM l GROUP BY session_id, edge_id""")
def edge_upserts(spark, d):
    links = G.event_links(G.event_rows(spark, d))
    o = F.col("ord").cast("string")
    a = links.withColumn("props", P.assign(empty_map(), {"last": o, "even": F.when(F.col("ord") % 2 == 0, o)}))
    edges, ev = M.upsert_edges(a)
    n = ev.groupBy("session_id", F.col("owner_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n_evidence"))
    # 'last' sorts after 'even': put it first to match the SQL text
    p = F.concat(F.lit("last="), P.get_prop(F.col("props"), "last"), F.coalesce(
        F.concat(F.lit(";even="), P.get_prop(F.col("props"), "even")), F.lit("")))
    return edges.join(n, ["session_id", "edge_id"]).select("session_id", "edge_id", "ord", "n_evidence", p.alias("props"))


@query("M8", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, label, max(CAST(regexp_extract(node_id, '_(\\d+)$', 1) AS BIGINT)) AS last_no FROM nodes GROUP BY ALL""")
def id_counters(spark, d):
    return M.highest_suffix(G.event_graph(spark, d).nodes)


@query("M9", f"""
WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
ok AS (SELECT label, a, b FROM p WHERE cos >= {COSINE_AUTO} OR (cos >= {COSINE_GATE} AND (a + b) % 2 = 0)),
sym AS (SELECT label, a, b FROM ok UNION ALL SELECT label, b, a FROM ok),
reach AS (SELECT label, vec_id AS id, vec_id AS root FROM v UNION SELECT s.label, s.b, r.root FROM reach r JOIN sym s ON s.label = r.label AND s.a = r.id),
m AS (SELECT label, id, min(root) AS survivor FROM reach GROUP BY label, id)
SELECT label, id, survivor FROM m""")
def entity_components(spark, d):
    """Vectors of a label resolved to entities; the judge accepts pairs with an even id sum."""
    v = A.table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"),
                                               F.col("embedding").cast("array<double>").alias("vec"))
    pairs = S.cosine_pairs(v, ["label"], COSINE_GATE)
    verdicts = pairs.select("label", "a", "b", ((F.col("a") + F.col("b")) % 2 == 0).alias("same"))
    return M.resolve_entities(v, ["label"], COSINE_GATE, COSINE_AUTO, verdicts).members


@query("M10", f"""
WITH {G.EVENTS_SQL}, s AS (SELECT DISTINCT session_id FROM ev)
SELECT s.session_id, c.label, (SELECT count(*) FROM nodes n WHERE n.session_id = s.session_id AND n.label = c.label) AS n FROM s, {_SCAFFOLD}""")
def label_snapshot(spark, d):
    nodes = G.event_graph(spark, d).nodes
    return M.found_counts(nodes, nodes.select("session_id").distinct())


@query("M11", f"""
WITH {G.EVENTS_SQL},
r AS (SELECT session_id, label, text, row_number() OVER (PARTITION BY session_id, label ORDER BY ord) AS rn,
    count(*) OVER (PARTITION BY session_id, label) AS n FROM nodes),
l AS (SELECT session_id, label, '  ' || label || ': ' || string_agg(text, ' | ' ORDER BY rn) FILTER (rn <= 5)
    || CASE WHEN max(n) > 5 THEN ' (+' || (max(n) - 5) || ' more)' ELSE '' END AS line FROM r GROUP BY session_id, label)
SELECT session_id, 'Session phase: Rapport' || chr(10) || 'Active technique: Rapport Building' || chr(10)
  || 'What''s emerged in the graph so far:' || chr(10) || string_agg(line, chr(10) ORDER BY {G._RANK}) AS context FROM l GROUP BY session_id""")
def context_summary(spark, d):
    nodes = G.event_graph(spark, d).nodes
    state = nodes.select("session_id").distinct().select(
        "session_id", F.lit(O.PHASES[0]).alias("phase"), F.lit(O.INITIAL_TECHNIQUE).alias("technique"))
    return M.context_summary(nodes, state)


# ── edges ─────────────────────────────────────────────────────────────────

_FAM_SQL = "(VALUES " + ", ".join(f"({i}, '{s}', '{p}', '{o}')" for i, (s, p, o) in enumerate(O.FAMILIES)) + ") f(fo, s, p, o)"
_LISTS_SQL = f"""
lists AS (SELECT n.session_id, f.s AS subject_label, f.p AS predicate, n.node_id AS object_id,
   row_number() OVER (PARTITION BY n.session_id, f.s, f.p ORDER BY f.fo, n.ord) AS n FROM nodes n JOIN {_FAM_SQL} ON n.label = f.o)
"""


@query("G1", f"WITH {G.EVENTS_SQL}, {_LISTS_SQL} SELECT session_id, subject_label, predicate, n, object_id FROM lists")
def anchor_lists(spark, d):
    g = G.event_graph(spark, d)
    return E.object_lists(g.nodes, O.Ontology.of().family_table(spark)).select(
        "session_id", "subject_label", "predicate", "n", "object_id")


@query("G1 E3", f"""
WITH {G.EVENTS_SQL}, {_LISTS_SQL}, lastn AS (SELECT session_id, max(turn_index) AS t FROM ev GROUP BY session_id),
subj AS (SELECT n.* FROM nodes n JOIN lastn l ON n.session_id = l.session_id AND n.last_turn = l.t)
SELECT s.session_id, s.node_id AS subject_id, l.predicate, row_number() OVER (PARTITION BY s.session_id, s.node_id, l.predicate ORDER BY l.n) AS n, l.object_id
FROM subj s JOIN lists l ON l.session_id = s.session_id AND l.subject_label = s.label WHERE l.object_id <> s.node_id""")
def anchor_pairs(spark, d):
    """Numbered objects for the nodes of each session's latest turn."""
    rows = G.event_rows(spark, d)
    nodes = G.event_nodes(rows)
    last = rows.groupBy("session_id").agg(F.max_by("node_id", "turn_index").alias("node_id"))
    subjects = nodes.join(last, ["session_id", "node_id"], "left_semi")
    return E.anchor_pairs(subjects, E.object_lists(nodes, O.Ontology.of().family_table(spark)))


@query("G2", f"""
WITH {G.EVENTS_SQL}, {_LISTS_SQL},
subj AS (SELECT session_id, node_id, label, last_turn, ord FROM nodes WHERE label IN ('Situation', 'AutomaticThought', 'Problem')),
ans AS (SELECT *, CASE label WHEN 'Situation' THEN 'triggers' WHEN 'Problem' THEN 'manifestsAs' ELSE 'associatedWith' END AS p,
   CAST(ord % 7 + 1 AS BIGINT) AS n FROM subj WHERE ord % 5 <> 0)
SELECT a.session_id, a.node_id AS subject_id, a.p AS predicate, l.object_id, a.last_turn AS turn_index
FROM ans a JOIN lists l ON l.session_id = a.session_id AND l.subject_label = a.label AND l.predicate = a.p AND l.n = a.n""")
def asserted_edges(spark, d):
    """Answers naming a relation and a number, as edges; bad relations and numbers drop out."""
    g = G.event_graph(spark, d)
    lists = E.object_lists(g.nodes, O.Ontology.of().family_table(spark))
    s = g.nodes.filter(F.col("label").isin("Situation", "AutomaticThought", "Problem"))
    rel = (F.when(F.col("label") == "Situation", "triggers").when(F.col("label") == "Problem", "manifestsAs")
           .otherwise("associatedWith"))
    rel = F.when(F.col("ord") % 5 == 0, "dislikes").otherwise(rel)
    raw = F.concat(F.lit('[{"relation": " '), rel, F.lit('", "object": '), (F.col("ord") % 7 + 1).cast("string"),
                   F.lit(', "reason": "r", "reportedIntensity": "8/10"}, {"relation": "triggers", "object": 0}, 3]'))
    resp = s.select("session_id", F.col("node_id").alias("subject_id"), F.col("label").alias("subject_label"),
                    F.col("turn_acquired").cast("bigint").alias("turn_index"), "ord", raw.alias("raw"))
    return E.assert_edges(E.parse_assertions(resp), lists).select(
        "session_id", "subject_id", "predicate", "object_id", "turn_index")


_CAN = ", ".join(repr(x) for x in dict.fromkeys(s for s, _, _ in O.FAMILIES))
_ORPHANS_SQL = f"orphan AS (SELECT n.* FROM nodes n WHERE label IN ({_CAN}) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.session_id = n.session_id AND e.subject_id = n.node_id))"


@query("G3", f"WITH {G.EVENTS_SQL}, {_ORPHANS_SQL} SELECT session_id, node_id, label FROM orphan")
def orphans(spark, d):
    g = G.event_graph(spark, d)
    return E.orphans(g.nodes, g.edges).select("session_id", "node_id", "label")


_BOTH_SQL = """both_ AS (SELECT session_id, subject_id AS a, object_id AS b FROM edges UNION SELECT session_id, object_id, subject_id FROM edges)"""
_NEW_SQL = """newn AS (SELECT n.session_id, n.node_id, n.label FROM nodes n JOIN (SELECT session_id, max(turn_index) AS t FROM ev GROUP BY session_id) l
  ON l.session_id = n.session_id AND l.t = n.last_turn)"""
_NEAR_SQL = """
h1 AS (SELECT DISTINCT s.session_id, s.node_id AS start_id, b AS node_id FROM newn s JOIN both_ x ON x.session_id = s.session_id AND x.a = s.node_id WHERE b <> s.node_id),
h2 AS (SELECT DISTINCT h.session_id, h.start_id, x.b AS node_id FROM h1 h JOIN both_ x ON x.session_id = h.session_id AND x.a = h.node_id
  WHERE x.b <> h.start_id AND NOT EXISTS (SELECT 1 FROM h1 k WHERE k.session_id = h.session_id AND k.start_id = h.start_id AND k.node_id = x.b)),
near AS (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2)"""


def _latest_nodes(rows, nodes):
    last = rows.groupBy("session_id").agg(F.max_by("node_id", "turn_index").alias("node_id"))
    return nodes.join(last, ["session_id", "node_id"], "left_semi")


@query("G4", f"WITH {G.EVENTS_SQL}, {_BOTH_SQL}, {_NEW_SQL}, {_NEAR_SQL} SELECT session_id, start_id, node_id, hops FROM near")
def neighbourhood(spark, d):
    """Two hops in either direction around each session's latest node."""
    rows = G.event_rows(spark, d)
    g = G.event_graph(spark, d, rows)
    starts = _latest_nodes(rows, g.nodes).select("session_id", F.col("node_id").alias("start_id"))
    return E.neighbourhood(starts, g.edges, 2)


_MAP_SQL = "(VALUES " + ", ".join(f"('{s}', '{o}')" for s, o in dict.fromkeys((s, o) for s, _, o in O.EDGE_MAP)) + ") fm(s, o)"


@query("G5", f"""
WITH {G.EVENTS_SQL}, {_ORPHANS_SQL}, {_BOTH_SQL}, {_NEW_SQL}, {_NEAR_SQL},
iso AS (SELECT n.session_id, n.node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.session_id = n.session_id AND b.a = n.node_id))
SELECT DISTINCT o.session_id, o.node_id, o.label FROM orphan o JOIN newn w ON w.session_id = o.session_id JOIN {_MAP_SQL} ON fm.s = o.label AND fm.o = w.label
WHERE NOT EXISTS (SELECT 1 FROM newn x WHERE x.session_id = o.session_id AND x.node_id = o.node_id) AND (
  EXISTS (SELECT 1 FROM near r WHERE r.session_id = o.session_id AND r.start_id = w.node_id AND r.node_id = o.node_id)
  OR EXISTS (SELECT 1 FROM iso i WHERE i.session_id = o.session_id AND i.node_id = o.node_id)
  OR NOT EXISTS (SELECT 1 FROM near r WHERE r.session_id = o.session_id AND r.start_id = w.node_id))""")
def retry_set(spark, d):
    rows = G.event_rows(spark, d)
    g = G.event_graph(spark, d, rows)
    return E.retry_subjects(g.nodes, g.edges, _latest_nodes(rows, g.nodes)).select("session_id", "node_id", "label")


@query("G6", f"""
WITH {G.EVENTS_SQL},
l AS (SELECT session_id, label, node_id, row_number() OVER (PARTITION BY session_id, label ORDER BY ord) AS n FROM nodes),
acc AS (SELECT a.session_id, a.node_id AS s, b.node_id AS o FROM l a JOIN l b ON a.session_id = b.session_id AND a.label = 'Situation'
   AND b.label = 'Problem' AND b.n = a.n WHERE a.n % 2 = 1)
SELECT DISTINCT acc.session_id, acc.s AS subject_id, acc.o AS object_id, e.turn_index FROM acc JOIN en e ON e.session_id = acc.session_id AND e.node_id IN (acc.s, acc.o)""")
def reinforces(spark, d):
    """Accepted pairs of numbered lists; views stand in for reactions and errors for beliefs."""
    g = G.event_graph(spark, d)
    stand_in = g.nodes.withColumn("label", F.when(F.col("label") == "Situation", "Reaction").when(
        F.col("label") == "Problem", "CoreBelief").otherwise(F.col("label")))
    lists = E.reinforces_lists(stand_in)
    answers = lists.filter((F.col("label") == "Reaction") & (F.col("n") % 2 == 1)).select(
        "session_id", F.col("n").alias("ord"), F.col("n").alias("reaction"), F.col("n").alias("belief"))
    return E.reinforces_edges(answers, lists, g.node_evidence).select("session_id", "subject_id", "object_id", "turn_index")


@query("G7", rf"""
WITH {G.TURNS_SQL}, {G.sentences_sql("turns", "session_id, turn_index, speaker, pos")},
nd AS (SELECT session_id, speaker, pos * 100000 + sent_no AS ord,
   list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\s+'), lambda x: x <> '')) AS s FROM sents),
sc AS (SELECT r.session_id, r.ord AS response, a.ord AS thought, len(list_intersect(r.s, a.s)) AS c, len(r.s) + len(a.s) - len(list_intersect(r.s, a.s)) AS t
   FROM nd r JOIN nd a ON r.session_id = a.session_id AND r.speaker = 'therapist' AND a.speaker = 'client'),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id, response ORDER BY c / t DESC, thought) AS rn FROM sc WHERE c * 5 > t)
SELECT session_id, response, thought, CAST(c AS BIGINT) AS common, CAST(t AS BIGINT) AS total FROM b WHERE rn = 1""")
def reframe_best(spark, d):
    """Best client sentence for every therapist sentence, as thoughts and responses."""
    s = A.client_turns(spark, d).select("session_id", "speaker", "pos", F.posexplode(sentences(F.col("text"))).alias("sent_no", "t"))
    ord_ = (F.col("pos") * 100000 + F.col("sent_no")).cast("bigint")
    n = s.select("session_id", F.when(F.col("speaker") == "client", "AutomaticThought").otherwise("AdaptiveResponse").alias("label"),
                 ord_.cast("string").alias("node_id"), ord_.alias("ord"), F.create_map(F.lit("content"), F.col("t")).alias("props"))
    return E.reframe_links(n).select(
        "session_id", F.col("response_id").cast("bigint").alias("response"), F.col("thought_id").cast("bigint").alias("thought"),
        F.col("common").cast("bigint").alias("common"), F.col("total").cast("bigint").alias("total"))


@query("G8", f"""
WITH {G.EVENTS_SQL}, s AS (SELECT DISTINCT session_id FROM nodes)
SELECT session_id, 'client_1' AS subject_id, 'hasSession' AS predicate, 'session_1' AS object_id FROM s
UNION ALL SELECT session_id, 'session_1', 'hasProblem', node_id FROM nodes WHERE label = 'Problem'
UNION ALL SELECT g.session_id, g.node_id, 'targetsProblem', p.node_id FROM nodes g JOIN nodes p USING (session_id) WHERE g.label = 'Goal' AND p.label = 'Problem'""")
def structure_edges(spark, d):
    return E.structure_edges(G.event_graph(spark, d).nodes)


def _flawed_edges(spark, d):
    """Star edges plus, per order, one of four flaws derived from its key."""
    g = G.star_graph(spark, d)
    o = A.table(spark, d, "orders")
    k = F.col("o_orderkey")
    sid = F.concat(F.lit("sit_"), k.cast("string"))
    at = F.concat(F.lit("at_"), F.col("o_custkey").cast("string"))
    case = lambda *v: F.get(F.array(*v), (k % 4).cast("int"))
    s = case(sid, at, sid, sid)
    p = case(F.lit("triggers"), F.lit("leadsTo"), F.lit("stemsFrom"), F.lit("triggers"))
    ob = case(F.lit("at_none"), F.concat(F.lit("at_"), ((F.col("o_custkey") + 1) % 10).cast("string")), F.lit("cb_1"), at)
    bad = o.select(F.lit("star").alias("session_id"), F.concat_ws("__", s, p, ob).alias("edge_id"), s.alias("subject_id"),
                   p.alias("predicate"), ob.alias("object_id"), empty_map().alias("props"), F.lit("found").alias("status"),
                   k.alias("ord"))
    return g, g.edges.unionByName(bad)


_FLAWED_SQL = G.STAR_SQL + """,
bad AS (SELECT CASE o_orderkey % 4 WHEN 1 THEN 'at_' || o_custkey ELSE 'sit_' || o_orderkey END AS subject_id,
   CASE o_orderkey % 4 WHEN 1 THEN 'leadsTo' WHEN 2 THEN 'stemsFrom' ELSE 'triggers' END AS predicate,
   CASE o_orderkey % 4 WHEN 0 THEN 'at_none' WHEN 1 THEN 'at_' || ((o_custkey + 1) % 10) WHEN 2 THEN 'cb_1' ELSE 'at_' || o_custkey END AS object_id,
   CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 8 = 7 THEN 1 ELSE 0 END AS stray FROM orders),
alle AS (SELECT subject_id, predicate, object_id, 0 AS stray FROM edges UNION ALL SELECT * FROM bad),
cl AS (SELECT a.*, s.label AS sl, o.label AS ol FROM alle a LEFT JOIN nodes s ON s.node_id = a.subject_id LEFT JOIN nodes o ON o.node_id = a.object_id),
sig AS (SELECT * FROM """ + "(VALUES " + ", ".join(f"('{s}|{p}|{o}')" for s, p, o in O.EDGE_MAP) + """) v(t)),
v AS (SELECT *, CASE WHEN sl IS NULL OR ol IS NULL THEN 'dangling' WHEN sl = 'AutomaticThought' AND ol = 'AutomaticThought' THEN 'disjoint'
   WHEN NOT EXISTS (SELECT 1 FROM sig WHERE t = sl || '|' || predicate || '|' || ol) THEN 'signature' END AS r FROM cl)
"""


@query("G9", f"WITH {_FLAWED_SQL} SELECT predicate, coalesce(r, 'valid') AS outcome, count(*) AS n FROM v GROUP BY ALL")
def edge_validation(spark, d):
    g, edges = _flawed_edges(spark, d)
    return E.validate(edges, g.nodes).groupBy("predicate", F.coalesce("drop_reason", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


@query("G9", f"""
WITH {G.EVENTS_SQL}, le AS (SELECT l.session_id, l.subject_id || '__' || l.predicate || '__' || l.object_id AS edge_id, ord FROM links l)
SELECT session_id, edge_id, CASE WHEN max(ord) > 40 THEN 'evidence' ELSE 'valid' END AS outcome FROM le GROUP BY session_id, edge_id""")
def evidence_validation(spark, d):
    """Edges whose evidence reaches past the first forty turns, the transcript being those turns."""
    rows = G.event_rows(spark, d)
    g = G.event_graph(spark, d, rows)
    turns = rows.filter("turn_index <= 40").select("session_id", "turn_index")
    return E.validate(g.edges, g.nodes, g.edge_evidence, turns).select(
        "session_id", "edge_id", F.coalesce("drop_reason", F.lit("valid")).alias("outcome"))


@query("G10", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS k, 'at_' || o_custkey AS a, 'cb_' || c_nationkey AS c FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT session_id, CASE k % 3 WHEN 0 THEN 'sit_' || k || '__triggers__' || c ELSE a || '__stemsFrom__sit_' || k END AS old_edge_id,
  CASE k % 3 WHEN 0 THEN 'sit_' || k || '__triggers__' || a ELSE a || '__stemsFrom__' || c END AS edge_id FROM o WHERE k % 3 <> 2""")
def edge_repair(spark, d):
    """One session per customer with a single thought and belief; every order's relation has
    a wrong end, which one alternative can replace for two kinds and none for the third."""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    sess = F.col("o_custkey").cast("string")
    ids = {"Situation": F.concat(F.lit("sit_"), F.col("o_orderkey").cast("string")), "AutomaticThought": F.concat(F.lit("at_"), sess),
           "CoreBelief": F.concat(F.lit("cb_"), F.col("c_nationkey").cast("string"))}
    nodes = o.select(sess.alias("session_id"), F.explode(F.array(*[
        F.struct(i.alias("node_id"), F.lit(l).alias("label")) for l, i in ids.items()])).alias("n")).select(
        "session_id", "n.node_id", "n.label").distinct()
    case = lambda *v: F.get(F.array(*v), (F.col("o_orderkey") % 3).cast("int"))
    s = case(ids["Situation"], ids["AutomaticThought"], ids["AutomaticThought"])
    p = case(F.lit("triggers"), F.lit("stemsFrom"), F.lit("manifestsAs"))
    ob = case(ids["CoreBelief"], ids["Situation"], ids["Situation"])
    edges = o.select(sess.alias("session_id"), F.concat_ws("__", s, p, ob).alias("edge_id"), s.alias("subject_id"), p.alias("predicate"),
                     ob.alias("object_id"), empty_map().alias("props"), F.lit("found").alias("status"), F.col("o_orderkey").alias("ord"))
    return E.repair(E.validate(edges, nodes), nodes).select("session_id", "old_edge_id", "edge_id")


@query("G11", f"""
WITH {G.STAR_SQL}, v AS (SELECT 'intv_' || s_suppkey AS s FROM supplier WHERE s_acctbal < 0)
SELECT predicate, count(*) AS n FROM edges WHERE subject_id NOT IN (SELECT s FROM v) GROUP BY predicate""")
def edge_verdicts(spark, d):
    """Suppliers in debt lose their relations."""
    g = G.star_graph(spark, d)
    bad = A.table(spark, d, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("intv_"), F.col("s_suppkey").cast("string")).alias("subject_id"))
    verdicts = g.edges.join(bad, "subject_id", "left_semi").select("session_id", "edge_id", F.lit(False).alias("keep"))
    return E.edge_counts(E.verdict_filter(g.edges, verdicts))


@query("G12", f"WITH {G.EVENTS_SQL} SELECT predicate, count(*) AS n FROM edges GROUP BY predicate")
def edge_counts(spark, d):
    return E.edge_counts(G.event_graph(spark, d).edges)


@query("G13", f"""
WITH RECURSIVE {G.EVENTS_SQL}, tree AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{p}')" for c, p in O.PARENT.items() if p)}) t(label, parent)),
up AS (SELECT DISTINCT label, label AS anc FROM nodes UNION ALL SELECT u.label, t.parent FROM up u JOIN tree t ON t.label = u.anc)
SELECT n.session_id, u.anc AS class, count(*) AS n FROM nodes n JOIN up u USING (label) GROUP BY ALL""")
def class_rollup(spark, d):
    return E.class_rollup(G.event_graph(spark, d).nodes, O.Ontology.of())


# ── phases ────────────────────────────────────────────────────────────────

_FIRSTS = ", ".join(f"min(CASE WHEN label = '{c}' THEN turn_index END) AS {c}" for c in H.REQUIRED)
_PHASE_SQL = f"""
f AS (SELECT session_id, max(turn_index) AS last, {_FIRSTS} FROM ev GROUP BY session_id),
p1 AS (SELECT *, CASE WHEN Problem IS NOT NULL AND greatest(2, Problem) <= last THEN greatest(2, Problem) END AS e1 FROM f),
p2 AS (SELECT *, CASE WHEN e1 IS NOT NULL AND AutomaticThought IS NOT NULL AND Situation IS NOT NULL
   AND greatest(e1 + 1, 5, AutomaticThought, Situation) <= last THEN greatest(e1 + 1, 5, AutomaticThought, Situation) END AS e2 FROM p1),
p3 AS (SELECT *, CASE WHEN e2 IS NOT NULL AND AdaptiveResponse IS NOT NULL AND greatest(e2 + 1, 12, AdaptiveResponse) <= last
   THEN greatest(e2 + 1, 12, AdaptiveResponse) END AS e3 FROM p2)
"""


@query("P1", f"WITH {G.EVENTS_SQL}, {_PHASE_SQL} SELECT session_id, e1 AS exploration_turn, e2 AS technique_turn, e3 AS consolidation_turn FROM p3")
def phase_entry_turns(spark, d):
    ev = A.events(spark, d).select("session_id", "label", "turn_index")
    return H.phase_entry_turns(ev, ev)


@query("P1 P2", f"""
WITH RECURSIVE {G.EVENTS_SQL}, {_PHASE_SQL},
m AS (SELECT e.session_id, e.turn_index AS t, CASE WHEN e.k % 10 = 3 THEN 2 WHEN e.k % 10 = 7 THEN 3 ELSE -1 END AS model,
   (e.turn_index >= 2 AND coalesce(f.Problem <= e.turn_index, false)) AS g1,
   (e.turn_index >= 5 AND coalesce(f.AutomaticThought <= e.turn_index AND f.Situation <= e.turn_index, false)) AS g2,
   (e.turn_index >= 12 AND coalesce(f.AdaptiveResponse <= e.turn_index, false)) AS g3 FROM ev e JOIN f USING (session_id)),
w AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS t, 0 AS s FROM m
  UNION ALL SELECT w.session_id, m.t, CASE WHEN greatest(least(w.s + 1, 3), m.model) <= w.s THEN w.s
     WHEN CASE greatest(least(w.s + 1, 3), m.model) WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END THEN greatest(least(w.s + 1, 3), m.model) ELSE w.s END
  FROM w JOIN m ON m.session_id = w.session_id AND m.t = w.t + 1)
SELECT session_id, t AS turn_index, list_value('Rapport', 'Exploration', 'Technique', 'Consolidation')[s + 1] AS phase FROM w WHERE t > 0""")
def phase_timeline(spark, d):
    """Phase after every turn, with a model that sometimes proposes to skip ahead."""
    ev = A.events(spark, d)
    k = F.col("k").cast("int") % 10
    turns = ev.select("session_id", "turn_index", F.when(k == 3, "Technique").when(k == 7, "Consolidation").alias("model_phase"))
    return H.phase_timeline(turns, ev.select("session_id", "label", "turn_index"))


@query("P3", f"""
WITH {G.EVENTS_SQL}
SELECT session_id, turn_index, coalesce(last_value(CASE WHEN k % 4 = 0 THEN 'technique ' || (k % 8) END IGNORE NULLS)
  OVER (PARTITION BY session_id ORDER BY turn_index ROWS UNBOUNDED PRECEDING), 'Rapport Building') AS technique FROM ev""")
def technique_carry(spark, d):
    k = F.col("k").cast("int")
    t = A.events(spark, d).select("session_id", "turn_index", F.when(
        k % 4 == 0, F.concat(F.lit("technique "), (k % 8).cast("string"))).when(k % 4 == 1, "").alias("technique"))
    return H.technique_timeline(t)


@query("P4 R3", f"WITH {G.EVENTS_SQL} SELECT session_id, turn_index FROM ev WHERE turn_index % 6 = 0")
def consolidation_turns(spark, d):
    return H.consolidation_turns(A.events(spark, d))


# ── evaluation ────────────────────────────────────────────────────────────

@query("EV1", f"""
WITH {_FLAWED_SQL}, sig_ AS (SELECT * FROM v WHERE r IS NOT NULL)
SELECT 'edge' AS kind, r AS detail, count(*) AS n FROM v WHERE r IS NOT NULL GROUP BY r
UNION ALL SELECT 'gating', 'AutomaticThought', count(*) FROM customer HAVING count(*) > 0""")
def conformance(spark, d):
    """Violations of the star graph with flawed edges; its thoughts lack the default modality."""
    g, edges = _flawed_edges(spark, d)
    return V.conformance(g.nodes, edges).groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("EV2", f"""
WITH {G.EVENTS_SQL}, g AS (SELECT session_id, label, count(*) AS n FROM ev2 GROUP BY ALL), p AS (SELECT session_id, label, count(*) AS n FROM nodes GROUP BY ALL)
SELECT label, CAST(sum(coalesce(g.n, 0)) AS BIGINT) AS n_gold, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS n_produced,
  CAST(sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS BIGINT) AS n_matched,
  round(sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) / sum(coalesce(g.n, 0)), 6) AS recall
FROM g FULL OUTER JOIN p USING (session_id, label) GROUP BY label""")
def class_recall(spark, d):
    """Recall of the merged nodes against every event as a gold node."""
    rows = G.event_rows(spark, d)
    return V.recall(G.event_nodes(rows), rows, "label")


@query("EV3", """
WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'),
n AS (SELECT DISTINCT user_id, CASE WHEN k % 2 = 0 THEN 'self' ELSE 'world' END AS domain, CASE k % 3 WHEN 0 THEN 'helpless' WHEN 1 THEN 'worthless' END AS category FROM e)
SELECT CAST(user_id AS VARCHAR) AS session_id, domain, count(DISTINCT category) AS n_categories, count(*) AS n_nodes FROM n WHERE category IS NOT NULL GROUP BY ALL""")
def distinct_categories(spark, d):
    k = F.col("k").cast("int")
    props = P.assign(empty_map(), {"domain": F.when(k % 2 == 0, "self").otherwise("world"),
                                   "category": F.when(k % 3 == 0, "helpless").when(k % 3 == 1, "worthless")})
    n = A.events(spark, d).filter("event_type = 'click'").select("session_id", props_text(props).alias("t"), props.alias("props"))
    one = n.groupBy("session_id", "t").agg(F.first("props").alias("props"))
    return V.distinct_categories(one.withColumn("label", F.lit("CoreBelief")))
