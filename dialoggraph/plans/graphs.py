"""Graphs derived from the driver tables, with the SQL form of each.

*Event graph*: one session per user.  Its texts have two words, so two of them can only
be merged when they are equal; nodes are therefore plain groups here, and a test holds
them against the general merge.  *Star graph*: one single session holding every row of
five tables, which makes it the skew case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions.lookup import lookup
from ..operators.candidates import rule_candidates
from ..operators.graph import Graph, edge_id, empty_map
from ..operators.merge import node_name
from ..operators.ordered import numbered
from ..operators.turns import utterance_nodes
from ..session import cut
from . import adapters as A

# Property given to event nodes by class, and its values (picked by k modulo their number).
EVENT_PROP = {
    "Problem": ("domain", O.ENUMS[("Problem", "domain")]),
    "Situation": ("kind", O.ENUMS[("Situation", "kind")]),
    "AutomaticThought": ("distortionType", O.ENUMS[("AutomaticThought", "distortionType")]),
}
EVENT_FAMILIES = [(i, s, p, o) for i, (s, p, o) in enumerate(O.FAMILIES)
                  if {s, o} <= set(A.EVENT_LABEL.values())]


def event_props() -> Column:
    """Text and, for three classes, one property picked by k."""
    label = F.col("label")
    values = lookup_list({l: vs for l, (_, vs) in EVENT_PROP.items()}, label)
    prop = lookup({l: p for l, (p, _) in EVENT_PROP.items()}, label)
    picked = F.get(values, F.pmod(F.col("k").cast("int"), F.size(values)))
    return F.map_from_entries(F.filter(F.array(
        F.struct(P.text_prop(label).alias("key"), F.col("text").alias("value")),
        F.struct(F.coalesce(prop, F.lit("")).alias("key"), picked.alias("value"))),
        lambda e: e["value"].isNotNull()))


def lookup_list(mapping: dict[str, list[str]], key: Column) -> Column:
    """Constant lists by key."""
    entries = [x for k, vs in mapping.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))]
    return F.try_element_at(F.create_map(*entries), key)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the node each belongs to: adds node_id, head (first turn of the node)."""
    ev = A.events(spark, sf_dir)
    heads = ev.groupBy("session_id", "label", "text", "k").agg(
        F.min("turn_index").alias("head"), F.max("turn_index").alias("last_turn"))
    named = numbered(heads, ["session_id", "label"], ["head"], "node_no", "head")
    named = named.withColumn("node_id", node_name(F.col("label"), F.col("node_no")))
    return cut(ev.join(named.select("session_id", "label", "text", "head", "last_turn", "node_id"),
                       ["session_id", "label", "text"]))


def event_nodes(rows: DataFrame) -> DataFrame:
    nodes = rows.groupBy("session_id", "node_id", "label", "text", "k").agg(
        F.first("head").alias("ord"), F.first("last_turn").alias("last_turn"))
    return nodes.select("session_id", "node_id", "label", event_props().alias("props"),
                        F.lit("found").alias("status"), F.col("last_turn").cast("int").alias("turn_acquired"),
                        F.col("ord").cast("bigint").alias("ord"))


def event_links(rows: DataFrame) -> DataFrame:
    """Assertions between consecutive events whose classes have a relation."""
    relation = {f"{s}|{o}": p for _, s, p, o in reversed(EVENT_FAMILIES)}
    pred = lookup(relation, F.concat_ws("|", "s_label", "o_label"))
    a = rows.select("session_id", (F.col("turn_index") + 1).alias("turn_index"),
                    F.col("node_id").alias("subject_id"), F.col("label").alias("s_label"))
    b = rows.select("session_id", "turn_index", F.col("node_id").alias("object_id"),
                    F.col("label").alias("o_label"))
    return (a.join(b, ["session_id", "turn_index"]).withColumn("predicate", pred)
            .filter("predicate is not null")
            .select("session_id", F.col("turn_index").cast("bigint").alias("ord"), "subject_id", "predicate",
                    "object_id", empty_map().alias("props"), "turn_index"))


def event_graph(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> Graph:
    rows = event_rows(spark, sf_dir) if rows is None else rows
    links = event_links(rows)
    edges = links.groupBy("session_id", "subject_id", "predicate", "object_id").agg(F.min("ord").alias("ord"))
    edges = edges.select("session_id", edge_id().alias("edge_id"), "subject_id", "predicate", "object_id",
                         empty_map().alias("props"), F.lit("found").alias("status"), "ord")
    node_ev = rows.select("session_id", F.col("node_id").alias("owner_id"),
                          F.col("turn_index").cast("bigint").alias("pos"),
                          F.col("turn_index").cast("bigint").alias("turn_index"))
    edge_ev = links.select("session_id", edge_id().alias("owner_id"), F.col("ord").alias("pos"),
                           F.col("turn_index").cast("bigint").alias("turn_index"))
    return Graph(event_nodes(rows), edges, node_ev, edge_ev)


_LABEL_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.EVENT_LABEL.items()) + " END"
_PREFIX_CASE = "CASE label " + " ".join(f"WHEN '{l}' THEN '{O.ID_PREFIX[l]}'" for l in A.EVENT_LABEL.values()) + " END"
_PRED_CASE = "CASE " + " ".join(
    f"WHEN a.label='{s}' AND b.label='{o}' THEN '{p}'" for _, s, p, o in EVENT_FAMILIES) + " END"
_PROP_CASE = "CASE label " + " ".join(
    f"WHEN '{l}' THEN list_value({', '.join(repr(v) for v in vs)})[(k % {len(vs)}) + 1]"
    for l, (_, vs) in EVENT_PROP.items()) + " END"

# CTEs: ev (events as turns), en (events with node), nodes, links, edges.
EVENTS_SQL = f"""
ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_index,
         event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         {_LABEL_CASE} AS label FROM events),
ev2 AS (SELECT *, event_type || ' ' || CAST(k AS VARCHAR) AS text FROM ev),
heads AS (SELECT session_id, label, text, k, min(turn_index) AS head, max(turn_index) AS last_turn
          FROM ev2 GROUP BY ALL),
nodes AS (SELECT session_id, label, text, k, head AS ord, last_turn,
            {_PREFIX_CASE} || '_' || CAST(row_number() OVER (PARTITION BY session_id, label ORDER BY head) AS VARCHAR)
              AS node_id, {_PROP_CASE} AS prop
          FROM heads),
en AS (SELECT e.*, n.node_id FROM ev2 e JOIN nodes n USING (session_id, label, text)),
links AS (SELECT a.session_id, b.turn_index AS ord, a.node_id AS subject_id, {_PRED_CASE} AS predicate,
            b.node_id AS object_id FROM en a JOIN en b
            ON a.session_id = b.session_id AND b.turn_index = a.turn_index + 1
          WHERE ({_PRED_CASE}) IS NOT NULL),
edges AS (SELECT session_id, subject_id, predicate, object_id, min(ord) AS ord,
            subject_id || '__' || predicate || '__' || object_id AS edge_id
          FROM links GROUP BY session_id, subject_id, predicate, object_id)
"""


# ── star graph ────────────────────────────────────────────────────────────

STAR_CLASSES = {"orders": "Situation", "customer": "AutomaticThought", "nation": "CoreBelief",
                "region": "IntermediateBelief", "supplier": "Intervention"}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """orders -> customer -> nation -> region, supplier -> nation, all in one session.

    ``ord`` is class rank and key in one number, so it is unique and known per row
    without ranking the session.
    """
    t = lambda name: A.table(spark, sf_dir, name)
    sess = F.lit("star")

    def node(df: DataFrame, rank: int, label: str, key: str, text: Column, extra: dict[str, Column]) -> DataFrame:
        entries = [F.lit(O.TEXT_PROP[label]), text]
        for k, v in extra.items():
            entries += [F.lit(k), v]
        return df.select(sess.alias("session_id"),
                         F.concat(F.lit(O.ID_PREFIX[label] + "_"), F.col(key).cast("string")).alias("node_id"),
                         F.lit(label).alias("label"), F.create_map(*entries).alias("props"),
                         F.lit("found").alias("status"), F.lit(1).alias("turn_acquired"),
                         (F.lit(rank) * F.lit(1 << 40) + F.col(key)).cast("bigint").alias("ord"))

    def edge(df: DataFrame, rank: int, s: str, sk: str, p: str, o: str, ok: str) -> DataFrame:
        sid = F.concat(F.lit(O.ID_PREFIX[s] + "_"), F.col(sk).cast("string"))
        oid = F.concat(F.lit(O.ID_PREFIX[o] + "_"), F.col(ok).cast("string"))
        return df.select(sess.alias("session_id"), F.concat_ws("__", sid, F.lit(p), oid).alias("edge_id"),
                         sid.alias("subject_id"), F.lit(p).alias("predicate"), oid.alias("object_id"),
                         empty_map().alias("props"), F.lit("found").alias("status"),
                         (F.lit(rank) * F.lit(1 << 40) + F.col(sk)).cast("bigint").alias("ord"))

    nodes = (node(t("region"), 0, "IntermediateBelief", "r_regionkey", F.col("r_name"), {})
             .unionByName(node(t("nation"), 1, "CoreBelief", "n_nationkey", F.col("n_name"), {}))
             .unionByName(node(t("customer"), 2, "AutomaticThought", "c_custkey", F.col("c_name"),
                               {"distortionType": F.lower("c_mktsegment")}))
             .unionByName(node(t("supplier"), 3, "Intervention", "s_suppkey", F.col("s_name"), {}))
             .unionByName(node(t("orders"), 4, "Situation", "o_orderkey", F.col("o_orderpriority"),
                               {"kind": F.col("o_orderstatus")})))
    edges = (edge(t("nation"), 1, "CoreBelief", "n_nationkey", "givesRiseTo", "IntermediateBelief", "n_regionkey")
             .unionByName(edge(t("customer"), 2, "AutomaticThought", "c_custkey", "stemsFrom", "CoreBelief", "c_nationkey"))
             .unionByName(edge(t("supplier"), 3, "Intervention", "s_suppkey", "appliedTo", "CoreBelief", "s_nationkey"))
             .unionByName(edge(t("orders"), 4, "Situation", "o_orderkey", "triggers", "AutomaticThought", "o_custkey")))
    none = spark.createDataFrame([], "session_id string, owner_id string, pos bigint, turn_index bigint")
    return Graph(nodes, edges, none, none)


# CTEs: nodes (node_id, label, text, prop, ord) and edges (subject_id, predicate, object_id, edge_id, ord).
STAR_SQL = f"""
nodes AS (
  SELECT 'ib_' || r_regionkey AS node_id, 'IntermediateBelief' AS label, r_name AS text, '' AS prop, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'cb_' || n_nationkey, 'CoreBelief', n_name, '', {1 << 40} + n_nationkey FROM nation
  UNION ALL SELECT 'at_' || c_custkey, 'AutomaticThought', c_name, lower(c_mktsegment), {2 << 40} + c_custkey FROM customer
  UNION ALL SELECT 'intv_' || s_suppkey, 'Intervention', s_name, '', {3 << 40} + s_suppkey FROM supplier
  UNION ALL SELECT 'sit_' || o_orderkey, 'Situation', o_orderpriority, o_orderstatus, {4 << 40} + o_orderkey FROM orders),
edges0 AS (
  SELECT 'cb_' || n_nationkey AS subject_id, 'givesRiseTo' AS predicate, 'ib_' || n_regionkey AS object_id, {1 << 40} + n_nationkey AS ord FROM nation
  UNION ALL SELECT 'at_' || c_custkey, 'stemsFrom', 'cb_' || c_nationkey, {2 << 40} + c_custkey FROM customer
  UNION ALL SELECT 'intv_' || s_suppkey, 'appliedTo', 'cb_' || s_nationkey, {3 << 40} + s_suppkey FROM supplier
  UNION ALL SELECT 'sit_' || o_orderkey, 'triggers', 'at_' || o_custkey, {4 << 40} + o_orderkey FROM orders),
edges AS (SELECT *, subject_id || '__' || predicate || '__' || object_id AS edge_id FROM edges0)
"""


# ── dialogue graph ────────────────────────────────────────────────────────

# CTEs: turns (client turns), utts (utterances by id), sents (sentences in order), cands.
TURNS_SQL = """
msgs AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos, role, text FROM conversations),
nums AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id ORDER BY pos) AS BIGINT) AS turn_index FROM msgs),
turns AS (SELECT session_id, turn_index, CASE role WHEN 'user' THEN 'client' ELSE 'therapist' END AS speaker, text, pos
          FROM nums WHERE role IN ('user', 'assistant') AND turn_index > 0),
utts AS (SELECT session_id, turn_index, speaker, arg_max(text, pos) AS text,
           'utt_' || turn_index || CASE speaker WHEN 'client' THEN '' ELSE '_t' END AS node_id
         FROM turns GROUP BY session_id, turn_index, speaker)
"""


def sentences_sql(source: str, keys: str, name: str = "sents") -> str:
    """CTEs splitting ``text`` of ``source`` into numbered sentences (no look-behind in RE2)."""
    return rf"""
{name}_l AS (SELECT {keys}, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), '[\x1e\n]+'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS l FROM {source}),
{name} AS (SELECT {keys}, unnest(l) AS sentence, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sent_no FROM {name}_l)
"""


def _rule_sql(rule: A.Rule) -> str:
    speaker = "" if rule.speaker is None else f" AND speaker = '{rule.speaker}'"
    return (f"SELECT session_id, turn_index, speaker, sent_no, '{rule.label}' AS label, {rule.priority} AS priority, "
            f"sentence AS text FROM sents WHERE regexp_matches(lower(sentence), '{rule.pattern}'){speaker}")


CANDS_SQL = (TURNS_SQL + "," + sentences_sql("turns", "session_id, turn_index, speaker, pos")
             + ",cands AS (" + " UNION ALL ".join(_rule_sql(r) for r in A.FIXTURE_RULES) + ")")


def dialogue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_candidates(A.client_turns(spark, sf_dir), A.FIXTURE_RULES)


def dialogue_nodes(spark: SparkSession, sf_dir: str) -> Graph:
    """One node per (class, turn) that has a candidate, its first sentence as text, and
    the utterances; used where quotes matter more than merging."""
    turns = A.client_turns(spark, sf_dir)
    c = rule_candidates(turns, A.FIXTURE_RULES)
    first = c.groupBy("session_id", "label", "turn_index").agg(
        F.min_by("text", F.struct("sent_no", "speaker")).alias("text"))
    own = P.text_prop(F.col("label"))
    nodes = first.select(
        "session_id", node_name(F.col("label"), F.col("turn_index")).alias("node_id"), "label",
        F.create_map(own, F.col("text")).alias("props"), F.lit("found").alias("status"),
        F.col("turn_index").cast("int").alias("turn_acquired"),
        (F.col("turn_index") * 100 + O.label_rank()).cast("bigint").alias("ord"))
    utts = utterance_nodes(turns).withColumn("ord", F.col("ord") + F.lit(1 << 40))
    evidence = nodes.select("session_id", F.col("node_id").alias("owner_id"), F.lit(0).cast("bigint").alias("pos"),
                            F.col("turn_acquired").cast("bigint").alias("turn_index"))
    none = spark.createDataFrame([], "session_id string, edge_id string, subject_id string, predicate string, "
                                     "object_id string, props map<string,string>, status string, ord bigint")
    none_ev = spark.createDataFrame([], "session_id string, owner_id string, pos bigint, turn_index bigint")
    return Graph(nodes.unionByName(utts), none, evidence, none_ev)


_ALL_PREFIX = "CASE label " + " ".join(f"WHEN '{l}' THEN '{p}'" for l, p in O.ID_PREFIX.items()) + " END"
_RANK = "CASE label " + " ".join(f"WHEN '{l}' THEN {i}" for i, l in enumerate(O.LABELS)) + " END"
DIALOGUE_NODES_SQL = CANDS_SQL + f""",
nodes AS (SELECT session_id, label, turn_index, {_ALL_PREFIX} || '_' || turn_index AS node_id,
            arg_min(text, (sent_no, speaker)) AS text, turn_index * 100 + {_RANK} AS ord
          FROM cands GROUP BY session_id, label, turn_index)
"""
