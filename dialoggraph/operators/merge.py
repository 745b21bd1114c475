"""Entity merge: ordered greedy merge, property folding, scaffold, counts.

The merge rule is order-dependent: a candidate joins the first existing node (by
creation) of its session and label whose *current* text is similar enough, and the node's
text then becomes the candidate's.  A node's text is always some candidate's text, so a
node can never leave its connected component of the similarity graph.  Hence:

1. copies collapse to distinct token sets (pre-aggregated, any number of copies);
2. distinct sets are linked by a prefix-filtered similarity join and split into components;
3. a component with one set is one node, with no ordered work at all;
4. the others run the ordered rule inside the component, over runs of equal sets, in
   bounded blocks that hand over the nodes' current texts through a written table;
5. nodes are numbered by their first candidate, block-parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions import props as P
from ..functions.lookup import lookup
from ..functions.text import token_set
from ..session import cut
from .graph import Graph, edge_id, empty_map
from .ordered import TURN_BLOCKS, numbered, running
from .simjoin import components, cosine_pairs, distinct_sets, narrowed, similarity_links

# Similarity must exceed 3/5.
THRESHOLD = (3, 5)
# Candidates of one component handled by one task in one round.
FOLD_ROWS = 50_000

KEY = ["session_id", "label"]


@dataclass(frozen=True)
class Merged:
    """assigned: session_id, label, ord, node_no; nodes: one row per node; evidence rows."""

    assigned: DataFrame
    nodes: DataFrame
    evidence: DataFrame


def _fold_schema() -> str:
    return "session_id string, label string, root bigint, kind int, ord bigint, head bigint, state string"


def _fold_block(guarded: bool):
    """Ordered merge of one block of one component, given the state it starts from.

    Rows: kind 0 = candidate (ord, tokens, category, domain), kind 1 = node handed over.
    Out: kind 0 = assignment (ord -> head), kind 1 = node after the block.
    """
    import json

    num, den = THRESHOLD

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        head0 = (pdf["session_id"].iloc[0], pdf["label"].iloc[0], int(pdf["root"].iloc[0]))
        check = guarded and head0[1] == "CoreBelief"
        nodes = []
        for s in pdf.loc[pdf["kind"] == 1].sort_values("head")["state"]:
            h, toks, dom, cat = json.loads(s)
            nodes.append([h, frozenset(toks), dom, cat])
        out = []
        cands = pdf.loc[pdf["kind"] == 0].sort_values("ord")
        for ord_, toks, dom, cat in zip(cands["ord"], cands["tokens"], cands["domain"], cands["category"]):
            t = frozenset(toks)
            hit = None
            for n in nodes:
                common = len(t & n[1])
                if common * (num + den) > (len(t) + len(n[1])) * num:
                    if check and n[3] and cat and n[3] != cat:
                        continue
                    hit = n
                    break
            if hit is None:
                hit = [int(ord_), t, None, None]
                nodes.append(hit)
            hit[1] = t
            if check:
                hit[2] = dom or hit[2]
                hit[3] = (cat or hit[3]) if hit[2] == "self" else None
            out.append((*head0, 0, int(ord_), hit[0], None))
        for n in nodes:
            out.append((*head0, 1, None, n[0], json.dumps([n[0], sorted(n[1]), n[2], n[3]])))
        res = pd.DataFrame(out, columns=["session_id", "label", "root", "kind", "ord", "head", "state"])
        return res.astype({"root": "int64", "kind": "int32", "ord": "Int64", "head": "int64"})

    return fold


def assign_nodes(cands: DataFrame, guard_category: bool = True,
                 fold_rows: int = FOLD_ROWS, hot: int | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """session_id, label, ord, head: the ord of the first candidate of the node joined.

    cands: session_id, label, ord (unique per session and label), text, props.  A
    candidate with no token resembles nothing and is a node of its own.  ``keep`` names columns
    of the candidates that come back too, so that nobody has to look the candidates up again.
    """
    tokens = token_set(F.col("text"))
    marked = cands.select(*KEY, F.col("ord").cast("bigint").alias("ord"), tokens.alias("tokens"),
                          F.nullif(P.get_prop(F.col("props"), "domain"), F.lit("")).alias("domain"),
                          F.nullif(P.get_prop(F.col("props"), "category"), F.lit("")).alias("category"), *keep)
    # from here on a text is its digest; the words themselves exist once per distinct set
    digest = F.unhex(F.sha2(F.array_join("tokens", "\u0001"), 256))
    base = cut(marked.select(*KEY, "ord", "domain", "category", digest.alias("sig"),
                             (F.size("tokens") == 0).alias("blank"), *keep))
    sets = cut(distinct_sets(marked, KEY, "tokens", "ord").withColumn("sig", digest), "zstd")
    links = similarity_links(sets, KEY, *THRESHOLD, **({} if hot is None else {"hot": hot}))
    roots = cut(components(links, KEY).select(*KEY, F.col("id").alias("set_id"), "root"))
    linked = narrowed(sets, roots, [*KEY, "set_id"]).join(roots, [*KEY, "set_id"]).select(*KEY, "sig", "tokens", "root")
    # beliefs with categories can part company even over one text, so they are folded too
    if guard_category:
        parted = (base.filter((F.col("label") == "CoreBelief") & F.col("category").isNotNull())
                  .groupBy(*KEY, "sig").agg(F.min("category").alias("_c1"), F.max("category").alias("_c2"))
                  .filter("_c1 <> _c2").select(*KEY, "sig"))
        linked = linked.unionByName(
            sets.filter(F.col("label") == "CoreBelief").join(parted, [*KEY, "sig"], "left_semi").join(roots, [*KEY, "set_id"], "left_anti")
            .select(*KEY, "sig", "tokens", F.col("set_id").alias("root")))
    linked = cut(linked, "zstd")
    single = (sets.join(linked.select(*KEY, "sig"), [*KEY, "sig"], "left_anti")
              .select(*KEY, "sig", F.col("set_id").alias("head")))
    easy = base.filter("not blank").join(single, [*KEY, "sig"]).select(*KEY, "ord", "head", *keep)
    blank = base.filter("blank").select(*KEY, "ord", F.col("ord").alias("head"), *keep)
    hard = cut(base.join(linked.drop("tokens"), [*KEY, "sig"]))
    words = linked.select(*KEY, "sig", "tokens")
    folded = _fold(hard.drop(*keep), words, guard_category, fold_rows)
    if keep:
        folded = folded.join(hard.select(*KEY, "ord", *keep), [*KEY, "ord"])
    return easy.unionByName(blank).unionByName(folded)


def _fold(hard: DataFrame, words: DataFrame, guard_category: bool, fold_rows: int) -> DataFrame:
    """hard: candidates with the digest of their words; only a round's block gets the words themselves."""
    comp = [*KEY, "root"]
    marked = hard.withColumn("_sig", F.struct("sig", "domain", "category"))
    lagged = running(marked, comp, ["ord"], {"_prev": ("last", "_sig")}, "ord", TURN_BLOCKS,
                     inclusive=False)
    lagged = lagged.withColumn("_new_run", (~F.coalesce(F.col("_sig").eqNullSafe(F.col("_prev")),
                                                        F.lit(False))).cast("bigint"))
    runs = running(lagged, comp, ["ord"], {"_run": ("sum", "_new_run")}, "ord")
    runs = cut(runs.select(*comp, "ord", "sig", "domain", "category", "_new_run", "_run"))
    # the first row of a run decides for the run: repeating a text changes nothing
    leads = runs.filter("_new_run = 1").withColumn(
        "_round", F.expr(f"cast((_run - 1) div {fold_rows} as int)"))
    n_rounds = (leads.agg(F.max("_round")).first()[0])
    fold = _fold_block(guard_category)
    assigned, state = None, None
    for r in range((n_rounds if n_rounds is not None else -1) + 1):
        block = leads.filter(F.col("_round") == r).join(words, [*KEY, "sig"]).select(
            *comp, F.lit(0).alias("kind"), "ord", "tokens", "domain", "category",
            F.lit(None).cast("bigint").alias("head"), F.lit(None).cast("string").alias("state"))
        if state is not None:
            live = state.join(block.select(*comp).distinct(), comp, "left_semi")
            block = block.unionByName(live.select(
                *comp, F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("ord"),
                F.array().cast("array<string>").alias("tokens"),
                F.lit(None).cast("string").alias("domain"),
                F.lit(None).cast("string").alias("category"), "head", "state"))
        out = cut(block.groupBy(*comp).applyInPandas(fold, _fold_schema()))
        done = out.filter("kind = 0").select(*comp, "ord", "head")
        assigned = done if assigned is None else assigned.unionByName(done)
        state = out.filter("kind = 1").select(*comp, "head", "state")
    if assigned is None:
        return hard.select(*KEY, "ord", F.col("ord").alias("head")).limit(0)
    by_run = leads.select(*comp, "ord", "_run").join(assigned, [*comp, "ord"]).select(
        *comp, "_run", "head")
    return runs.join(by_run, [*comp, "_run"]).select(*KEY, "ord", "head")


def number_nodes(assigned: DataFrame) -> DataFrame:
    """session_id, label, head, node_no: nodes counted per class by first candidate."""
    heads = assigned.filter("ord = head").select(*KEY, "head")
    return numbered(heads, KEY, ["head"], "node_no", "head")


def node_name(label: Column, number: Column) -> Column:
    return F.concat(lookup(O.ID_PREFIX, label, F.lower(label)), F.lit("_"), number.cast("string"))


def fold_props(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Properties of a node after all its candidates, in order: keys, label, props.

    Newest non-empty value wins per property.  A gated property only survives if its gate
    has stayed open since it was set, because the gate is applied after every candidate.
    Both parts are aggregates (max_by), so a node with very many candidates is cheap.
    """
    def values(some: DataFrame) -> DataFrame:
        return some.select(*keys, "label", "ord", F.explode("props").alias("k", "v")).filter(
            F.coalesce("v", F.lit("")) != "")

    # classes without a gate are not read again for the gates
    kv, guarded = values(rows), values(rows.filter(F.col("label").isin(*[l for l, *_ in P.GATES])))
    gates = {(l, g): v for l, _, g, v in P.GATES}
    gated = {(l, p): g for l, p, g, _ in P.GATES}
    is_gate = F.lit(False)
    closes = F.lit(False)
    for (l, g), v in gates.items():
        here = (F.col("label") == l) & (F.col("k") == g)
        is_gate |= here
        closes |= here & (F.col("v") != v)
    by_label = [*keys, "label"]
    last_closed = guarded.filter(is_gate).groupBy(*by_label).agg(
        F.max(F.when(closes, F.col("ord"))).alias("_closed"))
    opened = (guarded.filter(is_gate & ~closes).join(last_closed, by_label)
              .filter(F.col("_closed").isNull() | (F.col("ord") > F.col("_closed")))
              .groupBy(*by_label).agg(F.min("ord").alias("_open")))
    is_gated = F.lit(False)
    for (l, p) in gated:
        is_gated |= (F.col("label") == l) & (F.col("k") == p)
    plain = kv.filter(~is_gated)
    kept = (guarded.filter(is_gated).join(opened, by_label).filter(F.col("ord") >= F.col("_open"))
            .select(*plain.columns))
    latest = plain.unionByName(kept).groupBy(*keys, "label", "k").agg(F.max_by("v", "ord").alias("v"))
    maps = latest.groupBy(*keys, "label").agg(F.map_from_entries(F.collect_list(
        F.struct("k", "v"))).alias("props"))
    return maps.withColumn("props", P.gate(F.col("label"), F.col("props")))


def merge(cands: DataFrame, guard_category: bool = True, fold_rows: int = FOLD_ROWS) -> Merged:
    """Merge candidates into nodes.

    cands: session_id, label, ord, text, props, turn_index.  Nodes come back as
    session_id, label, node_id, node_no, props, turn_acquired, ord (first candidate).
    """
    assigned = cut(assign_nodes(cands, guard_category, fold_rows, keep=["text", "props", "turn_index"]))
    # every candidate with its node, written once: all that follows are aggregates of this table
    full = cut(assigned.join(cut(number_nodes(assigned)), [*KEY, "head"]))
    # the text lives under the property of its class and is gated by nothing
    own = P.text_prop(F.col("label"))
    other = full.withColumn("props", F.map_filter("props", lambda k, v: (k != own) & (v != ""))).filter(F.size("props") > 0)
    props = fold_props(other, ["session_id", "head"])
    found = full.groupBy(*KEY, "head").agg(
        F.max("node_no").alias("node_no"), F.max_by("turn_index", "ord").alias("turn_acquired"),
        F.max_by("text", F.when(F.col("text") != "", F.col("ord"))).alias("_text"))
    said = F.when(own.isNotNull() & F.col("_text").isNotNull(), F.create_map(
        F.coalesce(own, F.lit("")), F.col("_text"))).otherwise(empty_map())
    nodes = (found.join(props, [*KEY, "head"], "left")
             .select("session_id", "label", node_name(F.col("label"), F.col("node_no")).alias("node_id"), "node_no",
                     F.map_concat(F.coalesce("props", P.gate(F.col("label"), empty_map())), said).alias("props"),
                     F.col("turn_acquired").cast("int").alias("turn_acquired"),
                     F.col("head").alias("ord")))
    evidence = (full.groupBy(*KEY, "head", "node_no", "turn_index").agg(F.min("ord").alias("pos"))
                .select("session_id", node_name(F.col("label"), F.col("node_no")).alias("owner_id"),
                        "pos", F.col("turn_index").cast("bigint").alias("turn_index")))
    return Merged(full.select(*KEY, "ord", "node_no"), nodes, evidence)


# ── scaffold, edges, counts ───────────────────────────────────────────────

def scaffold_nodes(sessions: DataFrame, ontology: O.Ontology) -> DataFrame:
    """One placeholder per class and session (the class list is fixed, so it is exploded)."""
    entries = F.array(*[F.struct(F.lit(i).alias("class_ord"), F.lit(l).alias("label"),
                                 F.lit(f"{ontology.id_prefix.get(l, l.lower())}_1").alias("node_id"))
                        for i, l in enumerate(O.LABELS)])
    return sessions.select("session_id", F.explode(entries).alias("c")).select(
        "session_id", "c.node_id", "c.label", empty_map().alias("props"),
        F.lit("missing").alias("status"), F.lit(None).cast("int").alias("turn_acquired"),
        F.col("c.class_ord").cast("bigint").alias("ord"))


def scaffold_edges(sessions: DataFrame, ontology: O.Ontology) -> DataFrame:
    """One placeholder edge per schema triple and session."""
    prefix = lambda l: ontology.id_prefix.get(l, l.lower())
    triples = [e for e in O.EDGE_MAP if e in ontology.families or e == O.REINFORCES
               or e not in O.FAMILIES]
    entries = F.array(*[F.struct(F.lit(i).alias("map_ord"), F.lit(f"{prefix(s)}_1").alias("s"),
                                 F.lit(p).alias("p"), F.lit(f"{prefix(o)}_1").alias("o"))
                        for i, (s, p, o) in enumerate(triples)])
    return sessions.select("session_id", F.explode(entries).alias("e")).select(
        "session_id", edge_id(F.col("e.s"), F.col("e.p"), F.col("e.o")).alias("edge_id"),
        F.col("e.s").alias("subject_id"), F.col("e.p").alias("predicate"),
        F.col("e.o").alias("object_id"), empty_map().alias("props"),
        F.lit("missing").alias("status"), F.col("e.map_ord").cast("bigint").alias("ord"))


def flip(scaffold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Found rows plus the placeholders whose id has not been taken.

    A found row that takes over a placeholder takes its place in the order as well; new
    ones come after the scaffold.
    """
    place = scaffold.select("session_id", key, F.col("ord").alias("_slot"))
    taken = found.join(place, ["session_id", key], "left").withColumn(
        "ord", F.coalesce("_slot", F.col("ord") + 1000)).select(*found.columns)
    left = scaffold.join(found.select("session_id", key), ["session_id", key], "left_anti")
    return taken.unionByName(left.select(*found.columns))


def upsert_edges(asserted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and their evidence from assertions in order.

    asserted: session_id, ord, subject_id, predicate, object_id, props, evidence turns as
    rows (turn_index may be NULL).  One edge per triple; newer properties overwrite;
    evidence keeps the order of first mention.
    """
    key = ["session_id", "subject_id", "predicate", "object_id"]
    base = asserted.groupBy(*key).agg(F.min("ord").alias("ord"))
    kv = asserted.select(*key, "ord", F.explode("props").alias("k", "v"))
    props = (kv.groupBy(*key, "k").agg(F.max_by("v", "ord").alias("v"))
             .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props")))
    edges = base.join(props, key, "left").select(
        "session_id", edge_id().alias("edge_id"), "subject_id", "predicate", "object_id",
        F.coalesce("props", empty_map()).alias("props"), F.lit("found").alias("status"), "ord")
    evidence = (asserted.filter("turn_index is not null")
                .groupBy("session_id", edge_id().alias("owner_id"), "turn_index")
                .agg(F.min("ord").alias("pos"))
                .select("session_id", "owner_id", "pos", F.col("turn_index").cast("bigint").alias("turn_index")))
    return edges, evidence


def highest_suffix(nodes: DataFrame) -> DataFrame:
    """Largest number in use per session and class, so that new ids never collide."""
    prefix = lookup(O.ID_PREFIX, F.col("label"), F.lower("label"))
    rest = F.when(F.col("node_id").startswith(F.concat(prefix, F.lit("_"))),
                  F.substr("node_id", F.length(prefix) + 2))
    number = F.when(rest.rlike(r"^\d+$"), rest.try_cast("bigint"))
    return nodes.groupBy("session_id", "label").agg(
        F.coalesce(F.max(number), F.lit(0)).cast("bigint").alias("last_no"))


def found_counts(nodes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Found nodes per class; with ``sessions`` every class of every session, zeros included."""
    counts = nodes.filter("status = 'found'").groupBy("session_id", "label").agg(
        F.count(F.lit(1)).alias("n"))
    if sessions is None:
        return counts
    grid = sessions.select("session_id", F.explode(F.array(*[F.lit(l) for l in O.LABELS])).alias("label"))
    return grid.join(counts, ["session_id", "label"], "left").select(
        "session_id", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def context_summary(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """What has emerged so far, per session: session_id, context.

    nodes: found nodes; state: session_id, phase, technique.  Five texts per class.
    """
    shown = (nodes.filter(F.col("label").isin(*O.CONTENT_LABELS))
             .select("session_id", "label", "ord", F.substring(
                 P.main_text(F.col("label"), F.col("props")), 1, 80).alias("t")).filter("t <> ''"))
    totals = shown.groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id", "label").orderBy("ord")
    five = shown.withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
    lists = five.groupBy("session_id", "label").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("_r", "t"))), lambda x: x["t"]), " | ").alias("items"))
    rows = lists.join(totals, ["session_id", "label"]).select(
        "session_id", O.label_rank().alias("r"), F.concat(
            F.lit("  "), "label", F.lit(": "), "items",
            F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"),
                                            F.lit(" more)"))).otherwise("")).alias("line"))
    body = rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return state.join(body, "session_id", "left").select("session_id", F.concat_ws(
        "\n", F.concat(F.lit("Session phase: "), "phase"),
        F.concat(F.lit("Active technique: "), "technique"),
        F.lit("What's emerged in the graph so far:"),
        F.coalesce("body", F.lit("  (nothing yet — still rapport)"))).alias("context"))


# ── entity resolution on vectors ──────────────────────────────────────────

@dataclass(frozen=True)
class Resolved:
    survivors: DataFrame  # keys, survivor, n_members
    members: DataFrame    # keys, id, survivor


def resolve_entities(vectors: DataFrame, keys: list[str], gate: float, auto: float,
                     verdicts: DataFrame | None = None, block: int = 2048) -> Resolved:
    """Entities whose vectors say the same thing, by connected components.

    vectors: keys, id, vec.  Pairs at or above ``auto`` are accepted; pairs between gate
    and auto only if ``verdicts`` (keys, a, b, same) says so.  The lowest id survives.
    """
    pairs = cut(cosine_pairs(vectors, keys, gate, block))
    accepted = pairs.filter(F.col("cos") >= auto).select(*keys, "a", "b")
    if verdicts is not None:
        unsure = pairs.filter(F.col("cos") < auto)
        judged = unsure.join(verdicts.filter("same").select(*keys, "a", "b"), [*keys, "a", "b"], "left_semi")
        accepted = accepted.unionByName(judged.select(*keys, "a", "b"))
    comp = components(accepted, keys)
    members = (vectors.select(*keys, "id").join(comp, [*keys, "id"], "left")
               .select(*keys, "id", F.coalesce("root", F.col("id")).alias("survivor")))
    survivors = members.groupBy(*keys, "survivor").agg(F.count(F.lit(1)).alias("n_members"))
    return Resolved(survivors, members)
