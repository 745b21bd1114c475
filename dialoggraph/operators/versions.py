"""Graph editing, overlays, op-log replay, checkpoints and conversation branches.

Nothing is updated in place: edits are rows, and a state is a query over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space
from ..session import cut
from ..sources.store import exists, merged_sessions
from .graph import edge_id, empty_map

MAX_CHECKPOINTS = 40
BRANCH_LABEL_CHARS = 48


# ── single edits ──────────────────────────────────────────────────────────

def update_nodes(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the last change per node; second result: changes to unknown nodes.

    changes: session_id, node_id, op_no, props, label, status (NULL = leave as it is).
    Properties are replaced as a whole.
    """
    last = changes.groupBy("session_id", "node_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull() & (F.lit(True) if c == "props" else F.col(c) != ""),
                             F.col("op_no"))).alias(f"_{c}") for c in ("props", "label", "status")])
    updated = nodes.join(last, ["session_id", "node_id"], "left")
    for c in ("props", "label", "status"):
        updated = updated.withColumn(c, F.coalesce(f"_{c}", c))
    unknown = changes.join(nodes.select("session_id", "node_id"), ["session_id", "node_id"], "left_anti")
    return updated.select(*nodes.columns), unknown


def without_ends(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is in ``gone`` (session_id, node_id)."""
    for end in ("subject_id", "object_id"):
        edges = edges.join(gone.select("session_id", F.col("node_id").alias(end)),
                           ["session_id", end], "left_anti")
    return edges


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and the edges that touch them."""
    return (nodes.join(gone.select("session_id", "node_id"), ["session_id", "node_id"], "left_anti"),
            without_ends(edges, gone).select(*edges.columns))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove edges by id (session_id, edge_id)."""
    return edges.join(gone.select("session_id", "edge_id"), ["session_id", "edge_id"], "left_anti")


def split_edge_id(c: Column) -> Column:
    parts = F.split(c, "__")
    return F.struct(F.get(parts, F.lit(0)).alias("subject_id"), F.get(parts, F.lit(1)).alias("predicate"),
                    F.get(parts, F.lit(2)).alias("object_id"))


def replace_graph(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Whole-graph replacement of the sessions that occur in ``incoming``."""
    kept = existing.join(incoming.select("session_id").distinct(), "session_id", "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def write_replacing(df: DataFrame, path: str) -> None:
    """Store a table by session; sessions of ``df`` are replaced, all others stay.

    Sessions are grouped into a fixed number of folders, as a folder per session would not
    scale.  The folders that ``df`` touches are read, merged, written aside, and then put
    in place of the old ones.  Columns go by name, also those that only one side has.
    ``sources.store.SessionStore`` also survives a write that is killed half way.
    """
    spark = df.sparkSession
    new = df.withColumn("bucket", session_bucket())
    if exists(spark, path):
        stored = spark.read.option("mergeSchema", "true").parquet(path)
        touched = stored.join(new.select("bucket").distinct(), "bucket", "left_semi")
        new = cut(merged_sessions(touched, new))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def session_bucket(n: int = 256) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(n)).cast("int")


# ── overlay of a corrected graph ──────────────────────────────────────────

def overlay(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame,
            new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected graph over the old one, keeping placeholders and the old order.

    Placeholders survive unless their id was supplied or, for edges, an end is gone.
    Rows known before keep their place; new ones follow in incoming order (``ord``).
    """
    def merged(old: DataFrame, new: DataFrame, key: str, kept: DataFrame) -> DataFrame:
        tail = old.groupBy("session_id").agg(F.max("ord").alias("_tail"))
        place = old.select("session_id", key, F.col("ord").alias("_place"))
        both = new.unionByName(kept.select(*new.columns))
        return (both.join(place, ["session_id", key], "left").join(tail, "session_id", "left")
                .withColumn("ord", F.coalesce("_place", F.coalesce("_tail", F.lit(0)) + 1 + F.col("ord")))
                .select(*new.columns))

    kept_nodes = old_nodes.filter("status = 'missing'").join(
        new_nodes.select("session_id", "node_id"), ["session_id", "node_id"], "left_anti")
    nodes = merged(old_nodes, new_nodes, "node_id", kept_nodes)
    live = nodes.select("session_id", "node_id")
    kept_edges = (old_edges.filter("status = 'missing'")
                  .join(new_edges.select("session_id", "edge_id"), ["session_id", "edge_id"], "left_anti")
                  .join(live.withColumnRenamed("node_id", "subject_id"), ["session_id", "subject_id"], "left_semi")
                  .join(live.withColumnRenamed("node_id", "object_id"), ["session_id", "object_id"], "left_semi"))
    return nodes, merged(old_edges, new_edges, "edge_id", kept_edges)


# ── op-log replay ─────────────────────────────────────────────────────────

def replay_ops(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after an ordered log of edits, without stepping through it.

    ops: session_id, op_no, op (add_node, update_node, delete_node, add_edge,
    delete_edge), node_id, label, props, subject_id, predicate, object_id.

    A node's last delete closes everything before it; later ops on it start afresh.  An
    edge lives if its last add comes after its last delete and after the last delete of
    either end.  All of this is "latest per key", so it is aggregation, not iteration.
    """
    node_ops = ops.filter(F.col("op").isin("add_node", "update_node", "delete_node"))
    base = nodes.select("session_id", "node_id", F.lit(-1).cast("bigint").alias("op_no"),
                        F.lit("add_node").alias("op"), "label", "props", "status", "ord")
    logged = node_ops.select("session_id", "node_id", F.col("op_no").cast("bigint").alias("op_no"), "op",
                             "label", "props", F.lit(None).cast("string").alias("status"),
                             F.lit(None).cast("bigint").alias("ord"))
    log = base.unionByName(logged)
    key = ["session_id", "node_id"]
    last_delete = log.filter("op = 'delete_node'").groupBy(*key).agg(F.max("op_no").alias("_deleted"))
    live = (log.filter("op <> 'delete_node'").join(last_delete, key, "left")
            .filter(F.col("_deleted").isNull() | (F.col("op_no") > F.col("_deleted"))))
    # an update only counts on a node that exists at that time
    born = live.filter("op = 'add_node'").groupBy(*key).agg(F.min("op_no").alias("_born"))
    live = live.join(born, key).filter(F.col("op_no") >= F.col("_born"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("op_no")))
    new_nodes = live.groupBy(*key).agg(
        newest("label").alias("label"), newest("props").alias("props"),
        F.coalesce(newest("status"), F.lit("found")).alias("status"),
        F.coalesce(F.min("ord"), F.min(F.col("op_no") + F.lit(1 << 40))).alias("ord"))

    ekey = ["session_id", "subject_id", "predicate", "object_id"]
    elog = (edges.select(*ekey, F.lit(-1).cast("bigint").alias("op_no"), F.lit("add_edge").alias("op"),
                         "props", "ord")
            .unionByName(ops.filter(F.col("op").isin("add_edge", "delete_edge")).select(
                *ekey, F.col("op_no").cast("bigint").alias("op_no"), "op", "props",
                F.lit(None).cast("bigint").alias("ord"))))
    edel = elog.groupBy(*ekey).agg(F.max(F.when(F.col("op") == "delete_edge", F.col("op_no"))).alias("_gone"))
    dead = last_delete.select("session_id", "node_id", "_deleted")
    e = (elog.filter("op = 'add_edge'").join(edel, ekey)
         .join(dead.select("session_id", F.col("node_id").alias("subject_id"), F.col("_deleted").alias("_sd")),
               ["session_id", "subject_id"], "left")
         .join(dead.select("session_id", F.col("node_id").alias("object_id"), F.col("_deleted").alias("_od")),
               ["session_id", "object_id"], "left"))
    e = e.filter(F.col("op_no") > F.greatest(F.coalesce("_gone", F.lit(-2)), F.coalesce("_sd", F.lit(-2)),
                                             F.coalesce("_od", F.lit(-2))))
    new_edges = e.groupBy(*ekey).agg(
        F.coalesce(newest("props"), empty_map()).alias("props"),
        F.coalesce(F.min("ord"), F.min(F.col("op_no") + F.lit(1 << 40))).alias("ord")).select(
        "session_id", edge_id().alias("edge_id"), "subject_id", "predicate", "object_id", "props",
        F.lit("found").alias("status"), "ord")
    return new_nodes, new_edges


# ── checkpoints and branches ──────────────────────────────────────────────

def checkpoints(turns: DataFrame, keep: int = MAX_CHECKPOINTS) -> DataFrame:
    """Turns that can be rewound to: the newest ``keep`` client turns per session.

    A checkpoint is no copy: the state before turn t is the rows with a smaller turn.
    """
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc())
    return (turns.select("session_id", "turn_index").distinct()
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
            .select("session_id", "turn_index"))


def as_of(rows: DataFrame, points: DataFrame, turn: str = "turn_index") -> DataFrame:
    """Rows as they were before a turn: points hold session_id, before_turn."""
    return rows.join(points, "session_id").filter(F.col(turn) < F.col("before_turn"))


def branch_label(turn: Column, message: Column) -> Column:
    text = collapse_space(F.coalesce(message, F.lit("")))
    cut_ = F.when(F.length(text) > BRANCH_LABEL_CHARS,
                  F.concat(F.substring(text, 1, BRANCH_LABEL_CHARS), F.lit("…"))).otherwise(text)
    head = F.concat(F.lit("turn "), turn.cast("string"))
    return F.when(cut_ == "", head).otherwise(F.concat(head, F.lit(": "), cut_))


def rewrite_turns(turns: DataFrame, edits: DataFrame, keep: int = MAX_CHECKPOINTS
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Say one turn differently: branches, their own rows, rejected edits.

    turns: session_id, branch_id, turn_index, speaker, text.  edits: session_id,
    branch_id (rewritten), new_branch_id, turn_index, message.  A turn without a
    checkpoint is rejected.  The old timeline stays what it was; the new one consists of
    its parent's rows before the turn plus its own.
    """
    client = turns.filter("speaker = 'client'").select("session_id", "branch_id", "turn_index", "text")
    w = Window.partitionBy("session_id", "branch_id").orderBy(F.col("turn_index").desc())
    points = (client.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
              .select("session_id", "branch_id", "turn_index", F.col("text").alias("_old")))
    key = ["session_id", "branch_id", "turn_index"]
    ok = edits.join(points, key)
    rejected = edits.join(points, key, "left_anti")
    branches = ok.select(
        "session_id", F.col("new_branch_id").alias("branch_id"), F.col("branch_id").alias("parent_branch_id"),
        F.col("turn_index").alias("fork_turn"), "message",
        branch_label(F.col("turn_index"), F.col("message")).alias("label"), F.lit(True).alias("active")
    ).unionByName(ok.select(
        "session_id", "branch_id", F.lit(None).cast("string").alias("parent_branch_id"),
        F.col("turn_index").alias("fork_turn"), F.col("_old").alias("message"),
        branch_label(F.col("turn_index"), F.col("_old")).alias("label"), F.lit(False).alias("active")))
    own = ok.select("session_id", F.col("new_branch_id").alias("branch_id"), "turn_index",
                    F.lit("client").alias("speaker"), F.col("message").alias("text"))
    return branches, own, rejected


def lineage(branches: DataFrame) -> DataFrame:
    """Which rows a branch sees of itself and its ancestors.

    Out: session_id, branch_id, from_branch, before_turn (NULL = no limit).  Branch depth
    is the number of rewrites of rewrites, so the loop is short; each step joins the
    written frontier with the branch table, until no branch has a further ancestor.  A
    branch that is its own ancestor is an error.
    """
    forks = branches.filter("parent_branch_id is not null").select(
        "session_id", F.col("branch_id").alias("from_branch"),
        F.col("parent_branch_id").alias("_parent"), F.col("fork_turn").cast("bigint").alias("_fork"))
    level = cut(branches.select("session_id", "branch_id", F.col("branch_id").alias("from_branch"),
                                F.lit(None).cast("bigint").alias("before_turn")).distinct())
    out = level
    while True:
        level = cut(level.join(forks, ["session_id", "from_branch"]).select(
            "session_id", "branch_id", F.col("_parent").alias("from_branch"),
            F.least("before_turn", "_fork").alias("before_turn")))
        if level.isEmpty():
            return out
        if not level.filter("from_branch = branch_id").isEmpty():
            raise ValueError("a branch is its own ancestor")
        out = out.unionByName(level)


def branch_timeline(turns: DataFrame, branches: DataFrame) -> DataFrame:
    """Turns of every branch: own rows and the visible prefix of each ancestor.

    Branches of turns that the branch table does not name see their own rows.
    """
    unnamed = turns.select("session_id", "branch_id").distinct().join(
        branches.select("session_id", "branch_id"), ["session_id", "branch_id"], "left_anti")
    seen = lineage(branches).unionByName(unnamed.select(
        "session_id", "branch_id", F.col("branch_id").alias("from_branch"),
        F.lit(None).cast("bigint").alias("before_turn")))
    rows = turns.withColumnRenamed("branch_id", "from_branch")
    return (rows.join(seen, ["session_id", "from_branch"])
            .filter(F.col("before_turn").isNull() | (F.col("turn_index") < F.col("before_turn")))
            .select("session_id", "branch_id", "turn_index", "speaker", "text"))


def switch_branch(branches: DataFrame, choice: DataFrame) -> DataFrame:
    """Make the chosen branch (session_id, branch_id) the active one of its session."""
    known = choice.join(branches.select("session_id", "branch_id"), ["session_id", "branch_id"], "left_semi")
    picked = known.select("session_id", F.col("branch_id").alias("_to"))
    return branches.join(picked, "session_id", "left").withColumn(
        "active", F.when(F.col("_to").isNull(), F.col("active")).otherwise(F.col("branch_id") == F.col("_to"))
    ).select(*branches.columns)


def editable_turns(turns: DataFrame, keep: int = MAX_CHECKPOINTS) -> DataFrame:
    """Client turns that still have a checkpoint, one row each."""
    return checkpoints(turns.filter("speaker = 'client'"), keep)


def reset_sessions(table: DataFrame, sessions: DataFrame, scaffold: DataFrame | None = None) -> DataFrame:
    """Table with the given sessions cleared, and their placeholders put back."""
    rest = table.join(sessions.select("session_id"), "session_id", "left_anti")
    if scaffold is None:
        return rest
    return rest.unionByName(scaffold.join(sessions.select("session_id"), "session_id", "left_semi")
                            .select(*table.columns))
