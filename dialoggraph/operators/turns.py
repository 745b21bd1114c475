"""Turn preparation: speakers, windows, chunks, utterances, transcript views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology as O
from ..functions.lookup import lookup
from ..functions.text import cut_text, strip
from ..session import cut
from .ordered import TURN_BLOCKS, numbered, running

TRANSCRIPT_TURNS = 60
TRANSCRIPT_CHARS = 400
CHAR_BUDGET = 14000
TURN_OVERLAP = 5


def normal_speaker(c: Column) -> Column:
    """client / patient / therapist spellings to the two speakers; others unchanged."""
    return lookup(O.SPEAKERS, F.lower(strip(c)), c)


def speaker_tag(c: Column) -> Column:
    return F.when(c == "therapist", "T").otherwise("C")


def rendered_line(turn: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("turn "), turn.cast("string"), F.lit(" | "), speaker_tag(speaker),
                    F.lit(": "), text)


def client_turn_numbers(messages: DataFrame, name: str = "client_turn") -> DataFrame:
    """Running number of user messages at every message position.

    Counted, not computed from the position: a session may open with an introduction
    and a failed reply leaves no message.
    """
    flagged = messages.withColumn("_is_user", (F.col("role") == "user").cast("bigint"))
    return running(flagged, ["session_id"], ["pos"], {name: ("sum", "_is_user")},
                   "pos").drop("_is_user")


def evidence_window(evidence: DataFrame, turns: DataFrame, width: int = 1) -> DataFrame:
    """Turns within ``width`` of an evidence turn, by index value, once per owner.

    evidence: session_id, owner_id, turn_index.  Missing indices are skipped.  A turn
    row can be claimed by several owners, so the equi-join runs on (session, turn).
    """
    wanted = (evidence.select(
        "session_id", "owner_id",
        F.explode(F.sequence(F.col("turn_index") - width, F.col("turn_index") + width))
        .alias("turn_index")).distinct())
    return wanted.join(turns, ["session_id", "turn_index"]).select(
        "session_id", "owner_id", "turn_index", speaker_tag(F.col("speaker")).alias("tag"), "text")


# Most turns rendered into one text.
WINDOW_TURNS = 4096


def render_windows(window: DataFrame, owners: DataFrame, max_turns: int = WINDOW_TURNS) -> DataFrame:
    """Window texts: session_id, owner_id, piece, context; '(none)' where nothing was found.

    An owner with more turns than fit one text gets further pieces, so that no task has
    to hold an unbounded window.
    """
    placed = numbered(window, ["session_id", "owner_id"], ["turn_index"], "_n", "turn_index")
    texts = placed.groupBy("session_id", "owner_id", F.expr(f"(_n - 1) div {int(max_turns)}").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct(
            "turn_index",
            F.concat(F.lit("turn "), F.col("turn_index").cast("string"), F.lit(" | "),
                     F.col("tag"), F.lit(": "), F.col("text")).alias("line")))).alias("_l"))
    joined = owners.select("session_id", "owner_id").join(texts, ["session_id", "owner_id"], "left")
    return joined.select("session_id", "owner_id", F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"),
                         F.coalesce(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"),
                                    F.lit("(none)")).alias("context"))


def exchanges(turns: DataFrame) -> DataFrame:
    """One row per client turn with the therapist's last reply ('' when there is none).

    Several texts of a turn are told apart by ``pos`` where turns have it.
    """
    order = F.struct("pos", "text") if "pos" in turns.columns else F.struct("text")

    def last_of(speaker: str) -> Column:
        mine = (F.col("speaker") == speaker) & F.col("text").isNotNull()
        return F.max_by(F.when(mine, F.col("text")), F.when(mine, order))

    return turns.groupBy("session_id", "turn_index").agg(
        last_of("client").alias("client_text"), F.coalesce(last_of("therapist"), F.lit("")).alias("reply")
    ).filter(F.col("client_text").isNotNull())


def recent_exchanges(pairs: DataFrame, n: int = 2) -> DataFrame:
    """For every client turn the last ``n`` completed exchanges before it.

    A completed exchange of rank r is wanted by the turns that have seen r .. r+n-1
    completed exchanges, so the lookup is an equi-join on (session, number seen).
    """
    done = pairs.withColumn("_done", (F.col("reply") != "").cast("bigint"))
    seen = running(done, ["session_id"], ["turn_index"], {"_seen": ("sum", "_done")},
                   "turn_index")
    seen = seen.withColumn("_before", F.col("_seen") - F.col("_done"))
    offered = seen.filter("_done = 1").select(
        "session_id", F.explode(F.sequence(F.col("_seen"), F.col("_seen") + (n - 1)))
        .alias("_before"),
        F.col("turn_index").alias("prior_turn"), F.col("client_text").alias("prior_client"),
        F.col("reply").alias("prior_reply"))
    return (seen.select("session_id", "turn_index", "_before")
            .join(offered, ["session_id", "_before"])
            .select("session_id", "turn_index", "prior_turn", "prior_client", "prior_reply"))


def utterances(turns: DataFrame) -> DataFrame:
    """One Utterance node per (turn, speaker); a later row of the same id replaces it."""
    ident = F.when(F.col("speaker") == "client",
                   F.concat(F.lit("utt_"), F.col("turn_index").cast("string"))).otherwise(
        F.concat(F.lit("utt_"), F.col("turn_index").cast("string"), F.lit("_t")))
    order = F.col("pos") if "pos" in turns.columns else F.col("turn_index")
    latest = turns.groupBy("session_id", ident.alias("node_id")).agg(
        F.max_by(F.struct("turn_index", "speaker", "text"), order).alias("u"))
    return latest.select("session_id", "node_id", F.col("u.turn_index").alias("turn_index"),
                         F.col("u.speaker").alias("speaker"), F.col("u.text").alias("text"))


def utterance_nodes(turns: DataFrame) -> DataFrame:
    """Utterances in the shape of graph nodes."""
    u = utterances(turns)
    return u.select(
        "session_id", "node_id", F.lit("Utterance").alias("label"),
        F.create_map(F.lit("text"), F.col("text"), F.lit("speaker"), F.col("speaker"),
                     F.lit("turnIndex"), F.col("turn_index").cast("string")).alias("props"),
        F.lit("found").alias("status"), F.col("turn_index").cast("int").alias("turn_acquired"),
        (F.col("turn_index") * 2 + F.when(F.col("speaker") == "client", 0).otherwise(1))
        .cast("bigint").alias("ord"))


def chat_messages(turns: DataFrame, system: str | None = None) -> DataFrame:
    """Role / content rows of a chat: system first, empty replies left out.

    The rows carry their order; callers that need one array per session build it for
    the bounded window they send (see ``recent_exchanges``), never for whole sessions.
    """
    rows = turns.select(
        "session_id",
        (F.col("turn_index") * 2 + F.when(F.col("speaker") == "client", 0).otherwise(1))
        .cast("bigint").alias("msg_ord"),
        F.when(F.col("speaker") == "client", "user").otherwise("assistant").alias("role"),
        F.col("text").alias("content"))
    rows = rows.filter((F.col("role") == "user") | (F.col("content") != ""))
    if system is None:
        return rows
    heads = turns.select("session_id").distinct().select(
        "session_id", F.lit(-1).cast("bigint").alias("msg_ord"), F.lit("system").alias("role"),
        F.lit(system).alias("content"))
    return heads.unionByName(rows)


def corpus_profile(turns: DataFrame) -> DataFrame:
    return turns.groupBy("speaker").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


def transcript_view(utts: DataFrame, max_turns: int = TRANSCRIPT_TURNS,
                    max_chars: int = TRANSCRIPT_CHARS) -> DataFrame:
    """Dialogue of the last ``max_turns`` distinct turn numbers, client first in a turn.

    dense_rank <= k is pushed below the shuffle as a per-partition group limit, so a
    large session contributes at most k turns per partition.
    """
    w = Window.partitionBy("session_id").orderBy(F.col("turn_index").desc())
    return (utts.filter(F.coalesce(F.col("text"), F.lit("")) != "")
            .withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= max_turns)
            .select("session_id", "turn_index",
                    F.coalesce(F.nullif("speaker", F.lit("")), F.lit("unknown")).alias("speaker"),
                    F.when(F.col("speaker") == "client", 0).otherwise(1).alias("speaker_ord"),
                    cut_text(F.col("text"), max_chars).alias("text")))


def batches(df: DataFrame, keys: list[str], order: list[str], pos: str, size: int) -> DataFrame:
    """Fixed-size batches per key with a 1-based item number inside the batch."""
    out = numbered(df, keys, order, "_n", pos)
    return out.select(
        *df.columns, F.expr(f"(_n - 1) div {size}").alias("batch"),
        ((F.col("_n") - 1) % size + 1).cast("int").alias("item"))


def first_turns(turns: DataFrame, n: int) -> DataFrame:
    """Only the first ``n`` positions of every transcript."""
    return turns.filter(F.col("turn_index") < n)


def chunk_ranges(turns: DataFrame, budget: int = CHAR_BUDGET,
                 overlap: int = TURN_OVERLAP) -> DataFrame:
    """Overlapping turn ranges whose rendering fits ``budget``, by repeated halving.

    turns: session_id, turn_index (0-based, dense), speaker, text.  Returns session_id,
    chunk (in reading order), lo, hi (exclusive).  Running line lengths are computed
    once; every halving round looks up its bounds by (session, position), and rounds
    only continue for the ranges that are still too long.
    """
    line = F.length(rendered_line(F.col("turn_index"), F.col("speaker"), F.col("text")))
    sized = turns.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"),
                         line.cast("bigint").alias("_len"))
    prefix = running(sized, ["session_id"], ["turn_index"], {"_sum": ("sum", "_len")},
                     "turn_index").select("session_id", F.col("turn_index").alias("_at"), "_sum")
    whole = sized.groupBy("session_id").agg(
        (F.max("turn_index") + 1).alias("hi"), F.sum("_len").alias("_chars"))
    # path: 0 for the left half, 1 for the right; sorting paths gives the reading order
    pending = whole.select("session_id", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("lo"),
                           "hi", (F.col("_chars") + F.col("hi") - 1).alias("chars"))
    fits = (F.col("chars") <= budget) | (F.col("hi") - F.col("lo") <= 2 * overlap + 1)
    done = pending.filter(fits)
    pending = cut(pending.filter(~fits))
    if not pending.isEmpty():
        prefix = cut(prefix)
    while not pending.isEmpty():
        mid = F.expr("(hi - lo) div 2")
        halves = pending.select("session_id", F.explode(F.array(
            F.struct(F.concat("path", F.lit("0")).alias("path"), F.col("lo").alias("lo"),
                     F.least(F.col("lo") + mid + overlap, F.col("hi")).alias("hi")),
            F.struct(F.concat("path", F.lit("1")).alias("path"),
                     (F.col("lo") + F.greatest(F.lit(0).cast("bigint"), mid - overlap)).alias("lo"),
                     F.col("hi").alias("hi")))).alias("h")).select("session_id", "h.*")
        ends = prefix.select("session_id", (F.col("_at") + 1).alias("hi"), F.col("_sum").alias("_upto"))
        starts = prefix.select("session_id", (F.col("_at") + 1).alias("lo"), F.col("_sum").alias("_before"))
        measured = (halves.join(ends, ["session_id", "hi"])
                    .join(starts, ["session_id", "lo"], "left")
                    .select("session_id", "path", "lo", "hi",
                            (F.col("_upto") - F.coalesce("_before", F.lit(0))
                             + F.col("hi") - F.col("lo") - 1).alias("chars")))
        measured = cut(measured)
        done = done.unionByName(measured.filter(fits))
        pending = measured.filter(~fits)
    done = done.filter("hi > 0")
    # pieces of one session are few (its length over the budget); their order is the path
    ranked = done.withColumn("_first", F.col("lo"))
    return numbered(ranked, ["session_id"], ["path"], "chunk", "_first").select(
        "session_id", (F.col("chunk") - 1).alias("chunk"), "lo", "hi", "chars")


def render_chunks(turns: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rendered text of every chunk; a chunk is bounded by the character budget."""
    spread = ranges.select("session_id", "chunk",
                           F.explode(F.sequence("lo", F.col("hi") - 1)).alias("turn_index"))
    rows = spread.join(turns, ["session_id", "turn_index"])
    return rows.groupBy("session_id", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "turn_index",
            rendered_line(F.col("turn_index"), F.col("speaker"), F.col("text")).alias("line")))),
            lambda x: x["line"]), "\n").alias("transcript"))
