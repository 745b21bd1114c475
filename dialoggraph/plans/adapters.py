"""Driver tables as canonical dialogue-graph tables.

The texts of these tables are invented, so the rule pack below exercises mechanics on
words that occur in them; it has no clinical meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import lookup
from ..operators.ordered import TIME_BLOCKS, numbered, one_block
from ..operators.turns import client_turn_numbers
from ..session import cut, spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, pos, role, text."""
    return spread_small(table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"),
        "role", "text")


def speaker_of_role(role=None):
    role = F.col("role") if role is None else role
    return F.when(role == "user", "client").when(role == "assistant", "therapist").otherwise(role)


def positioned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript form: the turn index is the position in the file."""
    return messages(spark, sf_dir).select(
        "session_id", F.col("pos").alias("turn_index"), speaker_of_role().alias("speaker"), "text")


def client_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live form: both speakers share the number of the client's turn."""
    numbered_msgs = client_turn_numbers(messages(spark, sf_dir), "turn_index")
    return cut(numbered_msgs.filter(F.col("role").isin("user", "assistant")).filter(
        "turn_index > 0").select("session_id", "turn_index", speaker_of_role().alias("speaker"),
                                 "text", "pos"))


@dataclass(frozen=True)
class Rule:
    """One extraction rule: a sentence of ``speaker`` matching ``pattern`` is a ``label``."""

    label: str
    speaker: str | None
    pattern: str
    priority: int


def word(w: str) -> str:
    return f"(^|[^a-z]){w}([^a-z]|$)"


# Words that occur in the invented text of the test tables.
FIXTURE_RULES = [
    Rule("Problem", "client", word("that"), 1),
    Rule("Situation", "client", word("was"), 2),
    Rule("AutomaticThought", "client", word("with"), 3),
    Rule("Reaction", "client", word("from"), 4),
    Rule("CoreBelief", "client", word("this"), 5),
    Rule("IntermediateBelief", "client", word("des"), 6),
    Rule("Goal", None, word("pour"), 7),
    Rule("Intervention", "therapist", word("the"), 8),
    Rule("Homework", "therapist", word("und"), 9),
    Rule("AdaptiveResponse", None, word("los"), 10),
]

# Event type -> class of the event graph.
EVENT_LABEL = {"error": "Problem", "view": "Situation", "click": "AutomaticThought",
               "purchase": "AdaptiveResponse", "signup": "Goal"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a turn: session = user, turn = order in time, label by type.

    The numbered table is written once; everything built on it reads that table.

    event_id, session_id, turn_index, label, text, event_type, value.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").alias("k"))
    e = one_block(e.withColumn("_pos", F.unix_micros("ts")), ["session_id"], "_pos")
    e = numbered(e, ["session_id"], ["ts", "event_id"], "turn_index", "_pos", TIME_BLOCKS)
    return cut(e.select("event_id", "session_id", "turn_index",
                        lookup(EVENT_LABEL, F.col("event_type")).alias("label"),
                        F.concat_ws(" ", "event_type", "k").alias("text"), "event_type", "value", "k"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents"))
