"""Session phases: gates, closed form, state machine with proposals, techniques."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from .ordered import TURN_BLOCKS, run_states, running

GATED = O.PHASES[1:]
REQUIRED = list(dict.fromkeys(c for p in GATED for c in O.PHASE_REQUIRES[p]))


def allowed_phase(proposed: Column, current: Column, found: Column, turn: Column) -> Column:
    """Gate for one proposal; ``found`` is the array of classes found so far."""
    index = lambda c: F.array_position(F.array(*[F.lit(p) for p in O.PHASES]), c)
    met = F.lit(True)
    for phase in GATED:
        ok = turn >= O.PHASE_MIN_TURN[phase]
        for cls in O.PHASE_REQUIRES[phase]:
            ok &= F.array_contains(found, cls)
        met = F.when(proposed == phase, ok).otherwise(met)
    known = (index(proposed) > 0) & (index(current) > 0)
    return (F.when(~known, current).when(index(proposed) <= index(current), proposed)
            .when(met, proposed).otherwise(current))


def first_found(nodes: DataFrame) -> DataFrame:
    """First turn every required class was found: session_id, one column per class."""
    return nodes.groupBy("session_id").agg(*[
        F.min(F.when(F.col("label") == c, F.col("turn_index"))).alias(c) for c in REQUIRED])


def phase_entry_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn at which each phase is entered, NULL if never; one pass of plain aggregates.

    Holds when nothing is deleted and no proposal skips ahead: one phase per turn, at the
    earliest turn that satisfies its gate, within the length of the session.
    """
    last = turns.groupBy("session_id").agg(F.max("turn_index").alias("_last"))
    f = last.join(first_found(nodes), "session_id", "left")
    reached: Column | None = None
    cols = {}
    for phase in GATED:
        needs = [F.col(c) for c in O.PHASE_REQUIRES[phase]]
        bounds = [F.lit(O.PHASE_MIN_TURN[phase]), *needs] + ([reached + 1] if reached is not None else [])
        complete = reduce(lambda a, b: a & b, [b.isNotNull() for b in bounds])
        at = F.greatest(*bounds)
        at = F.when(complete & (at <= F.col("_last")), at)
        cols[f"{phase.lower()}_turn"] = at.cast("bigint")
        reached = at
    return f.select("session_id", *[c.alias(n) for n, c in cols.items()])


def phase_timeline(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Phase after every turn, with model proposals: session_id, turn_index, phase.

    turns: session_id, turn_index, model_phase (may be NULL).  nodes: session_id, label,
    turn_index of everything found.  The proposal of a turn is the next phase, or the
    model's if that is further ahead; the gate decides.  A turn is therefore a function
    from phase to phase, and functions compose, so one long session is folded in blocks.
    """
    firsts = first_found(nodes)
    j = turns.join(firsts, "session_id", "left")
    gate_open = {}
    for i, phase in enumerate(O.PHASES):
        if i == 0:
            continue
        ok = F.col("turn_index") >= O.PHASE_MIN_TURN[phase]
        for c in O.PHASE_REQUIRES[phase]:
            ok &= F.coalesce(F.col(c) <= F.col("turn_index"), F.lit(False))
        gate_open[i] = ok
    model = F.lit(-1)
    for i, phase in enumerate(O.PHASES):
        model = F.when(F.col("model_phase") == phase, F.lit(i)).otherwise(model)
    last = len(O.PHASES) - 1
    step = []
    for cur in range(len(O.PHASES)):
        nxt = min(cur + 1, last)
        want = F.greatest(F.lit(nxt), model)
        to = F.lit(cur)
        for i, ok in gate_open.items():
            if i > cur:
                to = F.when((want == i) & ok, F.lit(i)).otherwise(to)
        step.append(to)
    stepped = j.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"),
                       F.array(*step).cast("array<int>").alias("_step"))
    states = run_states(stepped, ["session_id"], "turn_index", "_step", len(O.PHASES), "_state")
    names = F.array(*[F.lit(p) for p in O.PHASES])
    return states.select("session_id", "turn_index", F.get(names, F.col("_state")).alias("phase"))


def technique_timeline(turns: DataFrame) -> DataFrame:
    """Technique after every turn: the last one reported, else the initial one.

    turns: session_id, turn_index, technique (NULL or '' when not reported).
    """
    t = turns.withColumn("technique", F.nullif("technique", F.lit("")))
    return running(t, ["session_id"], ["turn_index"], {"_t": ("last", "technique")}, "turn_index",
                   TURN_BLOCKS).select("session_id", "turn_index", F.coalesce(
                       "_t", F.lit(O.INITIAL_TECHNIQUE)).alias("technique"))


def consolidation_turns(turns: DataFrame, every: int = O.CONSOLIDATE_EVERY) -> DataFrame:
    """Turns at which the whole-session pass runs over the transcript so far."""
    return turns.filter((F.col("turn_index") > 0) & (F.col("turn_index") % every == 0)).select(
        "session_id", "turn_index").distinct()
