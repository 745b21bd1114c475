"""Turns as a stream: ordered merge, properties, edges, phase and technique per session, in keyed state.

Turns of one session are applied in the order of their numbers.  State is pages of nodes, edges, turns
that wait and ranges of numbers that were passed over: each look into the state is a call to the JVM,
so a row is a few dozen of them, and a turn writes a few pages of a large session, not one document.

* Order: a turn that follows the last one applied is applied at once; others wait.
* First number and gaps come from the data: what waits is applied, in order, when ``patience`` has
  passed since it arrived (a timer on the arrival time's watermark), or at once when a turn closes
  the session.  Nothing waits for ever.
* Late turns: a turn whose number was passed over is worked in when it comes and marked ``late``;
  it corrects the graph, not the phases and techniques that were reported meanwhile.
* Repeats: a number that waits or was applied is ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import ontology as O
from ..functions import props as P
from ..operators.merge import THRESHOLD
from ..operators.phases import consolidation_turns

# One row per turn: what was found in it and what the model reported.  Optional further columns:
# candidates may carry ``props`` (a map); ``links``, ``arrived`` (when the turn came in) and ``closes``.
TURN_SCHEMA = ("session_id string, turn_index bigint, candidates array<struct<label:string,text:string>>, "
               "technique string, model_phase string")
# A link: the candidate of this turn (from 1), a predicate, and a node by class and number.
LINK = "struct<subject:int,predicate:string,object_label:string,object:int,reported_intensity:string>"
ENTRIES = "array<struct<key:string,value:string>>"
CANDIDATES = f"array<struct<label:string,text:string,props:{ENTRIES}>>"
OUT_ROW = ("turn_index bigint, place bigint, late boolean, phase string, technique string, n_before bigint, kind string, label string, "
           "node_id string, object_id string, text string, props map<string,string>")
OUT_SCHEMA = f"session_id string, {OUT_ROW}"
# Rows that come back as one text: a row of several columns costs Python many times what it holds.
OUT_ROWS = 512
# Nodes and edges of a page, in the order in which they came; numbers of turns and of passed-over ranges to a page.
PAGE, TURN_PAGE, GAP_PAGE = 64, 32, 256
LOWEST = -(1 << 62)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _gated(label: str, props: dict[str, str]) -> dict[str, str]:
    """The column form's rule (``functions.props.gate``) for the one node in hand."""
    shut = {prop for lab, prop, key, value in P.GATES if lab == label and props.get(key, "") != value}
    kept = {k: v for k, v in props.items() if k not in shut}
    return {key: value for lab, key, value in P.DEFAULTS if lab == label} | kept


def _paged(table) -> Iterator[list]:
    """What the pages of a table hold, in order."""
    for _, rows in sorted((k[0], v[0]) for k, v in table.iterator()):
        yield from json.loads(rows)


class _Node:
    __slots__ = ("label", "number", "at", "text", "tokens", "props")

    def __init__(self, label: str, number: int, at: int, text: str = "", props: dict[str, str] | None = None):
        self.label, self.number, self.at, self.props = label, number, at, props or {}
        self.say(text, set(text.lower().split()))

    def say(self, text: str, tokens: set[str]) -> None:
        self.text, self.tokens = text, tokens


class _Session:
    """What the state holds of one session; at the end of a call the pages that changed are written.

    A new session looks once, tables that the head says are empty are not looked into, and nodes and
    edges are read only if a turn is applied.
    """

    def __init__(self, p: TurnProcessor):
        self.p = p
        self.stored_head = p.head.get()
        self.known = self.stored_head is not None
        self.last, self.place, self.phase, self.technique, *held = self.stored_head or (None, 0, 0, O.INITIAL_TECHNIQUE)
        waits, passed = held or (True, True)
        self.early = {turn: row for turn, row in _paged(p.early)} if self.known and waits else {}
        self.gaps = {low: high for low, high in _paged(p.gaps)} if self.known and passed else {}
        self.stored = {"early": {t // TURN_PAGE for t in self.early}, "gaps": {low // GAP_PAGE for low in self.gaps}}
        self.late: list[tuple[int, tuple]] = []
        # Pages that differ from the state, by table.
        self.changed = {name: set() for name in ("nodes", "edges", "early", "gaps")}
        self.arrivals: set[int] = set()

    @cached_property
    def order(self) -> list[_Node]:
        """All nodes as they came."""
        found = _paged(self.p.nodes) if self.known else ()
        return [_Node(label, number, at, text, dict(props)) for at, (label, number, text, props) in enumerate(found)]

    @cached_property
    def nodes(self) -> dict[str, list[_Node]]:
        nodes: dict[str, list[_Node]] = {}
        for node in self.order:
            nodes.setdefault(node.label, []).append(node)
        return nodes

    @cached_property
    def edges(self) -> dict[tuple, list]:
        """Place and intensity of each edge, as they came."""
        found = _paged(self.p.edges) if self.known else ()
        return {(s, o, predicate): [at, intensity] for at, (s, o, predicate, intensity) in enumerate(found)}

    def take(self, turn: int, row: tuple) -> None:
        """Let a turn wait, or note it as late; ignore it if it is known."""
        if self.last is None or turn > self.last:
            if turn not in self.early:
                self.early[turn] = row
                self.arrivals.add(row[0])
                self.changed["early"].add(turn // TURN_PAGE)
            return
        low = next((a for a, b in self.gaps.items() if a <= turn <= b), None)
        if low is None:
            return
        high = self.gaps.pop(low)
        self.changed["gaps"].add(low // GAP_PAGE)
        for a, b in ((low, turn - 1), (turn + 1, high)):
            if a <= b:
                self._passed_over(a, b)
        self.late.append((turn, row))

    def _passed_over(self, low: int, high: int) -> None:
        self.gaps[low] = high
        self.changed["gaps"].add(low // GAP_PAGE)

    def run(self, key: tuple, flush: int | None) -> Iterator[dict]:
        """Apply late turns, then what is in order or to be flushed up to a number."""
        for turn, row in sorted(self.late, key=lambda x: x[0]):
            yield from self._applied(turn, row, True)
        for turn in sorted(self.early):
            due = self.p.first if self.last is None else self.last + 1
            if not ((due is not None and turn <= due) or (flush is not None and turn <= flush)):
                break
            low = LOWEST if self.last is None else self.last + 1
            if low < turn:
                self._passed_over(low, turn - 1)
            row = self.early.pop(turn)
            self.changed["early"].add(turn // TURN_PAGE)
            self.last = turn
            yield from self._applied(turn, row, False)
        self._write()

    def _write(self) -> None:
        p = self.p
        head = (self.last, self.place, self.phase, self.technique, bool(self.early), bool(self.gaps))
        if not self.known or head[:len(self.stored_head)] != tuple(self.stored_head):
            p.head.update(head)
        for page in self.changed["nodes"]:
            rows = [(n.label, n.number, n.text, sorted(n.props.items())) for n in self.order[page * PAGE:(page + 1) * PAGE]]
            p.nodes.updateValue((page,), (json.dumps(rows),))
        edges = list(self.edges.items()) if self.changed["edges"] else []
        for page in self.changed["edges"]:
            p.edges.updateValue((page,), (json.dumps([(*key, v[1]) for key, v in edges[page * PAGE:(page + 1) * PAGE]]),))
        for name, size in (("early", TURN_PAGE), ("gaps", GAP_PAGE)):
            pages: dict[int, list] = {page: [] for page in self.changed[name]}
            for key, value in getattr(self, name).items() if pages else ():
                if key // size in pages:
                    pages[key // size].append((key, value))
            for page, rows in pages.items():
                if rows:
                    getattr(p, name).updateValue((page,), (json.dumps(rows),))
                elif page in self.stored[name]:
                    getattr(p, name).removeKey((page,))
        # One timer for all turns that came at one time.
        for arrived in self.arrivals & {row[0] for row in self.early.values()}:
            p.handle.registerTimer(arrived + p.patience)

    def _applied(self, turn: int, row: tuple, late: bool) -> Iterator[dict]:
        """``n_before`` counts the nodes that the reply of this turn could know about: the state
        before the turn's own words were worked in."""
        said = json.loads(row[1])
        before, rows, own = len(self.order), [], []
        for c in said["candidates"] or []:
            label, text = c["label"], c["text"]
            node = self._merged(label, text, {e["key"]: e["value"] for e in c["props"] or [] if e["value"]})
            own.append((label, node.number))
            rows.append(("node", label, f"{O.ID_PREFIX[label]}_{node.number}", None, text, dict(sorted(node.props.items()))))
        for link in said["links"] or []:
            subject, predicate, object_label, number, intensity = link.values()
            if 1 <= subject <= len(own) and self._linked(own[subject - 1], predicate, object_label, number, intensity):
                a, b = own[subject - 1], (object_label, number)
                rows.append(("edge", predicate, *[f"{O.ID_PREFIX[l]}_{n}" for l, n in (a, b)], intensity, None))
        if not late:
            self.technique = said["technique"] or self.technique
            self._advance(turn, said["model_phase"])
        self.place += 1
        for kind, label, node_id, object_id, text, props in rows or [("turn", None, None, None, None, None)]:
            yield {"turn_index": turn, "place": self.place, "late": late, "phase": O.PHASES[self.phase], "technique": self.technique,
                   "n_before": before, "kind": kind, "label": label, "node_id": node_id, "object_id": object_id, "text": text, "props": props}

    def _merged(self, label: str, text: str, props: dict[str, str]) -> _Node:
        """The first node of the class whose latest text is similar and whose category agrees, or a new one."""
        num, den = THRESHOLD
        tokens, nodes = set(text.lower().split()), self.nodes.setdefault(label, [])
        size = len(tokens)
        for node in nodes if tokens else ():
            other = node.tokens
            if len(tokens & other) * (num + den) > (size + len(other)) * num:
                a, b = node.props.get("category"), props.get("category")
                if label == "CoreBelief" and a and b and a != b:
                    continue
                break
        else:
            node = _Node(label, len(nodes) + 1, len(self.order))
            nodes.append(node)
            self.order.append(node)
            self.changed["nodes"].add(node.at // PAGE)
        gated = _gated(label, node.props | props)
        if text != node.text or gated != node.props:
            node.say(text, tokens)
            node.props = gated
            self.changed["nodes"].add(node.at // PAGE)
        return node

    def _linked(self, subject: tuple[str, int], predicate: str, label: str, number: int, intensity: str | None) -> bool:
        if (subject[0], predicate, label) not in self.p.signatures or not 1 <= number <= len(self.nodes.get(label, [])):
            return False
        key = (*[f"{O.ID_PREFIX[l]}_{n}" for l, n in (subject, (label, number))], predicate)
        if key[0] == key[1]:
            return False
        edge = self.edges.get(key)
        if edge is None:
            edge = self.edges[key] = [len(self.edges), intensity or None]
        elif not intensity or intensity == edge[1]:
            return True
        else:
            edge[1] = intensity
        self.changed["edges"].add(edge[0] // PAGE)
        return True

    def _advance(self, turn: int, model_phase: str | None) -> None:
        nxt = min(self.phase + 1, len(O.PHASES) - 1)
        want = max(nxt, O.PHASES.index(model_phase) if model_phase in O.PHASES else -1)
        if want > self.phase:
            name = O.PHASES[want]
            if turn >= O.PHASE_MIN_TURN[name] and all(self.nodes.get(c) for c in O.PHASE_REQUIRES[name]):
                self.phase = want


def _packed(key: tuple, rows: Iterator[dict]) -> Iterator[Row]:
    for some in batched(rows, OUT_ROWS):
        yield Row(session_id=key[0], rows=json.dumps(some))


class TurnProcessor(StatefulProcessor):
    """first: number of a session's first turn, if it is known; patience: milliseconds."""

    def __init__(self, first: int | None, patience: int, signatures: set[tuple[str, str, str]]):
        self.first, self.patience, self.signatures = first, patience, signatures

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last bigint, place bigint, phase int, technique string, waits boolean, passed boolean")
        for name in ("nodes", "edges", "early", "gaps"):
            setattr(self, name, handle.getMapState(f"{name}_pages", "page bigint", "rows string"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        session, flush = _Session(self), None
        for r in rows:
            session.take(r.turn_index, (r.arrived_ms, r.said))
            if r.closes:
                flush = 1 << 62
        yield from _packed(key, session.run(key, flush))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session, now = _Session(self), expiredTimerInfo.getExpiryTimeInMs()
        waited = [turn for turn, row in session.early.items() if row[0] + self.patience <= now]
        if waited:
            yield from _packed(key, session.run(key, max(waited)))

    def close(self) -> None:
        pass


def turn_stream(turns: DataFrame, first: int | None = 1, patience: str = "10 minutes",
                ontology: O.Ontology | None = None) -> DataFrame:
    """Nodes, edges, phase and technique per applied turn; see TURN_SCHEMA and OUT_SCHEMA.

    ``place`` numbers the turns of a session as they were applied.  The stream needs the RocksDB
    state store (``start_turns`` sees to that).
    """
    have, onto = set(turns.columns), ontology or O.Ontology.of()
    if "arrived" not in have:
        turns = turns.withColumn("arrived", F.current_timestamp())
    for name, kind in (("links", f"array<{LINK}>"), ("closes", "boolean")):
        if name not in have:
            turns = turns.withColumn(name, F.lit(None).cast(kind))
    with_props = "props" in turns.schema["candidates"].dataType.elementType.names
    none = F.lit(None).cast(ENTRIES)
    candidates = F.transform("candidates", lambda c: F.struct(
        c["label"].alias("label"), c["text"].alias("text"), (F.map_entries(c["props"]) if with_props else none).alias("props")))
    # What was said is one text, which waits as it is until its turn is applied.
    said = F.to_json(F.struct(candidates.cast(CANDIDATES).alias("candidates"), F.col("links").cast(f"array<{LINK}>").alias("links"),
                              F.nullif("technique", F.lit("")).alias("technique"), "model_phase"), {"ignoreNullFields": "false"})
    rows = turns.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"), "arrived", F.unix_millis("arrived").alias("arrived_ms"),
                        "closes", said.alias("said")).withWatermark("arrived", "0 seconds")
    # Arrival times never run back, so no turn is late for the watermark, however old its number.
    signatures = {tuple(f) for f in [*onto.families, O.REINFORCES]}
    out = rows.groupBy("session_id").transformWithState(
        TurnProcessor(first, _milliseconds(patience), signatures), "session_id string, rows string", "Append", "EventTime")
    return out.select("session_id", F.explode(F.from_json("rows", f"array<struct<{OUT_ROW}>>")).alias("r")).select("session_id", "r.*")


_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(float(number) * _UNITS[unit.rstrip("s")])


# Turns of a session whose utterances are one value of the state: each look into it is a call to the JVM.
UTTERANCE_TURNS = 32


class Utterances(StatefulProcessor):
    """The last text of each utterance of a few turns; an utterance goes when ``keep`` has passed since it came."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.texts = handle.getValueState("texts", "known array<struct<node_id:string,arrived:bigint,text:string,version:bigint>>")

    def _known(self) -> dict[str, tuple]:
        stored = self.texts.get()
        return {u[0]: (u[1], u[2], u[3]) for u in stored[0]} if stored else {}

    def _keep(self, known: dict[str, tuple]) -> None:
        self.texts.update(([(node, *value) for node, value in known.items()],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, last = self._known(), {}
        for r in rows:
            at = (r.arrived_ms, r.text or "")
            if r.node_id not in last or at > last[r.node_id][0]:
                last[r.node_id] = (at, r)
        timers = set()
        for node, (_, r) in last.items():
            arrived, text, version = known.get(node, (None, None, 0))
            if arrived is not None and r.arrived_ms < arrived:
                continue
            changed = arrived is None or text != r.text
            known[node] = (r.arrived_ms, r.text, version + changed)
            timers.add(r.arrived_ms + self.keep)
            if changed:
                yield Row(session_id=key[0], node_id=node, turn_index=r.turn_index, speaker=r.speaker, text=r.text,
                          version=version + changed)
        if timers:
            self._keep(known)
        for at in timers:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, now = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        left = {node: value for node, value in known.items() if value[0] + self.keep > now}
        if known and not left:
            self.texts.clear()
        elif len(left) < len(known):
            self._keep(left)
        return iter(())

    def close(self) -> None:
        pass


def utterance_stream(turns: DataFrame, keep: str = "1 day") -> DataFrame:
    """Utterance rows of a stream of turns: a new version of an id whenever its text changes.

    Of rows with one id the last to arrive counts (``arrived``; of equal times the largest text).  An
    id is forgotten when nothing came for ``keep``; ``latest`` picks the versions that count.
    """
    if "arrived" not in turns.columns:
        turns = turns.withColumn("arrived", F.current_timestamp())
    node = F.concat(F.lit("utt_"), F.col("turn_index").cast("string"),
                    F.when(F.col("speaker") == "client", "").otherwise("_t"))
    rows = turns.select("session_id", node.alias("node_id"), F.col("turn_index").cast("bigint").alias("turn_index"), "speaker", "text",
                        "arrived", F.unix_millis("arrived").alias("arrived_ms"), F.expr(f"turn_index div {UTTERANCE_TURNS}").alias("part")
                        ).withWatermark("arrived", "0 seconds")
    return rows.groupBy("session_id", "part").transformWithState(
        Utterances(_milliseconds(keep)), "session_id string, node_id string, turn_index bigint, speaker string, text string, version bigint",
        "Append", "EventTime")


def latest(utterances: DataFrame) -> DataFrame:
    """Stored versions of utterances to one row per id."""
    newest = F.max_by(F.struct("turn_index", "speaker", "text"), "version").alias("u")
    return utterances.groupBy("session_id", "node_id").agg(newest).select("session_id", "node_id", "u.*")


def with_row_state(spark):
    """A context in which streams are started on the RocksDB state store, which holds state by rows."""
    from contextlib import contextmanager

    @contextmanager
    def store():
        before = spark.conf.get(_PROVIDER, None)
        spark.conf.set(_PROVIDER, ROCKS)
        try:
            yield
        finally:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return store()


def start_turns(turns: DataFrame, out_path: str, checkpoint: str,
                wide_pass: Callable[[DataFrame, int], None] | None = None, first: int | None = 1,
                patience: str = "10 minutes", ontology: O.Ontology | None = None, **trigger) -> StreamingQuery:
    """Run the turn stream into parquet, one folder per micro-batch.

    ``wide_pass`` is called with the sessions (session_id, turn_index) that have just
    crossed a consolidation turn; it is a batch job over their stored transcripts.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if wide_pass is not None:
            # What was written is what was applied; the batch is not worked out again.
            stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{out_path}/batch={batch_id}")
            due = consolidation_turns(stored)
            if not due.isEmpty():
                wide_pass(due, batch_id)

    out = turn_stream(turns, first, patience, ontology)
    with with_row_state(turns.sparkSession):
        return (out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def transcripts_due(turns: DataFrame, due: DataFrame) -> DataFrame:
    """Transcript so far of every session due for the wide pass."""
    point = due.groupBy("session_id").agg(F.max("turn_index").alias("_upto"))
    return turns.join(point, "session_id").filter(F.col("turn_index") <= F.col("_upto")).drop("_upto")
