"""Conversation structure repair: the cheapest edits that make roles read (s? (u a)+)?.

Every message has one fault at most: blank, a duplicate of an earlier message of its
conversation (role and text), or truncated.  Blank and duplicate messages must go.  Edits and
costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty message 5; a truncated
message that stays costs 5 more.  Of the cheapest edit sequences the ASCII-least is taken.

The states between messages are: begun, after system, after a user, after an assistant.  An edit
letter in a state leads to one state, so edit letters determine the result.  Costs to the end,
by state, are kept at checkpoints only:

* messages are numbered in order by a range shuffle, which splits large conversations, and are
  cut into blocks that grow by ``GROW`` messages each (and end with an Arrow batch), so that a
  conversation of n messages has about sqrt(n) blocks of about sqrt(n) messages, up to factors;
* a block is a 4 x 4 matrix over (min, +); one pass over a conversation's matrices, backwards,
  gives the state-cost vector at each checkpoint;
* blocks are then recomputed from their checkpoint, in parallel: walking forward, the least
  letter that keeps to the cost is emitted.  A first walk gives the state in which each entry
  state leaves the block; a pass over those gives the entry of each block; a second walk emits.

All messages of a batch are worked on in step, as arrays.  Texts are not moved for this: messages
are told apart by SHA-256, and only those that stay are joined with their texts at the end.

Order: by turn (nulls first); messages of one turn by role, then by the first 64 characters and the
SHA-256 of their text.  Defined results: a null role or text is one space; a null conversation id
is a conversation; equal messages (id, turn, role, text) are copies, of which all but one are
duplicates; a role other than those with initial s, u or a can only be reroled or deleted; a
conversation without messages has no rows; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, picked

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
GROW = 64
FAR = 1 << 60

# States: 0 begun, 1 after system, 2 after a user, 3 after an assistant.
_NEXT = np.array([2, 2, 3, 2])  # by a message that is not system
_FINAL = np.array([0, 10, 5, 0], np.int64)  # inserts that complete a conversation
# Codes of messages: initial (s, u, a, other) + 4 * (truncated) + 8 * (must go).
_KEEP = np.full((16, 4), FAR, np.int64)
for _t in (0, 1):
    _KEEP[4 * _t, 0] = _KEEP[4 * _t + 1, [0, 1, 3]] = _KEEP[4 * _t + 2, 2] = _t * TRUNCATED
_KEPT = np.array([1, 2, 3, 0])[np.arange(16) % 4]  # the state behind a kept message
_REROLE = np.where(np.arange(16) < 8, REROLE + (np.arange(16) // 4 % 2) * TRUNCATED, FAR)
_LETTERS = np.frombuffer(b"DIKR", np.uint8)
_INITIALS = np.frombuffer(b"sua?", np.uint8)
# A message takes 16 places: inserted ones before it, itself at 8, inserted ones behind the last.
PLACES = 16


def closed(v: np.ndarray) -> np.ndarray:
    """Costs by state (second axis) when messages may be inserted at this place."""
    for _ in range(3):
        v = np.minimum(v, np.minimum(v[:, _NEXT] + INSERT, FAR))
    return v


def before(code: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Costs by state before messages of these codes, given those behind them; v: (n, 4, ...)."""
    spread = (slice(None), slice(None)) + (None,) * (v.ndim - 2)
    kept = v[np.arange(len(code)), _KEPT[code]][:, None]
    best = np.minimum(v + DELETE, kept + _KEEP[code][spread])
    best = np.minimum(best, v[:, _NEXT] + _REROLE[code][(slice(None),) + (None,) * (v.ndim - 1)])
    return np.minimum(closed(best), FAR)


def in_step(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """For k = 0, 1, ...: the rows that are longer than k, while there are any."""
    order = np.argsort(-lengths, kind="stable")
    upto = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    for n in upto:
        yield order[:n]


def matrices(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4): cost from each state before a block to each state behind it."""
    n = np.diff(offs)
    m = np.full((len(n), 4, 4), FAR, np.int64)
    m[:, np.arange(4), np.arange(4)] = 0
    for k, rows in enumerate(in_step(n)):
        m[rows] = before(code[offs[rows + 1] - 1 - k], m[rows])
    return m


def checkpoint(matrix: np.ndarray, behind: np.ndarray) -> np.ndarray:
    return np.minimum((matrix + behind).min(-1), FAR)


def vectors(code: np.ndarray, offs: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs by state at every place of the blocks: block b has places offs[b] + b and on."""
    n = np.diff(offs)
    out = np.empty((len(code) + len(n), 4), np.int64)
    out[offs[1:] + np.arange(len(n))] = behind
    for k, rows in enumerate(in_step(n)):
        at = offs[rows + 1] + rows - 1 - k
        out[at] = before(code[offs[rows + 1] - 1 - k], out[at + 1])
    return out


def walk(code: np.ndarray, offs: np.ndarray, costs: np.ndarray, entry: np.ndarray, last: np.ndarray):
    """Follow the ASCII-least tight edits: state behind each block, and the edits as arrays
    (block, message in the block or its length for those behind all, letter 0-3, state behind)."""
    n, state, made = np.diff(offs), entry.copy(), []
    steps = in_step(n + 1)
    for k, rows in enumerate(steps):
        rows = np.sort(rows)
        pending = rows
        while len(pending):
            q, v = state[pending], costs[offs[pending] + pending + k]
            now, inner = v[np.arange(len(pending)), q], k < n[pending]
            c = code[np.minimum(offs[pending] + k, max(len(code) - 1, 0))] if len(code) else np.zeros(len(pending), int)
            ahead = costs[np.where(inner, offs[pending] + pending + k + 1, 0)]
            row = np.arange(len(pending))
            insert = (v[row, _NEXT[q]] + INSERT == now) & (inner | last[pending])
            delete = inner & (ahead[row, q] + DELETE == now)
            keep = inner & (ahead[row, _KEPT[c]] + _KEEP[c, q] == now)
            letter = np.select([delete, insert, keep, inner], [0, 1, 2, 3], 4)
            state[pending] = np.select([letter == 1, letter == 2, letter == 3], [_NEXT[q], _KEPT[c], _NEXT[q]], q)
            done = letter < 4
            made.append((pending[done], np.full(done.sum(), k), letter[done], state[pending[done]]))
            pending = pending[letter == 1]
    edits = [np.concatenate(x) if made else np.zeros(0, np.int64) for x in zip(*made)] or [np.zeros(0, np.int64)] * 4
    order = np.lexsort((np.arange(len(edits[0])), edits[0]))
    return state, [x[order] for x in edits]


def conversation_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text under these names, nulls of role and text as one space."""
    named = picked(rows, conv_id, turn, role, text).toDF("conv_id", "turn", "role", "text")
    return named.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in all columns of these names, nulls equal to nulls; ``right`` has them with a trailing _."""
    on = F.lit(True)
    for c in names:
        on &= left[c].eqNullSafe(right[f"{c}_"])
    return on


def messages(rows: DataFrame) -> DataFrame:
    """One row per distinct message: conv_id, turn, role, head, key, copies, code, fault."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    narrow = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"),
        (F.length(solid) == 0).alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("short"), kind.alias("kind"))
    found = cut(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = found.groupBy("conv_id", "role", "key").agg(F.min(place).alias("first")).toDF("conv_id_", "role_", "key_", "first")
    again = place > F.col("first")
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("short"), "truncated")
    return found.join(first, same(found, first, ["conv_id", "role", "key"])).withColumn("fault", fault).select(
        "conv_id", "turn", "role", "head", "key", "copies", "fault",
        (F.col("kind") + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)).alias("code"))


MESSAGES = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()), ("copies", pa.int64())]))
BLOCK = pa.schema([("block", pa.int64()), ("conv_id", pa.int64()), ("codes", pa.binary()), ("messages", MESSAGES),
                   ("matrix", pa.binary())])
BLOCK_DDL = ("block long, conv_id long, codes binary, messages array<struct<turn:long,role:string,key:binary,copies:long>>, "
             "matrix binary")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all blocks of a binary column, and their offsets."""
    parts = column.to_pylist()
    return (np.frombuffer(b"".join(parts), np.uint8).astype(np.int64),
            np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64))


def longs(column, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, *shape)


def _unless(mask: pa.Array, values: pa.Array) -> pa.Array:
    return pc.if_else(mask, pa.scalar(None, values.type), values)


def binaries(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())


def blocks_of(ordered: DataFrame, grow: int) -> DataFrame:
    """Blocks of messages that lie next to each other; ``line`` numbers them over all."""
    def building(batches):
        conv, part, size, seen = object(), None, 0, 0
        for batch in batches:
            ids, lines = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cuts = []
            for k, c in enumerate(ids):
                if k == 0 or c != conv or seen == size:
                    size = grow if c != conv else size + (grow if seen == size else 0)
                    conv, seen = c, 0
                    cuts.append(k)
                seen += 1
            size, seen = max(size, grow), 0  # a batch ends a block
            offs = np.r_[cuts, len(ids)].astype(np.int64)
            if not len(ids):
                continue
            code = batch.column(2).to_numpy().astype(np.uint8)
            fields = [batch.column(k) for k in range(3, 7)]
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)),
                                             pa.StructArray.from_arrays(fields, fields=list(MESSAGES.value_type)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines[offs[:-1]]), batch.column(0).take(pa.array(offs[:-1])),
                 pa.array([code[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])], pa.binary()), lists,
                 binaries(matrices(code.astype(np.int64), offs))], schema=BLOCK)

    return ordered.select("conv_id", "line", "code", "turn", "role", "key", "copies").mapInArrow(building, BLOCK_DDL)


def ends_of(blocks: DataFrame) -> DataFrame:
    """block, first, last, behind: one pass over each conversation's matrices, backwards."""
    schema = pa.schema([("block", pa.int64()), ("last", pa.bool_()), ("behind", pa.binary())])

    def scanning(batches):
        conv, vector = object(), _FINAL
        for batch in batches:
            ids, m = batch.column(1).to_pylist(), longs(batch.column(2), 4, 4)
            behind, last = np.empty((len(ids), 4), np.int64), np.zeros(len(ids), bool)
            for k, c in enumerate(ids):
                if c != conv:
                    conv, vector, last[k] = c, _FINAL, True
                behind[k] = vector
                vector = checkpoint(m[k], vector)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last), binaries(behind)], schema=schema)

    return (blocks.select("block", "conv_id", "matrix").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(scanning, "block long, last boolean, behind binary"))


def exits_of(blocks: DataFrame) -> DataFrame:
    """block, conv_id, last, behind, exits (state behind the block for each entry state), and what
    counting role changes needs: initials of the first and last message, changes inside."""
    schema = pa.schema([("block", pa.int64()), ("conv_id", pa.int64()), ("last", pa.bool_()), ("behind", pa.binary()),
                        ("exits", pa.binary()), ("edge", pa.binary()), ("illegal", pa.int64())])

    def leaving(batches):
        for batch in batches:
            code, offs = flat(batch.column(2))
            last, behind = batch.column(3).to_numpy(zero_copy_only=False), longs(batch.column(4), 4)
            costs = vectors(code, offs, behind)
            n = batch.num_rows
            exits = np.stack([walk(code, offs, costs, np.full(n, q), last)[0] for q in range(4)], 1)
            kind = code % 4
            wrong = np.r_[0, np.cumsum(~legal(kind[:-1], kind[1:]))]
            illegal = wrong[offs[1:] - 1] - wrong[offs[:-1]]
            # Copies stand next to each other: no pair of equal roles is legal.
            copies = batch.column(5).flatten().field("copies").to_numpy()
            illegal += np.add.reduceat(copies - 1, offs[:-1]) if len(copies) else 0
            edge = np.stack([kind[offs[:-1]], kind[offs[1:] - 1]], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), binaries(exits), binaries(edge),
                 pa.array(illegal)], schema=schema)

    return blocks.select("block", "conv_id", "codes", "last", "behind", "messages").mapInArrow(
        leaving, "block long, conv_id long, last boolean, behind binary, exits binary, edge binary, illegal long")


def legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def entries_of(exits: DataFrame) -> DataFrame:
    """block, last, behind, entry, illegal: one pass over each conversation's blocks, forward."""
    schema = pa.schema([("block", pa.int64()), ("last", pa.bool_()), ("behind", pa.binary()), ("entry", pa.int64()),
                        ("illegal", pa.int64())])

    def scanning(batches):
        conv, state, role = object(), 0, None
        for batch in batches:
            ids, out, edge = batch.column(1).to_pylist(), longs(batch.column(4), 4), longs(batch.column(5), 2)
            entry, illegal = np.empty(len(ids), np.int64), batch.column(6).to_numpy().copy()
            for k, c in enumerate(ids):
                if c != conv:
                    conv, state = c, 0
                elif not legal(role, edge[k, 0]):
                    illegal[k] += 1
                entry[k] = state
                state, role = out[k, state], edge[k, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(entry),
                                              pa.array(illegal)], schema=schema)

    return exits.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        scanning, "block long, last boolean, behind binary, entry long, illegal long")


STAYING = pa.list_(pa.struct([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("turn", pa.int64()),
                              ("old_role", pa.string()), ("key", pa.binary())]))
EDITS = pa.schema([("block", pa.int64()), ("conv_id", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()),
                   ("audit", pa.string()), ("staying", STAYING)])
EDITS_DDL = ("block long, conv_id long, cost long, illegal long, audit string, staying "
             "array<struct<place:long,edit:string,role:string,turn:long,old_role:string,key:binary>>")


def edits_of(blocks: DataFrame) -> DataFrame:
    """For each block the cost and letters of its edits, and the messages that stay or are inserted."""
    roles = np.array(["", "system", "user", "assistant"], object)

    def emitting(batches):
        for batch in batches:
            code, offs = flat(batch.column(2))
            last, behind = batch.column(3).to_numpy(zero_copy_only=False), longs(batch.column(4), 4)
            costs = vectors(code, offs, behind)
            _, (block, at, letter, state) = walk(code, offs, costs, batch.column(5).to_numpy(), last)
            lines, n = batch.column(0).to_numpy(), np.diff(offs)
            inner = at < n[block]
            place = offs[block] + np.minimum(at, n[block] - 1)
            own = batch.column(7).flatten()
            copies = own.field("copies").to_numpy()[place]
            stays = letter > 0
            price = np.select([letter == 0, letter == 1], [DELETE, INSERT],
                              np.where(letter == 3, REROLE, 0) + (code[place] // 4 % 2) * TRUNCATED)
            # Behind a message come the deletions of its copies.
            more = np.where(letter != 1, copies - 1, 0)
            cost = np.bincount(block, price + DELETE * more, len(n)).astype(np.int64)
            marks = np.repeat(_LETTERS[letter], 1 + more)
            first = np.cumsum(1 + more) - 1 - more
            behind_first = np.ones(len(marks), bool)
            behind_first[first] = False
            marks = np.where(behind_first, _LETTERS[0], marks).tobytes().decode()
            upto = np.r_[0, np.cumsum(np.bincount(block, 1 + more, len(n)).astype(np.int64))]
            # Inserted messages are counted from the place before (or behind) their message.
            new = np.r_[True, (block[1:] != block[:-1]) | (at[1:] != at[:-1])] if len(block) else np.zeros(0, bool)
            nth = np.arange(len(block)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(block) else at
            number = (lines[block] + np.minimum(at, n[block] - 1)) * PLACES
            number += np.where(letter == 1, nth + np.where(inner, 0, 9), 8)
            pick = np.flatnonzero(stays)
            inserted = letter[pick] == 1
            old_role = own.field("role").take(pa.array(place[pick]))
            given = pa.array(roles[np.where(letter[pick] == 2, 0, state[pick])], pa.string())
            kept = pa.array(letter[pick] == 2)
            none = pa.array(inserted)
            fields = [pa.array(number[pick]), pa.array(np.array(["D", "I", "K", "R"], object)[letter[pick]], pa.string()),
                      pc.if_else(kept, old_role, given),
                      _unless(none, own.field("turn").take(pa.array(place[pick]))),
                      _unless(none, old_role),
                      _unless(none, own.field("key").take(pa.array(place[pick])))]
            counts = np.r_[0, np.cumsum(np.bincount(block[pick], minlength=len(n)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(fields, fields=list(STAYING.value_type)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cost), batch.column(6),
                 pa.array([marks[a:b] for a, b in zip(upto[:-1], upto[1:])], pa.string()), lists], schema=EDITS)

    return blocks.select("block", "conv_id", "codes", "last", "behind", "entry", "illegal", "messages").mapInArrow(emitting, EDITS_DDL)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", grow: int = GROW) -> tuple[DataFrame, DataFrame]:
    """(report, repaired).  Ids and turns are whole numbers.

    report, one row per conversation: conv_id, gaps (turn numbers missing between its least and
    largest), blank, duplicate, truncated, illegal (neighbours whose roles may not follow), cost, audit.
    repaired: conv_id, place (order), edit (K, R or I), role, text.
    """
    rows = conversation_rows(rows, conv_id, turn, role, text).withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    found = cut(messages(rows))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "head", "key")]
    ordered = (found.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("line", F.monotonically_increasing_id()))
    blocks = cut(blocks_of(ordered, grow))
    checked = cut(exits_of(blocks.join(ends_of(blocks), "block")))
    entered = blocks.join(entries_of(checked), "block")
    edits = cut(edits_of(entered))

    none = F.lit(0).cast("long")
    count = lambda name: F.sum(F.when(F.col("fault") == name, F.col("copies")).otherwise(none)).alias(name)
    copied = F.sum(F.when(F.col("fault").isNull() | (F.col("fault") == "truncated"), F.col("copies") - 1).otherwise(none))
    # Copies behind the first are duplicates, unless they are blank; the first alone may be truncated.
    truncated = F.sum((F.col("fault") == "truncated").cast("long"))
    faults = found.groupBy("conv_id").agg(
        count("blank"), (F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).otherwise(none)) + copied).alias("duplicate"),
        F.coalesce(truncated, none).alias("truncated"))
    turns = found.filter(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("_"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    pieces = F.sort_array(F.collect_list(F.struct("block", "audit")))
    made = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
                                        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    report = faults
    for part in (gaps, made):
        part = part.withColumnRenamed("conv_id", "conv_id_")
        report = report.join(part, same(report, part, ["conv_id"]), "left").drop("conv_id_")
    report = report.select("conv_id", F.coalesce("gaps", none).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    staying = edits.select("conv_id", F.explode("staying").alias("s")).select("conv_id", "s.*")
    texts = (rows.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
             .groupBy("conv_id", "turn", "role", "key").agg(F.first("text").alias("text"))
             .toDF("conv_id_", "turn_", "old_role_", "key_", "text"))
    repaired = staying.join(texts, same(staying, texts, ["conv_id", "turn", "old_role", "key"]), "left").select(
        "conv_id", "place", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))
    return report, repaired
