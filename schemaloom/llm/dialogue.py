"""Conversation structure repair: the cheapest edits that make a conversation's roles fit `(s?(ua)+)?`, an optional system turn and then user and assistant in turn.

State is how far the grammar has come: nothing yet, after the system turn, after a user's, after an assistant's. The cost to go from each turn and state is
found backward; a forward walk then takes, of the edits that lose nothing of that cost, the one whose initial is least in ASCII.

A conversation may hold any share of all turns. Turns are sorted over range partitions, and each partition cuts its turns into pieces of bounded size, in parallel.
A piece is worth a 4 x 4 matrix of least costs between states; the cost to go at the ends of pieces comes from these alone, backward, 16 numbers a piece. Each
piece is then walked from all four states, again in parallel, and what is left to one task per conversation is to follow the pieces in order, rebuild the turns and
feed them to the digest, piece by piece: a digest of a whole conversation is sequential by definition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, saved, tidy

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after the role that must come next, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FAR = 1 << 60
#: Costs from each state at the end of a conversation: what is missing is inserted.
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
#: A piece ends with the turn that makes it this long.
PIECE_TURNS, PIECE_BYTES = 4_096, 1 << 20
#: Turns that differ in nothing are one row with a count; texts of this length decide the range of turns that differ in no more.
PREFIX = 64

Costs = Sequence[int]


@dataclass
class Turn:
    role: str
    text: str
    fault: str  # "", "blank", "duplicate" or "truncated", of the first of its copies
    copies: int

    def kept_state(self, state: int) -> int | None:
        """The state after the turn as it is, if the grammar allows it from state."""
        to = _INITIALS.get(self.role[:1])
        return to if to is not None and (to == NEXT[state] or (to == SYSTEM and state == NOTHING)) else None


def before_turn(turn: Turn, after: Costs) -> list[int]:
    """Costs to go from each state before the turn, from those after it. Its copies are deleted."""
    if turn.fault in ("blank", "duplicate"):
        return [DELETE_COST * turn.copies + c for c in after]
    rest = DELETE_COST * (turn.copies - 1)
    extra = TRUNCATED_COST if turn.fault == "truncated" else 0
    found = []
    for state in range(4):
        cost = min(DELETE_COST + after[state], REROLE_COST + extra + after[NEXT[state]])
        kept = turn.kept_state(state)
        if kept is not None:
            cost = min(cost, extra + after[kept])
        found.append(rest + cost)
    # insertions before it: NOTHING and SYSTEM lead to USER, which leads to ASSISTANT and back
    user = min(found[USER], INSERT_COST + found[ASSISTANT])
    assistant = min(found[ASSISTANT], INSERT_COST + found[USER])
    return [min(found[NOTHING], INSERT_COST + user), min(found[SYSTEM], INSERT_COST + user), user, assistant]


def costs_to_go(turns: Sequence[Turn], after: Costs) -> list[Costs]:
    """Costs before each turn, and after the last."""
    found = [after]
    for turn in reversed(turns):
        found.append(before_turn(turn, found[-1]))
    return found[::-1]


def walk(turns: Sequence[Turn], costs: Sequence[Costs], state: int) -> tuple[str, int]:
    """(initials of the edits, state after the last turn): of the edits that cost no more than is left, always the ASCII-least."""
    done = []
    for k, turn in enumerate(turns):
        here, after = costs[k], costs[k + 1]
        if turn.fault in ("blank", "duplicate"):
            done.append(DELETE * turn.copies)
            continue
        rest = DELETE_COST * (turn.copies - 1)
        extra = TRUNCATED_COST if turn.fault == "truncated" else 0
        while True:
            kept = turn.kept_state(state)
            if here[state] == DELETE_COST + rest + after[state]:
                done.append(DELETE)
            elif here[state] == INSERT_COST + here[NEXT[state]]:
                done.append(INSERT)
                state = NEXT[state]
                continue
            elif kept is not None and here[state] == extra + rest + after[kept]:
                done.append(KEEP)
                state = kept
            else:
                done.append(REROLE)
                state = NEXT[state]
            break
        done.append(DELETE * (turn.copies - 1))
    return "".join(done), state


def rebuilt(turns: Iterable[Turn], edits: str, state: int) -> Iterator[str]:
    """`role:text` of what the edits leave of the turns, beginning in state."""
    at = 0
    for turn in turns:
        while edits[at] == INSERT:
            state, at = NEXT[state], at + 1
            yield ROLES[state] + ":"
        if edits[at] == KEEP:
            state = _INITIALS[turn.role[:1]]
            yield f"{turn.role}:{turn.text}"
        elif edits[at] == REROLE:
            state = NEXT[state]
            yield f"{ROLES[state]}:{turn.text}"
        at += turn.copies
    for _ in edits[at:]:
        state = NEXT[state]
        yield ROLES[state] + ":"


# Damage, for tests of repair on conversations that are whole.


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of turns (conv_id, turn, role, text) damaged by crc32(`conv_id:turn`) mod 20; a dropped turn stays as a row without turn, role and text
    of 0 copies, so that its conversation is known. Null ids and turns count as one space in that text, null roles and texts are one space."""
    rule = F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), rule.alias("rule"))
    gone = F.col("rule") == 0
    text = F.when(F.col("rule").isin(0, 1), "").when(F.col("rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("rule") == 3, 2).otherwise(1).alias("copies"),
    )


_SPACE = " \t\n\x0b\f\r"


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copies) with equal ones as one row, and fault of the first copy. The first of equal role and text is found by a join on all that tells turns apart,
    so that no conversation and no text, however often it is repeated, meets in one task."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    seen = F.trim(F.col("text"), F.lit(_SPACE))
    rows = saved(rows.withColumns({"_said": said, "_blank": seen == "", "_whole": F.substring(seen, -1, 1).isin(".", "!", "?")}))
    no_turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.filter("copies > 0 and not _blank").groupBy("conv_id", "_said").agg(F.min(no_turn).alias("at"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_text"), F.when(F.col("at.given"), F.col("at.turn")).alias("_turn"), F.lit(True).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_text")) & F.col("turn").eqNullSafe(F.col("_turn"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("_whole"), "truncated").otherwise("")
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


# Pieces.

_TURNS = "turns array<struct<role:string,text:string,fault:string,copies:long>>"
_PIECE = f"conv_id long, part int, place long, {_TURNS}, matrix array<long>, low long, high long, distinct long"
_NAMES = ("blank", "duplicate", "truncated", "illegal")


def _arrow_schema(spark, text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], text).schema)


class _Rows:
    """Rows of Python values that leave in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.weight = schema, [], 0

    def add(self, row: tuple, weight: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.weight += weight
        if self.weight >= 4 * PIECE_BYTES or len(self.rows) >= PIECE_TURNS:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)] if self.rows else [pa.array([], f.type) for f in self.schema]
        self.rows, self.weight = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def pieces(turns: DataFrame, most: int = PIECE_TURNS) -> DataFrame:
    """Turns (with faults) in pieces of most turns: neighbours of one conversation from one range of the order by conv_id, turn, role and text, nulls first."""
    spark = turns.sparkSession
    short = F.when(F.length("role") < PREFIX, F.substring("text", 1, PREFIX))
    ranged = turns.repartitionByRange(partitions(spark), "conv_id", "turn", F.substring("role", 1, PREFIX), short).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _arrow_schema(spark, _PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = _Rows(schema), 0
        conv, part, own, size = None, 0, [], 0
        given: list[int] = []

        def close() -> tuple:
            kept = [Turn(*x) for x in own if x[3] > 0]
            ends = []
            for state in range(4):
                after = [_FAR] * 4
                after[state] = 0
                ends.append(costs_to_go(kept, after)[0])
            numbers = [ends[to][frm] for frm in range(4) for to in range(4)]
            steps = sum(a != b for a, b in zip(given, given[1:]))
            return (conv, part, place, [dict(zip(("role", "text", "fault", "copies"), (x.role, x.text, x.fault, x.copies), strict=True)) for x in kept], numbers, given[0] if given else None, given[-1] if given else None, steps + 1 if given else 0)

        for batch in batches:
            for c, p, turn, *said in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "part", "turn", "role", "text", "fault", "copies")], strict=True):
                if own and (c != conv or len(own) >= most or size >= PIECE_BYTES):
                    yield from out.add(close(), size)
                    own, given, size, place = [], [], 0, place + 1
                conv, part = c, p
                own.append(said)
                size += 64 + len(said[0]) + 2 * len(said[1])
                if turn is not None and said[3] > 0:
                    given.append(turn)
        if own:
            yield from out.add(close(), size)
        yield out.batch()

    return ranged.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "fault", "copies").mapInArrow(cut, _PIECE)


def _in_order(rows: DataFrame, backward: bool) -> DataFrame:
    """Pieces of each conversation together, in order or backward."""
    way = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", way("part"), way("place"))


def _ends(light: DataFrame) -> DataFrame:
    """(part, place, after): costs to go at the end of every piece, from the pieces' matrices."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs, began = None, AT_END, False
        for batch in batches:
            after = []
            for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if not began or c != conv:
                    conv, costs, began = c, AT_END, True
                after.append(list(costs))
                costs = [min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("place"), pa.array(after, pa.list_(pa.int64()))], ["part", "place", "after"])

    return _in_order(light, True).mapInArrow(each, "part int, place long, after array<long>")


_WALKED = f"conv_id long, part int, place long, {_TURNS}, low long, high long, distinct long, before array<long>, edits array<string>, states array<int>"


def _read(column: list[dict]) -> list[Turn]:
    return [Turn(x["role"], x["text"], x["fault"], x["copies"]) for x in column]


def _walked(rows: DataFrame) -> DataFrame:
    """Pieces walked from each state, with the costs before them."""
    schema = _arrow_schema(rows.sparkSession, _WALKED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(schema)
            for c, p, place, turns, low, high, distinct, after in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "part", "place", "turns", "low", "high", "distinct", "after")], strict=True):
                own = _read(turns)
                costs = costs_to_go(own, after)
                walks = [walk(own, costs, s) for s in range(4)]
                row = (c, p, place, turns, low, high, distinct, list(costs[0]), [w for w, _ in walks], [s for _, s in walks])
                yield from out.add(row, sum(64 + len(x.role) + 2 * len(x.text) for x in own))
            yield out.batch()

    return rows.mapInArrow(each, _WALKED)


_REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is known of a conversation after some of its pieces."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.edits, self.digest, self.any = conv, NOTHING, None, [], hashlib.sha256(), False
        self.low = self.high = None
        self.distinct, self.last, self.counts = 0, None, dict.fromkeys(_NAMES, 0)

    def say(self, texts: Iterable[str]) -> None:
        for text in texts:
            self.digest.update((("\n" if self.any else "") + text).encode())
            self.any = True

    def add(self, turns: list[Turn], low: int | None, high: int | None, distinct: int, before: list[int], edits: list[str], states: list[int]) -> None:
        if self.cost is None:
            self.cost = before[NOTHING]
        if low is not None:
            self.distinct += distinct - (low == self.high)
            self.low, self.high = (low if self.low is None else self.low), high
        for turn in turns:
            own = turn.role[:1]
            if self.last is not None:
                self.counts["illegal"] += self.last + own not in ("su", "ua", "au")
            self.counts["illegal"] += turn.copies - 1  # a role beside itself
            self.last = own
            if turn.fault == "blank":
                self.counts["blank"] += turn.copies
            else:
                if turn.fault:
                    self.counts[turn.fault] += 1
                self.counts["duplicate"] += turn.copies - 1
        self.edits.append(edits[self.state])
        self.say(rebuilt(turns, edits[self.state], self.state))
        self.state = states[self.state]

    def row(self) -> tuple:
        missing = INSERT * (AT_END[self.state] // INSERT_COST)
        self.say(rebuilt([], missing, self.state))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *(self.counts[n] for n in _NAMES), self.cost, "".join(self.edits) + missing, self.digest.hexdigest())


def repaired(turns: DataFrame, most: int = PIECE_TURNS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of damaged turns (see damaged).

    Turns go by turn, those without one first; ties by role, then text, so that copies stand together. Turns without a conv_id are one conversation. A role counts by its first sign,
    one without any fits nowhere. A turn's first fault of blank, duplicate and truncated counts. A conversation of which nothing is left has zeros, an empty audit and the
    digest of an empty text. most: turns of a piece. Further columns are ignored; an empty table gives an empty result.
    """
    with tidy(turns.sparkSession):
        cut = saved(pieces(faults(turns), most))
        ends = _ends(cut.select("conv_id", "part", "place", "matrix"))
        walked = _in_order(_walked(cut.drop("matrix").join(ends, ["part", "place"])), False)
        return saved(walked.mapInArrow(_finished(_arrow_schema(turns.sparkSession, _REPAIRED)), _REPAIRED), keep=True)


def _finished(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Rows(schema), None
        for batch in batches:
            for conv, turns, *rest in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turns", "low", "high", "distinct", "before", "edits", "states")], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        row = now.row()
                        yield from out.add(row, len(row[7]))
                    now = _Conversation(conv)
                now.add(_read(turns), *rest)
        if now is not None:
            yield from out.add(now.row(), 0)
        yield out.batch()

    return each
