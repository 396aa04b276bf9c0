"""Chat formatting: turns of a conversation become one marked-up text with a loss mask over what the assistant says.

A turn is `### role: text</turn>` and a line feed. In roles and texts every backslash, # and < gets a backslash before it (in roles
also : and line feeds), so no control string can occur inside and unescaping is exact.

Batches of turns are assembled by columns: lengths of all segments give cumulative offsets, these the place of every byte, and
headers, contents and ends are copied into one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, saved

START, END = b"### ", b"</turn>\n"
LEARNED_ROLE = "assistant"
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord("\\"), ord("#"), ord("<")]] = True


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(data) else data, at - at[0]


def header(role: str) -> bytes:
    return START + re.sub(r"([\\#<:\n])", r"\\\1", role).encode() + b": "


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.Table:
    """(conv_id, formatted, loss_starts, loss_ends): one row per run of equal conv; loss offsets are in code points of formatted."""
    n = len(conv)
    ids = conv.to_numpy(zero_copy_only=False)
    known = np.array(conv.is_valid())
    fresh = np.ones(n, bool)
    fresh[1:] = (known[1:] != known[:-1]) | (known[1:] & known[:-1] & (ids[1:] != ids[:-1]))
    first = np.flatnonzero(fresh)
    roles = role.fill_null("").dictionary_encode()
    code = roles.indices.to_numpy()
    names = roles.dictionary.to_pylist()
    heads = [header(x) for x in names]
    pool = np.frombuffer(b"".join(heads) + END, np.uint8)
    head_len = np.array([len(x) for x in heads])
    head_at = np.concatenate([[0], np.cumsum(head_len)])
    data, at = _bytes(text)
    marks = _ESCAPED[data]
    before = np.concatenate([[0], np.cumsum(marks)])  # escapes before each content byte
    content_len = np.diff(at) + before[at[1:]] - before[at[:-1]]
    total = head_len[code] + content_len + len(END)
    turn_at = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(turn_at[-1], np.uint8)

    def copy(source: np.ndarray, source_at: np.ndarray, lengths: np.ndarray, target_at: np.ndarray) -> None:
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(target_at, lengths) + within] = source[np.repeat(source_at, lengths) + within]

    copy(pool, head_at[code], head_len[code], turn_at[:-1])
    copy(pool, np.full(n, head_at[-1]), np.full(n, len(END)), turn_at[1:] - len(END))
    content_at = turn_at[:-1] + head_len[code]
    turn = np.repeat(np.arange(n), np.diff(at))
    place = content_at[turn] + np.arange(len(data)) - at[turn] + before[1:] - before[at[turn]]
    out[place] = data
    out[place[marks] - 1] = ord("\\")
    ends = np.append(first[1:], n)
    whole = np.concatenate([turn_at[first], turn_at[-1:]]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(whole), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    learned = np.array([x == LEARNED_ROLE for x in names], bool)[code] if n else np.zeros(0, bool)
    own = np.repeat(np.arange(len(first)), ends - first)[learned]
    counts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(first)))]).astype(np.int32)
    base = points[turn_at[first]][own]
    spans = [pa.ListArray.from_arrays(counts, pa.array(points[x[learned]] - base)) for x in (content_at, content_at + content_len)]
    return pa.table([conv.take(pa.array(first)), formatted, *spans], ["conv_id", "formatted", "loss_starts", "loss_ends"])


_PIECES = "conv_id long, part int, place long, formatted string, loss_starts array<long>, loss_ends array<long>"
PREFIX = 64
#: A piece ends with the turn that brings it to this many turns or bytes.
PIECE_TURNS, PIECE_BYTES = 1_000, 4 << 20


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices that are small enough for pieces."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = min(start + PIECE_TURNS, int(np.searchsorted(sizes, before + PIECE_BYTES)) + 1, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def formatted_pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, at, formatted, loss_starts, loss_ends) of the conversations of turns (conv_id long, turn, role, text), in pieces of whole turns.

    The pieces of a conversation, in order of piece from 0, are its text; at is how many code points come before a piece, and the offsets of what is learned are those in the whole
    conversation. A piece has at most PIECE_TURNS turns and ends when it has PIECE_BYTES, so neither a conversation that holds a third of all turns nor the turns without a conv_id, which are one, have to be in one task or
    fit into memory. Turns go by turn; ties by role, then text, and repeated rows stay. Null roles and texts count as empty. Other columns are ignored; an empty table gives an empty result.
    """
    spark = turns.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in (own for whole in batches for own in _cut(whole)):
            made = assemble(*[batch.column(c) for c in ("conv_id", "role", "text")])
            part = pa.array(np.full(made.num_rows, batch.column("part")[0].as_py(), np.int32))
            places = pa.array(np.arange(place, place + made.num_rows))
            place += made.num_rows
            columns = [made.column(0), part, places, made.column(1).cast(pa.string()), made.column(2), made.column(3)]
            yield from pa.table(columns, [x.split()[0] for x in _PIECES.split(", ")]).combine_chunks().to_batches()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.monotonically_increasing_id().alias("_row"))
    # ranges end between turns, and between rows that are alike; texts decide by their beginnings where roles are short
    short = F.when(F.coalesce(F.length("role"), F.lit(0)) < PREFIX, F.substring("text", 1, PREFIX))
    whole = F.coalesce(F.length("text"), F.lit(0)) <= PREFIX
    ranged = rows.repartitionByRange(partitions(spark), "conv_id", "turn", F.substring("role", 1, PREFIX), short, F.when(whole & short.isNotNull(), F.col("_row")))
    ranged = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = saved(ranged.select("conv_id", F.spark_partition_id().alias("part"), "role", "text").mapInArrow(each, _PIECES), keep=True)
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    offsets = pieces.select("conv_id", "part", "place", F.length("formatted").cast("long").alias("n")).select(
        "part", "place", (F.row_number().over(order) - 1).cast("long").alias("piece"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("at")
    )
    moved = lambda c: F.transform(c, lambda x: x + F.col("at")).alias(c)
    return pieces.join(offsets, ["part", "place"]).select("conv_id", "piece", "at", "formatted", moved("loss_starts"), moved("loss_ends"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_starts, loss_ends) of each conversation: its pieces (see formatted_pieces) as one row, so a conversation has to fit into memory, and into 2 GB."""
    own = F.array_sort(F.collect_list(F.struct("piece", "formatted", "loss_starts", "loss_ends")))
    rows = formatted_pieces(turns).groupBy("conv_id").agg(own.alias("p"))
    return rows.select("conv_id", F.array_join("p.formatted", "").alias("formatted"), F.flatten("p.loss_starts").alias("loss_starts"), F.flatten("p.loss_ends").alias("loss_ends"))


_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    found, at = [], 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if turn is None:
            raise ValueError(f"no turn begins at {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What has been read back of a conversation so far."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.learned, self.chars = conv, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        turns = read_back(text)
        self.said.update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        learned = "".join(unescaped(text[a - self.chars : b - self.chars]) for a, b in zip(starts, ends, strict=True))
        self.loss.update(learned.encode())
        self.turns, self.learned, self.chars = self.turns + len(turns), self.learned + len(learned), self.chars + len(text)

    def row(self) -> tuple:
        return (self.conv, self.turns, self.said.hexdigest(), self.learned, self.loss.hexdigest(), self.chars)


def digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations (the result of formatted_pieces, or of formatted, where a conversation is one piece): turns and the text under the loss mask.

    A digest of a whole conversation is sequential, so its pieces pass through one task, one after another; no more than a batch of them is held.
    """
    rows = pieces if "piece" in pieces.columns else pieces.withColumn("piece", F.lit(0))
    rows = rows.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def batch_of(done: list[_Digest]) -> pa.RecordBatch:
        columns = list(zip(*[d.row() for d in done], strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _SCHEMA.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, text, starts, ends in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now)
                    now = _Digest(conv)
                now.add(text, starts, ends)
            yield batch_of(done)
        if now is not None:
            yield batch_of([now])

    return rows.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(each, _SCHEMA)
