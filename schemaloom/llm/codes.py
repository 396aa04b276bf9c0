"""Vector codes: vectors are cut into parts, and each part becomes the index of the nearest entry of its position's codebook.

Codebooks are learned by Lloyd's rounds with Elkan's bounds. Every part keeps an upper bound of the distance to its entry and a lower bound of the distance
to every entry of the codebook; when entries move, bounds shift by the way they moved. An entry is passed over only if a bound says that it is strictly
farther than the part's own, so what is left, ties included, is decided by whole squared distances. Bounds travel with the vectors, from a written
table to the next: an upper bound is rounded up to 4 bytes, a lower one down to 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, saved, tidy
from .vectors import cells, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A label of over one in this many rows has its sum sent to all tasks; there are fewer such labels than this.
COMMON = 1_000


def _down(x: np.ndarray) -> np.ndarray:
    """x as the next smaller half-precision number, never over the largest."""
    with np.errstate(over="ignore"):
        near = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(near.astype(np.float64) > x, np.nextafter(near, np.float16(-np.inf)), near)


def _up(x: np.ndarray) -> np.ndarray:
    near = x.astype(np.float32)
    return np.where(near.astype(np.float64) < x, np.nextafter(near, np.float32(np.inf)), near)


#: Square roots and their sums are off by less than this share of themselves.
_SLACK = 1e-12


class Codebook:
    """The entries of one position: whole numbers, and half the distances between entries, rounded down."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.half = np.sqrt(between.astype(np.float64)) * (0.5 * (1 - _SLACK))


def first_assigned(book: Codebook, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds, squared distance) of parts that have no bounds yet: all distances are computed."""
    square = ((parts[:, None, :] - book.entries[None, :, :]) ** 2).sum(2)
    own = square.argmin(1)
    least = square[np.arange(len(parts)), own]
    return own, _up(np.sqrt(least.astype(np.float64)) * (1 + _SLACK)), _down(np.sqrt(square.astype(np.float64)) * (1 - _SLACK)), least


def reassigned(book: Codebook, parts: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_assigned, and how many distances to other entries it took: bounds shift by how far entries moved, and only what they can't rule out is computed."""
    rows, n = np.arange(len(parts)), len(book.entries)
    upper = _up((upper.astype(np.float64) + moved[own]) * (1 + _SLACK))
    lower = _down(np.maximum(lower.astype(np.float64) - moved[None, :], 0) * (1 - _SLACK))
    square = ((parts - book.entries[own]) ** 2).sum(1)  # of the part's own entry: makes the upper bound tight
    upper = np.minimum(upper, _up(np.sqrt(square.astype(np.float64)) * (1 + _SLACK)))
    bound = upper.astype(np.float64)[:, None]
    open_ = (lower.astype(np.float64) <= bound) & (book.half[own] <= bound)
    open_[rows, own] = False
    row, entry = np.nonzero(open_)
    distance = ((parts[row] - book.entries[entry]) ** 2).sum(1)
    lower[row, entry] = _down(np.sqrt(distance.astype(np.float64)) * (1 - _SLACK))
    lower[rows, own] = _down(np.sqrt(square.astype(np.float64)) * (1 - _SLACK))
    # the least of (distance, entry) of the own entry and the open ones
    row, entry, distance = np.concatenate([rows, row]), np.concatenate([own, entry]), np.concatenate([square, distance])
    order = np.lexsort((entry, distance, row))
    at = order[np.searchsorted(row[order], rows)]
    own, square = entry[at], distance[at]
    return own, _up(np.sqrt(square.astype(np.float64)) * (1 + _SLACK)), lower, square, len(row) - len(rows)


_STATE = "cells array<int>, code binary, upper binary, lower binary"
_SUMS = "part int, entry int, place int, total long, n long"


def _assigned(rows: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """rows (vec_id, label, cells, and from the second time on code, upper and lower) with a new code, bounds and the squared error. before: the entries that
    the bounds are of."""
    own, moved = [Codebook(b) for b in books], [np.sqrt(((a - b) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK) for a, b in zip(books, before or books, strict=True)]
    width, entries = books[0].shape[1], len(books[0])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = matrix(batch.column("cells"), PARTS * width).reshape(n, PARTS, width)
            code, upper, lower, error = np.empty((n, PARTS), np.uint8), np.empty((n, PARTS), np.float32), np.empty((n, PARTS, entries), np.float16), np.zeros(n, np.int64)
            if before is not None:
                read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
                old = read("code", np.uint8).reshape(n, PARTS), read("upper", np.float32).reshape(n, PARTS), read("lower", np.float16).reshape(n, PARTS, entries)
            for p, book in enumerate(own):
                if before is None:
                    found = first_assigned(book, parts[:, p])
                else:
                    found = reassigned(book, parts[:, p], old[0][:, p].astype(np.int64), old[1][:, p], old[2][:, p], moved[p])
                code[:, p], upper[:, p], lower[:, p] = found[:3]
                error += found[3]
            pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("cells"), pack(code), pack(upper), pack(lower), pa.array(error)], ["vec_id", "label", "cells", "code", "upper", "lower", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(each, f"vec_id long, label {label}, {_STATE}, error long")


def _moved_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry as the floor of its parts' mean; unused entries stay. Sums are made where the rows are; one row for each component of the codebooks meets."""
    width, entries = books[0].shape[1], len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            parts = matrix(batch.column("cells"), PARTS * width).reshape(n, PARTS, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
            for p in range(PARTS):
                np.add.at(total[p], code[:, p], parts[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e, at = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(at), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], ["part", "entry", "place", "total", "n"])

    new = [b.copy() for b in books]
    found = rows.select("cells", "code").mapInArrow(sums, _SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in found.filter("n > 0").collect():  # PARTS * ENTRIES * width rows at most
        new[r.part][r.entry, r.place] = r.total // r.n
    return new


def compressed(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each of rows (vec_id, embedding, label) whose vector takes part; further columns are ignored.

    Components are floor(256 * x), held within 2^24 either way. Vectors that are null or hold null or non-finite components are left out. All vectors count as
    filled up with zeros to the longest length, rounded up to a multiple of PARTS. Codebooks begin with the vectors of the ENTRIES smallest ids (all, if there are
    fewer; ties by the vector; rows without an id after all others). Repeated rows and rows without an id get a code each. Of equally near entries the one of the
    lower index is taken. Rows without a label are summed together. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    with tidy(spark):
        own = saved(cells(rows, "label"))
        first = [list(r.cells) for r in own.orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(ENTRIES).select("cells").collect()]
        longest = own.agg(F.coalesce(F.max(F.size("cells")), F.lit(0))).first()[0]
        width = -(-longest // PARTS)
        start = matrix(pa.array(first, pa.list_(pa.int32())), PARTS * width).reshape(len(first), PARTS, width)
        books, before = [np.ascontiguousarray(start[:, p]) for p in range(PARTS)], None
        state = own
        for _ in range(ROUNDS if first else 0):
            old, state = state, saved(_assigned(state, books, before))
            discard(old)  # bounds are the bulk of a table: one of a round is kept, and the one it is made from while it is
            before, books = books, _moved_books(state, books)
        text = ",".join(str(x) for b in books for e in b for x in e)
        if first:
            state = _assigned(state, books, before)
        else:
            state = state.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        coded = saved(state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
        return saved(with_label_errors(coded).withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())), keep=True)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error). Sums of common labels, which are few, go to all tasks; rows of other labels meet their sum by a join."""
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    many = coded.count() // COMMON
    common = sums.filter(F.col("n") > many).select(F.col("label").alias("_label"), "label_error")
    rest = sums.filter(F.col("n") <= many).select(F.col("label").alias("_label"), F.col("label_error").alias("_error"))
    marked = coded.join(F.broadcast(common), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    rare = marked.filter("label_error is null").drop("label_error").join(rest, F.col("label").eqNullSafe(F.col("_label"))).withColumnRenamed("_error", "label_error")
    shown = ("vec_id", "code", "error", "label_error")
    return marked.filter("label_error is not null").select(*shown).union(rare.select(*shown))
