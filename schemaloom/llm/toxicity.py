"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character 3- to 5-grams inside words. Each n-gram f has the log ratio r(f) of its smoothed
share of toxic and of other training texts. A logistic regression is fitted on the features r(f) of the n-grams
present, so a weight can only stand out where the classes differ. Weights of single n-grams are w(f) * r(f).

Training reads a sample of labelled rows bounded by TRAIN_EACH rows of either class, chosen by a hash of doc_id; scoring
reads every text once, whole, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import code_points, grams
from .scratch import held_out

ORDERS = range(3, 6)
BITS = 20
TRAIN_EACH = 1_500
LEAST_TEXTS = 3
LEAST_RATIO = 0.7
SMOOTH = 1.0
PENALTY = 2.0
ROUNDS = 120


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.buckets] = self.weights
        return dense


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for row, end, points, at in code_points(texts):
        found = [(start, bucket) for _, start, bucket in grams(points, ORDERS, BITS)]
        start, bucket = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        text = np.searchsorted(at, start, "right") - 1
        both = np.unique(text << BITS | bucket)
        cuts = np.searchsorted(both, np.arange(end - row + 1) << BITS)
        for r in range(end - row):
            yield both[cuts[r] : cuts[r + 1]] & ((1 << BITS) - 1)


def fit(texts: list[str | None], toxic: np.ndarray) -> Model:
    """toxic: 1 or 0 per text. With no text of one class every score is that of the other class's share."""
    toxic = np.asarray(toxic, np.float64)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if not len(texts) or not 0 < toxic.sum() < len(toxic):
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0, np.float32))
    sets = list(_sets(texts))
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for own, label in zip(sets, toxic, strict=True):
        (p if label else q)[own] += 1
    # shares of the texts of a class that hold an n-gram
    ratio = np.log((p + SMOOTH) / (toxic.sum() + 2 * SMOOTH)) - np.log((q + SMOOTH) / (len(toxic) - toxic.sum() + 2 * SMOOTH))
    kept = np.flatnonzero((p + q >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    columns = [(x := place[own])[x >= 0] for own in sets]
    rows = np.repeat(np.arange(len(texts)), [len(x) for x in columns])
    columns = np.concatenate(columns)
    r = ratio[kept]
    weight, bias = np.zeros(len(kept)), float(np.log(share / (1 - share)))
    balance = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum())) * len(toxic)
    first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for k in range(1, ROUNDS + 1):  # gradient descent with moment estimates (Adam)
        z = np.bincount(rows, (weight * r)[columns], len(texts)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * balance
        slope = np.concatenate([np.bincount(columns, off[rows], len(kept)) * r + PENALTY * weight, [off.sum()]])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    final = (weight * r).astype(np.float32)
    heavy = np.abs(final) > 1e-3 * np.abs(final).max(initial=1e-9)
    return Model(float(bias), kept[heavy], final[heavy])


def score(model: Model, table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for row, end, points, at in code_points(texts):
        for _, start, bucket in grams(points, ORDERS, BITS):
            own = np.flatnonzero(table[bucket])  # only n-grams with a weight are looked at further
            text = np.searchsorted(at, start[own], "right") - 1
            both = np.unique(text << BITS | bucket[own])
            out[row:end] += np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], end - row)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From rows that are not held out, have a doc_id, a text and a label; at most TRAIN_EACH of either class."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [labels.filter(f"toxic = {k}").orderBy(order, "doc_id").limit(TRAIN_EACH) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * TRAIN_EACH rows of two numbers
    rows = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by("doc_id")
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity double (0 to 1) and toxic int (1 from 0.5 on), replacing columns of these names. Null and empty texts get the model's bias alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("toxicity", "toxic")
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            found = score(shared.value, table, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [*names, "toxicity", "toxic"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return docs.mapInArrow(each, StructType([*docs.schema.fields]).add("toxicity", DoubleType()).add("toxic", IntegerType()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); other columns are ignored. A text is scored whole, however long.

    Repeated rows and equal texts get equal scores; null and empty texts the model's bias alone; a score of exactly 0.5 counts as toxic; a
    null doc_id counts as not held out, but is not learned from. Of an id with several labels the larger counts. Empty tables give empty results; without
    labels of both classes every score is the same.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier finds toxic, with docs' own columns, whatever their names.

    Each row is judged by its own text alone, so repeated ids and rows without an id stand or fall by themselves. Null and empty texts
    get the model's bias. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            yield batch.filter(pa.array(score(shared.value, table, batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(kept, docs.schema)
