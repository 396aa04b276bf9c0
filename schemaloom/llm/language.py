"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters) has features: its character 2- to 4-grams with marked word ends, which are its affixes and inner n-grams,
and itself, as an entry of a lexicon. All are hashed into 2**BITS buckets with a weight per language. Learned
transition weights join neighbouring words, so that a word that several languages share follows its
neighbours, while a switch of language inside a text is found where the words are clear. Forward-backward gives each
word's language probabilities; a text's language is the one with the largest sum over its words.

Training texts are cut into segments, and segments of all languages are shuffled into code-switched sequences with
known labels. Training reads at most TRAIN_EACH whole texts of each language, chosen by a hash of doc_id. Weights take one megabyte a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .chargrams import code_points, grams, letter_runs, run_hashes
from .scratch import held_out, saved

BITS = 18
ORDERS = range(2, 5)
TRAIN_EACH = 120
SEGMENT = (8, 40)
SEQUENCE = 12
EPOCHS = 6
BATCH_WORDS = 20_000
PENALTY = 1e-6
BLOCK = 32
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # language, bucket
    transitions: np.ndarray  # from, to


def features(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, each feature's word, each feature's bucket)"""
    starts, ends, letter = letter_runs(points)
    word_of = np.cumsum(np.bincount(starts, minlength=len(points))) - 1
    words, buckets = [np.arange(len(starts))], [(run_hashes(points, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)] if len(starts) else [np.zeros(0, np.int64)]
    for _, at, bucket in grams(points, ORDERS, BITS):
        words.append(word_of[at + ~letter[at]])
        buckets.append(bucket)
    return starts, np.concatenate(words), np.concatenate(buckets)


def emissions(weights: np.ndarray, n: int, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(word, own[bucket], n) for own in weights], 1) if n else np.zeros((0, len(weights)))


def _unit(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axes, keepdims=True)


def forward_backward(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and, with pairs, the expected number of each transition.

    emission: word, label; first: each sequence's first word, and one past the last. A sequence is cut into blocks; each
    block's product of transition matrices is taken for all blocks at once, the sequences are passed through block by block, and
    then all blocks are filled in at once. Exact: nothing is cut off at the ends of blocks.
    """
    labels = emission.shape[1]
    if not len(emission):
        return emission, np.zeros((labels, labels))
    move = np.exp(transitions)
    gain = np.exp(emission - emission.max(1, keepdims=True))
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    start = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(lengths)), blocks)
    within = np.arange(len(row)) - start[row]
    at = (first[row] + within * BLOCK)[:, None] + np.arange(BLOCK)
    real = at < first[row + 1][:, None]
    at = np.where(real, at, 0)
    own = gain[at]  # block, place, label
    head = within == 0  # nothing leads to a sequence's first word
    whole = np.broadcast_to(np.eye(labels), (len(row), labels, labels)).copy()
    for k in range(BLOCK):
        moved = whole @ move if k else np.where(head[:, None, None], whole, whole @ move)
        whole = np.where(real[:, k, None, None], _unit(moved * own[:, k, None, :], (1, 2)), whole)
    order = np.argsort(-blocks, kind="stable")
    before, after = np.empty((len(row), labels)), np.empty((len(row), labels))
    state, back = np.full((len(lengths), labels), 1 / labels), np.full((len(lengths), labels), 1 / labels)
    most = int(blocks.max(initial=0))
    active = [int(np.count_nonzero(blocks > k)) for k in range(most)]
    for k in range(most):
        seq = order[: active[k]]
        before[start[seq] + k] = state[seq]
        state[seq] = _unit((state[seq][:, None, :] @ whole[start[seq] + k])[:, 0], (1,))
    for k in range(most):  # the k-th block from the end
        seq = order[: active[k]]
        at_block = start[seq] + blocks[seq] - 1 - k
        after[at_block] = back[seq]
        back[seq] = _unit((whole[at_block] @ back[seq][:, :, None])[:, :, 0], (1,))
    alpha, beta = np.empty((len(row), BLOCK, labels)), np.empty((len(row), BLOCK, labels))
    for k in range(BLOCK):
        moved = before @ move if k else np.where(head[:, None], before, before @ move)
        step = _unit(moved * own[:, k], (1,))
        before = np.where(real[:, k, None], step, before)
        alpha[:, k] = before
    for k in range(BLOCK - 1, -1, -1):
        beta[:, k] = after
        after = np.where(real[:, k, None], _unit((after * own[:, k]) @ move.T, (1,)), after)
    flat = at[real]
    a, b = np.empty_like(emission), np.empty_like(emission)
    a[flat], b[flat] = alpha[real], beta[real]
    expected = np.zeros((labels, labels))
    if pairs:
        inner = np.ones(len(emission), bool)
        inner[first[:-1][lengths > 0]] = False
        t = np.flatnonzero(inner)
        joint = a[t - 1][:, :, None] * move * (gain[t] * b[t])[:, None, :]
        expected = _unit(joint, (1, 2)).sum(0)
    return _unit(a * b, (1,)), expected


def fit(texts: list[str], languages: list[str]) -> Model:
    """languages: of each text. Deterministic."""
    names = sorted(set(languages))
    labels = np.array([names.index(x) for x in languages])
    segments = []  # (label, features' words from 0, buckets, words)
    chance = np.random.RandomState(7)
    for row, end, points, at in code_points(texts):
        starts, word, bucket = features(points)
        order = np.argsort(word, kind="stable")
        word, bucket = word[order], bucket[order]
        text = np.searchsorted(at, starts, "right") - 1
        for r in range(end - row):
            lo, hi = np.searchsorted(text, [r, r + 1])
            while lo < hi:
                cut = min(hi, lo + chance.randint(*SEGMENT))
                a, b = np.searchsorted(word, [lo, cut])
                segments.append((labels[row + r], word[a:b] - lo, bucket[a:b], cut - lo))
                lo = cut
    weights, transitions = np.zeros((len(names), 1 << BITS)), np.zeros((len(names), len(names)))
    if len(names) < 2 or not segments:
        return Model(names, weights.astype(np.float32), transitions)
    seen, seen_moves = np.full(weights.shape, 1e-3), np.full(transitions.shape, 1e-3)
    for _ in range(EPOCHS):
        order, batch, size = chance.permutation(len(segments)), [], 0
        for k, s in enumerate(order):
            batch.append(segments[s])
            size += segments[s][3]
            if size < BATCH_WORDS and k + 1 < len(order):
                continue
            n = [x[3] for x in batch]
            ends = np.cumsum(n)
            word = np.concatenate([x[1] + e - m for x, e, m in zip(batch, ends, n, strict=True)])
            bucket = np.concatenate([x[2] for x in batch])
            label = np.repeat([x[0] for x in batch], n)
            first = np.unique(np.concatenate([[0], ends[SEQUENCE - 1 :: SEQUENCE], [size]]))
            found, expected = forward_backward(emissions(weights, size, word, bucket), first, transitions, pairs=True)
            found[np.arange(size), label] -= 1
            inner = np.setdiff1d(np.arange(1, size), first)
            np.add.at(expected, (label[inner - 1], label[inner]), -1)
            for own, past, slope in zip(weights, seen, found.T, strict=True):
                g = np.bincount(bucket, slope[word], 1 << BITS)
                g += PENALTY * size * own
                past += g * g
                own -= 0.25 * g / np.sqrt(past)
            seen_moves += expected * expected
            transitions -= 0.25 * expected / np.sqrt(seen_moves)
            batch, size = [], 0
    return Model(names, weights.astype(np.float32), transitions)


def label_texts(model: Model, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, starts of its words in lower-cased code points, language probabilities of each word) for every text."""
    for row, end, points, at in code_points(texts):
        starts, word, bucket = features(points)
        first = np.searchsorted(starts, at)
        found, _ = forward_backward(emissions(model.weights, len(starts), word, bucket), first, model.transitions)
        for r in range(end - row):
            yield row + r, starts[first[r] : first[r + 1]] - at[r] - 1, found[first[r] : first[r + 1]]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for text, _, found in label_texts(model, texts) if model.languages else ():
        if len(found):
            share = found.mean(0)
            names[text], scores[text] = model.languages[int(share.argmax())], float(min(1.0, share.max()))
    return names, scores


def train(docs: DataFrame) -> Model:
    """From rows that are not held out and have a doc_id, a text and a lang; at most TRAIN_EACH of each lang."""
    known = docs.select("doc_id", "lang").filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    # the smallest hashes of each language in every partition, and of these of all: one pass, whatever the number of languages
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= TRAIN_EACH).select("doc_id", "lang").distinct()
    chosen = saved(chosen)  # the join knows its size: broadcast if it is small
    rows = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).filter("text is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    if not len(rows):
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0)))
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string and lang_score double, replacing columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(each, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang).

    Null texts and texts without a letter are 'und' with score 0, and so is every text where no row can be learned from. Texts are read whole,
    however long; of languages with equal shares the first by name is taken. Other columns are ignored. Repeated rows get equal results; a null doc_id counts as not held out but is not learned from; an empty table gives an empty result.
    """
    found = identified(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
