"""Benchmark decontamination: which documents contain a benchmark item.

An inverted index of the items answers BM25 queries by block-max WAND. Every passage of every document is a query: PASSAGE words,
beginning every half passage. A score is taken as a share of the item's score for its own text, so that one threshold serves
all items. Retrieved items are verified on the document's own words: the question (all but the item's last sentence) and the
answer (its last sentence) must both overlap.

What is broadcast is bounded however long the benchmark is: the index is cut into shards of at most SHARD_WORDS words, or of one bucket of
items if that alone has more, as one item has to fit into memory; a bucket is a sixteenth of a shard on average. Long items are indexed as parts of at
most PASSAGE words. Document frequencies count all parts of all shards. Documents are never shuffled.

Most passages have no item near the threshold. WAND's bound by largest impacts of terms is too loose to tell so for short items, so a bound per
unit goes first for all passages at once (see promising); it is never below the score, so WAND finds all units that it would find without it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .words import PLAIN_BYTE, mix, spans, steps, word_hashes

PASSAGE = 64
HALF = PASSAGE // 2
THRESHOLD = 0.5
OVERLAP = 0.5
ANSWER_WORDS = 5
K1, B = 1.2, 0.75
BLOCK = 8
SHARD_WORDS = 2_000_000
#: Share of an item's own score that its less telling terms may make up; the first bound looks at the others only.
LESS_TELLING = 0.2


def words_of(text: str | None) -> np.ndarray:
    for _, _, data, at in steps(pa.array([(text or "").lower()], pa.large_string()), 1 << 62):
        starts, ends, _ = spans(data, at, PLAIN_BYTE)
        return word_hashes(data, starts, ends)
    return np.zeros(0, np.uint64)


def question_and_answer(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The words of both. The last sentence is the answer, or the last ANSWER_WORDS words if it is shorter; a question of fewer words
    than that leaves all to the answer."""
    words = words_of(text)
    cuts = [m.end() for m in re.finditer(r"[.?!:\n]\s+", (text or "").rstrip())]
    size = max(ANSWER_WORDS, len(words_of(text[cuts[-1] :])) if cuts else 0)
    cut = len(words) - size if len(words) - size >= ANSWER_WORDS else 0
    return words[:cut], words[cut:]


def overlap(part: np.ndarray, near: np.ndarray) -> float:
    """Share of the distinct runs of three words of part (of all its words, if fewer) that near holds; 1 if part is empty."""
    k = min(3, len(part))
    if not k:
        return 1.0
    runs = lambda w: np.unique(mix(sum((w[i : len(w) - k + 1 + i] * np.uint64(2 * i + 1) for i in range(k)), np.zeros(max(0, len(w) - k + 1), np.uint64))))
    return float(np.isin(runs(part), runs(near)).mean()) if len(near) >= k else 0.0


def parts_of(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // PASSAGE)) if len(words) else []


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # of each term's postings
    units: np.ndarray  # ascending within a term
    impacts: np.ndarray  # share of the unit's own score
    most: np.ndarray  # per term
    blocks: list[np.ndarray]  # per term, largest impact of each block of postings
    telling: np.ndarray  # per term: looked at by the first bound
    rest: np.ndarray  # per unit: impacts of its terms that aren't telling
    item: np.ndarray  # per unit
    sieve: np.ndarray  # low 16 bits of telling terms

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of words that are terms, their terms)"""
        if not len(self.terms):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        own = np.flatnonzero(self.terms[at] == words)
        return own, at[own]


def build(items: list[np.ndarray], held: dict[int, int] | None = None, units: int = 0) -> Index:
    """items: each one's words. held: in how many of all units each term is, where items are only one shard of them."""
    parts = [(i, part) for i, words in enumerate(items) for part in parts_of(words)]
    counted = [np.unique(part, return_counts=True) for _, part in parts]
    terms, place = np.unique(np.concatenate([t for t, _ in counted]) if counted else np.zeros(0, np.uint64), return_inverse=True)
    n = max(units, len(parts))
    df = np.bincount(place, minlength=len(terms)) if held is None else np.array([held[int(t)] for t in terms])
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    unit = np.repeat(np.arange(len(parts)), [len(t) for t, _ in counted])
    tf = np.concatenate([c for _, c in counted]).astype(float) if counted else np.zeros(0)
    length = np.array([len(p) for _, p in parts], float)
    scale = K1 * (1 - B + B * length / length.mean()) if len(parts) else length
    gain = idf[place] * tf * (K1 + 1) / (tf + scale[unit])
    impact = gain / np.bincount(unit, gain, len(parts))[unit] if len(parts) else gain
    order = np.lexsort((unit, place))
    units_, impacts, place_ = unit[order], impact[order], place[order]
    first = np.searchsorted(place_, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(impacts, first[:-1]) if len(terms) else np.zeros(0)
    blocks = [np.maximum.reduceat(impacts[a:b], np.arange(0, b - a, BLOCK)) for a, b in zip(first, first[1:])]
    telling = np.zeros(len(terms), bool)
    by_unit = np.lexsort((df[place], unit))
    before = np.cumsum(impact[by_unit]) - impact[by_unit]
    before -= before[np.searchsorted(unit[by_unit], unit[by_unit])]
    telling[place[by_unit][before < 1 - LESS_TELLING]] = True
    rest = np.bincount(units_, np.where(telling[place_], 0, impacts), len(parts))
    sieve = np.zeros(1 << 16, bool)
    sieve[(terms[telling] & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(terms, first, units_, impacts, most, blocks, telling, rest, np.array([i for i, _ in parts], np.int64), sieve)


def wand(index: Index, terms: np.ndarray, least: float = THRESHOLD) -> list[tuple[int, float]]:
    """(unit, score) of every unit whose impacts over the query's distinct terms come to least or more."""
    lists = []  # [unit at the cursor, cursor, end, term]
    for t in terms:
        lists.append([int(index.units[index.first[t]]), int(index.first[t]), int(index.first[t + 1]), int(t)])
    units, impacts, most, found = index.units, index.impacts, index.most, []

    def move(cursor: list, to: int) -> None:
        cursor[1] += int(np.searchsorted(units[cursor[1] : cursor[2]], to))
        cursor[0] = int(units[cursor[1]]) if cursor[1] < cursor[2] else 1 << 62

    while True:
        lists.sort()
        while lists and lists[-1][0] == 1 << 62:
            lists.pop()
        bound, pivot = 0.0, -1
        for k, cursor in enumerate(lists):
            bound += most[cursor[3]]
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        unit = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
            pivot += 1
        bound, ends = 0.0, 1 << 62
        for cursor in lists[: pivot + 1]:
            start = index.first[cursor[3]]
            at = cursor[1] + int(np.searchsorted(units[cursor[1] : cursor[2]], unit))
            if at < cursor[2]:
                block = (at - start) // BLOCK
                bound += index.blocks[cursor[3]][block]
                ends = min(ends, int(units[min(start + (block + 1) * BLOCK, cursor[2]) - 1]))
        if bound < least:  # no unit up to the nearest block's end can reach the threshold
            to = min(ends + 1, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62)
            for cursor in lists[: pivot + 1]:
                if cursor[0] < to:
                    move(cursor, to)
        elif lists[0][0] == unit:
            score = sum(float(impacts[cursor[1]]) for cursor in lists[: pivot + 1])
            if score >= least:
                found.append((unit, score))
            for cursor in lists[: pivot + 1]:
                move(cursor, unit + 1)
        else:
            for cursor in lists[: pivot + 1]:
                if cursor[0] < unit:
                    move(cursor, unit)


def promising(index: Index, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the passages that can reach the threshold, by a bound from above over telling terms; first: each row's first word.

    Half passages are added up per unit; a passage is two halves in a row. For a passage p and a unit u, score(p, u) is the sum of impact(t, u) over
    the distinct terms t of p that u has. Telling ones among them are added up here (a term that is in both halves twice, which only raises the sum), and the
    others come to at most rest(u), whichever p has. So the bound is at least the score. A unit without any telling term in p scores at most
    rest(u) <= LESS_TELLING < THRESHOLD and is rightly left out.
    """
    maybe = np.flatnonzero(index.sieve[(words & np.uint64(0xFFFF)).astype(np.int64)])
    own, terms = index.rows(words[maybe])
    own, terms = maybe[own][index.telling[terms]], terms[index.telling[terms]]
    if not len(own):
        return own
    row = np.searchsorted(first, own, "right") - 1
    halves = np.concatenate([[0], np.cumsum(-(-np.diff(first) // HALF) + 1)])  # one more between rows
    half = halves[row] + (own - first[row]) // HALF
    times = index.first[terms + 1] - index.first[terms]
    posting = np.repeat(index.first[terms] - np.cumsum(times) + times, times) + np.arange(times.sum())
    units = len(index.rest)
    key, at = np.unique(np.repeat(half, times) * units + index.units[posting], return_inverse=True)
    total = np.bincount(at, index.impacts[posting])
    # the passage that begins at the previous half may have telling terms in its second half only
    early = np.setdiff1d(key[~np.isin(key // units, halves)] - units, key)
    order = np.argsort(np.concatenate([key, early]), kind="stable")
    key, total = np.concatenate([key, early])[order], np.concatenate([total, np.zeros(len(early))])[order]
    after = np.minimum(np.searchsorted(key, key + units), len(key) - 1)
    total = total + np.where(key[after] == key + units, total[after], 0) + index.rest[key % units]
    half = np.unique(key[total >= THRESHOLD - 1e-9] // units)
    row = np.searchsorted(halves, half, "right") - 1
    return first[row] + (half - halves[row]) * HALF


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

#: An index and, of each of its items, id, question and answer.
Shard = tuple[Index, list[tuple[int | None, np.ndarray, np.ndarray]]]


def _matches(shard: Shard, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
    """(place in texts, item's place in the shard, score, overlaps), once for each text and item, by its best passage."""
    index, items = shard
    for row0, _, data, at in steps(pa.array([(x or "").lower() for x in texts], pa.large_string())):
        starts, ends, first = spans(data, at, PLAIN_BYTE)
        words = word_hashes(data, starts, ends)
        best: dict[tuple[int, int], tuple] = {}
        for start in promising(index, words, first):
            row = int(np.searchsorted(first, start, "right")) - 1
            end = min(start + PASSAGE, first[row + 1])
            for unit, score in wand(index, np.unique(index.rows(words[start:end])[1])):
                item = int(index.item[unit])
                _, question, answer = items[item]
                reach = PASSAGE + len(question) + len(answer)
                near = words[max(first[row], start - reach) : min(first[row + 1], end + reach)]
                q, a = overlap(question, near), overlap(answer, near)
                if q >= OVERLAP and a >= OVERLAP and score > best.get((row, item), (0,))[0]:
                    best[row, item] = (score, q, a)
        for (row, item), (score, q, a) in best.items():
            yield row0 + row, item, min(score, 1.0), q, a


def packed(buckets: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Buckets (name, words) in groups of at most limit words; one that has more is alone."""
    groups: list[list[int]] = []
    size = limit
    for name, words in sorted(buckets):
        if size + words > limit:
            groups.append([])
            size = 0
        groups[-1].append(name)
        size += words
    return groups


def _shards(benchmark: DataFrame) -> Iterator[Shard]:
    """The index in shards of at most SHARD_WORDS words (or one bucket of items), one at a time."""
    spark = benchmark.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(p) for x in batch.column("text").to_pylist() for p in parts_of(words_of(x))]
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            unit = np.concatenate([np.arange(len(x)) == 0 for x in own]) if own else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(unit.astype(np.int64))], ["term", "unit"])

    counts = saved(benchmark.mapInArrow(terms, "term long, unit long").groupBy("term").agg(F.count("*").alias("held"), F.sum("unit").alias("unit")))
    units = counts.agg(F.sum("unit")).first()[0] or 0
    size = F.length("text") / 4 + 1  # about as many words
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(16 * max(1, math.ceil(total / SHARD_WORDS))))
    sizes = [(r.bucket, math.ceil(r.words)) for r in benchmark.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("words")).collect()]
    for group in packed(sizes, SHARD_WORDS):
        rows = benchmark.filter(bucket.isin(group)).orderBy("item_id", "text").collect()
        words = [words_of(r.text) for r in rows]
        wanted = np.unique(np.concatenate(words)).view(np.int64) if words else np.zeros(0, np.int64)
        names = spark.createDataFrame(pa.table({"term": wanted}))
        held = {int(np.array([r.term], np.int64).view(np.uint64)[0]): r.held for r in counts.join(F.broadcast(names), "term").collect()}
        yield build(words, held, units), [(r.item_id, *question_and_answer(r.text)) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the items that documents contain, once per row of docs and item.

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are ignored. Null and empty texts, and items
    without words, match nothing. Repeated rows of docs give repeated results, repeated items count once; items with equal texts and different ids are
    all found, with equal scores. Of equally good passages the first counts. Null ids are kept as null. Texts are read whole, passage by passage. Empty
    tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shard in _shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def matches(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_matches(shared.value, batch.column("text").to_pylist()))
                place, item, *numbers = zip(*rows, strict=True) if rows else [[]] * 5
                ids = [shared.value[1][k][0] for k in item]
                columns = [batch.column("doc_id").take(pa.array(place, pa.int64())), pa.array(ids, pa.int64()), *[pa.array(x, pa.float64()) for x in numbers]]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])

        one = docs.mapInArrow(matches, _SCHEMA)
        found = one if found is None else found.unionAll(one)
    return docs.sparkSession.createDataFrame([], _SCHEMA) if found is None else found


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text contains a benchmark item, with docs' own columns, whatever their names.

    Each row is judged by its own text alone, so repeated ids and rows without an id stand or fall by themselves. Null and empty texts stay.
    The shards are filters one after the other: each sees what the one before it has left, in one pass over docs.
    """
    for shard in _shards(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _matches(shared.value, batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
