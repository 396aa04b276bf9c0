"""Document fingerprints: threshold-scaled sketches of word 5-grams.

A sketch keeps every shingle hash up to a fixed fraction of the hash range, so its size follows the document, sketches
of parts merge into the sketch of the whole, and very unequal documents are still compared on the same
hashes. So that short documents are compared too, the FLOOR smallest hashes are kept whatever their value. A sketch
states the bound up to which it holds every hash of its document; two sketches are compared up to the
smaller bound of the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions
from .words import shingles, steps

FRACTION = 1 / 8
#: Least hashes of a sketch, if the document has as many. Documents of fewer than about FLOOR / FRACTION shingles keep a larger share than FRACTION,
#: up to all of them: with FRACTION alone most of them would have a handful of hashes or none. 0 leaves FRACTION alone.
FLOOR = 64
_LIMIT = np.uint64(int(FRACTION * 2**64) - 1)
_ALL = np.uint64(2**64 - 1)
_ROWS = 512

Sketch = tuple[np.uint64, np.ndarray]


def sketch(hashes: np.ndarray, floor: int = FLOOR) -> Sketch:
    """(bound, sorted distinct hashes up to it) of all shingle hashes of a document."""
    own = np.unique(hashes[hashes <= _LIMIT])
    if len(own) >= floor:
        return _LIMIT, own
    own = np.unique(hashes)
    return (_ALL, own) if len(own) <= floor else (max(_LIMIT, own[floor - 1]), own[:floor])


def merge(a: Sketch, b: Sketch, floor: int = FLOOR) -> Sketch:
    """The sketch of the union of two documents' shingles, from their sketches alone."""
    own = np.union1d(a[1], b[1])
    bound = min(a[0], b[0])
    if len(own) > floor:
        bound = min(bound, max(_LIMIT, own[floor - 1] if floor else _LIMIT))
    return bound, own[own <= bound]


def _common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    bound = min(a[0], b[0])
    x, y = a[1][: np.searchsorted(a[1], bound, "right")], b[1][: np.searchsorted(b[1], bound, "right")]
    if not len(x) or not len(y):
        return 0, len(x), len(y)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity of two documents: 1 for two without shingles, 0 if only one has none."""
    both, x, y = _common(a, b)
    return 1.0 if not x + y else both / (x + y - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of a that b holds; 1 if a has none."""
    both, x, _ = _common(a, b)
    return both / x if x else 1.0


def to_text(a: Sketch) -> str:
    return f"{int(a[0]):016x}:{a[1].astype('>u8').tobytes().hex()}"


def from_text(text: str) -> Sketch:
    bound, _, own = text.partition(":")
    return np.uint64(int(bound, 16)), np.frombuffer(bytes.fromhex(own), ">u8").astype(np.uint64)


def sketches(texts: list[str]) -> list[Sketch]:
    found = []
    for row, end, data, at in steps(pa.array(texts, pa.large_string())):
        hashes, first = shingles(data, at)
        found += [sketch(hashes[first[r] : first[r + 1]]) for r in range(end - row)]
    return found


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, contained_in_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in document order; the last (tail) is the one after the partition's end."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        mine, next_ones = texts[:-1], texts[1:]
        changed = [edited(a, b) for a, b in zip(mine, next_ones, strict=True)]
        own, new = sketches(texts), sketches(changed)
        columns = [
            ids[:-1], [len(x) for x in mine], [hashlib.sha256(x.encode()).hexdigest() for x in changed], [to_text(x) for x in own[:-1]], [to_text(x) for x in new],
            [likeness(a, b) for a, b in zip(own, new)], [likeness(a, b) for a, b in zip(own, own[1:])], [containment(a, b) for a, b in zip(own, new)], [containment(a, b) for a, b in zip(own, own[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    ids: list = []
    texts: list[str] = []
    ended = False
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            for i, text, tail in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("tail").to_pylist(), strict=True):
                if ended:
                    continue
                ids.append(i)
                texts.append(text or "")
                ended = tail
            if len(texts) > 1:
                yield rows(ids, texts)
                ids, texts = ids[-1:], texts[-1:]


#: Where rows without a doc_id stand, and from where on their ties are, so that they come after a document of that very id.
_LAST, _NO_ID = 2**63 - 1, 1 << 31


def boundaries(quantiles: list[float]) -> list[tuple[int, int]]:
    """(place, tie) at which a partition begins, from quantiles of the places. A place that fills several partitions is cut by ties."""
    places = [min(int(x), _LAST) for x in quantiles]
    found = []
    for place in sorted(set(places)):
        times, least = places.count(place), _NO_ID if place == _LAST else 0
        found += [(place, least + k * _NO_ID // times) for k in range(times)]
    return found


def part_of(cuts: list[tuple[int, int]], place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many cuts are not after (place, tie), by binary search."""
    cut_place, cut_tie = (np.array([x[k] for x in cuts], np.int64) for k in (0, 1))
    low, high = np.searchsorted(cut_place, place), np.searchsorted(cut_place, place, "right")
    part = low.copy()
    for start in np.unique(low[high > low]):
        own = np.flatnonzero((low == start) & (high > low))
        part[own] += np.searchsorted(cut_tie[start : high[own[0]]], tie[own], "right")
    return part


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text string): n_chars, the edited text's SHA-256, both fingerprints, likenesses. Other columns are ignored.

    The next document is the next in ascending doc_id (ties by a hash of the text, then by the text), after the last the first; a single
    document follows itself. Null texts count as empty; rows without a doc_id come last, in the order of ties. Repeated rows follow
    each other. A text is read whole and has to fit into memory; texts without words have an empty fingerprint and are alike.
    An empty table gives an empty result.

    The texts are shuffled once: ranges of (doc_id, hash of the text) become partitions, so that many rows of one id or of none are split as well,
    and each range also gets the first document of the range after it, which is all that it needs from elsewhere. Only
    one boundary and one first place for each partition pass the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 33) + F.when(F.col("doc_id").isNull(), F.lit(_NO_ID)).otherwise(F.lit(0))
    docs = docs.withColumns({"place": F.coalesce("doc_id", F.lit(_LAST)), "tie": tie})
    count = max(partitions(spark), 1)
    cuts = boundaries(docs.stat.approxQuantile("place", [k / count for k in range(1, count)], 0.1 / count)) if count > 1 else []

    @F.pandas_udf("int")
    def part(place: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(part_of(cuts, place.to_numpy(), tie.to_numpy()).astype(np.int32))

    ranges = docs.withColumn("part", part("place", "tie"))
    order = F.col("place").cast("decimal(38,0)") * F.lit(2**32).cast("decimal(18,0)") + F.col("tie").cast("decimal(18,0)")
    ranges = ranges.withColumn("order", order.cast("decimal(38,0)"))
    firsts = sorted(tuple(x) for x in ranges.groupBy("part").agg(F.min("order")).collect())
    before = pa.table({"order": pa.array([x for _, x in firsts], pa.decimal128(38, 0)), "to_before": pa.array([firsts[k - 1][0] for k in range(len(firsts))], pa.int32())})
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    heads = F.broadcast(spark.createDataFrame(before))  # one row per partition
    dealt = ranges.join(heads, "order", "left")
    sent = F.when(F.col("to_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to_before").alias("part"), F.lit(True).alias("tail"))))
    dealt = dealt.withColumn("to", F.explode(sent)).select("doc_id", "text", "place", "tie", "to.part", "to.tail")
    return dealt.repartitionById(count, F.col("part")).sortWithinPartitions("tail", "place", "tie", "text").mapInArrow(_compare, _SCHEMA)
