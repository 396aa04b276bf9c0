"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists of every dimension.

Candidates are dealt into shards and queries into blocks, both of bounded size; a pair of a shard and a block is a tile, and a tile is one group. Inside a
tile the shard's vectors are sorted once by each dimension. A query walks the lists of its dimensions side by side, from the end that its component favours,
scores what it meets for the first time, and stops when the score that a vector not met yet could reach, the sum over the dimensions of the components last
seen, is below its kth result. The best of every tile are merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, saved, tidy
from .vectors import cells, matrix

K = 5
EVERY = 50
#: Vectors of a shard at most, and at least where that gives tasks enough; queries of a block.
SHARD, LEAST_SHARD, BLOCK = 16_384, 1_024, 2_048
#: Entries of each list that the first step reads; every further step reads as many as all before it.
FIRST_STEP = 8


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, places of its best vectors, their scores): the k highest, ties to the smaller id, without the vector of the query's own id.

    ids must ascend.
    """
    n, width = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)  # a list of places for each dimension
    ordered = np.take_along_axis(vectors.T, order, axis=1)
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(queries).max(initial=0)))
    exact = np.float64 if largest * largest * max(width, 1) < 1 << 53 else np.int64
    scored = np.ascontiguousarray(vectors, exact)
    own = np.searchsorted(ids, query_ids)
    for at, query in enumerate(queries):
        seen = np.zeros(n, bool)
        if own[at] < n and ids[own[at]] == query_ids[at]:
            seen[own[at]] = True
        used = np.flatnonzero(query)
        up = query[used] > 0
        weights = query[used]
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_STEP
        while depth < n:
            end = min(n, depth + step) if len(used) else n
            if len(used):
                met = np.concatenate([order[used[up], n - end : n - depth].ravel(), order[used[~up], depth:end].ravel()])
                fresh = np.unique(met[~seen[met]])
            else:  # every score is zero
                fresh = np.flatnonzero(~seen)
            seen[fresh] = True
            if len(fresh):
                best = np.concatenate([best, fresh])
                scores = np.concatenate([scores, (scored[fresh] @ query.astype(exact)).astype(np.int64)])
                if len(best) > k:  # ids ascend, so places decide ties
                    kept = np.lexsort((best, -scores))[:k]
                    best, scores = best[kept], scores[kept]
            depth, step = end, end
            if len(best) == k and depth < n:
                last = np.where(up, ordered[used, n - depth], ordered[used, depth - 1])
                if int(weights @ last) < scores.min():
                    break
        if len(best):
            kept = np.lexsort((best, -scores))
            yield at, best[kept], scores[kept]


_FOUND = "query_id long, vec_id long, score long"


def nearest(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the highest inner product with each vector whose id is divisible by every.

    rows: (vec_id, embedding), further columns are ignored. Components are floor(256 * x), held within 2^24 either way; a shorter vector counts as filled up with
    zeros, and an empty one as zeros. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat an
    id count once, with the smallest of their vectors. Ties go to the smaller id. A query with fewer than k others gets all of them; an empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    with tidy(spark):
        own = saved(cells(rows).filter("vec_id is not null").groupBy("vec_id").agg(F.min("cells").alias("cells")))
        asked = own.filter(F.col("vec_id") % every == 0)
        n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("cells")), F.lit(0))).first()
        blocks = max(1, -(-asked.count() // BLOCK))
        tasks = partitions(spark)
        shards = max(1, -(-n // SHARD), min(2 * tasks, -(-n // LEAST_SHARD)))
        deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count))
        each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        candidates = own.select(deal(shards, 1).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "cells")
        questions = asked.select(deal(blocks, 2).alias("block"), each(shards).alias("shard"), F.lit(True).alias("asks"), "vec_id", "cells")

        def tile(group: pa.Table) -> pa.Table:
            asks = group.column("asks").combine_chunks()
            held, wanted = group.filter(pc.invert(asks)).sort_by("vec_id"), group.filter(asks)
            ids, query_ids = held.column("vec_id").to_numpy(), wanted.column("vec_id").to_numpy()
            found = list(threshold_search(ids, matrix(held.column("cells"), width), query_ids, matrix(wanted.column("cells"), width), k)) if len(ids) and len(query_ids) else []
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            return pa.table([pa.array(join([np.full(len(b), query_ids[at]) for at, b, _ in found])), pa.array(join([ids[b] for _, b, _ in found])), pa.array(join([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

        tiles = candidates.unionByName(questions).repartition(max(tasks, min(2 * shards * blocks, 8 * tasks)), "shard", "block")
        found = tiles.groupBy("shard", "block").applyInArrow(tile, _FOUND)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        return saved(best.select("query_id", "rank", "vec_id", "score"), keep=True)
