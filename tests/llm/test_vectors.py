"""Search and codes of vectors against plain Python, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest

from schemaloom.llm import codes, topk
from schemaloom.llm.vectors import LARGEST

SCHEMA = "vec_id long, embedding array<float>, label int, cells string, rank int"
NAN, INF = float("nan"), float("inf")


def whole(x):
    return max(-LARGEST, min(LARGEST, math.floor(max(-1e30, min(1e30, 256 * x)))))


def kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 3) for r in rows], SCHEMA)


def some_vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(np.float32(x)) for x in rng.normal(0, spread, width)], int(rng.integers(0, 3)) if k % 7 else None) for k in range(n)]


ODD = [(None, [1.0, 1.0], 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [NAN, 1.0], 2), (1003, [INF, 0.0], None), (1050, [], None), (1100, [0.5], 2), (1101, [1e30, -1e30], 2), (1150, [0.0, 0.0], 0)]


def plain_nearest(rows, k, every):
    vectors = {}
    for i, v, *_ in kept(rows):
        if i is not None:
            cells = [whole(x) for x in v]
            vectors[i] = min(vectors.get(i, cells), cells)
    found = set()
    for q, a in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)
            found |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])}
    return found


@pytest.mark.parametrize("rows", [
    some_vectors(700, 8, 1) + ODD,
    some_vectors(300, 3, 2, 0.01),  # many equal scores
    some_vectors(40, 4, 3) * 3 + [(k, [0.25, 0.5, 0.25, -0.5], 1) for k in range(100, 400)],  # repeated ids, one vector of many ids
    [(0, [1.0], 1), (50, [2.0], 1)], [(0, [1.0], 1)], ODD, [],
], ids=["odd", "ties", "copies", "few", "one", "only odd", "empty"])
def test_search_equals_all_products(spark, rows):
    found = topk.nearest(frame(spark, rows))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_nearest(rows, 5, 50))


def test_search_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60), monkeypatch.setattr(topk, "LEAST_SHARD", 10), monkeypatch.setattr(topk, "BLOCK", 4)
    rows = some_vectors(500, 6, 4)
    assert sorted(map(tuple, topk.nearest(frame(spark, rows), 3, 20).collect())) == sorted(plain_nearest(rows, 3, 20))


def test_search_stops_early():
    """On vectors that differ in few dimensions, far from all are scored."""
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(0, 1, (20_000, 12)) * 256 * np.array([1.0, 0.5] + [0.001] * 10)).astype(np.int64)

    class Counted(np.ndarray):
        met = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype != bool and at.ndim == 1:
                Counted.met += len(at)
            return np.asarray(super().__getitem__(at))

    plain = np.argsort(-(vectors @ vectors[7]), kind="stable")
    original = np.ascontiguousarray
    try:
        topk.np.ascontiguousarray = lambda a, kind=None: original(a, kind).view(Counted)
        [(at, best, scores)] = topk.threshold_search(np.arange(20_000), vectors, np.array([7]), vectors[7:8], 5)
    finally:
        topk.np.ascontiguousarray = original
    assert [x for x in plain if x != 7][:5] == list(best)
    assert 0 < Counted.met < 10_000


def plain_codes(rows):
    rows = kept(rows)
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 16)
    cut = []
    for i, v, label in rows:
        cells = [whole(x) for x in v]
        cells += [0] * (16 * width - len(cells))
        cut.append((i, label, [cells[p * width : (p + 1) * width] for p in range(16)], [whole(x) for x in v]))
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:64]
    books = [[r[2][p] for r in first] for p in range(16)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((square(part, e), j) for j, e in enumerate(books[p])) for p, part in enumerate(r[2])] for r in cut]
    for _ in range(2):
        own = assign()
        for p in range(16):
            for j in range(len(books[p])):
                parts = [r[2][p] for r, o in zip(cut, own) if o[p][1] == j]
                if parts:
                    books[p][j] = [sum(x) // len(parts) for x in zip(*parts)]
    own = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in o) for o in own]
    by_label = {}
    for r, e in zip(cut, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    return [(r[0], "".join(f"{j:02x}" for _, j in o), e, by_label[r[1]], digest) for r, o, e in zip(cut, own, errors)]


@pytest.mark.parametrize("rows", [
    some_vectors(300, 32, 1),
    some_vectors(200, 16, 2, 0.01),  # many equal distances, repeated entries
    some_vectors(150, 20, 3) + ODD,
    some_vectors(30, 16, 4) + [(k, [0.25] * 16, 1) for k in range(100, 300)] + [(7, [0.25] * 16, 1)] * 3,
    [(0, [1.0], 1)], [(0, [], 1)], [(1, None, 1)], [],
], ids=["plain", "ties", "odd", "copies", "one", "no components", "none kept", "empty"])
def test_codes_equal_plain_lloyd(spark, rows):
    found = codes.compressed(frame(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_codes(rows), key=repr)


def test_bounds_rule_out_entries_and_hold():
    """After entries have moved, most distances need not be computed, and no bound is broken."""
    rng = np.random.default_rng(6)
    centers = rng.integers(-4000, 4000, (64, 4))
    parts = (centers[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))).astype(np.int64)
    book = codes.Codebook(centers.astype(np.int64))
    own, upper, lower, _ = codes.first_assigned(book, parts)
    new = centers + rng.integers(-3, 4, centers.shape)
    moved = np.sqrt(((new - centers) ** 2).sum(1)) * (1 + 1e-12)
    own, upper, lower, square, computed = codes.reassigned(codes.Codebook(new.astype(np.int64)), parts, own, upper, lower, moved)
    exact = ((parts[:, None] - new[None]) ** 2).sum(2)
    assert (own == exact.argmin(1)).all() and (square == exact.min(1)).all()
    assert (lower.astype(float) <= np.sqrt(exact)).all() and (upper.astype(float) >= np.sqrt(exact.min(1))).all()
    assert computed < 0.05 * exact.size


def test_codes_of_common_and_rare_labels(spark):
    rows = [(k, "ab" if k % 3 else f"l{k}", k) for k in range(3000)] + [(-1, None, 5), (-2, None, 6)]
    found = codes.with_label_errors(spark.createDataFrame(rows, "vec_id long, label string, error long").selectExpr("*", "'' as code"))
    total = {}
    for _, label, error in rows:
        total[label] = total.get(label, 0) + error
    assert {(r.vec_id, r.label_error) for r in found.collect()} == {(i, total[label]) for i, label, _ in rows}
