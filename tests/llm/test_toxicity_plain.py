"""The classifier against plain sums: n-grams, log-count ratios, the fit and the scores, each by its definition."""

import math
import random

import numpy as np
import pytest

from schemaloom.llm import toxicity as t

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_set(text):
    """Buckets of all 3- to 5-grams that hold no blank inside; signs other than letters are blanks."""
    signs = [" "] + [c if c.isalpha() else " " for c in (text or "").lower()] + [" "]
    found = set()
    for order in (3, 4, 5):
        for k in range(len(signs) - order + 1):
            own = signs[k : k + order]
            if all(c != " " for c in own[1:-1]):
                state = ord(own[0])
                for c in own[1:]:
                    state = (state * 0x9E3779B97F4A7C15 + ord(c)) & MASK
                found.add(mixed((state + order) & MASK) >> (64 - t.BITS))
    return found


def texts(seed, n):
    draw = random.Random(seed)
    clean, foul = ["river", "garden", "Morning", "ünder", "tree", "a", "book-shop"], ["vile", "VILEST", "rotten", "scumbag"]
    rows = []
    for k in range(n):
        toxic = k % 3 == 0
        rows.append((" ".join(draw.choices(clean, k=draw.randint(0, 12)) + (draw.choices(foul, k=draw.randint(1, 3)) if toxic else [])), int(toxic)))
    return rows + [("", 0), (None, 1), ("!!! 123", 0)]


def plain_model(rows):
    """Weights w(f) * r(f) of a logistic regression on features r(f), and its bias, by the same steps of gradient descent."""
    sets, labels = [plain_set(x) for x, _ in rows], [y for _, y in rows]
    n, ones = len(rows), sum(labels)
    names = set().union(*sets)
    p = {f: sum(f in s for s, y in zip(sets, labels) if y) for f in names}
    q = {f: sum(f in s for s, y in zip(sets, labels) if not y) for f in names}
    r = {f: math.log((p[f] + 1) / (ones + 2)) - math.log((q[f] + 1) / (n - ones + 2)) for f in names}
    kept = sorted(f for f in names if p[f] + q[f] >= t.LEAST_TEXTS and abs(r[f]) >= t.LEAST_RATIO)
    place = {f: k for k, f in enumerate(kept)}
    share = (ones + 0.5) / (n + 1)
    w, bias = [0.0] * len(kept), math.log(share / (1 - share))
    first, second = [0.0] * (len(kept) + 1), [0.0] * (len(kept) + 1)
    for k in range(1, t.ROUNDS + 1):
        slope = [t.PENALTY * x for x in w] + [0.0]
        for s, y in zip(sets, labels):
            own = [f for f in s if f in place]
            z = bias + sum(w[place[f]] * r[f] for f in own)
            off = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * (0.5 / ones if y else 0.5 / (n - ones)) * n
            slope[-1] += off
            for f in own:
                slope[place[f]] += off * r[f]
        first = [0.9 * a + 0.1 * b for a, b in zip(first, slope)]
        second = [0.99 * a + 0.01 * b * b for a, b in zip(second, slope)]
        move = [0.05 * (a / (1 - 0.9**k)) / (math.sqrt(b / (1 - 0.99**k)) + 1e-8) for a, b in zip(first, second)]
        w, bias = [a - b for a, b in zip(w, move)], bias - move[-1]
    final = {f: w[place[f]] * r[f] for f in kept}
    most = max(map(abs, final.values()), default=0)
    return bias, {f: x for f, x in final.items() if abs(x) > 1e-3 * most}


@pytest.fixture(scope="module")
def models():
    rows = texts(1, 60)
    return t.fit([x for x, _ in rows], np.array([y for _, y in rows])), plain_model(rows)


def test_fit_equals_plain_sums(models):
    found, (bias, weights) = models
    assert found.bias == pytest.approx(bias, abs=1e-6)
    have = dict(zip(found.buckets.tolist(), found.weights.tolist(), strict=True))
    assert all(have.get(f, 0) == pytest.approx(weights.get(f, 0), abs=2e-5) for f in set(have) | set(weights)) and len(have) > 20


def test_scores_equal_plain_sums(spark, models):
    model = models[0]
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    rows = [x for x, _ in texts(2, 80)] + ["vile " * 50_000, "x" * 300_000 + " rotten", "𝔳𝔦𝔩𝔢 VILE.vile", "a", "ab", "é"]
    plain = [1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weight.get(f, 0) for f in plain_set(x)))))) for x in rows]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: (r.toxicity, r.toxic) for r in t.scored(frame, model).collect()}
    assert [found[k][0] for k in range(len(rows))] == pytest.approx(plain, abs=1e-6)
    assert [found[k][1] for k in range(len(rows))] == [int(p >= 0.5) for p in plain]
