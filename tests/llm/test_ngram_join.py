import random
import re

import pytest

from schemaloom.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d)) for d in ids}


def rows_of(frame):
    return {tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()}


def copies(seed, n, words, base_words=120, passage=60):
    """Random texts, copies of one another with some words changed, and texts around one common passage."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(words)}"
    common = [word() for _ in range(passage)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.45:
            own = r.choice(texts).split()
            for _ in range(r.randrange(4)):
                if own:
                    own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
        elif kind < 0.7:
            texts.append(" ".join([word() for _ in range(r.randrange(40))] + common + [word() for _ in range(r.randrange(40))]))
        else:
            texts.append(" ".join(word() for _ in range(r.randrange(base_words))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_brute_force(spark, seed):
    rows = copies(seed, 150, 5000)
    found = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found) == brute_force(rows)


def test_near_copies_of_two_bases(spark):
    rows = [(k, " ".join(f"w{x}" for x in range(100) if x != k % 25)) for k in range(60)]
    rows += [(100 + k, " ".join(f"w{x}" for x in range(100)) + f" end{k}") for k in range(60)]
    found = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found) == brute_force(rows)


def test_spots_bring_every_pair_of_chunks_together():
    import numpy as np

    r = np.random.RandomState(1)
    for token in (7, -(2**62), 2**63 - 1):
        salts = r.randint(0, 5, 1 << ngram_join.SPREAD_SLOTS).astype(np.uint8)
        for n, m in ((100, 100), (100, 124), (100, 80), (1, 1)):
            for a, b in ((1, 2), (7, 99), (12345, 54321), (5, 5)):
                x, y = ngram_join._spots(token, n, a, salts), ngram_join._spots(token, m, b, salts)
                assert len(x) == len(set(x)) and {s >> 1 for s in x} & {s >> 1 for s in y}


def test_a_token_of_very_many_texts_is_split(spark):
    """20,000 texts of one shingle that no order can put last: no task gets more of them at once than a few tiles, and the links are right."""
    import numpy as np

    rows = [(k, "same five words every time" + f" own{k}" * (k % 3 > 0) + (" and some more" * (k % 4))) for k in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = ngram_join.saved(ngram_join.described(frame)).drop("hot", "held")
    placed = ngram_join._placed(ngram_join.saved(ngram_join._prefixes(frame, sets, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))))
    spots = placed.selectExpr("doc_id", "explode(arrays_zip(tokens, spots)) as x").selectExpr("doc_id", "x.tokens as token", "shiftright(x.spots, 1) as tile")
    assert spots.groupBy("token", "tile").count().agg({"count": "max"}).first()[0] <= 4 * ngram_join.TILE
    hot = spots.groupBy("token").agg({"doc_id": "count"}).agg({"count(doc_id)": "max"}).first()[0]
    assert hot <= 20_000 * 3 * 2 * 20_000 / ngram_join.TILE / 2  # a text goes to twice 3 * held / TILE tiles at most, fewer where bands divide them
    small = rows[:400]
    assert rows_of(ngram_join.similarity_classes(spark.createDataFrame(small, "doc_id long, text string"))) == brute_force(small)


def test_spanning_forest_joins_what_likeness_joins():
    import numpy as np

    like = np.zeros((6, 6))
    for a, b, v in ((0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.85), (3, 4, 1.0)):
        like[a, b] = like[b, a] = v
    ends, starts = ngram_join._spanning_forest(like)
    assert {frozenset(x) for x in zip(ends.tolist(), starts.tolist())} == {frozenset((0, 1)), frozenset((0, 2)), frozenset((3, 4))}


def test_odd_rows(spark):
    rows = [(1, "a b c"), (2, "A B  C"), (3, ""), (4, None), (5, "  \t"), (6, "x" * 200_000), (7, "x" * 200_000), (8, "a b c d"), (None, "a b c"), (1, "a b c"), (9, "é É a b c d"), (10, "É é a b c d")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, component long")
    found = [tuple(r) for r in ngram_join.similarity_classes(frame).collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    assert by_id[2] == (2, 1, 1) and by_id[3] == (3, 0, 3) and by_id[4] == (4, 0, 4) and by_id[7] == (7, 1, 6)
    assert by_id[8] == (8, 1, 8) and by_id[10][2] == 10
    assert ngram_join.similarity_classes(frame.limit(0)).count() == 0


def test_repeated_ids_and_rows_without_an_id(spark):
    rows = [(1, "a b c d e f", "x"), (1, "quite another text than that", "x"), (2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "x"), (None, None, "x"), (3, "", "x"), (3, "", "x")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, _text string, _head int, component_id string")
    kept = ngram_join.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=repr) == sorted([(0, "a b c d e f"), (0, None), (1, "a b c d e f"), (1, "quite another text than that"), (3, "")], key=repr)
    assert ngram_join.one_of_each_group(frame.limit(0)).count() == 0


def test_tokens_that_are_equal_in_their_upper_bytes_only(spark, monkeypatch):
    """With one byte of each token in the first check, chance makes many links; whole tokens decide where it may."""
    monkeypatch.setattr(ngram_join, "CHANCE", 10_000)
    rows = copies(5, 120, 3000)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(a)], "a long, b long")
    close = ngram_join._verified(frame, pairs, 2)
    assert close.filter("sure").count() == 0
    found = {(r.a, r.b) for r in ngram_join._verified(frame, close.select("a", "b"), 8).filter("sure").collect()}
    sets = {d: shingle_set(t) for d, t in rows}
    wanted = {(a, b) for a in range(40) for b in range(a) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found == wanted and close.count() >= len(wanted)
    assert rows_of(ngram_join.similarity_classes(frame)) == brute_force(rows)


def test_very_long_texts_of_many_words(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, long.upper()), (4, " ".join(f"w{k}" for k in range(40_000)))]
    assert rows_of(ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == {(1, 59_996, 1), (2, 59_997, 1), (3, 59_996, 1), (4, 39_996, 4)}


def test_scratch_tables_go(spark, tmp_path):
    import os

    from schemaloom.llm.scratch import shared_dir

    frame = spark.createDataFrame(copies(3, 60, 5000), "doc_id long, text string")
    before = set(os.listdir(shared_dir(spark)))
    assert ngram_join.similarity_classes(frame).count() == 60
    assert len(set(os.listdir(shared_dir(spark))) - before) <= 3


def test_one_of_each_group_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here"), (3, "other words here"), (4, None)]
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = ngram_join.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
