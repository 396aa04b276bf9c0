"""Texts made to be hard: words whose polynomial hashes would agree, runs that would be tried again and again, very many matches in one text."""

import random
import re
import time

from pyspark.sql import functions as F

from schemaloom.llm import fingerprint, html_extract, native_spans, ngram_join, pii, secrets, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *texts):
    return spark.createDataFrame([(k, t, None, None, len(t)) for k, t in enumerate(texts)], DOCS)


def morse(n, signs):
    return "".join(signs[bin(k).count("1") % 2] for k in range(n))


def test_words_of_equal_sums_of_powers_are_told_apart(spark):
    """The sign sequences of Thue and Morse and their complements agree under every polynomial hash modulo a power of two."""
    docs = documents(spark, morse(2048, "ab"), morse(2048, "ba"), morse(1024, "xy") + " and", morse(1024, "yx") + " and")
    assert {r.component_id for r in ngram_join.similarity_classes(docs).collect()} == {0, 1, 2, 3}
    assert ngram_join.one_of_each_group(docs).count() == 4
    found = fingerprint.fingerprints(docs).collect()
    assert len({r.fingerprint for r in found}) == 4 and max(r.near_next for r in found if r.doc_id in (0, 2)) == 0.0


def test_word_hashes_depend_on_bytes_and_places_only():
    texts = [b"aa a aab baa ab ba abab", b"x ab  ba\taa"]
    seen = {}
    for text in texts:
        import numpy as np

        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = words.spans(data, np.array([0, len(data)]))
        for a, b, h in zip(starts, ends, words.word_hashes(data, starts, ends)):
            assert seen.setdefault(text[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_long_run_of_digits_is_read_once(spark):
    docs = documents(spark, "1 " * 500_000 + "1x", "call 555 123 4567 now", "1 2 3 4 5 6 7 8a 555 123 4567")
    pii.personal_data(documents(spark, "warm")).collect()
    began = time.time()
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    kept = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert time.time() - began < 30
    assert spans[0] == "" and kept[0] == "1 " * 500_000 + "1x"


def test_very_many_matches_in_one_text(spark):
    """25,000 of each of two kinds: far from the square of that many steps."""
    draw = random.Random(3)
    key = lambda: "AKIA" + "".join(draw.choices("ABCDEFGHJKLMNPQR23456789", k=16))
    token = lambda: "".join(draw.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQR23456789", k=24))
    text = " ".join(f"{key()} {token()}" for _ in range(25_000))
    secrets.secrets(documents(spark, "warm")).collect()
    began = time.time()
    row = secrets.secrets(documents(spark, text)).first()
    took = time.time() - began
    assert row.n_access == 25_000 and row.spans.count(",") >= 25_000 and took < 60, took
    text = " ".join(f"a{k}@b{k}.org or call {200 + k % 700}-555-{1000 + k % 9000}" for k in range(25_000))
    pii.personal_data(documents(spark, "warm")).collect()
    began = time.time()
    row = pii.personal_data(documents(spark, text)).first()
    masked = pii.redacted(documents(spark, text)).first().text
    took = time.time() - began
    assert row.n_email == 25_000 and masked.count("[EMAIL]") == 25_000 and took < 90, took


def test_masks_cover_runs_of_overlapping_spans(spark):
    draw = random.Random(5)
    rows = []
    for k in range(120):
        text = "".join(draw.choices("abcü€𝄞 ", k=draw.randint(0, 600)))
        spans = sorted((a, min(len(text), a + draw.randint(1, 9)), draw.choice(["x", "y"])) for a in (draw.randrange(len(text)) for _ in range(draw.choice([0, 1, 5, 150])))) if text else []
        rows.append((k, text, [(kind, a, b, "") for a, b, kind in spans]))

    def plain(text, spans):
        runs = []
        for kind, a, b, _ in spans:
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b, kind])
        out, at = "", 0
        for a, b, kind in runs:
            out, at = out + text[at:a] + f"[{kind.upper()}]", b
        return out + text[at:]

    frame = spark.createDataFrame(rows, "k int, text string, spans array<struct<kind:string,at:int,end:int,match:string>>")
    found = frame.select("k", native_spans.masked(F.col("text"), F.col("spans")).alias("m"), native_spans.before(F.col("spans"), F.col("text"), 7).alias("b"), native_spans.apart(F.slice("spans", 1, 40), F.slice("spans", 41, 200)).alias("a")).collect()
    by_k = {r[0]: r for r in rows}
    for r in found:
        _, text, spans = by_k[r.k]
        assert r.m == plain(text, spans)
        assert [(x.s.at, x.low) for x in r.b] == [(s[1], text[max(0, s[1] - 7) : s[1]].lower()) for s in spans]
        assert [(x.at, x.end) for x in r.a] == [(s[1], s[2]) for s in spans[:40] if not any(s[1] < o[2] and o[1] < s[2] for o in spans[40:])]


def test_spans_of_many_matches_equal_the_patterns(spark):
    text = "".join(random.Random(1).choices(["ab1 ", "x", "12 ", "é7", "𝄞", "123456 "], k=5_000))
    row = native_spans.with_matches(spark.createDataFrame([(text,), ("",), (None,)], "text string"), F.col("text"), {"n": (r"[0-9]++", F.lit(True))}).collect()[0]
    assert [(s.at, s.end, s.match) for s in row.n] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_parsing_is_linear_whatever_is_left_open():
    began = time.time()
    html_extract.parse("<dd><dl>" + "<div>" * 50_000 + "<dd>x</dd>" * 50_000)
    assert time.time() - began < 5


def test_a_conversation_of_very_many_turns_comes_in_pieces(spark):
    """Half of all turns without a conv_id, many of them alike: the pieces are bounded, over several partitions, and read back as the turns in order."""
    import hashlib

    from schemaloom.llm import chat

    draw = random.Random(7)
    roles, texts = ["user", "assistant", "system", None], ["Hi.", "same", "<a> \\ # ü𝄞", "", None, "x" * 200]
    rows = [(None if k % 2 else k % 50, draw.choice([None, 1, 2, k // 100]), draw.choice(roles), draw.choice(texts)) for k in range(12_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.formatted_pieces(turns.repartition(3)).cache()
    hot = pieces.filter("conv_id is null").orderBy("piece").collect()
    assert len(hot) > 3 and [p.piece for p in hot] == list(range(len(hot)))
    assert max(p.formatted.count("</turn>") for p in hot) <= chat.PIECE_TURNS
    own = sorted(((t is not None, t or 0, (r is not None, r or ""), (x is not None, x or "")) for c, t, r, x in rows if c is None), key=lambda z: (z[0], z[1], z[2][0], z[2][1].encode(), z[3][0], z[3][1].encode()))
    said = [(r[1], x[1]) for _, _, r, x in own]
    assert [t for p in hot for t in chat.read_back(p.formatted)] == said
    whole = "".join(p.formatted for p in hot)
    learned = [chat.unescaped(whole[a:b]) for p in hot for a, b in zip(p.loss_starts, p.loss_ends)]
    assert learned == [x for r, x in said if r == "assistant"] and all(p.at == sum(len(q.formatted) for q in hot[:k]) for k, p in enumerate(hot))
    row = chat.digests(pieces).filter("conv_id is null").first()
    assert (row.n_turns, row.formatted_chars, row.loss_sha256) == (len(said), len(whole), hashlib.sha256("".join(learned).encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
    assert sorted(map(tuple, chat.digests(chat.formatted(turns)).collect()), key=repr) == sorted(map(tuple, chat.digests(pieces).collect()), key=repr)
