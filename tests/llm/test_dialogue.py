"""Repair of conversations against plain Python: damage by its rule, faults by their words, the cheapest edits by search over all of them."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from schemaloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, copies string, fault int"


def plain_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if rule:
            text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
            found += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return found


def cheapest(turns):
    """(cost, audit, lines) by search from the start in order of cost and then audit; turns: (role, text, fault)."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in ("", "a"):
            return cost, audit, lines
        due = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 2, audit + "I", at, due[0], (*lines, f"{due}:")))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, lines))
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                heapq.heappush(queue, (more + 2, audit + "R", at + 1, due[0], (*lines, f"{due}:{text}")))
                if role[:1] == due[0] or (state == "" and role[:1] == "s"):
                    heapq.heappush(queue, (more, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))


def plain_repair(rows):
    hurt = plain_damage(rows)
    found = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\f\r")
            turns.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = lambda fault: sum(t[2] == fault for t in turns)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(turns)
        found.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return found


def made(seed, conversations, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "uncle", "User"]
    texts = ["Yes.", "No!", "What?", "well", "", " \t", None, "a  b .", "ü", "x. \n", "...", "\x0b\x85"]
    rows = []
    for c in range(conversations):
        n = draw.randint(1, longest)
        fair = draw.random() < 0.5
        for k in range(n):
            role = ("user", "assistant")[k % 2] if fair and draw.random() < 0.8 else draw.choice(roles)
            rows.append((c if c else None, draw.choice([k, k, k, k // 2, None, -k]), role, draw.choice(texts)))
    return rows + rows[:5]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, dialogue.repaired(dialogue.damaged(frame), **options).collect()), key=repr)


@pytest.mark.parametrize("rows", [made(1, 120, 6), made(2, 40, 12), [], [(1, None, None, None)], [(None, None, "user", "Hi.")] * 50], ids=["short", "longer", "empty", "nulls", "repeated"])
def test_repair_equals_plain_search(spark, rows):
    assert found(spark, rows) == sorted(plain_repair(rows), key=repr)


def test_a_conversation_over_many_pieces_and_partitions(spark):
    rows = [(1, *r[1:]) for r in made(3, 60, 9)] + made(4, 20, 5)
    wanted = sorted(plain_repair(rows), key=repr)
    assert found(spark, rows, most=3) == wanted and found(spark, rows, most=1) == wanted
    pieces = dialogue.pieces(dialogue.faults(dialogue.damaged(spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA))), 3)
    assert pieces.filter("conv_id = 1").select("part").distinct().count() > 1
    assert pieces.selectExpr("max(size(turns))").first()[0] <= 3


def test_a_very_long_text_and_long_blanks(spark):
    blank = " " * 1_000_000
    rows = [(5, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(["a" + blank + "b", "word " * 400_000 + "end.", blank, "x" + blank, "é" * 300_000])]
    assert found(spark, rows) == sorted(plain_repair(rows), key=repr)


def test_a_conversation_that_is_dropped_whole(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(conv, 0, "user", "Hi.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
