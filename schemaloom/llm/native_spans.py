"""Spans of pattern matches as Column expressions: no Python runs on executors.

A span is struct<kind, at, end, match> with offsets in code points, end exclusive. Offsets come from the lengths of the matches
and of what lies between them, so nothing but the regular-expression functions reads the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<struct<kind:string,at:int,end:int,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, inside expressions where a projection of its own isn't possible."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none() -> Column:
    return F.array().cast(EMPTY)


#: Arrays are gone through in blocks of so many, as growing an array copies it: n entries cost n * (BLOCK + n / BLOCK / BLOCK) steps and not n * n.
BLOCK = 64


def blocks(values: Column) -> Column:
    """values in arrays of BLOCK entries."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.slice(F.array(v), 1, 0)))


def running(parts: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step has made of all entries before each block, from 0, and after the last."""
    start = F.array(F.lit(0))
    return F.aggregate(parts, start, lambda done, part: F.concat(done, F.array(F.aggregate(part, F.try_element_at(done, F.lit(-1)), step))))


def with_matches(docs: DataFrame, text: Column, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """docs with a column of spans for each kind of wanted: (pattern, a cheap test that any text with a match passes).

    Matches are leftmost and non-overlapping. Patterns use possessive quantifiers, so that the matcher neither recurses nor tries a
    long run again and again. Each text is searched once for its matches and once for what lies between, in a projection of
    its own, so that neither is done again where it is used.
    """
    raw = {}
    for kind, (pattern, test) in wanted.items():
        raw[f"_found_{kind}"] = F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        raw[f"_between_{kind}"] = F.when(test, F.split(text, pattern, -1))
    docs = docs.withColumns(raw)
    names = [(k, F.col(f"_found_{k}"), F.col(f"_between_{k}")) for k in wanted]

    def spans(kind: str, found: Column, between: Column) -> Column:
        pairs = F.filter(F.arrays_zip(found.alias("match"), between.alias("gap")), lambda x: x["match"].isNotNull())
        sized = F.transform(pairs, lambda x: F.struct(x["match"].alias("match"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("length")))

        def placed(parts: Column) -> Column:
            return let(running(parts, lambda n, x: n + x["gap"] + x["length"]), lambda starts: F.flatten(F.transform(parts, lambda part, k: within(part, F.get(starts, k)))))

        def within(part: Column, start: Column) -> Column:
            step = lambda done, x: F.struct(
                (done["at"] + x["gap"] + x["length"]).alias("at"),
                F.concat(done["spans"], F.array(F.struct(F.lit(kind).alias("kind"), (done["at"] + x["gap"]).alias("at"), (done["at"] + x["gap"] + x["length"]).alias("end"), x["match"].alias("match")))).cast(EMPTY).alias("spans"),
            )
            return F.aggregate(part, F.struct(start.alias("at"), none().alias("spans")), step, lambda done: done["spans"])

        return F.when(F.size(found) > 0, let(blocks(sized), placed)).otherwise(none())

    return docs.withColumns({k: spans(k, found, between) for k, found, between in names}).drop(*raw)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 13 to 19 digits has a valid check digit; false for any other length."""

    def valid(digit: Column) -> Column:
        values = F.transform(F.reverse(F.split(digit, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c > "4", 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
        return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0

    return F.when(F.length(number).between(13, 19), let(F.when(F.length(number).between(13, 19), number), valid)).otherwise(False)


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def by_kind(spans: Column, kinds: list[str]) -> Column:
    """Spans by the order of kinds, then start."""
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return F.concat(*[F.array_sort(of(k), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)) for k in kinds])


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then the order of kinds."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    key = lambda s: s["at"] * len(kinds) + rank[s["kind"]]
    return F.array_sort(spans, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others. Others are looked at in blocks, of which most lie elsewhere."""
    reach = lambda parts: F.transform(parts, lambda part: F.struct(F.array_min(F.transform(part, lambda o: o["at"])).alias("at"), F.array_max(F.transform(part, lambda o: o["end"])).alias("end"), part.alias("own")))
    meets = lambda s, o: (s["at"] < o["end"]) & (o["at"] < s["end"])
    return let(reach(blocks(others)), lambda parts: F.filter(spans, lambda s: ~F.exists(parts, lambda part: meets(s, part) & F.exists(part["own"], lambda o: meets(s, o)))))


def before(spans: Column, text: Column, width: int) -> Column:
    """struct<s, low> of every span: the width signs of text before it, in small letters. Each block of spans takes its stretch of the text once."""

    def of(part: Column) -> Column:
        first = F.greatest(F.array_min(F.transform(part, lambda s: s["at"])) - width, F.lit(0))
        last = F.array_max(F.transform(part, lambda s: s["at"]))
        stretch = F.struct(first.alias("first"), F.substr(text, first + 1, last - first).alias("text"))
        low = lambda s, x: F.lower(F.substr(x["text"], F.greatest(s["at"] - width, F.lit(0)) - x["first"] + 1, F.least(s["at"], F.lit(width))))
        return let(stretch, lambda x: F.transform(part, lambda s: F.struct(s.alias("s"), low(s, x).alias("low"))))

    return F.flatten(F.transform(blocks(spans), of))


def masked(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by [KIND] of the first of them. spans: sorted by start.

    A span begins a run if no span before it ends behind its start; the run ends where the farthest span before the next run does.
    """
    farthest = lambda n, s: F.greatest(n, s["end"])

    def heads(parts: Column) -> Column:
        def within(part: Column, start: Column) -> Column:
            step = lambda done, s: F.struct(F.greatest(done["far"], s["end"]).alias("far"), F.concat(done["own"], F.array(F.struct(s["kind"].alias("kind"), s["at"].alias("at"), done["far"].alias("far")))).alias("own"))
            return F.aggregate(part, F.struct(start.alias("far"), F.array().cast("array<struct<kind:string,at:int,far:int>>").alias("own")), step, lambda done: done["own"])

        begun = lambda far: F.filter(F.flatten(F.transform(parts, lambda part, k: within(part, F.get(far, k)))), lambda s: s["at"] >= s["far"])
        return let(running(parts, farthest), lambda far: let(begun(far), lambda own: runs(own, F.try_element_at(far, F.lit(-1)))))

    def runs(own: Column, end: Column) -> Column:
        return F.transform(own, lambda s, k: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), F.coalesce(F.get(own, k + 1)["far"], end).alias("end")))

    def written(own: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(own, lambda s: s["end"]))
        gaps = let(starts, lambda from_: F.transform(own, lambda s, k: F.struct(F.get(from_, k).alias("from"), s["at"].alias("to"), s["kind"].alias("kind"))))

        def shown(part: Column) -> Column:
            first = F.get(part, F.lit(0))["from"]
            stretch = F.substr(text, first + 1, F.try_element_at(part, F.lit(-1))["to"] - first)
            return let(F.struct(first.alias("first"), stretch.alias("text")), lambda x: F.array_join(F.transform(part, lambda g: F.concat(F.substr(x["text"], g["from"] - x["first"] + 1, g["to"] - g["from"]), F.lit("["), F.upper(g["kind"]), F.lit("]"))), ""))

        rest = F.try_element_at(own, F.lit(-1))["end"]
        return F.concat(F.array_join(F.transform(blocks(gaps), shown), ""), F.substr(text, rest + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(heads(blocks(spans)), written))
