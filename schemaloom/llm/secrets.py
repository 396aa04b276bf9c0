"""Secret scans: fixed forms, and any other token that a battery of randomness tests can't tell from random signs.

Tokens of LEAST signs or more get the encoding that their signs allow (hexadecimal, base 32, 36, 62 or 64, letters of both cases) and four p-values against the hypothesis of
independent uniform signs: chi-squared over the alphabet, chi-squared over the classes of signs, runs above and below the middle,
and serial correlation. Fisher's method combines them. Whether a token departs from randomness is then a matter of many tests at once, so
tokens are rejected under a false-discovery rate of RATE (Benjamini-Hochberg), for each encoding and band of lengths apart,
as the tests' power grows with length. The procedure runs on counts of tokens per cell of p, over the whole table. Tokens that are
not rejected, and whose length carries BITS bits or more in their encoding, are reported as random.

What is controlled is the share of random tokens among those that are dismissed: at most RATE of them. The share of tokens among the
reported ones that aren't random is not controlled, as it depends on how far from random the other tokens are; tests/llm measures it.

All of it is DataFrame expressions. What is collected are counts per encoding, band and cell: at most len(ENCODINGS) * BANDS * CELLS rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import apart, by_start, let, listed, with_matches
from .scratch import saved

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
LEAST, BITS, RATE = 20, 80, 0.05
BANDS, CELLS = 8, 64
_CAPITALS, _SMALL, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Signs of each encoding, in the order of their values; and what a token of it looks like. A token has the first encoding that it fits, so the
#: smallest alphabets come first.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]+|[0-9A-F]+)$"),
    "base32": (_CAPITALS + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$"),
    "base32_small": (_SMALL + "234567", r"^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+=*$"),
    "base36": (_DIGITS + _SMALL, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    "base36_capital": (_DIGITS + _CAPITALS, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    "base62": (_CAPITALS + _SMALL + _DIGITS, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$"),
    "base64": (_CAPITALS + _SMALL + _DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]+=*$"),
    "letters": (_CAPITALS + _SMALL, r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$"),
}
ALPHABETS = {k: signs for k, (signs, _) in ENCODINGS.items()}


def _found(docs: DataFrame) -> DataFrame:
    """docs with base (spans of the fixed forms) and tokens (other long runs of signs)."""
    text = F.coalesce("text", F.lit(""))
    wanted = {
        "assign": (ASSIGN, text.rlike("(?i)(?:passw|secret|token|api_?key)")),
        "access": (ACCESS, text.contains("AKIA")),
        "hex": (HEX, text.rlike("[0-9a-f]{24}")),
        "random": (TOKEN, text.rlike(f"[A-Za-z0-9+/_=-]{{{LEAST}}}")),
    }
    docs = with_matches(docs, text, {k: (p, t) for k, (p, t) in wanted.items()})
    base = F.concat(
        F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6),
        F.filter("access", lambda s: F.length(s["match"]) >= 20),
        F.filter("hex", lambda s: F.length(s["match"]) >= 24),
    )
    long = F.filter("random", lambda s: F.length(s["match"]) >= LEAST)
    return docs.withColumn("base", base).withColumn("tokens", apart(long, F.col("base"))).drop(*wanted)


def _tail(z: Column) -> Column:
    """Two-sided normal tail of |z|, by a logistic approximation."""
    return let(F.least(F.abs(z), F.lit(30.0)), lambda a: F.lit(2.0) / (1 + F.exp(1.5976 * a + 0.070566 * a * a * a)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _chi_squared(x: Column, freedom: Column, n: Column) -> Column:
    """Upper tail of a chi-squared statistic of n signs, by normal approximation with the exact mean and a variance for few signs."""
    return let((x - freedom) / F.sqrt(2 * freedom * (n - 1) / n), lambda z: F.when(z > 0, _tail(z) / 2).otherwise(1 - _tail(z) / 2))


def _uniform(values: Column, n: Column, m: Column) -> Column:
    counted = F.map_values(F.aggregate(values, F.create_map().cast("map<int,double>"), lambda done, v: F.map_concat(F.map_filter(done, lambda k, _: k != v), F.create_map(v, F.coalesce(F.try_element_at(done, v), F.lit(0.0)) + 1))))
    squares = _total(F.transform(counted, lambda c: c * c))
    return _chi_squared(squares * m / n - n, m - 1, n)


def _by_class(signs: Column, alphabet: Column, n: Column, m: Column) -> Column:
    """Vowels and other letters, capital and small, and other signs, against their shares of the alphabet. Words have more vowels than random letters."""
    statistic, classes = F.lit(0.0), F.lit(0)
    for others in ("[^AEIOU]", "[^B-DF-HJ-NP-TV-Z]", "[^aeiou]", "[^b-df-hj-np-tv-z]", "[A-Za-z]"):
        due = n * F.length(F.regexp_replace(alphabet, others, "")) / m
        held = F.length(F.regexp_replace(signs, others, ""))
        statistic = statistic + F.when(due > 0, (held - due) * (held - due) / due).otherwise(0.0)
        classes = classes + (due > 0).cast("int")
    return _chi_squared(statistic, (classes - 1).cast("double"), n)


def _neighbours(values: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), each)


def _runs(values: Column, n: Column, m: Column) -> Column:
    def of(high: Column) -> Column:
        runs = F.size(F.filter(_neighbours(high, lambda a, b: a != b), lambda x: x)) + 1.0
        h = F.size(F.filter(high, lambda x: x)).cast("double")
        return let(F.struct(runs.alias("runs"), h.alias("h"), (2 * h * (n - h) / n + 1).alias("mean")), spread)

    def spread(s: Column) -> Column:
        variance = (s["mean"] - 1) * (s["mean"] - 2) / (n - 1)
        return F.when((s["h"] == 0) | (s["h"] == n) | (variance <= 0), F.pow(F.lit(0.5), n - 1)).otherwise(_tail((s["runs"] - s["mean"]) / F.sqrt(variance)))

    return let(F.transform(values, lambda v: v * 2 >= m), of)


def _serial(values: Column, n: Column, m: Column) -> Column:
    def of(around: Column) -> Column:
        variance = _total(F.transform(around, lambda v: v * v))
        lagged = _total(_neighbours(around, lambda a, b: a * b))
        return let(variance, lambda s: F.when(s > 0, _tail((lagged / s + 1 / n) * F.sqrt(n))).otherwise(F.pow(1 / m, n - 1)))

    return let(_total(values) / n, lambda middle: let(F.transform(values, lambda v: v - middle), of))


def battery(token: Column, encoding: Column) -> Column:
    """Combined p-value of a token's randomness in its encoding."""
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[encoding]
    plain = F.translate(F.when(encoding == "hex", F.lower(token)).otherwise(token), "-_=", "+/")

    def tests(s: Column) -> Column:
        n, m = F.size(s["values"]).cast("double"), F.length(s["alphabet"]).cast("double")
        p = F.array(_uniform(s["values"], n, m), _by_class(s["signs"], s["alphabet"], n, m), _runs(s["values"], n, m), _serial(s["values"], n, m))
        x = -_total(F.transform(p, lambda q: F.ln(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-30)))))
        return let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))  # chi-squared with 8 degrees of freedom, beyond 2 x

    def values(s: Column) -> Column:
        return let(F.struct(s["signs"].alias("signs"), s["alphabet"].alias("alphabet"), F.transform(F.filter(F.split(s["signs"], ""), lambda c: c != ""), lambda c: F.position(c, s["alphabet"]) - 1).alias("values")), tests)

    return let(F.struct(plain.alias("signs"), alphabet.alias("alphabet")), values)


def _encoding(token: Column) -> Column:
    """The first encoding that a token fits; null for numbers and for words of one case, alone or joined by other signs."""
    found = None
    for name, (_, looks) in ENCODINGS.items():
        found = F.when(token.rlike(looks), name) if found is None else found.when(token.rlike(looks), name)
    return found


def _band(length: Column) -> Column:
    return F.least(F.floor(F.log2(length / LEAST) * 2), F.lit(BANDS - 1)).cast("int")


def _cell(p: Column) -> Column:
    """Cells of equal ratio, from p of 1 down; the last holds all smaller."""
    return F.least(F.floor(-F.log2(p) * 2), F.lit(CELLS - 1)).cast("int")


def rejection_cells(counts: list[tuple[str, int, int, int]]) -> dict[tuple[str, int], int]:
    """(encoding, band) -> the first cell whose tokens depart from randomness; counts: (encoding, band, cell, tokens).

    Benjamini-Hochberg on cells: the largest upper edge t with t * all / (tokens with p up to t) at most RATE.
    """
    found = {}
    for group in {(e, b) for e, b, _, _ in counts}:
        own = {c: n for e, b, c, n in counts if (e, b) == group}
        total, below, first = sum(own.values()), 0, CELLS
        for cell in range(CELLS - 1, -1, -1):
            below += own.get(cell, 0)
            if below and 2 ** (-cell / 2) * total / below <= RATE:
                first = cell
        found[group] = first
    return found


def _judged(tokens: Column) -> Column:
    """Tokens with encoding, band and cell, those without an encoding left out."""
    known = F.filter(F.transform(tokens, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["end"].alias("end"), s["match"].alias("match"), _encoding(s["match"]).alias("encoding"))), lambda s: s["encoding"].isNotNull())
    return F.transform(known, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["end"].alias("end"), s["match"].alias("match"), s["encoding"].alias("encoding"), _band(F.length(s["match"])).alias("band"), _cell(battery(s["match"], s["encoding"])).alias("cell")))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text); other columns are ignored.

    Base spans stay whatever the battery says; random spans overlap no base span. Null and empty texts have no spans. Texts are read whole,
    however long. Tokens with equal p stand or fall together. Repeated rows count each by itself, and an empty table gives an empty result.
    """
    found = _found(docs.select("doc_id", "text")).select("doc_id", "base", "tokens")
    found = saved(found.select("doc_id", "base", F.when(F.size("tokens") > 0, _judged(F.col("tokens"))).otherwise(F.array()).alias("tokens")))
    one = found.select(F.explode("tokens").alias("t")).select("t.encoding", "t.band", "t.cell").groupBy("encoding", "band", "cell").count()
    cells = rejection_cells([tuple(r) for r in one.collect()])
    limit = F.create_map(*[F.lit(x) for (e, b), c in sorted(cells.items()) for x in (f"{e}{b}", c)]) if cells else F.create_map(F.lit(""), F.lit(0))
    bits = F.create_map(*[F.lit(x) for k, a in ALPHABETS.items() for x in (k, math.log2(len(a)))])
    kept = F.filter("tokens", lambda t: (t["cell"] < limit[F.concat(t["encoding"], t["band"].cast("string"))]) & (F.length(t["match"]) * bits[t["encoding"]] >= BITS))
    more = F.transform(kept, lambda t: F.struct(t["kind"].alias("kind"), t["at"].alias("at"), t["end"].alias("end"), t["match"].alias("match")))
    base = by_start(F.col("base"), KINDS)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(by_start(F.concat("base", more), KINDS)).alias("spans"))
