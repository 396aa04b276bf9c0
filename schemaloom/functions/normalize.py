"""Canonical texts: conditions, scripts and defaults that mean the same become equal. Column functions without Python code."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and the control characters.
_EDGE = r"[\x00-\x20]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_EDGE}+|{_EDGE}+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def _layers(opening: Column, closing: Column, inner: Column) -> Column:
    """How many pairs of parentheses go around all of inner, which stands between opening and closing ones."""
    steps = F.transform(F.filter(F.split(F.regexp_replace(inner, r"[^()]", ""), ""), lambda x: x != ""), lambda x: F.when(x == "(", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = F.when(inner.contains("(") | inner.contains(")"), F.aggregate(steps, start, lambda s, x: F.struct((s["depth"] + x).alias("depth"), F.least(s["least"], s["depth"] + x).alias("least")))).otherwise(start)
    sides = F.struct(_count(opening, "(").alias("opened"), _count(closing, ")").alias("closed"), walk.alias("walk"))
    return _let(sides, lambda x: F.when(x["opened"] + x["walk"]["depth"] == x["closed"], F.greatest(F.lit(0), F.least(x["opened"], x["closed"], x["opened"] + x["walk"]["least"]))).otherwise(0))


def _bare(text: Column) -> Column:
    """text, which begins and ends with a parenthesis, without those around all of it."""
    opening, closing = F.regexp_extract(text, rf"^(?:{_EDGE}*+\()++", 0), F.reverse(F.regexp_extract(F.reverse(text), rf"^(?:{_EDGE}*+\))++", 0))
    sides = F.struct(text.alias("text"), opening.alias("opening"), closing.alias("closing"))

    def cut(x: Column) -> Column:
        inner = F.substr(x["text"], F.length(x["opening"]) + 1, F.length(x["text"]) - F.length(x["opening"]) - F.length(x["closing"]))
        # of the sides stays what is inside of the layers: what follows the last opening parenthesis that goes, and what comes before the first closing one
        part = lambda side, sign, times: F.length(F.call_function("substring_index", side, F.lit(sign), times))

        def keep(layers: Column) -> Column:
            before, behind = part(x["opening"], "(", layers) + 1, part(x["closing"], ")", -layers) + 1
            return F.when(layers > 0, _strip(F.substr(x["text"], before + 1, F.length(x["text"]) - before - behind))).otherwise(x["text"])

        return _let(_layers(x["opening"], x["closing"], inner), keep)

    return _let(sides, cut)


def check_condition(text: Column) -> Column:
    """A condition without a leading CHECK and without parentheses around all of it.

    As many layers go as there are opening parentheses at the start and closing ones at the end with nothing between them that closes a
    layer: the smallest depth over the inner part bounds the layers. Conditions that don't balance stay, and those without parentheses at both ends are not looked into.
    """
    plain = _strip(F.regexp_replace(_strip(text), "^(?i:check)", ""))
    return _let(plain, lambda x: F.when(x.startswith("(") & x.endswith(")"), _bare(x)).otherwise(x))


#: Literals, quoted names, words, numbers, blanks and single signs.
_TOKEN = r"'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"|`[^`]*+`|\[[^\]]*+\]|[\p{L}_$#@][\p{L}\p{N}_$#@]*+|[0-9.]++|\s++|."


def expression(text: Column) -> Column:
    """An expression's canonical form: names in capitals and blanks only between words, but literals and quoted names as they are; no parentheses around all of it."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit("(?s)" + _TOKEN), F.lit(0)), lambda x: ~x.rlike(r"^\s"))
    word = lambda x: x.rlike(r"^[\p{L}\p{N}_$#@]")
    shown = F.transform(tokens, lambda x: F.when(word(x), F.translate(x, string.ascii_lowercase, string.ascii_uppercase)).otherwise(x))
    spaced = _let(shown, lambda t: F.transform(t, lambda x, k: F.when((k > 0) & word(x) & word(F.get(t, k - 1)), F.concat(F.lit(" "), x)).otherwise(x)))
    joined = F.array_join(spaced, "")
    return _let(joined, lambda x: F.when(x.startswith("(") & x.endswith(")"), _bare(x)).otherwise(x))


def joined_checks(text: Column, delimiter: str) -> Column:
    """Conditions held in one text: none become '', one stays bare, more are joined by AND, each in parentheses."""
    parts = F.filter(F.transform(F.split(text, rf"\Q{delimiter}\E", -1), check_condition), lambda x: x != "")
    several = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("("), x, F.lit(")"))), " AND ")
    return F.when(F.size(parts) > 1, several).otherwise(F.array_join(parts, ""))


def default_value(text: Column) -> Column:
    """Upper case, without a leading DEFAULT or =."""
    return _strip(F.regexp_replace(F.regexp_replace(F.upper(_strip(text)), "^DEFAULT", ""), "^=", ""))


def script(text: Column) -> Column:
    """White space outside of '...' becomes one blank, and none at the ends; literals and case stay."""
    parts = F.split(text, "'", -1)
    spaced = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, "[ \t\n\r\f]+", " ")).otherwise(p))
    joined = F.ltrim(F.array_join(spaced, "'"))
    return F.when(F.size(parts) % 2 == 1, F.rtrim(joined)).otherwise(joined)


def view_body(text: Column) -> Column:
    """What follows AS in CREATE VIEW ... AS; any other text stays."""
    body = F.regexp_extract(text, r"(?is)\bVIEW\b.*?\bAS\b(.*)$", 1)
    return F.when(body == "", text).otherwise(_strip(body))


def same_text(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a).eqNullSafe(F.lower(b))
