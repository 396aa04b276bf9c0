"""Personal data: fixed forms, and further spans that weak labelers and a trained classifier agree on.

Candidates are the spans of the fixed forms and of looser ones: groups of digits, and addresses with spelled-out signs. Labelers vote on
each: patterns (strict form, valid check digit, number groupings), gazetteers (number prefixes, top-level domains, units) and context (words before the
span). A vote is for (1), against (-1) or absent (0). Expectation-maximisation on the counts of vote patterns estimates how
reliable every labeler is and how likely each pattern is personal data. On these probabilities a logistic classifier of
the span's own features is trained. It adds the loose candidates it finds likely; spans of the fixed forms stay in any case.

All of it is DataFrame expressions. What is collected are counts per pattern of votes (at most 3 ** len(LABELERS) rows), and per
combination of features (at most the product of their sizes); the loops over them run on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import apart, before, by_kind, by_start, digits, let, listed, luhn, masked, with_matches
from .scratch import saved

KINDS = ["email", "ip", "card", "phone", "number", "address"]
BASE = KINDS[:4]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z_.@+-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+[A-Za-z_@]?+"
ADDRESS = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
LABELERS = ["form", "check", "grouping", "prefix", "context", "unit"]
# Words near contact and payment data, words near other numbers, number prefixes, top-level domains.
NEAR = "e-?mail|mail|phone|tel|call|fax|mobile|cell|contact|whatsapp|ssn|passport|card|visa|iban|account|ip|host|address"
FAR = "version|isbn|issn|doi|page|pages|chapter|section|figure|invoice|order|item|serial|build|usd|eur|total|year"
PREFIXES = r"^(?:4|5[1-5]|3[47]|6011|65|00[1-9]|1[2-9][0-9]{2}[2-9]|[2-9][0-9]{2}[2-9][0-9]{6}$)"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|example|de|fr|es|uk|eu|us|co)$"
WINDOW = 24
LIKELY = 0.5
ROUNDS = 60
#: What a labeler is trusted with at first: of each vote, the probability if the span isn't and if it is personal data; and the weight of
#: this as a number of spans.
START = {-1: (0.4, 0.05), 0: (0.55, 0.55), 1: (0.05, 0.4)}
PRIOR = 50


def _candidates(docs: DataFrame) -> DataFrame:
    """docs with base (spans of the fixed forms) and loose (other candidates, apart from base)."""
    text = F.coalesce("text", F.lit(""))
    wanted = {
        "email": (EMAIL, text.contains("@")),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        "phone": (PHONE, text.rlike(r"\+[0-9]")),
        "number": (NUMBER, text.rlike(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}")),
        "address": (ADDRESS, text.rlike(r"(?i)[\[(]at[\])]")),
    }
    docs = with_matches(docs, text, wanted)
    ip_fits = lambda s: F.forall(F.split(s["match"], r"\."), lambda part: part.cast("double") <= 255)
    card_fits = lambda s: luhn(digits(s["match"]))
    phone_fits = lambda s: F.length(digits(s["match"])).between(9, 15)
    base = F.concat("email", F.filter("ip", ip_fits), F.filter("card", card_fits), F.filter("phone", phone_fits))
    docs = docs.withColumn("base", base)
    number = F.filter("number", lambda s: s["match"].rlike("[0-9]$"))  # a run that goes on with a letter is none, nor is any part of it
    return docs.withColumn("loose", apart(F.concat(number, "address"), F.col("base"))).drop(*wanted)


def _described(spans: Column, text: Column) -> Column:
    """Spans with their votes and features."""

    def each(x: Column) -> Column:
        return let(F.struct(x["s"].alias("s"), digits(x["s"]["match"]).alias("number"), x["low"].alias("low")), judged)

    def judged(x: Column) -> Column:
        s, number, low = x["s"], x["number"], x["low"]
        n = F.length(number)
        numeric = ~s["kind"].isin("email", "address")
        near, far = low.rlike(rf"\b(?:{NEAR})\b[^\n]*+$"), low.rlike(rf"(?:\b(?:{FAR})|[$€£#])\W*+$")
        votes = {
            "form": F.when(s["kind"].isin("email", "ip", "phone"), 1).when(s["kind"] == "number", -1).otherwise(0),
            "check": F.when(s["kind"] == "card", 1).when((s["kind"] == "number") & n.between(13, 19), F.when(luhn(number), 1).otherwise(-1)).otherwise(0),
            "grouping": F.when(numeric & s["match"].rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$"), 1).when((s["kind"] == "number") & s["match"].rlike(r"^[0-9]++$"), -1).otherwise(0),
            "prefix": F.when(numeric & (s["kind"] != "ip") & number.rlike(PREFIXES), 1).when(~numeric & F.regexp_replace(s["match"], r"(?i)\x20?[\[(]dot[\])]\x20?", ".").rlike(DOMAINS), 1).otherwise(0),
            "context": F.when(far, -1).when(near, 1).otherwise(0),
            "unit": F.when((s["kind"] == "number") & s["match"].rlike(r"/|^0\b|^[0-9]{4}-[0-9]{2}-[0-9]{2}"), -1).otherwise(0),
        }
        cell = [
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int"),
            F.when(n < 9, 0).when(n < 11, 1).when(n < 13, 2).when(n < 17, 3).when(n < 20, 4).otherwise(5),
            F.when(s["match"].rlike(r"\(|-"), 2).when(s["match"].rlike(r"[\x20.]"), 1).otherwise(0),
            F.when(far, 2).when(near, 1).otherwise(0),
            F.when(luhn(number), 1).otherwise(0),
        ]
        return F.struct(*[s[c].alias(c) for c in ("kind", "at", "end", "match")], F.array(*[votes[k].cast("int") for k in LABELERS]).alias("votes"), F.array(*[c.cast("int") for c in cell]).alias("cell"))

    return F.transform(before(spans, text, WINDOW), each)


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of personal data, for each labeler vote -> (probability if not, if personal data)) of vote patterns, by EM.

    The start trusts every labeler: a vote is likelier where it is right. No patterns leave the start as it is.
    """
    share = 0.5
    table = [dict(START) for _ in LABELERS]
    total = sum(counts.values())
    for _ in range(ROUNDS if total else 0):
        likely = {v: probability(share, table, v) for v in counts}
        yes = sum(n * likely[v] for v, n in counts.items())
        share = (yes + 1) / (total + 2)
        for k in range(len(LABELERS)):
            new = {}
            for vote in (-1, 0, 1):
                of = [(n, likely[v]) for v, n in counts.items() if v[k] == vote]
                start = START[vote]
                new[vote] = ((sum(n * (1 - q) for n, q in of) + PRIOR * start[0]) / (total - yes + PRIOR), (sum(n * q for n, q in of) + PRIOR * start[1]) / (yes + PRIOR))
            table[k] = new
    return share, table


def probability(share: float, table: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(share) - math.log(1 - share)
    for k, v in enumerate(votes):
        odds += math.log(table[k][v][1]) - math.log(table[k][v][0])
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def train_classifier(cells: dict[tuple[int, ...], tuple[int, float]]) -> tuple[float, dict[tuple[int, int], float]]:
    """(bias, weight of each feature's value) of a logistic regression on cells: features -> (spans, sum of probabilities)."""
    weights = {(k, v): 0.0 for cell in cells for k, v in enumerate(cell)}
    total = sum(n for n, _ in cells.values())
    bias = 0.0
    past = dict.fromkeys(weights, 1e-6)
    for _ in range(300 if total else 0):
        slope, slope_bias = {w: -0.001 * x for w, x in weights.items()}, 0.0
        for cell, (n, yes) in cells.items():
            z = bias + sum(weights[k, v] for k, v in enumerate(cell))
            off = (yes - n / (1 + math.exp(-max(-50.0, min(50.0, z))))) / total
            slope_bias += off
            for k, v in enumerate(cell):
                slope[k, v] += off
        bias += slope_bias
        for w, g in slope.items():
            past[w] += g * g
            weights[w] += 0.3 * g / math.sqrt(past[w])
    return bias, weights


def _spans(docs: DataFrame) -> DataFrame:
    """docs with base and loose, their spans described."""
    docs = _candidates(docs)
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({c: F.when(F.size(c) > 0, _described(F.col(c), text)).otherwise(F.array()) for c in ("base", "loose")})


def _likely(found: DataFrame) -> Column:
    """Whether a described span is likely personal data, as learned from all spans of found (base, loose)."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.votes", "s.cell").groupBy("votes", "cell").count().collect()
    votes: dict[tuple[int, ...], int] = {}
    for r in spans:
        votes[tuple(r.votes)] = votes.get(tuple(r.votes), 0) + r["count"]
    share, table = reliabilities(votes)
    cells: dict[tuple[int, ...], tuple[int, float]] = {}
    for r in spans:
        n, yes = cells.get(tuple(r.cell), (0, 0.0))
        cells[tuple(r.cell)] = (n + r["count"], yes + r["count"] * probability(share, table, tuple(r.votes)))
    bias, weights = train_classifier(cells)
    names = F.create_map(*[F.lit(x) for (k, v), w in sorted(weights.items()) for x in (f"{k}:{v}", w)]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def likely(s: Column) -> Column:
        parts = F.transform(s["cell"], lambda v, k: F.coalesce(F.try_element_at(names, F.concat_ws(":", k.cast("string"), v.cast("string"))), F.lit(0.0)))
        return F.aggregate(parts, F.lit(bias), lambda a, v: a + v) > math.log(LIKELY / (1 - LIKELY))

    return likely


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "at", "end", "match")]))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text); other columns are ignored.

    Null and empty texts have no spans. Texts are read whole, however long. Spans of the fixed forms may overlap each other; added ones overlap none
    of them; spans with equal features are added or left out together. Repeated rows each have their own result; an empty table gives an empty one.
    """
    found = saved(_spans(docs.select("doc_id", "text")).select("doc_id", "base", "loose"))
    more = F.filter("loose", _likely(found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = found.select("doc_id", _plain(F.col("base")).alias("base"), _plain(more).alias("more"))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(by_kind(F.col("base"), BASE)), 256).alias("base_sha256"), listed(by_kind(F.concat("base", "more"), KINDS)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in brackets; null texts stay null. n_chars, where docs has it, follows."""
    names = docs.columns
    learned = _likely(saved(_spans(docs.select("text")).select("base", "loose")))
    found = _spans(docs.withColumnsRenamed({c: f"own_{c}" for c in names if c in ("base", "loose", *KINDS)}))
    found = found.withColumn("loose", by_start(_plain(F.concat("base", F.filter("loose", learned))), KINDS))
    found = found.withColumn("text", F.when(F.size("loose") > 0, masked(F.col("text"), F.col("loose"))).otherwise(F.col("text"))).drop("base", "loose")
    found = found.withColumnsRenamed({f"own_{c}": c for c in names if c in ("base", "loose", *KINDS)})
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[f"`{c}`" for c in names])
