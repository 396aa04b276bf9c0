"""Rules for values as Column conditions: a row passes where all are true."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """column, kind (not_null, minimum, maximum, not_empty, size) and the bounds that the kind takes."""

    column: str
    kind: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.col(self.column)
        text = F.coalesce(value.cast("string"), F.lit(""))
        if self.kind == "not_null":
            return text != ""
        if self.kind == "minimum":
            return F.coalesce(value >= self.low, F.lit(True))
        if self.kind == "maximum":
            return F.coalesce(value <= self.high, F.lit(True))
        if self.kind == "not_empty":
            number = value.try_cast("double")
            return (text != "") & F.coalesce(number != 0, F.lit(True))
        if self.kind == "size":
            length = F.length(text)
            return (length >= (self.low or 0)) & (F.lit(True) if self.high is None else length <= self.high)
        raise ValueError(f"unknown kind of rule: {self.kind}")


def broken_rules(rules: list[Rule]) -> Column:
    """The names (column:kind) of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~r.holds(), F.lit(f"{r.column}:{r.kind}")) for r in rules]))


def valid(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return rows.filter(reduce(Column.__and__, [r.holds() for r in rules], F.lit(True)))


def invalid(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break a rule, with broken: which ones."""
    return rows.withColumn("broken", broken_rules(rules)).filter(F.size("broken") > 0)


def null_if_empty(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))
