"""The gate between differences and commands: what a policy doesn't allow goes to the audit. Unknown commands are denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.options import COMMAND_OPERATIONS, GUARDS


class PolicyViolation(RuntimeError):
    """A plan has commands that the policy does not allow."""


def _names(texts) -> Column:
    return F.array(*[F.lit(x) for x in sorted(texts)]).cast("array<string>")


def gated(changes: DataFrame, policy: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """(changes whose needs are all allowed, audit of the others). A change that needs a pair of commands passes with both or not at all.

    Diagnostics, which need nothing and do nothing, go to the audit.
    """
    allowed = F.size(F.array_except("needs", _names(policy))) == 0
    passes = allowed & (F.size("ops") > 0)
    audit = changes.filter(~passes).select("place", "audit")
    return changes.filter(passes), audit


def operation(command: Column) -> Column:
    """The operation that a command needs; 'guard' for guards; null for unknown ones."""
    found = F.when(command.isin(*GUARDS), "guard")
    for name, needs in COMMAND_OPERATIONS.items():
        found = found.when(command == name, needs)
    return found


def denied(commands: DataFrame, policy: frozenset[str]) -> DataFrame:
    """The commands that the policy does not allow, unknown ones among them."""
    needs = operation(F.col("op"))
    return commands.filter(~F.coalesce((needs == "guard") | needs.isin(*sorted(policy), "guard"), F.lit(False)))


def validated(commands: DataFrame, policy: frozenset[str]) -> DataFrame:
    """commands, if the policy allows them all."""
    if bad := denied(commands, policy).limit(5).collect():
        raise PolicyViolation(", ".join(sorted(f"{r.op} {r.name}" for r in bad)))
    return commands
