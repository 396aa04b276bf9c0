"""A plan as the text of a migration script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dialects as D
from ..operators.sequence import PHASES
from .compare import Plan

_RULE = "-- " + "=" * 60


def header(dialect: str) -> list[str]:
    return [_RULE, "-- Migration script", f"-- Dialect: {dialect}", f"-- Transactional DDL: {dialect in D.TRANSACTIONAL}", _RULE]


def script_lines(plan: Plan) -> DataFrame:
    """(phase_order, table_rank, place, part, line) of the script's body, to be ordered by all but line.

    Commands without a statement are left out. A phase's heading is a row of its own, before the phase's commands; so no row needs to
    know its neighbour.
    """
    shown = plan.commands.filter(F.trim("sql") != "")
    note = F.concat_ws("; ", F.array("label"), "notes")
    lines = F.array(F.struct(F.lit(1).alias("part"), F.concat(F.lit("-- "), note).alias("line")), F.struct(F.lit(2).alias("part"), F.col("sql").alias("line")))
    body = shown.select(*Plan.ORDER, F.explode(lines).alias("x")).select(*Plan.ORDER, "x.part", "x.line")
    kinds = dict(shown.select(*Plan.ORDER).dtypes)
    heads = shown.select("phase_order", "phase").distinct().select(
        "phase_order", F.lit(-1).alias("table_rank"), F.lit(None).cast(kinds["place"]).alias("place"), F.lit(0).alias("part"),
        F.concat(F.lit("\n-- ---------- PHASE: "), "phase", F.lit(" ----------")).alias("line"),
    )
    return body.unionByName(heads)


def ordered_lines(plan: Plan) -> DataFrame:
    return script_lines(plan).orderBy(*Plan.ORDER, "part").select("line")


def script(plan: Plan) -> str:
    lines = [r.line for r in ordered_lines(plan).toLocalIterator()]
    return "\n".join([*header(plan.options.dialect), *lines]) + "\n"


def write_script(plan: Plan, path: str) -> None:
    """UTF-8 without a byte order mark, written piece by piece."""
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.writelines(x + "\n" for x in header(plan.options.dialect))
        for r in ordered_lines(plan).toLocalIterator():
            out.write(r.line + "\n")


def dry_run(plan: Plan) -> DataFrame:
    """(sequence order columns, phase, label, sql, status): Empty for commands without a statement, else Pending."""
    status = F.when(F.trim("sql") == "", "Empty").otherwise("Pending")
    return plan.commands.select(*Plan.ORDER, "phase", "op", "label", "sql", "notes", status.alias("status"))


def phase_name(order: int) -> str:
    return PHASES[order]
