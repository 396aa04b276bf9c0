"""Compare two catalogs and plan the migration: commands in a safe order, and the audit of what was held back."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..operators import alter, diff, policy, sequence
from ..operators.schemas import aligned
from ..relations import Catalog, local_frame, written
from .options import GUARDS, CompareOptions

_PLACE = ("stage", "sub", "own", "step", "item", "part")


@dataclass(frozen=True)
class Plan:
    """commands: one row each, to be ordered by ORDER; audit: texts of what the policy or a rule held back; desired: the catalog that the plan leads to."""

    commands: DataFrame
    audit: DataFrame
    edges: DataFrame
    options: CompareOptions
    desired: Catalog | None = None

    ORDER = ("phase_order", "table_rank", "place")

    def ordered(self) -> DataFrame:
        """op, phase, label, sql, notes and names of the commands in the order to run them."""
        return self.commands.orderBy(*self.ORDER).select("phase", "op", "table_key", "object_key", "table_name", "name", "label", "sql", "notes")

    def phase_counts(self) -> DataFrame:
        return self.commands.groupBy("phase").count()

    def cycles(self) -> DataFrame:
        return sequence.cycles(self.edges)


_DROPS = "startswith(op, 'Drop') and op not in ('DropDefaultValue', 'DropColumnRebuild')"


def _guards(spark: SparkSession, like: DataFrame) -> DataFrame:
    """The commands that suspend foreign keys and triggers before all others and resume them after all others."""
    rows = ", ".join(f"({0 if state == 'Off' else diff.LAST_STAGE}, {k}, '{op}', '{state}')" for state in ("Off", "On") for k, op in enumerate(GUARDS))
    frame = spark.sql(f"select * from values {rows} as guards(stage, part, op, name)")
    place = "named_struct('stage', stage, 'sub', 0, 'own', '', 'step', 0, 'item', '', 'part', part, 'op_part', 0)"
    given = {"place": place, "op": "op", "name": "name", "table_key": "''", "object_key": "''", "schema": "''", "table_name": "''", "notes": "cast(array() as array<string>)"}
    return frame.selectExpr(*[f"{given.get(f.name, f'cast(null as {f.dataType.simpleString()})')} as {f.name}" for f in like.schema])


def compare(desired: Catalog, current: Catalog, options: CompareOptions, rows: DataFrame | None = None) -> Plan:
    """The plan that turns current into desired. rows: what diff.compared gives for the two, if it is at hand. Two equal catalogs give the guards alone; empty catalogs are allowed.

    Commands are written once (see relations.written), as the order of tables and the script both read them.
    """
    if options.schema:
        desired, current = replace(desired, schema=options.schema), replace(current, schema=options.schema)
    desired, current = aligned(desired, current, options.schemas)
    kept, held = policy.gated(diff.differences(diff.compared(desired, current) if rows is None else rows, options), options.policy)
    steps, refused = alter.expanded(kept, options)
    steps = steps.select("*", F.posexplode("ops").alias("op_part", "op"))
    place = "named_struct(" + ", ".join(f"'{n}', place.{n}" for n in _PLACE) + ", 'op_part', op_part) as place"
    side = [f"case when {_DROPS} then t.{n} else m.{n} end as {n}" for n in ("schema", "table_name", "name", "attrs")]
    commands = steps.selectExpr(place, "op", "table_key", "object_key", *side, "sql", "notes")
    commands = commands.unionByName(_guards(desired.spark, commands))
    commands = commands.selectExpr("*", f"map('sql', coalesce(sql, ''), 'new_name', concat(name, '{alter.TEMPORARY}')) as extra")
    commands = render.rendered(commands, options.dialect).withColumn("phase", sequence.phase(F.col("op"), F.col("name"))).drop("extra")
    commands = written(commands)
    keys = [c.foreign_keys.select("table_key", "parent_key") for c in (desired, current) if "foreign_keys" in c.frames]
    foreign_keys = reduce(DataFrame.union, keys) if keys else None
    if options.sequenced:
        commands = sequence.ranked(commands.withColumn("phase_order", sequence.phase_order(F.col("phase"))), foreign_keys)
    else:
        commands = commands.withColumns({"phase": F.lit("Unknown"), "phase_order": F.lit(0), "table_rank": F.lit(0)})
    edges = local_frame(desired.spark, [], "child string, parent string") if foreign_keys is None else foreign_keys.selectExpr("table_key as child", "parent_key as parent").filter("child <> parent").distinct()
    return Plan(commands, held.unionByName(refused), edges, options, desired)
