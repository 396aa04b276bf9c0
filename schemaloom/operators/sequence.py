"""Dependency-safe order of commands: phases, and inside the phases of tables the order of foreign keys."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import local_frame, written

# Phases in their order.
PHASES = (
    "Pre", "DropProcedures", "DropTriggers", "DropViews", "DropForeignKeys", "DropChecks", "DropIndexes", "DropPrimaryKeys", "DropColumns", "DropTables", "DropSequences", "DropDomains",
    "CreateSequences", "CreateDomains", "CreateTables", "Columns", "PrimaryKeys", "Indexes", "Checks", "ForeignKeys", "Views", "Triggers", "Procedures", "Unknown", "Comments", "Post",
)
PHASE_OF = {
    "DropProcedure": "DropProcedures", "DropTrigger": "DropTriggers", "DropView": "DropViews", "DropForeignKey": "DropForeignKeys", "DropCheck": "DropChecks", "DropIndexe": "DropIndexes",
    "DropPrimaryKey": "DropPrimaryKeys", "DropColumn": "DropColumns", "DropDefaultValue": "DropColumns", "DropTable": "DropTables", "DropSequence": "DropSequences", "DropDomain": "DropDomains",
    "CreateSequence": "CreateSequences", "AlterSequence": "CreateSequences", "CreateDomain": "CreateDomains", "CreateTable": "CreateTables",
    **dict.fromkeys(("CreateColumn", "AlterColumn", "AlterColumnPosition", "AlterDefaultValue", "CreateColumnRebuild", "CopyColumnData", "BackfillColumnData", "DropColumnRebuild", "RenameColumn"), "Columns"),
    "CreatePrimaryKey": "PrimaryKeys", "CreateIndexe": "Indexes", "CreateCheck": "Checks", "AlterCheck": "Checks", "CreateForeignKey": "ForeignKeys", "CreateView": "Views",
    "CreateTrigger": "Triggers", "CreateProcedure": "Procedures", "SetTableComment": "Comments", "SetColumnComment": "Comments",
}


def phase(op: Column, name: Column) -> Column:
    """Guards that suspend come first and those that resume last; unknown commands come near the end."""
    found = F.when(op.isin("EnableForeignKeys", "EnableTriggers"), F.when(name == "On", "Post").otherwise("Pre"))
    for belongs in dict.fromkeys(PHASE_OF.values()):
        found = found.when(op.isin(*[own for own, phase_ in PHASE_OF.items() if phase_ == belongs]), belongs)
    return found.otherwise("Unknown")


def phase_order(name: Column) -> Column:
    return F.array_position(F.lit(list(PHASES)), name).cast("int") - 1


def table_order(names: list[str], edges: set[tuple[str, str]], inverse: bool = False) -> list[str]:
    """names so that parents come before children; of those that may come next, the first by name does. edges: (child, parent).

    Edges of a table to itself or to tables outside of names don't count. Tables of a cycle and what depends on it come last, in the order
    given. inverse turns all around, for drops.
    """
    inside = set(names)
    edges = {(c, p) for c, p in edges if c != p and c in inside and p in inside}
    waits = dict.fromkeys(names, 0)
    children: dict[str, list[str]] = {}
    for child, parent in edges:
        waits[child] += 1
        children.setdefault(parent, []).append(child)
    ready = [n for n in waits if not waits[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for child in children.get(out[-1], ()):
            waits[child] -= 1
            if not waits[child]:
                heapq.heappush(ready, child)
    done = set(out)
    out += [n for n in waits if n not in done]
    return out[::-1] if inverse else out


def dependencies(commands: DataFrame, foreign_keys: DataFrame, op: str) -> DataFrame:
    """(child, parent) of the foreign keys between tables that commands of one kind name."""
    named = commands.filter(F.col("op") == op).select("table_key").distinct()
    edges = foreign_keys.select(F.col("table_key").alias("child"), F.col("parent_key").alias("parent")).filter("child <> parent").distinct()
    edges = edges.join(named.withColumnRenamed("table_key", "child"), "child", "left_semi")
    return edges.join(named.withColumnRenamed("table_key", "parent"), "parent", "left_semi").select("child", "parent")


def _until_still(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows after step until no row of its result has moved; each round is written, so that plans stay small."""
    while True:
        after = written(step(rows))
        rows = after.drop("moved")
        if after.filter("moved").isEmpty():
            return rows


def _peeled(edges: DataFrame) -> DataFrame:
    """edges without those of tables that nothing depends on, or that depend on nothing: one layer of them."""
    inner = edges.select("child").intersect(edges.select("parent"))
    return written(edges.join(inner, "child", "left_semi").join(inner.withColumnRenamed("child", "parent"), "parent", "left_semi").select("child", "parent"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges with chains as one edge each, (name, prev, next) of what lies inside of chains, (name, cycle) of plain rings); None if there are no chains.

    Inside of a chain are tables with one edge in and one edge out. Every one of them points at its neighbours; pointers jump to where the pointed-at point, so that after as many
    rounds as the length of the longest chain has binary digits all point at the chain's ends. Those that still point at others inside then are on rings.
    """
    outs = edges.groupBy(F.col("child").alias("name")).agg(F.count("*").alias("outs"), F.first("parent").alias("next"))
    ins = edges.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("ins"), F.first("child").alias("prev"))
    inside = written(outs.join(ins, "name").filter("outs = 1 and ins = 1").selectExpr("name", "prev", "next", "name as low"))
    n = inside.count()
    if not n:
        return None
    for _ in range(n.bit_length()):
        ahead, back = inside.selectExpr("name as next", "next as after", "low as low_after"), inside.selectExpr("name as prev", "prev as ahead_of")
        jumped = inside.join(ahead, "next", "left").join(back, "prev", "left")
        moved = "after is not null or ahead_of is not null"
        inside = written(jumped.selectExpr("name", "coalesce(ahead_of, prev) as prev", "coalesce(after, next) as next", "least(low, coalesce(low_after, low)) as low", f"{moved} as moved"))
        if inside.filter("moved").isEmpty():
            break
        inside = inside.drop("moved")
    names = inside.select("name")
    on_ring = names.withColumnRenamed("name", "next")
    chains = inside.join(on_ring, "next", "left_anti").select("name", "prev", "next")
    outer = edges.join(names.withColumnRenamed("name", "child"), "child", "left_anti").join(names.withColumnRenamed("name", "parent"), "parent", "left_anti").select("child", "parent")
    chains = written(chains)
    edges = outer.union(chains.select("prev", "next").filter("prev <> next")).distinct()
    return written(edges), chains, inside.join(on_ring, "next", "left_semi").selectExpr("name", "low as cycle")


def _coloured(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, cycle) of tables on cycles that are found, the edges that cycles not found yet are made of).

    Every table learns the smallest name that it reaches (low) and the smallest one that reaches it (high), both in the same rounds. Besides its neighbours it asks the tables that it has as low
    and high so far, and one on each side that is twice as far in every round (ahead, back), so ways mostly take rounds by the digits of their length. Where low and high are the same name, that table and this one reach each other.
    The tables of a cycle agree in both, so edges between tables that don't are on no cycle; the smallest name of all is found for certain, so every call finds something or takes something off.
    """
    edges = rest.selectExpr("child as name", "parent as asked", "'low' as tells").union(rest.selectExpr("parent", "child", "'high'"))
    told = {"low": "if(tells in ('low', 'ahead'), low, null)", "high": "if(tells in ('high', 'back'), high, null)", "ahead": "if(tells = 'ahead', ahead, null)", "back": "if(tells = 'back', back, null)"}
    state = list(told)

    def lower(tables: DataFrame) -> DataFrame:
        asks = edges.union(tables.selectExpr("name", "stack(4, low, 'low', high, 'high', ahead, 'ahead', back, 'back')"))
        heard = asks.join(tables.withColumnRenamed("name", "asked"), "asked").selectExpr("name", *[f"{x} as {c}" for c, x in told.items()], "null as was_low", "null as was_high")
        own = tables.selectExpr("name", "low", "high", "null", "null", "low", "high")
        least = heard.union(own).groupBy("name").agg(*[F.min(c).alias(c) for c in (*state, "was_low", "was_high")])
        return least.selectExpr("name", *state, "low < was_low or high < was_high as moved")

    near = edges.groupBy("name").agg(*[F.min(F.when(F.col("tells") == tells, F.col("asked"))).alias(c) for c, tells in (("ahead", "low"), ("back", "high"))])
    tables = _until_still(near.selectExpr("name", "name as low", "name as high", "coalesce(ahead, name) as ahead", "coalesce(back, name) as back"), lower).select("name", "low", "high")
    members = tables.filter("low = high")
    several = members.groupBy("low").count().filter("count > 1").select("low")
    others = tables.filter("low <> high")
    inside = rest.join(others.withColumnRenamed("name", "child"), "child").join(others.withColumnRenamed("name", "parent"), ["parent", "low", "high"])
    return members.join(several, "low", "left_semi").selectExpr("name", "low as cycle"), written(inside.select("child", "parent"))


def cycles(edges: DataFrame) -> DataFrame:
    """(name, cycle) of every table on a cycle of edges (child, parent): cycle is the smallest name of those that it reaches and that reach it.

    Chains become single edges and ends without a way on are taken off, over and over; what is left has branches everywhere and is solved by colours, after which the rest goes round again.
    Then what lay inside of a chain is on a cycle if both its ends are on the same one. The rows are tables and edges, never pairs of tables. Rounds grow with the binary digits of the lengths
    of chains, and mostly so with those of ways on which every table has branches (at worst with their steps). Edges of a table to itself don't count; an empty table gives an empty table.
    """
    rest = written(edges.select("child", "parent").filter("child <> parent").distinct())
    levels, parts, size = [], [local_frame(edges.sparkSession, [], "name string, cycle string")], rest.count()
    while size:
        if contracted := _contracted(rest):
            rest, chains, rings = contracted
            levels.append(chains)
            parts.append(rings)
        rest = _peeled(rest)
        now = rest.count()
        if now and now == size and contracted is None:
            found, rest = _coloured(rest)
            parts.append(found)
            now = rest.count()
        size = now
    if not levels and len(parts) == 1:
        return parts[0]
    found = written(reduce(DataFrame.union, parts))
    for chains in reversed(levels):
        ends = chains.join(found.selectExpr("name as prev", "cycle"), "prev", "left").join(found.selectExpr("name as next", "cycle as other"), "next", "left")
        inner = ends.filter("cycle = other or prev = next").selectExpr("name", "coalesce(cycle, prev) as cycle")
        loops = ends.filter("prev = next and cycle is null").selectExpr("prev as name", "prev as cycle").distinct()
        found = written(found.union(inner).union(loops))
    least = found.groupBy("cycle").agg(F.min("name").alias("least"))
    return found.join(least, "cycle").selectExpr("name", "least as cycle")


def ranked(commands: DataFrame, foreign_keys: DataFrame | None) -> DataFrame:
    """commands with table_rank: the place of created and dropped tables among each other, 0 for other commands.

    Only names of tables and their foreign keys are gathered, of the tables that this plan creates or drops; nothing if there is but one.
    """
    spark = commands.sparkSession
    ranks = []
    tables = commands.filter(F.col("op").isin("CreateTable", "DropTable")).select("op", "table_key", "place").orderBy("place").collect()
    for op, inverse in (("CreateTable", False), ("DropTable", True)):
        names = [r.table_key for r in tables if r.op == op]
        edges = {(r.child, r.parent) for r in dependencies(commands, foreign_keys, op).collect()} if len(names) > 1 and foreign_keys is not None else set()
        ranks += [(op, name, k) for k, name in enumerate(table_order(names, edges, inverse))]
    if not ranks:
        return commands.withColumn("table_rank", F.lit(0))
    found = local_frame(spark, ranks, "op string, table_key string, table_rank int")
    return commands.join(found, ["op", "table_key"], "left").withColumn("table_rank", F.coalesce("table_rank", F.lit(0)))
