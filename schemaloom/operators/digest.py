"""Which tables of two catalogs differ at all, by digests: what is equal on both sides leaves before its attributes are gathered.

Every row of every relation is hashed where it is, to 128 bits, and the hashes of a table's rows are summed, those of the current side negative, so that equal rows cancel out.
What is shuffled is a few numbers for each table and task, combined before the shuffle, however many columns a table has. Rows count as equal here only if nothing
about them differs, so a table that leaves has no difference in any comparison; what is only equal in meaning stays and is compared.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import SCHEMA_COLUMNS, SCHEMAS, Catalog, written
from .schemas import FREE

#: Catalogs smaller than this by the optimizer's estimate are compared as they are: two more passes would cost more than they save.
WORTHWHILE = 32 << 20
_SEEDS = (1, 2)
_WORDS = tuple(f"w{k}" for k in range(2 * len(_SEEDS)))


def owner(relation: str) -> Column:
    """What a row belongs to: its table, or itself outside of tables."""
    return F.concat(F.lit(relation + " "), F.col("object_key")) if relation in FREE else F.col("table_key")


def _compared(relation: str, rows: DataFrame) -> list[str]:
    """The columns that tell rows apart. The schema of a table is part of its key, where there are several."""
    given = [x.split()[0] for x in SCHEMAS[relation].split(",")] + [SCHEMA_COLUMNS.get(relation, "")]
    return [c for c in given if c in rows.columns and c not in ("schema_name", "parent_schema")]


def row_digests(catalog: Catalog, side: int) -> DataFrame | None:
    """(own, w0 to w3) of every row of the catalog's relations: two hashes in halves, so that no sum overflows. Nulls count as such."""
    parts = []
    for relation, rows in catalog.frames.items():
        if relation != "view_columns":
            told = [x for c in _compared(relation, rows) for x in (F.col(c), F.isnull(c))]
            rows = rows.select(owner(relation).alias("own"), *[F.xxhash64(F.lit(f"{seed} {relation}"), *told).alias(f"h{seed}") for seed in _SEEDS])
            halves = [half for seed in _SEEDS for half in (F.col(f"h{seed}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"h{seed}", 32))]
            parts.append(rows.select("own", *[(side * half).alias(f"w{k}") for k, half in enumerate(halves)]))
    return reduce(DataFrame.union, parts) if parts else None


def changed(desired: Catalog, current: Catalog) -> DataFrame:
    """(own) of the tables, and of the objects outside of tables, that differ in anything."""
    sides = [x for x in (row_digests(desired, 1), row_digests(current, -1)) if x is not None]
    if not sides:
        return desired.spark.createDataFrame([], "own string")
    folded = reduce(DataFrame.union, sides).groupBy("own").agg(*[F.sum(w).alias(w) for w in _WORDS])
    return folded.filter(" or ".join(f"{w} <> 0" for w in _WORDS)).select("own")


def narrowed(desired: Catalog, current: Catalog) -> tuple[Catalog, Catalog]:
    """Both catalogs without the tables and objects that are equal on both sides."""
    differing = written(changed(desired, current))  # its size is known, so that a short list is sent to all tasks and a long one is joined

    def own(catalog: Catalog) -> Catalog:
        frames = {n: rows.join(differing, owner(n) == F.col("own"), "left_semi") for n, rows in catalog.frames.items() if n != "view_columns"}
        return replace(catalog, frames=frames)

    return own(desired), own(current)


def _estimate(rows: DataFrame) -> int:
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def worthwhile(desired: Catalog, current: Catalog) -> bool:
    """Whether the catalogs are large enough for narrowed to pay; what it decides is cost, never the result."""
    total = 0
    for catalog in (desired, current):
        for rows in catalog.frames.values():
            total += _estimate(rows)
            if total >= WORTHWHILE:
                return True
    return False
