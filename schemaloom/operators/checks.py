"""Constraints as queries over rows: what a database would refuse, found on the tables themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a null in one of columns."""
    return rows.filter(reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


def duplicate_keys(rows: DataFrame, key: list[str], null_is_equal: bool = True) -> DataFrame:
    """(*key, copies) of keys that several rows have. Counts are combined before the shuffle, so a hot key is one small row of each task.

    With null_is_equal False, keys with a null are never duplicates, as for unique indexes in most databases.
    """
    counted = rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
    return counted if null_is_equal else counted.dropna("any", subset=key)


def key_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """(*key, copies, problem) of what a primary key on key would refuse: nulls and duplicates."""
    has_null = reduce(Column.__or__, [F.col(c).isNull() for c in key])
    counted = rows.groupBy(*key).agg(F.count("*").alias("copies"))
    problem = F.when(has_null, "null").when(F.col("copies") > 1, "duplicate")
    return counted.withColumn("problem", problem).filter("problem is not null")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of child whose key has no row in parent; a null in the key refers to nothing and passes.

    Only the key of parent is read, and every key once. Skewed keys of child are split by adaptive execution, as the join is left anti.
    """
    keys = parent.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(parent_columns)]).distinct()
    given = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    matches = reduce(Column.__and__, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)])
    return child.filter(given).join(keys, matches, "left_anti")


def check_violations(rows: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which a check is false; unknown passes, as in SQL."""
    return rows.filter(~(F.expr(condition) if isinstance(condition, str) else condition))


def lossy_casts(rows: DataFrame, column: str, to: str, length: int | None = None) -> DataFrame:
    """Rows whose value in column changes or is lost by a cast to another type, or is longer than length."""
    value = F.col(column)
    cast = value.try_cast(to)
    back = cast.try_cast(dict(rows.dtypes)[column])
    lost = value.isNotNull() & ~F.coalesce(back == value, F.lit(False))
    return rows.filter(lost | (F.length(value.cast("string")) > length) if length is not None else lost)


def violation_counts(rows: DataFrame, checks: dict[str, str | Column]) -> DataFrame:
    """(name, violations, checked) of many checks in one pass over rows."""
    conditions = {n: F.expr(c) if isinstance(c, str) else c for n, c in checks.items()}
    sums = [F.count_if(~c).alias(f"_{i}") for i, c in enumerate(conditions.values())]
    one = rows.agg(*sums, F.count("*").alias("_rows"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(conditions)])).alias("x")
    return one.select(named, F.col("_rows").alias("checked")).select("x.name", "x.violations", "checked")
