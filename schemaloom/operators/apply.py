"""Commands on columns applied to the rows of a table: the data side of a migration, as one projection.

Spark tables can't change their columns in place, so a migration reads the old table and writes the new one elsewhere; a reader sees the old
table until its location is switched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alter import TEMPORARY

STEPS = ("CreateColumn", "CreateColumnRebuild", "CopyColumnData", "BackfillColumnData", "DropColumn", "DropColumnRebuild", "RenameColumn", "AlterColumn", "AlterColumnPosition", "AlterDefaultValue", "DropDefaultValue")


class UnsupportedStep(ValueError):
    """A command that does not change rows' columns."""


def spark_type(attrs: Mapping[str, str]) -> str:
    """The Spark type of a column's attrs in any dialect."""
    base = re.match(r"[^( \[]*", attrs["type_name"].strip().upper())[0]
    if base in ("DECIMAL", "NUMERIC", "NUMBER", "DEC") and int(attrs.get("precision") or 0):
        return f"decimal({attrs['precision']},{attrs.get('scale') or 0})"
    if attrs["type_name"].upper().startswith("DOUBLE"):
        return "double"
    if base.endswith("[]") or attrs["type_name"].lower().startswith("array<"):
        return attrs["type_name"].lower()
    return {
        "INTEGER": "int", "INT": "int", "INT4": "int", "SMALLINT": "smallint", "TINYINT": "tinyint", "BIGINT": "bigint", "INT8": "bigint", "INT64": "bigint", "SERIAL": "int", "BIGSERIAL": "bigint",
        "BOOLEAN": "boolean", "BOOL": "boolean", "BIT": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NTZ": "timestamp_ntz", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz",
        "FLOAT": "double", "REAL": "float", "NUMERIC": "decimal(38,0)", "DECIMAL": "decimal(38,0)", "NUMBER": "decimal(38,0)", "MONEY": "decimal(19,4)", "BINARY_DOUBLE": "double",
        "BLOB": "binary", "BYTEA": "binary", "BINARY": "binary", "VARBINARY": "binary", "IMAGE": "binary",
    }.get(base, "string")


def literal(attrs: Mapping[str, str]) -> Column:
    """The default of a column as a value of its type; null if it has none."""
    text = attrs.get("default_value", "")
    if not text:
        return F.lit(None).cast(spark_type(attrs))
    known = {"CURRENT_TIMESTAMP": F.current_timestamp(), "NOW()": F.current_timestamp(), "CURRENT_DATE": F.current_date(), "NULL": F.lit(None)}.get(text.strip().upper())
    if known is None and len(text) >= 2 and text[0] == text[-1] == "'":
        text = text[1:-1].replace("''", "'")
    return (F.lit(text) if known is None else known).cast(spark_type(attrs))


def copied(value: Column, attrs: Mapping[str, str], lossy: bool = False) -> Column:
    """value as the new type. A value that does not fit fails the query, or becomes null (texts: is cut) with lossy."""
    kind, size = spark_type(attrs), int(attrs.get("size") or 0)
    cast = value.try_cast(kind) if lossy else value.cast(kind)
    if kind != "string" or size <= 0:
        return cast
    if lossy:
        return F.substring(cast, 1, size)
    return F.when(F.length(cast) > size, F.raise_error(F.concat(F.lit("value is longer than "), F.lit(str(size)))).cast("string")).otherwise(cast)


def applied(rows: DataFrame, steps: Iterable[Mapping], lossy: bool = False) -> DataFrame:
    """rows after steps (op, name, attrs; as a plan orders them). Names of columns match without regard to ASCII case."""
    columns = {c.upper(): (c, F.col(f"`{c}`")) for c in rows.columns}
    for step in steps:
        op, name, attrs = step["op"], step["name"], step.get("attrs") or {}
        key, temporary = name.upper(), (name + TEMPORARY).upper()
        if op == "CreateColumn":
            columns[key] = (name, literal(attrs))
        elif op == "CreateColumnRebuild":
            columns[temporary] = (name + TEMPORARY, F.lit(None).cast(spark_type(attrs)))
        elif op == "CopyColumnData":
            columns[temporary] = (columns[temporary][0], copied(columns[key][1], attrs, lossy))
        elif op == "BackfillColumnData":
            columns[key] = (columns[key][0], F.coalesce(columns[key][1], literal(attrs)))
        elif op in ("DropColumn", "DropColumnRebuild"):
            del columns[key]
        elif op == "RenameColumn":
            columns = {key if k == temporary else k: (name if k == temporary else shown, value) for k, (shown, value) in columns.items()}
        elif op == "AlterColumn":
            columns[key] = (columns[key][0], copied(columns[key][1], attrs, lossy))
        elif op == "AlterColumnPosition":
            others = [(k, v) for k, v in columns.items() if k != key]
            others.insert(int(attrs["position"]), (key, columns[key]))
            columns = dict(others)
        elif op not in STEPS:
            raise UnsupportedStep(op)
    return rows.select(*[value.alias(shown) for shown, value in columns.values()])
