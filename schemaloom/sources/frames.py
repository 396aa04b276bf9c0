"""Catalogs of Parquet folders and of the session's tables: read from schemas, no row is touched."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..functions.keys import ascii_upper_text
from ..relations import SCHEMAS, Catalog, DuplicateObject, local_frame

_LOGICAL = {
    T.BooleanType: ("ftBoolean", "BOOLEAN"), T.ByteType: ("ftByte", "TINYINT"), T.ShortType: ("ftSmallint", "SMALLINT"), T.IntegerType: ("ftInteger", "INT"), T.LongType: ("ftLargeint", "BIGINT"),
    T.FloatType: ("ftSingle", "FLOAT"), T.DoubleType: ("ftExtended", "DOUBLE"), T.StringType: ("ftString", "STRING"), T.BinaryType: ("ftBlob", "BINARY"), T.DateType: ("ftDate", "DATE"),
    T.TimestampType: ("ftTimeStampOffset", "TIMESTAMP"), T.TimestampNTZType: ("ftTimeStamp", "TIMESTAMP_NTZ"),
}


def column_row(table: str, position: int, field: T.StructField) -> tuple:
    """A row of the relation columns. Nested types keep their Spark text as the type name, with the logical type ftBlob."""
    kind, size, precision, scale = field.dataType, 0, 0, 0
    if isinstance(kind, T.DecimalType):
        logical, name, precision, scale = "ftBCD", "DECIMAL(%p,%s)", kind.precision, kind.scale
    elif isinstance(kind, (T.VarcharType, T.CharType)):
        logical, name, size = ("ftString", "VARCHAR(%l)", kind.length) if isinstance(kind, T.VarcharType) else ("ftFixedChar", "CHAR(%l)", kind.length)
    else:
        logical, name = _LOGICAL.get(type(kind), ("ftBlob", kind.simpleString().upper()))
    comment = (field.metadata or {}).get("comment", "")
    shown = field.name
    return (ascii_upper_text(table), position, shown, ascii_upper_text(shown), logical, name, size, precision, scale, not field.nullable, False, "NoSort", (field.metadata or {}).get("CURRENT_DEFAULT", ""), False, "", comment)


def from_schemas(spark: SparkSession, schemas: Mapping[str, T.StructType], name: str = "", schema: str = "", comments: Mapping[str, str] | None = None) -> Catalog:
    tables = [(schema, ascii_upper_text(t), t, (comments or {}).get(t, "")) for t in schemas]
    columns = [column_row(t, k, f) for t, own in schemas.items() for k, f in enumerate(own.fields)]
    for relation, keys in (("tables", [t[1] for t in tables]), ("columns", [(c[0], c[3]) for c in columns])):
        if twice := [k for k, times in Counter(keys).items() if times > 1]:
            raise DuplicateObject(f"{relation}: {twice[:5]}")
    return Catalog(spark, name, schema, {"tables": local_frame(spark, tables, SCHEMAS["tables"]), "columns": local_frame(spark, columns, SCHEMAS["columns"])})


def parquet_catalog(spark: SparkSession, folder: str, tables: Iterable[str], name: str = "", suffix: str = ".parquet") -> Catalog:
    """The catalog of folder/<table>.parquet: one footer of each table is read, of several tables at a time."""
    names = list(tables)
    with ThreadPoolExecutor(8) as pool:
        schemas = list(pool.map(lambda t: spark.read.parquet(f"{folder.rstrip('/')}/{t}{suffix}").schema, names))
    return from_schemas(spark, dict(zip(names, schemas, strict=True)), name)


def session_catalog(spark: SparkSession, database: str | None = None, name: str = "") -> Catalog:
    """The tables (not the views) of a database of the session, with their comments."""
    found = [t for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW"]
    schemas = {t.name: spark.table(f"`{database}`.`{t.name}`" if database else f"`{t.name}`").schema for t in found}
    return from_schemas(spark, schemas, name, "", {t.name: t.description or "" for t in found})
