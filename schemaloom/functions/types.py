"""Logical and physical column types as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dialects as D


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def type_template(field_type: Column, dialect: str, size: Column | None = None) -> Column:
    """The physical type of a logical one, with %l, %p and %s; an unknown logical type fails the query."""
    own = _lookup({**D.TYPE_TEMPLATES, **D.TYPE_EXCEPTIONS[dialect]}, field_type)
    if dialect == D.MSSQL and size is not None:
        own = F.when((field_type == "ftString") & (size == -1), "VARCHAR(MAX)").otherwise(own)
    return F.coalesce(own, F.raise_error(F.concat(F.lit("unsupported field type: "), F.coalesce(field_type, F.lit("null")))).cast("string"))


def resolved_types(columns, dialect: str, guid_as_octets: bool = False, for_database: bool = True):
    """columns with type_name, size, precision, scale and charset as the dialect has them.

    Sizes that a type doesn't use become 0, so that declared columns compare equal to extracted ones.
    """
    guid = F.col("field_type") == "ftGuid"
    octets = guid & F.lit(guid_as_octets)
    columns = columns.withColumn("size", F.when(octets & F.lit(dialect in (*D.FIREBIRD_FAMILY, D.POSTGRESQL)), 16).when(guid & (F.col("size") <= 0), 38).otherwise(F.col("size")))
    template = type_template(F.col("field_type"), dialect, F.col("size"))
    template = F.when(octets, F.lit("BYTEA" if dialect == D.POSTGRESQL else "CHAR(%l)")).otherwise(template)
    columns = columns.withColumns({"type_name": template, "charset": F.when(octets & F.lit(dialect == D.FIREBIRD), "OCTETS").otherwise(F.col("charset"))})
    if not for_database:
        return columns
    name = F.col("type_name")
    has_size, has_precision = name.contains("%l"), name.contains("%p")
    size = F.when(has_size, F.col("size")).when(name == "BLOB", 8).when(name == "Boolean", 1).when(octets & F.lit(dialect == D.POSTGRESQL), F.col("size")).otherwise(0)
    return columns.withColumns({
        "size": size,
        "precision": F.when(has_precision, F.col("precision")).otherwise(0),
        "scale": F.when(has_precision, F.col("scale")).otherwise(0),
    })


def type_class(field_type: Column) -> Column:
    return F.coalesce(_lookup(D.TYPE_CLASSES, field_type), field_type)


def rendered_type(attrs: Column) -> Column:
    """The physical type with its character set and numbers filled in."""
    text = F.concat(attrs["type_name"], F.when(attrs["charset"] != "", F.concat(F.lit(" CHARACTER SET "), attrs["charset"])).otherwise(F.lit("")))
    for mark, name in (("%l", "size"), ("%p", "precision"), ("%s", "scale")):
        text = F.regexp_replace(text, F.lit(f"(?i){mark}"), attrs[name])
    return text


def base_type(type_name: Column) -> Column:
    """Upper case, up to the first parenthesis, blank or bracket."""
    return F.regexp_extract(F.upper(F.trim(type_name)), r"^[^( \[]*", 0)


def is_char_type(base: Column) -> Column:
    return base.contains("CHAR") | base.isin("TEXT", "STRING", "CLOB", "MEMO")


def type_category(base: Column) -> Column:
    return (
        F.when(is_char_type(base), "char")
        .when(base.isin("INTEGER", "INT", "SMALLINT", "BIGINT", "TINYINT", "INT64", "SERIAL", "BIGSERIAL"), "integer")
        .when(base.isin("NUMERIC", "DECIMAL", "NUMBER", "FLOAT", "DOUBLE", "REAL", "MONEY", "CURRENCY", "DEC"), "numeric")
        .when(base.isin("DATE", "TIME", "TIMESTAMP", "DATETIME", "DATETIME2", "SMALLDATETIME"), "datetime")
        .when(base.isin("BLOB", "BYTEA", "IMAGE", "VARBINARY", "BINARY", "BYTES"), "blob")
        .otherwise("other")
    )


def mysql_cast_type(attrs: Column) -> Column:
    """The name that CAST takes in MySQL."""
    base, size, precision = base_type(attrs["type_name"]), attrs["size"].cast("int"), attrs["precision"].cast("int")
    return (
        F.when(is_char_type(base), F.when(size > 0, F.concat(F.lit("CHAR("), attrs["size"], F.lit(")"))).otherwise("CHAR"))
        .when(base.isin("INTEGER", "INT", "SMALLINT", "BIGINT", "TINYINT", "INT64"), "SIGNED")
        .when(
            base.isin("NUMERIC", "DECIMAL", "NUMBER", "DEC", "FLOAT", "DOUBLE", "REAL"),
            F.when(precision > 0, F.concat(F.lit("DECIMAL("), attrs["precision"], F.lit(","), attrs["scale"], F.lit(")"))).otherwise("DECIMAL"),
        )
        .when(base == "DATE", "DATE")
        .when(base.isin("DATETIME", "TIMESTAMP", "SMALLDATETIME"), "DATETIME")
        .when(base == "TIME", "TIME")
        .otherwise("CHAR")
    )
