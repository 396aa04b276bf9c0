"""Questions to one catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ascii_upper_text
from ..relations import Catalog


class UnknownTable(KeyError):
    """A table that the catalog does not have."""


def _key(catalog: Catalog, table: str) -> str:
    key = ascii_upper_text(table)
    if not catalog.tables.filter(F.col("table_key") == key).limit(1).count():
        raise UnknownTable(table)
    return key


def tables(catalog: Catalog) -> DataFrame:
    return catalog.tables.orderBy("table_key")


def fields(catalog: Catalog, table: str) -> DataFrame:
    """Columns in order of position."""
    return catalog.columns.filter(F.col("table_key") == _key(catalog, table)).orderBy("position")


def primary_key(catalog: Catalog, table: str) -> DataFrame:
    return catalog.primary_keys.filter(F.col("table_key") == _key(catalog, table))


def members(catalog: Catalog, table: str, kind: str, name: str = "") -> DataFrame:
    """Columns of a key or an index of a table, in order; kind as in relations.KEY_KINDS."""
    rows = catalog.key_columns.filter((F.col("table_key") == _key(catalog, table)) & (F.col("key_kind") == kind))
    return rows.filter(F.col("object_key") == ascii_upper_text(name)).orderBy("position")


def indexes(catalog: Catalog, table: str) -> DataFrame:
    return catalog.indexes.filter(F.col("table_key") == _key(catalog, table))


def foreign_keys(catalog: Catalog, table: str) -> DataFrame:
    return catalog.foreign_keys.filter(F.col("table_key") == _key(catalog, table))


def referencing(catalog: Catalog, table: str) -> DataFrame:
    """Foreign keys that refer to a table."""
    return catalog.foreign_keys.filter(F.col("parent_key") == _key(catalog, table))
