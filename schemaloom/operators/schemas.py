"""Catalogs of several schemas: keys that tell equal names in two schemas apart, and schemas that go by another name on the other side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ascii_upper, ascii_upper_text, schema_prefix_text
from ..relations import SCHEMA_COLUMNS, Catalog

#: Relations whose object_key is an identity by itself; keys of other relations are inside of a table.
FREE = ("views", "sequences", "domains", "procedures")


def _keys(relation: str, rows: DataFrame) -> list[str]:
    """The columns of a relation that hold keys with a schema."""
    own = ["object_key"] if relation in FREE else ["table_key"]
    return own + [c for c in ("parent_key",) if c in rows.columns]


def qualified(catalog: Catalog) -> Catalog:
    """A catalog of one schema as one that may span several: all of it is in catalog.schema."""
    if catalog.qualified:
        return catalog
    prefix, frames = F.lit(schema_prefix_text(catalog.schema)), {}
    for relation, rows in catalog.frames.items():
        rows = rows.withColumns({k: F.concat(prefix, F.col(k)) for k in _keys(relation, rows)})
        named = {"tables": "schema_name", **SCHEMA_COLUMNS}.get(relation)
        frames[relation] = rows.withColumn(named, F.lit(catalog.schema)) if named else rows
    return replace(catalog, frames=frames, qualified=True)


def renamed(catalog: Catalog, schemas: Sequence[tuple[str, str]]) -> Catalog:
    """A qualified catalog with schemas by other names: (old, new) pairs, all at once, so that two can change places."""
    if not schemas:
        return catalog

    def other(key: Column) -> Column:
        found = F.when(F.lit(False), key)
        for old, new in schemas:
            prefix = schema_prefix_text(old)
            found = found.when(key.startswith(prefix), F.concat(F.lit(schema_prefix_text(new)), F.substr(key, F.lit(len(prefix) + 1))))
        return found.otherwise(key)

    def shown(name: Column) -> Column:
        found = F.when(F.lit(False), name)
        for old, new in schemas:
            found = found.when(ascii_upper(name) == ascii_upper_text(old), new)
        return found.otherwise(name)

    frames = {}
    for relation, rows in catalog.frames.items():
        rows = rows.withColumns({k: other(F.col(k)) for k in _keys(relation, rows)})
        named = {"tables": "schema_name", **SCHEMA_COLUMNS}.get(relation)
        frames[relation] = rows.withColumn(named, shown(F.col(named))) if named else rows
    return replace(catalog, frames=frames)


def aligned(desired: Catalog, current: Catalog, schemas: Sequence[tuple[str, str]] = ()) -> tuple[Catalog, Catalog]:
    """Both catalogs with keys of one form. schemas: (desired, current) names of schemas that stand for each other."""
    if desired.qualified or current.qualified or schemas:
        return renamed(qualified(desired), schemas), qualified(current)
    return desired, current
