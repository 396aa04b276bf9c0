"""All objects of a catalog in one relation, so that one join compares every kind."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..relations import Catalog, key_list

SCHEMA = "kind string, table_key string, object_key string, schema string, table_name string, name string, attrs map<string,string>, members array<string>, to_members array<string>"
_NONE = "cast(array() as array<string>)"
_COLUMN = ("position", "field_type", "type_name", "size", "precision", "scale", "not_null", "auto_increment", "sorting_order", "default_value", "charset", "description")


def objects(catalog: Catalog) -> DataFrame:
    """One row per table, column, key, index, check, trigger, view, sequence, domain and routine.

    attrs has what the object is made of as text; members and to_members are the key forms of its columns. Texts that are compared by meaning have
    their canonical form in attrs too, made here once for each side. Children carry the name of their table, and its schema in a catalog of several. A primary key without
    columns, which stands for none, is left out. Kinds of which the catalog has no relation are left out of the plan.
    """
    own = catalog.tables.select("table_key", "table_name", *(["schema_name"] if catalog.qualified else []))
    schema = "coalesce(schema_name, '')" if catalog.qualified else "'" + catalog.schema.replace("'", "''") + "'"
    parts: list[DataFrame] = []

    def add(relation: str, kind: str, name: str, attrs: tuple[str, ...], by_table: bool = True, keys: str = _NONE, to_keys: str = _NONE, canonical: Callable[[], Column] | None = None, frame: DataFrame | None = None) -> None:
        if relation not in catalog.frames:
            return
        frame = catalog.relation(relation) if frame is None else frame
        if by_table and kind != "table":
            frame = frame.join(own, "table_key")
        if canonical is not None:
            frame = frame.withColumn("canonical", canonical())
            attrs = (*attrs, "canonical")
        key = {"table": "''", "primary_key": "''", "column": "name_key"}.get(kind, "object_key")
        pairs = ", ".join(f"'{a}', coalesce(cast({a} as string), '')" for a in attrs)
        parts.append(frame.selectExpr(
            f"'{kind}' as kind", f"{'table_key' if by_table else repr('')} as table_key", f"{key} as object_key", f"{schema} as schema", f"{'table_name' if by_table else repr('')} as table_name", f"{name} as name",
            f"map({pairs}) as attrs", f"coalesce({keys}, {_NONE}) as members", f"coalesce({to_keys}, {_NONE}) as to_members",
        ))

    def listed(frame: DataFrame, kind: str, to: str = "") -> DataFrame:
        found = key_list(catalog.key_columns, kind).selectExpr("table_key", "object_key", f"array_join(names, ', ') as {to}columns", f"keys as {to}keys")
        return frame.join(found, ["table_key", "object_key"], "left")

    add("tables", "table", "table_name", ("description",))
    add("columns", "column", "column_name", _COLUMN)
    if "primary_keys" in catalog.frames:
        keys = listed(catalog.primary_keys.withColumn("object_key", F.lit("")), "pk").filter("size(keys) > 0 or trim(pk_name) <> ''")
        add("primary_keys", "primary_key", "pk_name", ("auto_increment", "description", "columns"), keys="keys", frame=keys)
    if "indexes" in catalog.frames:
        add("indexes", "index", "name", ("is_unique", "description", "columns"), keys="keys", frame=listed(catalog.indexes, "index"))
    if "foreign_keys" in catalog.frames:
        foreign = listed(listed(catalog.foreign_keys, "fk_from"), "fk_to", "to_")
        add("foreign_keys", "foreign_key", "name", ("parent_table", "parent_key", "on_update", "on_delete", "description", "columns", "to_columns", *(["parent_schema"] if catalog.qualified else [])), keys="keys", to_keys="to_keys", frame=foreign)
    add("checks", "check", "name", ("condition", "description"), canonical=lambda: normalize.check_condition(F.col("condition")))
    script = lambda: normalize.script(F.col("script"))
    add("triggers", "trigger", "name", ("script", "description"), canonical=script)
    add("views", "view", "name", ("script", "description"), False, canonical=script)
    add("sequences", "sequence", "name", ("table_name", "initial_value", "increment", "description"), False)
    add("domains", "domain", "name", ("type_name", "not_null", "default_value", "check_condition", "description"), False, canonical=lambda: normalize.check_condition(F.col("check_condition")))
    add("procedures", "procedure", "name", ("signature", "is_function", "script", "description"), False, canonical=script)
    return reduce(DataFrame.unionByName, parts) if parts else catalog.spark.createDataFrame([], SCHEMA)
