"""The relations that hold a database catalog: one DataFrame per kind of object, one row per object or member.

Columns named *_key are ASCII upper-case identities to join on; names keep their case. Text attributes use '' for "none".
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "tables": "schema_name string, table_key string, table_name string, description string",
    "columns": "table_key string, position int, column_name string, name_key string, field_type string, type_name string, size int, precision int, scale int, "
    "not_null boolean, auto_increment boolean, sorting_order string, default_value string, is_primary_key boolean, charset string, description string",
    "primary_keys": "table_key string, pk_name string, auto_increment boolean, description string",
    "key_columns": "table_key string, key_kind string, object_key string, position int, column_name string, name_key string, sorting_order string",
    "indexes": "table_key string, object_key string, name string, is_unique boolean, description string",
    "foreign_keys": "table_key string, object_key string, name string, parent_table string, parent_key string, on_update string, on_delete string, description string",
    "checks": "table_key string, object_key string, name string, condition string, description string",
    "triggers": "table_key string, object_key string, name string, script string, description string",
    "views": "object_key string, name string, script string, description string",
    "sequences": "object_key string, name string, table_name string, initial_value int, increment int, description string",
    "domains": "object_key string, name string, type_name string, not_null boolean, default_value string, check_condition string, description string",
    "procedures": "object_key string, name string, signature string, is_function boolean, script string, description string",
}

#: The columns of views, kept but not compared: table_key is the view's object_key.
SCHEMAS["view_columns"] = SCHEMAS["columns"]

#: What rows of catalogs that span several schemas have besides: the schema of objects outside of tables, and that of a foreign key's parent.
SCHEMA_COLUMNS = {**dict.fromkeys(("views", "sequences", "domains", "procedures"), "schema_name"), "foreign_keys": "parent_schema"}

#: Kinds of key_columns rows.
KEY_KINDS = ("pk", "index", "fk_from", "fk_to")


class DuplicateObject(ValueError):
    """Two rows of a relation have the same identity."""


@dataclass(frozen=True)
class Catalog:
    """A database catalog: its name, its schema and its relations. Relations that are left out are empty.

    A qualified catalog spans several schemas: its keys begin with the schema (see functions.keys.qualified_key), and its rows have SCHEMA_COLUMNS.
    """

    spark: SparkSession
    name: str = ""
    schema: str = ""
    frames: Mapping[str, DataFrame] = field(default_factory=dict)
    qualified: bool = False

    def __getattr__(self, relation: str) -> DataFrame:
        if relation not in SCHEMAS:
            raise AttributeError(relation)
        return self.relation(relation)

    def relation(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        found = self.frames.get(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def replaced(self, **frames: DataFrame) -> Catalog:
        return replace(self, frames={**self.frames, **frames})

    def cached(self) -> Catalog:
        return replace(self, frames={k: v.cache() for k, v in self.frames.items()})

    def write(self, folder: str) -> None:
        """One Parquet folder for each relation."""
        for name in SCHEMAS:
            self.relation(name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    def assert_unique(self) -> Catalog:
        """self, or DuplicateObject with the first identities that occur twice."""
        for name in self.frames:
            own = _IDENTITY[name]
            twice = self.relation(name).groupBy(*own).count().filter("count > 1").limit(5).collect()
            if twice:
                raise DuplicateObject(f"{name}: {[tuple(r)[:-1] for r in twice]}")
        return self


_IDENTITY = {
    "tables": ("table_key",), "columns": ("table_key", "name_key"), "view_columns": ("table_key", "name_key"), "primary_keys": ("table_key",), "key_columns": ("table_key", "key_kind", "object_key", "position"),
    **dict.fromkeys(("indexes", "foreign_keys", "checks", "triggers"), ("table_key", "object_key")), **dict.fromkeys(("views", "sequences", "domains", "procedures"), ("object_key",)),
}


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a temporary one for each application if all runs on this machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.sparkContext.applicationId
    if own not in _local_folders:
        _local_folders[own] = tempfile.mkdtemp(prefix="schemaloom-")
    return _local_folders[own]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: plans over it stay small, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/relation-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalog(spark: SparkSession, folder: str, name: str = "", schema: str = "", qualified: bool = False) -> Catalog:
    """A catalog that Catalog.write has written."""
    full = {n: f"{s}, {SCHEMA_COLUMNS[n]} string" if qualified and n in SCHEMA_COLUMNS else s for n, s in SCHEMAS.items()}
    return Catalog(spark, name, schema, {n: spark.read.schema(s).parquet(f"{folder.rstrip('/')}/{n}") for n, s in full.items()}, qualified)


def from_rows(spark: SparkSession, name: str = "", schema: str = "", **rows: Iterable[Mapping]) -> Catalog:
    """A catalog of rows given as dicts; left out are keys (made from names), empty texts, zeros and False."""
    from .functions.keys import ascii_upper_text

    frames = {}
    for relation, given in rows.items():
        columns = [x.strip().split() for x in SCHEMAS[relation].split(",")]
        filled = []
        for r in given:
            r = dict(r)
            shown = r.get("name", r.get("column_name", ""))
            if relation == "tables":
                r.setdefault("table_key", ascii_upper_text(r["table_name"]))
            elif "table" in r:
                r["table_key"] = ascii_upper_text(r.pop("table"))
            if relation == "procedures":
                r.setdefault("object_key", ascii_upper_text(shown + (f"({r['signature']})" if r.get("signature", "").strip() else "")))
            if relation == "foreign_keys":
                r.setdefault("parent_key", ascii_upper_text(r.get("parent_table", "")))
                r.setdefault("on_update", "None"), r.setdefault("on_delete", "None")
            if "object" in r:
                r["object_key"] = ascii_upper_text(r.pop("object"))
            r.setdefault("object_key", ascii_upper_text(shown) if relation != "key_columns" else "")
            r.setdefault("name_key", ascii_upper_text(r.get("column_name", "")))
            r.setdefault("sorting_order", "NoSort")
            filled.append(tuple(r.get(c, {"string": "", "int": 0, "boolean": False}[t]) for c, t in columns))
        frames[relation] = local_frame(spark, filled, SCHEMAS[relation])
    return Catalog(spark, name, schema, frames)


_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a relation whose size the optimizer knows, so that small ones are broadcast and no shuffle is planned for them."""
    fields = [x.split() for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields]))


def key_list(members: DataFrame, kind: str) -> DataFrame:
    """(table_key, object_key, names array, keys array) of the members of one kind, in order of position."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "column_name", "name_key")))
    own = members.filter(F.col("key_kind") == kind).groupBy("table_key", "object_key").agg(ordered.alias("m"))
    return own.select("table_key", "object_key", F.col("m.column_name").alias("names"), F.col("m.name_key").alias("keys"))
