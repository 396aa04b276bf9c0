"""Catalogs of SQLite files. SQLite has no server: its table-valued pragmas are read here, a row per column, and decoded as other databases' are."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import SparkSession

from .. import dialects as D
from ..relations import Catalog
from .system_tables import decoded

_USER = "m.name not like 'sqlite_%'"
#: The one column of an INTEGER key; counts_up tells so of a table's name and statement.
_COUNTS_UP = "c.pk = 1 and upper(c.type) = 'INTEGER' and counts_up(m.name, m.sql) and (select count(*) from pragma_table_info(m.name) k where k.pk > 0) = 1"
QUERIES = {
    "tables": ("table_name string, description string", f"select m.name, '' from sqlite_master m where m.type = 'table' and {_USER}"),
    "columns": (
        "table_name string, column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string",
        f"select m.name, c.name, c.cid, upper(c.type), 0, 0, 0, c.\"notnull\", {_COUNTS_UP}, c.dflt_value, '', '' from sqlite_master m join pragma_table_info(m.name) c where m.type = 'table' and {_USER}",
    ),
    "primary_keys": ("table_name string, pk_name string, column_name string, position int, auto_increment int", f"select m.name, 'PK_' || m.name, c.name, c.pk, {_COUNTS_UP} from sqlite_master m join pragma_table_info(m.name) c where m.type = 'table' and c.pk > 0 and {_USER}"),
    "foreign_keys": (
        "table_name string, name string, column_name string, position int, parent_table string, parent_column string, on_update string, on_delete string",
        'select m.name, \'FK_\' || f."table" || \'_\' || (select g."from" from pragma_foreign_key_list(m.name) g where g.id = f.id and g.seq = 0), f."from", f.seq, f."table", coalesce(f."to", f."from"), f.on_update, f.on_delete '
        f"from sqlite_master m join pragma_foreign_key_list(m.name) f where m.type = 'table' and {_USER}",
    ),
    "indexes": (
        "table_name string, name string, is_unique int, column_name string, position int",
        f"select m.name, i.name, i.\"unique\", c.name, c.seqno from sqlite_master m join pragma_index_list(m.name) i join pragma_index_info(i.name) c where m.type = 'table' and i.origin <> 'pk' and {_USER}",
    ),
    "views": ("name string, script string", f"select m.name, m.sql from sqlite_master m where m.type = 'view' and {_USER}"),
}
SEQUENCES = ("name string, table_name string, initial_value int, increment int", "select name, name, 0, 0 from sqlite_sequence")
EXTRACTED = frozenset({"foreign_keys", "views", "sequences"})


_QUOTED = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|$)|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^]]*\]""", re.S)


def _numbers(rows: list[tuple]) -> list[tuple]:
    """NAME(p,s) in the type becomes size, precision and scale."""
    out = []
    for r in rows:
        kind, _, rest = r[3].partition("(")
        given = [int(x) for x in rest.rstrip(") ").split(",") if x.strip().isdigit()]
        first, second = (given + [0, 0])[:2]
        text = "CHAR" in kind
        out.append((*r[:3], kind.strip() or "BLOB", first if text else 0, 0 if text else first, 0 if text else second, *r[7:]))
    return out


def sqlite_catalog(spark: SparkSession, path: str, name: str = "") -> Catalog:
    """All relations are read in one transaction, so that they are of one version of the file."""
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True, isolation_level=None)
    try:
        connection.execute("begin")
        try:
            sequences = connection.execute(SEQUENCES[1]).fetchall()
        except sqlite3.OperationalError:  # there is no such table until a column counts up by itself
            sequences = []
        # before a table's first row only its statement tells that it counts up
        counted = {r[0] for r in sequences}
        connection.create_function("counts_up", 2, lambda table, sql: table in counted or bool(re.search(r"(?i)\bautoincrement\b", _QUOTED.sub(" ", sql or ""))))
        raw = {"sequences": spark.createDataFrame(sequences, SEQUENCES[0])}
        for relation, (schema, query) in QUERIES.items():
            rows = connection.execute(query).fetchall()
            raw[relation] = spark.createDataFrame(_numbers(rows) if relation == "columns" else rows, schema)
    finally:
        connection.close()
    return decoded(spark, raw, D.SQLITE, "", name)
