"""A database's catalog as of one moment: all system queries in one transaction of one connection, as a Spark data source.

Queries over JDBC have a connection each, so a table that is made or dropped between two of them is in one relation and not in the other. Here one task opens one connection, begins a transaction
that sees one version of the database, and gives the rows of all relations as they come. What it reads is as much as a schema has, whatever the size of the tables.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import dialects as D
from ..relations import Catalog, written
from .system_tables import decoded, queries_for

#: What begins a transaction that sees one version, by dialect.
BEGIN = {
    D.POSTGRESQL: "BEGIN ISOLATION LEVEL REPEATABLE READ READ ONLY", D.MYSQL: "START TRANSACTION WITH CONSISTENT SNAPSHOT, READ ONLY", D.ORACLE: "SET TRANSACTION READ ONLY", D.MSSQL: "SET TRANSACTION ISOLATION LEVEL SNAPSHOT; BEGIN TRANSACTION",
    **dict.fromkeys(D.FIREBIRD_FAMILY, "SET TRANSACTION READ ONLY ISOLATION LEVEL SNAPSHOT"),
}
NAME = "schemaloom_cut"


class CutReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A row with the columns of each relation, then its rows as JSON objects."""
        module, _, name = self.options["connect"].partition(":")
        connection = getattr(importlib.import_module(module), name)(*json.loads(self.options["arguments"]))
        try:
            cursor = connection.cursor()
            cursor.execute(self.options["begin"])
            for relation, sql in json.loads(self.options["queries"]).items():
                cursor.execute(sql)
                columns = [d[0].lower() for d in cursor.description]
                yield relation, columns, None
                for row in cursor:
                    yield relation, None, json.dumps(dict(zip(columns, row, strict=True)), default=str)
        finally:
            connection.close()


class CutSource(DataSource):
    """options: connect (module:function of a DB-API driver), arguments (JSON list), begin, queries (JSON object by relation)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "relation string, columns array<string>, row string"

    def reader(self, schema) -> CutReader:
        return CutReader(dict(self.options))


def cut_catalog(spark: SparkSession, connect: str, arguments: Sequence, dialect: str, schema: str = "", name: str = "", begin: str | None = None, older: bool = False) -> Catalog:
    """The catalog of a database at one moment. connect names a function (module:function) that executors can import and that gives a DB-API connection for arguments."""
    spark.dataSource.register(CutSource)
    queries = queries_for(dialect, schema, older)
    begin = BEGIN.get(dialect, "BEGIN") if begin is None else begin
    rows = spark.read.format(NAME).options(connect=connect, arguments=json.dumps(list(arguments)), begin=begin, queries=json.dumps(queries)).load()
    rows = written(rows)  # read once; what follows reads this
    raw = {}
    for found in rows.filter("columns is not null").select("relation", "columns").collect():  # one for each relation
        values = F.from_json("row", "map<string,string>")
        raw[found.relation] = rows.filter((F.col("relation") == found.relation) & F.col("row").isNotNull()).select(values.alias("v")).select(*[F.col("v")[c].alias(c) for c in found.columns])
    return decoded(spark, raw, dialect, schema, name)
