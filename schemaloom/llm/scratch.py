"""Intermediate tables in the cluster's shared checkpoint folder, and small shared helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relations import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one of our own if all runs on this machine, and an error on a cluster. The session stays as it is."""
    return shared_folder(spark)


_open: list[list[str]] = []


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing.

    Inside tidy() the table goes at the end of the block, unless keep says that the block's result reads it.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that saved() wrote inside the block and didn't keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that saved() wrote, before its block ends. Nothing may read it any more."""
    if files := df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROWS_PER_BATCH = 1_000


def short_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so what Python workers get at a time is kept to ROWS_PER_BATCH rows, for the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, ROWS_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """name, or a longer one that docs has no column of."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def held_out() -> "F.Column":
    """Rows whose crc32(doc_id as text) mod 5 is 0: never used for learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
