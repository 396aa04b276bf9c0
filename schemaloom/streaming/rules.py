"""Validation of streams: rows that break a rule are set aside as they come, and duplicate keys are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validators import Rule, broken_rules


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows (of a stream or not) with broken: the rules that each row breaks."""
    return rows.withColumn("broken", broken_rules(rules))


def unique_within(rows: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within delay; the state of older keys is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def split_to(rows: DataFrame, rules: list[Rule], good: str, bad: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Writes valid rows to good and others, with what they break, to bad (Parquet). Each batch is written under its number, so that a batch
    that is run again after a failure replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter(F.size("broken") == 0).drop("broken").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(F.size("broken") > 0).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return judged(rows, rules).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options).start()
