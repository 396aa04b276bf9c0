"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = ("plan_commands", "diff_columns_full_outer", "assert_fk_orphans", "assert_pk_unique", "assert_check", "copy_cast", "normalize_checks", "validators")


def synthetic(spark, tables: int, columns: int = 20):
    """Two catalogs of so many tables that differ in one column of every table."""
    from pyspark.sql import functions as F

    from schemaloom.relations import Catalog

    names = spark.range(tables).select(F.concat(F.lit("T"), F.col("id")).alias("table_key"))
    base = names.crossJoin(spark.range(columns).select(F.col("id").cast("int").alias("position")))
    c = base.select(
        "table_key", "position", F.concat(F.lit("C"), "position").alias("column_name"), F.concat(F.lit("C"), "position").alias("name_key"), F.lit("ftString").alias("field_type"), F.lit("VARCHAR(%l)").alias("type_name"),
        F.lit(60).alias("size"), F.lit(0).alias("precision"), F.lit(0).alias("scale"), F.lit(False).alias("not_null"), F.lit(False).alias("auto_increment"), F.lit("NoSort").alias("sorting_order"), F.lit("").alias("default_value"),
        F.lit(False).alias("is_primary_key"), F.lit("").alias("charset"), F.lit("").alias("description"),
    )
    t = names.select(F.lit("").alias("schema_name"), "table_key", F.col("table_key").alias("table_name"), F.lit("").alias("description"))
    other = c.withColumn("size", F.when(F.col("position") == 3, 30).otherwise(F.col("size")))
    return Catalog(spark, frames={"tables": t, "columns": c}), Catalog(spark, frames={"tables": t, "columns": other})


def main() -> None:
    from pyspark.sql import SparkSession

    from schemaloom import queries
    from schemaloom.plans.compare import compare
    from schemaloom.plans.options import CompareOptions

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries.queries()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)

    timed("warm_up", lambda: known["assert_check"](spark, sf))
    times.clear()
    for name in HEADLINES:
        timed(name, lambda name=name: known[name](spark, sf))
    for n in (100, 1_000, 10_000):
        timed(f"plan_build_{n}_tables", lambda n=n: compare(*synthetic(spark, n), CompareOptions("PostgreSQL")).ordered())
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
