"""Plans on Spark tables: published by phases, undone by phases, taken up again, and safe from other writers and from ends in the middle."""

import os
import subprocess
import sys
import textwrap

import pytest

from schemaloom import table_queries as q
from schemaloom.plans.execute import ExecutionFailed
from schemaloom.plans.options import CONTINUE
from schemaloom.plans.publish import Conflict, Manifest, Store, UnknownStoredTable, digest, publish

OLD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NEW = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_note"]


def statuses(report):
    return {(x.phase, x.status) for x in report.items}


@pytest.fixture(scope="module")
def orders(spark, sf):
    """A plan for tables of every store of orders_store; all stores begin alike."""
    store, current = q.orders_store(spark, sf)
    return store, q.orders_plan(spark, current)


def test_phases_are_published_one_by_one_and_not_twice(spark, sf, orders):
    store, plan = orders
    before = store.table("orders")
    report = publish(plan, store)
    assert not report.rolled_back and report.counts()["Succeeded"] >= 8
    assert len(store.versions()) > 3 and store.table("orders", 1).columns == OLD and sorted(store.table("orders").columns) == sorted(NEW)
    assert before.count() == store.table("orders").count()  # a reader that had begun goes on
    assert store.table("order_notes").columns == ["note_id"] and store.table("order_notes").count() == 0
    versions = store.versions()
    again = publish(plan, store)
    assert "Succeeded" not in {s for _, s in statuses(again)} and ("Columns", "Done") in statuses(again) and store.versions() == versions
    with pytest.raises(UnknownStoredTable):
        store.table("nothing")
    assert store.vacuum(keep=1, older_than=0) >= 1
    assert store.versions() == versions[-1:] and store.table("orders").count() == before.count()


def test_a_phase_that_fails_is_undone_and_the_run_can_go_on(spark, sf):
    store, current = q.orders_store(spark, sf)
    with pytest.raises(ExecutionFailed) as failed:
        publish(q.orders_plan(spark, current, "o_totalprice < 2000"), store)
    report = failed.value.report
    assert {("Checks", "Failed"), ("Columns", "Succeeded"), ("ForeignKeys", "Skipped")} <= statuses(report) and report.rolled_back
    assert sorted(store.table("orders").columns) == sorted(NEW)
    going_on = publish(q.orders_plan(spark, current, "o_totalprice < 2000", on_error=CONTINUE, raise_on_error=False), store)
    assert {("Columns", "Done"), ("PrimaryKeys", "Done"), ("Checks", "Failed"), ("ForeignKeys", "Succeeded")} <= statuses(going_on)


def test_rows_that_do_not_fit_undo_their_phase(spark, sf):
    from schemaloom.plans.compare import compare
    from schemaloom.plans.options import CompareOptions
    from schemaloom.relations import from_rows

    store, current = q.orders_store(spark, sf)
    name = {"table": "customer", "position": 0, "column_name": "c_name", "field_type": "ftString", "type_name": "VARCHAR(%l)", "size": 3}
    desired = current.replaced(columns=current.columns.filter("name_key <> 'C_NAME'").unionByName(from_rows(spark, columns=[name]).columns))
    report = publish(compare(desired, current, CompareOptions("PostgreSQL", raise_on_error=False)), store)
    assert ("Columns", "Failed") in statuses(report) and "longer than 3" in next(x.error for x in report.items if x.error)
    assert store.versions() == [1] and not [x for x in store._listed("data")]


def test_whole_plans_are_published_at_once_or_not_at_all(spark, sf):
    store, current = q.orders_store(spark, sf)
    report = publish(q.orders_plan(spark, current, "o_totalprice < 2000", raise_on_error=False), store, whole=True)
    assert store.versions() == [1] and store.table("orders").columns == OLD and not [x for x in store._listed("data")]
    assert {("Columns", "RolledBack"), ("Checks", "Failed"), ("ForeignKeys", "Skipped")} <= statuses(report)
    publish(q.orders_plan(spark, current), store, whole=True)
    assert store.versions() == [1, 2] and sorted(store.table("orders").columns) == sorted(NEW)
    assert len(store._listed("data")) == 2  # orders was written once, though two phases change it


def test_of_two_writers_the_slower_one_gives_way(spark, sf, orders, tmp_path):
    store = Store(spark, str(tmp_path))
    store.adopted(a="x")
    mine = Manifest(2, {})
    store.published(mine)
    with pytest.raises(Conflict):
        store.published(mine)
    assert store.versions() == [1, 2] and all(x.getPath().getName().endswith(".json") for x in store._listed("manifests"))


def test_equal_plans_have_equal_digests(spark, sf, orders):
    _, current = q.orders_store(spark, sf)
    assert digest(q.orders_plan(spark, current)) == digest(orders[1]) != digest(q.orders_plan(spark, current, "o_totalprice > 1"))


def test_a_process_that_ends_in_the_middle_leaves_whole_phases(spark, sf, tmp_path):
    """The process is ended while the columns of orders have been written but not published."""
    code = f"""
        import os
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
        from schemaloom import table_queries as q
        from schemaloom.plans import publish as p
        store, current = q.orders_store(spark, {sf!r})
        print("ROOT", store.root, flush=True)
        done = p.Store.published
        def dying(self, manifest):
            if "Columns" in manifest.phases:
                os._exit(9)
            return done(self, manifest)
        p.Store.published = dying
        p.publish(q.orders_plan(spark, current), store)
    """
    ended = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))})
    assert ended.returncode == 9, ended.stderr[-2000:]
    store = Store(spark, next(x for x in ended.stdout.splitlines() if x.startswith("ROOT"))[5:])
    live = store.manifest()
    assert live.phases[-1] != "Columns" and "o_orderdate" not in store.table("orders").columns and "o_note" not in store.table("orders").columns
    left = len(store._listed("data"))
    from schemaloom.sources.frames import parquet_catalog

    report = publish(q.orders_plan(spark, parquet_catalog(spark, f"{store.root}/given", ("orders", "customer"))), store)
    assert {("DropColumns", "Done"), ("Columns", "Succeeded")} <= statuses(report) and sorted(store.table("orders").columns) == sorted(NEW)
    assert store.vacuum(keep=1, older_than=0) >= 1 and len(store._listed("data")) <= left + 1
