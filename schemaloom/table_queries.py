"""Queries over plans carried out on Spark tables, over large catalogs compared by digests, and over catalogs of several schemas, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialects as D
from .catalog_queries import _ITEMS, _frame, catalogs
from .operators import diff
from .operators.digest import changed
from .operators.objects import objects
from .plans.compare import Plan, compare
from .plans.execute import ConnectionTarget, execute
from .plans.journal import Journal, command_id, digest
from .plans.options import REBUILD, CompareOptions
from .plans.publish import Store, publish
from .query_base import _table, query
from .relations import Catalog, from_rows, local_frame, shared_folder
from .sources import declared as m
from .sources.frames import parquet_catalog
from .sources.sqlite import sqlite_catalog

# publishing


def _column(name: str, type_name: str, position: int, **more) -> dict:
    return {"table": "orders", "column_name": name, "type_name": type_name, "position": position, **more}


def orders_store(spark: SparkSession, sf_dir: str) -> tuple[Store, Catalog]:
    """A store of orders, where the lowest priority is null, and customer; and its catalog."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    given = f"{store.root}/given"
    _table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).write.parquet(f"{given}/orders.parquet")
    _table(spark, sf_dir, "customer").write.parquet(f"{given}/customer.parquet")
    store.adopted(orders=f"{given}/orders.parquet", customer=f"{given}/customer.parquet")
    return store, parquet_catalog(spark, given, ("orders", "customer"))


def orders_plan(spark: SparkSession, current: Catalog, condition: str = "o_totalprice > 0", **options) -> Plan:
    """orders without o_orderdate, with whole cents, without null priorities, with a note; a new table; keys, a reference and a check."""
    kept = current.columns.filter("name_key not in ('O_ORDERDATE', 'O_TOTALPRICE', 'O_ORDERPRIORITY')")
    extra = from_rows(
        spark, tables=[{"table_name": "order_notes"}],
        columns=[
            _column("o_totalprice", "DECIMAL(%p,%s)", 3, field_type="ftBCD", precision=18, scale=2), _column("o_orderpriority", "STRING", 5, field_type="ftString", not_null=True, default_value="none"),
            _column("o_note", "STRING", 6, field_type="ftString", default_value="n/a"), {**_column("note_id", "BIGINT", 0, field_type="ftLargeint"), "table": "order_notes"},
        ],
        primary_keys=[{"table": "orders", "pk_name": "PK_ORDERS"}, {"table": "customer", "pk_name": "PK_CUSTOMER"}], foreign_keys=[{"table": "orders", "name": "FK_CUSTOMER", "parent_table": "customer"}],
        checks=[{"table": "orders", "name": "CK_PRICE", "condition": condition}],
        key_columns=[{"table": t, "key_kind": "pk", "object_key": "", "column_name": c} for t, c in (("orders", "o_orderkey"), ("customer", "c_custkey"))]
        + [{"table": "orders", "key_kind": k, "object": "FK_CUSTOMER", "column_name": c} for k, c in (("fk_from", "o_custkey"), ("fk_to", "c_custkey"))],
    )
    desired = current.replaced(**{**extra.frames, "tables": current.tables.unionByName(extra.tables), "columns": kept.unionByName(extra.columns)})
    return compare(desired, current, CompareOptions(D.SPARK, strategy=REBUILD, **options))


@query("published_orders", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice::decimal(18,2) as o_totalprice, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') as o_orderpriority, 'n/a' as o_note, 0::bigint as notes from orders")
def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of a store see after a plan was carried out on it phase by phase."""
    store, current = orders_store(spark, sf_dir)
    publish(orders_plan(spark, current), store)
    return store.table("orders").crossJoin(store.table("order_notes").agg(F.count("*").alias("notes")))  # one row


@query("published_in_part", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice::decimal(18,2) as o_totalprice, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') as o_orderpriority, 'n/a' as o_note from orders")
def published_in_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows break a check: its phase is undone, those before it stay."""
    store, current = orders_store(spark, sf_dir)
    publish(orders_plan(spark, current, "o_totalprice < 2000", raise_on_error=False), store)
    return store.table("orders")


@query("published_whole_or_not", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders")
def published_whole_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan as a whole: readers keep what they had."""
    store, current = orders_store(spark, sf_dir)
    publish(orders_plan(spark, current, "o_totalprice < 2000", raise_on_error=False), store, whole=True)
    return store.table("orders")


# digests


#: About as many lines are dealt to a task, whatever the number of lines.
PIECE = 1 << 19


def order_catalogs(spark: SparkSession, sf_dir: str) -> tuple[Catalog, Catalog]:
    """A table for each order and a column for each of its lines; on the current side every 97th order has other sizes, every 101st is missing and every 103rd has a line less.

    Lines are dealt by their order, in pieces, so that the memory of a task does not grow with the table, and the sums of an order are combined where its lines are.
    """
    given = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    lines = given.repartition(-(-given.count() // PIECE) or 1, "o").groupBy("o", "k").agg(F.max("q").cast("int").alias("q"))

    def side(rows: DataFrame, size: str) -> Catalog:
        tables = rows.select("o").distinct()
        columns = _frame(rows, "columns", table_key="concat('T', o)", position="k", column_name="concat('c', k)", name_key="concat('C', k)", field_type="'ftString'", type_name="'VARCHAR(%l)'", size=size, sorting_order="'NoSort'")
        return Catalog(spark, frames={"tables": _frame(tables, "tables", table_key="concat('T', o)", table_name="concat('T', o)"), "columns": columns})

    return side(lines, "q"), side(lines.filter("o % 101 <> 0 and (o % 103 <> 0 or k > 1)"), "if(o % 97 = 0, q + 1, q)")


_LINES = "select distinct l_orderkey as o, l_linenumber as k, l_orderkey % 97 = 0 as other, l_orderkey % 101 = 0 as missing, l_orderkey % 103 = 0 and l_linenumber = 1 as less from lineitem"


@query("digest_tables", f"select distinct 'T' || o as table_key from ({_LINES}) where other or missing or less")
def digest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that differ, found without a join."""
    return changed(*order_catalogs(spark, sf_dir)).selectExpr("own as table_key")


@query(
    "digest_differences",
    f"""with l as ({_LINES}), gone as (select o from l group by 1 having bool_and(missing or less)) select 'CreateTable' as op, 'T' || o as table_name, 'T' || o as name from gone
    union all select case when less then 'CreateColumn' else 'AlterColumn' end, 'T' || o, 'c' || k from l where (less or other) and o not in (select o from gone)""",
)
def digest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of two catalogs of which only tables that differ were joined."""
    rows = diff.differences(diff.compared(*order_catalogs(spark, sf_dir), narrow=True), CompareOptions(D.POSTGRESQL))
    m, t = F.col("m"), F.col("t")
    return rows.select(F.explode("ops").alias("op"), F.coalesce(m["table_name"], t["table_name"]).alias("table_name"), F.coalesce(m["name"], t["name"]).alias("name"))


# schemas


def schema_catalogs(spark: SparkSession, sf_dir: str) -> tuple[Catalog, Catalog]:
    """Tables T0 to T6 in each of the schemas app, dwh and new.s, which is called raw on the current side; a column for each part, a view for every 9th, and references from app to dwh. Sizes and
    references differ by fixed rules, and so do equal names in different schemas."""
    parts = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as n").selectExpr("n", "n % 3 as s", "concat('T', n % 7) as t")

    def side(new: bool) -> Catalog:
        third = "new.s" if new else "raw"
        rows = parts.withColumn("sc", F.expr(f"case s when 0 then 'app' when 1 then 'dwh' else '{third}' end"))
        prefix = f"case s when 0 then 'APP.' when 1 then 'DWH.' else '{chr(34) + 'NEW.S' + chr(34) if new else 'RAW'}.' end"
        own = rows.select("s", "sc", "t").distinct()
        size = "n % 40 + 1" if new else "n % 40 + if(n % 5 = 0 and s <> 1, 2, 1)"
        columns = _frame(rows.filter("n % 9 > 0"), "columns", table_key=f"concat({prefix}, t)", position="n", column_name="concat('c', n)", name_key="concat('C', n)", field_type="'ftString'", type_name="'VARCHAR(%l)'", size=size, sorting_order="'NoSort'")
        refers = rows.filter("n % 9 = 1 and s = 0")
        foreign = _frame(refers, "foreign_keys", table_key="concat('APP.', t)", object_key="concat('FK', n)", name="concat('fk', n)", parent_table="'T0'", parent_key="'DWH.T0'" if new else "if(n % 2 = 0, 'APP.T0', 'DWH.T0')", on_update="'None'", on_delete="'None'")
        member = lambda kind, name: _frame(refers, "key_columns", table_key="concat('APP.', t)", key_kind=f"'{kind}'", object_key="concat('FK', n)", column_name=name, name_key=f"upper({name})", sorting_order="'NoSort'")
        views = rows.filter("n % 9 = 0").selectExpr("concat(" + prefix + ", 'V', n) as object_key", "sc as schema_name", "concat('V', n) as name", f"concat('SELECT ', n{'' if new else ', if(n % 2 = 0, chr(32) || chr(43) || chr(32) || chr(49), chr(32))'}) as script", "'' as description")
        return Catalog(spark, frames={
            "tables": own.selectExpr("sc as schema_name", f"concat({prefix}, t) as table_key", "t as table_name", "'' as description"), "columns": columns, "views": views,
            "foreign_keys": foreign.withColumn("parent_schema", F.lit("dwh") if new else F.when(F.col("parent_key") == "APP.T0", "app").otherwise("dwh")), "key_columns": member("fk_from", "concat('c', n)").union(member("fk_to", "'id'")),
        }, qualified=True)

    return side(True), side(False)


@query(
    "schema_statements",
    """with p as (select p_partkey as n, case p_partkey % 3 when 0 then 'app' when 1 then 'dwh' else 'raw' end as sc, 'T' || p_partkey % 7 as t from part)
    select 'AlterColumn' as op, '"' || sc || '"."' || t || '"' as own, 'c' || n as name from p where n % 9 > 0 and n % 5 = 0 and sc <> 'dwh'
    union all select op, '"app"."' || t || '"', 'fk' || n from p cross join (values ('DropForeignKey'), ('CreateForeignKey')) as x(op) where n % 9 = 1 and n % 3 = 0 and n % 2 = 0
    union all select op, '', 'V' || n from p cross join (values ('DropView'), ('CreateView')) as x(op) where n % 9 = 0 and n % 2 = 0""",
)
def schema_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements between two catalogs of three schemas, one of which goes by another name, with the schema that they name."""
    plan = compare(*schema_catalogs(spark, sf_dir), CompareOptions(D.POSTGRESQL, schemas=(("new.s", "raw"),)))
    return plan.commands.filter("sql <> '' and op not like 'Enable%'").select("op", F.regexp_extract("sql", r'^ALTER TABLE ("[^"]*"\."[^"]*")', 1).alias("own"), "name")


# execution on a database, and what it has done


def plain_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables, columns, keys, indexes, references, checks and views of the pair's desired side: what SQLite can hold."""
    whole = catalogs(spark, sf_dir)[0]
    kept = ("tables", "columns", "primary_keys", "key_columns", "indexes", "foreign_keys", "checks", "views")
    return Catalog(spark, "", "", {n: f for n, f in whole.frames.items() if n in kept})


@query(
    "executed_on_sqlite",
    f"""{_ITEMS} select 'table' as kind, t as table_key, '' as object_key, '' as detail from tabs where j <> 3
    union all select 'column', t, 'ID', 'INTEGER|0|0|0|true' from tabs where j <> 3 union all select 'column', t, 'NOTE', 'VARCHAR(%l)|100|0|0|false' from tabs where j <> 3
    union all select 'column', t, name, case when c in (1, 4) then 'VARCHAR(%l)|40|0|0' when c = 2 then 'FLOAT(%p,%s)|0|12|2' when c = 3 then 'DATE|0|0|0' else 'INTEGER|0|0|0' end || case when nn <> '' then '|true' else '|false' end from cols where s <> 1 and j <> 3
    union all select 'primary_key', t, '', 'ID' from tabs where j <> 3 and j % 2 = 0
    union all select 'index', t, 'IX' || n, case when n % 2 = 0 then 'true' else 'false' end || '|ID' || case when n % 3 = 0 then ', Note' else '' end from items where k = 3 and s <> 1 and j <> 3
    union all select 'view', '', 'V' || n, '' from items where k = 7 and s <> 1""",
)
def executed_on_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan carried out on an SQLite file, and the file's catalog read back."""
    plan = compare(plain_catalog(spark, sf_dir), Catalog(spark), CompareOptions(D.SQLITE))
    with tempfile.TemporaryDirectory() as folder:  # of the driver, which is the only one to use it
        connection = sqlite3.connect(f"{folder}/made.db", isolation_level=None)
        execute(plan, ConnectionTarget(connection))
        connection.close()
        found = sqlite_catalog(spark, f"{folder}/made.db")
    details = {"column": ("type_name", "size", "precision", "scale", "not_null"), "primary_key": ("columns",), "index": ("is_unique", "columns")}
    detail = " ".join(f"when '{kind}' then concat_ws('|', {', '.join(f'attrs[{c!r}]' for c in columns)})" for kind, columns in details.items())
    rows = objects(found).filter("kind <> 'foreign_key'")  # SQLite keeps no names of references
    return rows.selectExpr("kind", "table_key", "object_key", f"case kind {detail} else '' end as detail")


@query(
    "journal_of_two_runs",
    f"""{_ITEMS}
    select 'CreateTables' as phase, t as name, 1 as run from tabs where j <> 3 union all select 'Views', 'V' || n, 2 from items where k = 7 and s <> 1""",
)
def journal_of_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that a view stops, whose name is taken; a second one that leaves out what the journal has; and in which of the runs every command was done. The phase of the views was
    one transaction, so the first run has none of them."""
    whole = plain_catalog(spark, sf_dir)
    last = whole.views.agg(F.max("name")).first()[0]
    plan = compare(whole, Catalog(spark), CompareOptions(D.SQLITE, raise_on_error=False))
    with tempfile.TemporaryDirectory() as folder:
        connection = sqlite3.connect(f"{folder}/made.db", isolation_level=None)
        connection.execute(f"create table {last} (a)")
        journal, known = Journal(connection), digest(plan)
        execute(plan, ConnectionTarget(connection), journal=journal)
        done = [set(journal.done(known))]
        connection.execute(f"drop table {last}")
        execute(plan, ConnectionTarget(connection), journal=journal)
        done.append(set(journal.done(known)) - done[0])
        connection.close()
    ledger = local_frame(spark, [(x, run + 1) for run, own in enumerate(done) for x in own], "command_id string, run int")
    return plan.commands.withColumn("command_id", command_id()).join(ledger, "command_id").select("phase", "name", "run")


# associations


@m.table("customer")
class _Customer:
    key = m.column("c_custkey", "ftLargeint")
    orders = m.association("OneToMany", "c_custkey", "orders", "o_custkey")
    largest = m.association("OneToOne", "c_nationkey", "nation", "n_nationkey")


@m.table("orders")
class _Orders:
    key = m.column("o_orderkey", "ftLargeint")
    line = m.association("OneToOne", "o_orderkey", "lineitem", "l_orderkey")
    customer = m.association("ManyToOne", "o_custkey", "customer", "c_custkey")


@m.table("lineitem")
class _Lines:
    key = m.column("l_orderkey", "ftLargeint")
    order = m.association("ManyToOne", "l_orderkey; l_linenumber", "orders", "o_orderkey; o_one")
    part = m.association("ManyToMany", "l_partkey", "orders", "o_orderkey")


@query(
    "association_violations",
    """select 'orders.line' as association, '["' || o_orderkey || '"]' as key, 1::bigint as own_rows, n as other_rows from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where n > 1
    union all select 'customer.largest', '["' || c_nationkey || '"]', count(*), 1::bigint from customer group by c_nationkey having count(*) > 1""",
)
def association_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have more partners than the associations of three models allow."""
    tables = {t: _table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation")}
    tables["orders"] = tables["orders"].withColumn("o_one", F.lit(1))
    return m.association_violations([m.read_model(c) for c in (_Customer, _Orders, _Lines)], tables)
