"""The library's queries for __spark_entry__.py, each with the SQL that DuckDB answers it by where SQL can.

The catalog under test is that of the tables themselves: the desired side is their schemas, the current side is the same relation changed
by fixed rules, so that every kind of difference occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_queries, extraction_queries, lifecycle_queries, table_queries  # noqa: F401  (they add their queries to those below)
from . import dialects as D
from .functions import normalize, types
from .functions.keys import position_key, routine_key
from .functions.render import default_literal
from .operators import checks, diff, policy, sequence, validators
from .operators.alter import classified
from .operators.apply import applied
from .plans.compare import compare
from .plans.options import ADDITIVE, FULL, REBUILD, CompareOptions
from .plans.script import ordered_lines
from .query_base import _table, oracle_sql, queries, query  # noqa: F401  (oracle_sql and queries are this module's too)
from .relations import Catalog, from_rows
from .sources.frames import parquet_catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMES = ", ".join(f"'{t}'" for t in TABLES)


def desired_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return parquet_catalog(spark, sf_dir, TABLES)


def current_catalog(desired: Catalog) -> Catalog:
    """desired without the columns in second place (later ones move up) and the tables whose name has the letter g; with doubles as DECIMAL(18,2), a column
    legacy_flag in tables whose name has an even length, and the first column of every table not null."""
    c = desired.columns.filter("position <> 1 and not contains(table_key, 'G')")
    double = F.col("field_type") == "ftExtended"
    c = c.withColumns({
        "type_name": F.when(double, "DECIMAL(%p,%s)").otherwise(F.col("type_name")), "precision": F.when(double, 18).otherwise(0), "scale": F.when(double, 2).otherwise(0),
        "field_type": F.when(double, "ftBCD").otherwise(F.col("field_type")), "not_null": F.col("position") == 0,
        "position": F.when(F.col("position") > 1, F.col("position") - 1).otherwise(F.col("position")),
    })
    tables = desired.tables.filter("not contains(table_key, 'G')")
    flags = tables.filter("length(table_name) % 2 = 0").select(
        "table_key", F.lit(99).alias("position"), F.lit("legacy_flag").alias("column_name"), F.lit("LEGACY_FLAG").alias("name_key"), F.lit("ftString").alias("field_type"), F.lit("VARCHAR(%l)").alias("type_name"),
        F.lit(1).alias("size"), F.lit(0).alias("precision"), F.lit(0).alias("scale"), F.lit(False).alias("not_null"), F.lit(False).alias("auto_increment"), F.lit("NoSort").alias("sorting_order"), F.lit("").alias("default_value"),
        F.lit(False).alias("is_primary_key"), F.lit("").alias("charset"), F.lit("").alias("description"),
    )
    return desired.replaced(tables=tables, columns=c.unionByName(flags))


# The same two catalogs in SQL.
_BOTH = f"""
with desired as (
    select table_name as t, column_name as c, ordinal_position - 1 as pos,
        case data_type when 'BIGINT' then 'BIGINT' when 'INTEGER' then 'INT' when 'DOUBLE' then 'DOUBLE' when 'VARCHAR' then 'STRING' when 'TIMESTAMP' then 'TIMESTAMP_NTZ' when 'FLOAT[]' then 'ARRAY<FLOAT>' end as ty, false as nn
    from information_schema.columns where table_name in ({_NAMES})
), current_side as (
    select t, c, case when pos > 1 then pos - 1 else pos end as pos, case ty when 'DOUBLE' then 'DECIMAL(18,2)' else ty end as ty, pos = 0 as nn from desired where pos <> 1 and not contains(t, 'g')
    union all select distinct t, 'legacy_flag', 99, 'VARCHAR(1)', false from desired where length(t) % 2 = 0 and not contains(t, 'g')
)"""
_DIFFS = f"""{_BOTH}, d as (
    select coalesce(m.t, o.t) as table_name, coalesce(m.c, o.c) as column_name,
        case when contains(coalesce(m.t, o.t), 'g') then null when m.c is null then 'DropColumn' when o.c is null then 'CreateColumn' when m.ty <> o.ty or m.nn <> o.nn then 'AlterColumn' end as op, m.ty as ty, m.pos as pos
    from desired m full join current_side o on m.t = o.t and m.c = o.c
)"""


@query("catalog_tables", f"select table_name, upper(table_name) as table_key, count(*)::bigint as n_columns from information_schema.columns where table_name in ({_NAMES}) group by 1, 2")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = desired_catalog(spark, sf_dir)
    return c.tables.join(c.columns, "table_key").groupBy("table_name", "table_key").agg(F.count("*").alias("n_columns"))


@query("catalog_columns", f"{_BOTH} select t as table_name, c as column_name, lpad(pos::varchar, 6, '0') as position_key, ty as type_name from desired")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = desired_catalog(spark, sf_dir)
    return c.columns.join(c.tables.select("table_key", "table_name"), "table_key").select("table_name", "column_name", position_key("position").alias("position_key"), "type_name")


_TYPED = {
    D.POSTGRESQL: {"BIGINT": "BIGINT", "INT": "INTEGER", "DOUBLE": "DOUBLE PRECISION", "STRING": "VARCHAR(%l)", "TIMESTAMP_NTZ": "TIMESTAMP", "ARRAY<FLOAT>": "BYTEA"},
    D.ORACLE: {"BIGINT": "NUMBER", "INT": "NUMBER", "DOUBLE": "BINARY_DOUBLE", "STRING": "VARCHAR2(%l)", "TIMESTAMP_NTZ": "DATE", "ARRAY<FLOAT>": "BLOB"},
    D.MSSQL: {"BIGINT": "NUMERIC(%l)", "INT": "INT", "DOUBLE": "FLOAT", "STRING": "VARCHAR(%l)", "TIMESTAMP_NTZ": "TIMESTAMP", "ARRAY<FLOAT>": "VARBINARY(MAX)"},
}
_CASES = " ".join(f"when '{d}|{k}' then '{v}'" for d, own in _TYPED.items() for k, v in own.items())


@query("type_templates", f"{_BOTH} select t as table_name, c as column_name, d as dialect, case d || '|' || ty {_CASES} end as template from desired cross join (values {', '.join(f'({d!r})' for d in _TYPED)}) as x(d)")
def type_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = desired_catalog(spark, sf_dir)
    rows = c.columns.join(c.tables.select("table_key", "table_name"), "table_key")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dialect"), types.type_template(F.col("field_type"), d).alias("template")) for d in _TYPED])).alias("x")
    return rows.select("table_name", "column_name", each).select("table_name", "column_name", "x.dialect", "x.template")


def _changes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    desired = desired_catalog(spark, sf_dir)
    return diff.changes(desired, current_catalog(desired), CompareOptions(**options))


@query("diff_columns_full_outer", f"{_DIFFS} select table_name, column_name, op from d where op is not null")
def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda n: F.coalesce(F.col("m")[n], F.col("t")[n])
    rows = _changes(spark, sf_dir).filter("kind = 'column'")
    return rows.select(side("table_name").alias("table_name"), side("name").alias("column_name"), F.explode("ops").alias("op"))


@query("diff_tables", f"{_BOTH} select m.t as table_name, 'CreateTable' as op, count(*)::bigint as n_columns from desired m where m.t not in (select t from current_side) group by 1")
def diff_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tables, with the number of columns that their statement has."""
    rows = _changes(spark, sf_dir).filter("kind = 'table'")
    return rows.select(F.col("m")["name"].alias("table_name"), F.col("ops")[0].alias("op"), (F.size(F.split("sql", ",\n")).cast("long")).alias("n_columns"))


@query("diff_positions", f"{_BOTH} select m.t as table_name, m.c as column_name, m.pos::int as desired_position, o.pos::int as current_position from desired m join current_side o on m.t = o.t and m.c = o.c where m.pos <> o.pos")
def diff_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir, dialect=D.FIREBIRD, compare_positions=True).filter(F.array_contains("ops", "AlterColumnPosition") & F.col("t").isNotNull())
    m, t = F.col("m"), F.col("t")
    place = lambda side: side["attrs"]["position"].cast("int")
    return rows.filter(place(m) != place(t)).select(m["table_name"].alias("table_name"), m["name"].alias("column_name"), place(m).alias("desired_position"), place(t).alias("current_position"))


@query("policy_audit", f"{_DIFFS} select case op when 'DropColumn' then 'DROP COLUMN ' else 'ALTER COLUMN ' end || table_name || '.' || column_name || ' suppressed by policy' as audit from d where op in ('DropColumn', 'AlterColumn')")
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gated(_changes(spark, sf_dir), ADDITIVE)[1].select("audit")


@query("policy_gate", f"{_DIFFS} select op, count(*)::bigint as n from d where op = 'CreateColumn' group by 1 union all select 'CreateTable', count(distinct t)::bigint from desired where contains(t, 'g')")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.gated(_changes(spark, sf_dir), ADDITIVE)[0]
    return kept.select(F.explode("ops").alias("op")).groupBy("op").agg(F.count("*").alias("n"))


@query(
    "alter_classification",
    f"""{_BOTH} select m.t as table_name, m.c as column_name, 'InPlace' as action
    from desired m join current_side o on m.t = o.t and m.c = o.c where m.ty <> o.ty or m.nn <> o.nn""",
)
def alter_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers stay numbers and nothing becomes stricter, so all of these changes are safe in place."""
    rows = _changes(spark, sf_dir, dialect=D.POSTGRESQL).filter(F.array_contains("ops", "AlterColumn"))
    m, t = F.col("m"), F.col("t")
    return rows.select(m["table_name"].alias("table_name"), m["name"].alias("column_name"), classified(m["attrs"], t["attrs"], D.POSTGRESQL).alias("action"))


@query(
    "alter_expansion",
    f"""{_BOTH} select o.t as table_name, o.c as column_name, step, label from desired m join current_side o on m.t = o.t and m.c = o.c and m.ty <> o.ty,
    (values (0, 'CreateColumnRebuild'), (1, 'CopyColumnData'), (2, 'DropColumnRebuild'), (3, 'RenameColumn')) as s(step, label)""",
)
def alter_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firebird rebuilds whatever changes its type."""
    from .operators.alter import expanded

    options = CompareOptions(D.FIREBIRD, strategy=REBUILD)
    desired = desired_catalog(spark, sf_dir)
    rows = expanded(policy.gated(diff.changes(desired, current_catalog(desired), options), FULL)[0], options)[0]
    m = F.col("m")
    steps = rows.filter(F.size("ops") == 4).select(m["table_name"].alias("table_name"), m["name"].alias("column_name"), F.posexplode("ops").alias("step", "label"))
    return steps


@query(
    "plan_commands",
    f"""{_DIFFS} select case op when 'DropColumn' then 'DropColumns' else 'Columns' end as phase, op, case op when 'DropColumn' then 'Drop Column: ' when 'CreateColumn' then 'Create Column: ' else 'Alter Column: ' end || column_name as label,
    'ALTER TABLE ' || table_name || case op when 'DropColumn' then ' DROP COLUMN ' || column_name when 'CreateColumn' then ' ADD ' || column_name || ' ' || ty else ' ALTER COLUMN ' || column_name || ' ' || ty end || ';' as sql from d where op is not null
    union all select 'CreateTables', 'CreateTable', 'Create Table: ' || t, 'CREATE TABLE ' || t || ' (' || chr(10) || '  ' || string_agg(c || ' ' || ty, ',' || chr(10) || '  ' order by pos) || chr(10) || ');' from desired where contains(t, 'g') group by t""",
)
def plan_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, from schemas to statements."""
    desired = desired_catalog(spark, sf_dir)
    plan = compare(desired, current_catalog(desired), CompareOptions(D.SPARK))
    return plan.commands.filter("sql <> ''").orderBy(*plan.ORDER).select("phase", "op", "label", "sql")


@query(
    "plan_order",
    f"""{_DIFFS}, c as (select case op when 'DropColumn' then 'DropColumns' else 'Columns' end as phase, table_name, column_name as name, case op when 'DropColumn' then '' else lpad(pos::varchar, 6, '0') end as item from d where op is not null
    union all select distinct 'CreateTables', t, t, '' from desired where contains(t, 'g'))
    select phase, name, table_name, row_number() over (partition by phase order by upper(table_name), item, upper(name))::int as place from c""",
)
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of commands inside of each phase."""
    desired = desired_catalog(spark, sf_dir)
    plan = compare(desired, current_catalog(desired), CompareOptions(D.SPARK))
    place = F.row_number().over(Window.partitionBy("phase").orderBy("table_rank", "place"))
    return plan.commands.filter("sql <> ''").select("phase", "name", "table_name", place.alias("place"))


@query("phase_plan", f"{_DIFFS} select case op when 'DropColumn' then 'DropColumns' else 'Columns' end as phase, count(*)::bigint as count from d where op is not null group by 1 union all select 'CreateTables', count(distinct t)::bigint from desired where contains(t, 'g') union all values ('Pre', 2), ('Post', 2)")
def phase_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = desired_catalog(spark, sf_dir)
    return compare(desired, current_catalog(desired), CompareOptions(D.POSTGRESQL)).phase_counts()


_MYSQL = "case op when 'DropColumn' then ' DROP COLUMN ' || column_name when 'CreateColumn' then ' ADD ' || column_name || ' ' || ty else ' MODIFY COLUMN ' || column_name || ' ' || ty end"


@query(
    "script_lines",
    f"""{_DIFFS}, commands as (
        select case op when 'DropColumn' then 'DropColumns' else 'Columns' end as phase, case op when 'DropColumn' then 'Drop Column: ' when 'CreateColumn' then 'Create Column: ' else 'Alter Column: ' end || column_name as label, 'ALTER TABLE ' || table_name || {_MYSQL} || ';' as sql from d where op is not null
        union all select 'CreateTables', 'Create Table: ' || t, 'CREATE TABLE ' || t || ' (' || chr(10) || '  ' || string_agg(c || ' ' || ty, ',' || chr(10) || '  ' order by pos) || chr(10) || ');' from desired where contains(t, 'g') group by t
        union all values ('Pre', 'Enable ForeignKeys: Off', 'SET FOREIGN_KEY_CHECKS = 0;'), ('Post', 'Enable ForeignKeys: On', 'SET FOREIGN_KEY_CHECKS = 1;')
    ) select '-- ' || label as line from commands union all select sql from commands union all select distinct chr(10) || '-- ---------- PHASE: ' || phase || ' ----------' from commands""",
)
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = desired_catalog(spark, sf_dir)
    return ordered_lines(compare(desired, current_catalog(desired), CompareOptions(D.MYSQL)))


_EDGES = (("nation", "region", "n_regionkey", "r_regionkey"), ("customer", "nation", "c_nationkey", "n_nationkey"), ("supplier", "nation", "s_nationkey", "n_nationkey"), ("orders", "customer", "o_custkey", "c_custkey"), ("lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem", "part", "l_partkey", "p_partkey"), ("lineitem", "supplier", "l_suppkey", "s_suppkey"))
_KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))


def keyed_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """desired_catalog with the primary and foreign keys of its star schema."""
    base = desired_catalog(spark, sf_dir)
    extra = from_rows(
        spark, primary_keys=[{"table": t, "pk_name": f"PK_{t}"} for t, _ in _KEYS], foreign_keys=[{"table": c, "name": f"FK_{c}_{p}", "parent_table": p, "on_delete": "Cascade"} for c, p, _, _ in _EDGES],
        key_columns=[{"table": t, "key_kind": "pk", "object_key": "", "column_name": c} for t, c in _KEYS]
        + [{"table": c, "key_kind": k, "object": f"FK_{c}_{p}", "column_name": x} for c, p, own, other in _EDGES for k, x in (("fk_from", own), ("fk_to", other))],
    )
    return base.replaced(**extra.frames)


_EDGE_ROWS = f"(values {', '.join(map(str, _EDGES))}) as e(child, parent, own, other)"


@query(
    "fk_topology",
    f"""with recursive names as (select distinct upper(table_name) as t from information_schema.columns where table_name in ({_NAMES})), edges as (select upper(child) as c, upper(parent) as p from {_EDGE_ROWS}),
    steps(place, done) as (select 0, []::varchar[] union all select place + 1, list_append(done, (
        select min(t) from names where not list_contains(done, t) and not exists (select 1 from edges where c = t and not list_contains(done, p))
    )) from steps where place < (select count(*) from names))
    select (place - 1)::int as place, done[-1] as table_key from steps where place > 0""",
)
def fk_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which new tables are made: parents first, and by name where there is a choice."""
    plan = compare(keyed_catalog(spark, sf_dir), Catalog(spark), CompareOptions(D.POSTGRESQL))
    return plan.commands.filter("op = 'CreateTable'").select(F.col("table_rank").alias("place"), "table_key")


@query("diff_foreign_keys", f"select child as table_name, 'ALTER TABLE ' || child || ' ADD CONSTRAINT FK_' || child || '_' || parent || ' FOREIGN KEY (' || own || ') REFERENCES ' || parent || '(' || other || ') ON DELETE CASCADE;' as sql from {_EDGE_ROWS}")
def diff_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compare(keyed_catalog(spark, sf_dir), desired_catalog(spark, sf_dir), CompareOptions(D.POSTGRESQL))
    return plan.commands.filter("op = 'CreateForeignKey'").select("table_name", "sql")


@query("diff_keys_pk", f"select t as table_name, 'ALTER TABLE ' || t || ' ADD CONSTRAINT PK_' || t || ' PRIMARY KEY (' || c || ');' as sql from (values {', '.join(map(str, _KEYS))}) as k(t, c)")
def diff_keys_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = compare(keyed_catalog(spark, sf_dir), desired_catalog(spark, sf_dir), CompareOptions(D.POSTGRESQL))
    return plan.commands.filter("op = 'CreatePrimaryKey'").select("table_name", "sql")


@query(
    "fk_cycles",
    """with recursive keys as (select s_suppkey as k, count(*) over () as n from supplier), edges as (
        select 'S' || k as child, 'S' || (k * k + 3) % n as parent from keys union select 'S' || k, 'S' || (k * 7) % n from keys where k % 5 = 0
    ), own as (select * from edges where child <> parent), reach as (select child as a, parent as b from own union select r.a, e.parent from reach r join own e on e.child = r.b)
    select x.a as name, min(x.b) as cycle from reach x join reach y on y.a = x.b and y.b = x.a group by 1""",
)
def fk_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables named by suppliers, with references by a rule that runs into cycles."""
    keys = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k")
    n = keys.count()
    edges = keys.selectExpr("concat('S', k) as child", f"concat('S', (k * k + 3) % {n}) as parent").union(keys.filter("k % 5 = 0").selectExpr("concat('S', k)", f"concat('S', k * 7 % {n})"))
    return sequence.cycles(edges)


# canonical texts, over the tables' own text columns


@query("normalize_scripts", r"select event_id, trim(regexp_replace(event_type || '  ' || chr(9) || coalesce(props, ''), '[ \t\n\r\f]+', ' ', 'g'), ' ') as script from events")
def normalize_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select("event_id", normalize.script(F.concat("event_type", F.lit("  \t"), F.coalesce("props", F.lit("")))).alias("script"))


@query("normalize_checks", "select o_orderkey, 'o_totalprice > ' || o_custkey::varchar as condition from orders")
def normalize_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in one to three layers of parentheses."""
    rows = _table(spark, sf_dir, "orders")
    plain = F.concat(F.lit("o_totalprice > "), F.col("o_custkey").cast("string"))
    layers = (F.col("o_orderkey") % 3 + 1).cast("int")
    text = F.concat(F.lit("CHECK "), F.repeat(F.lit("( "), layers), plain, F.repeat(F.lit(")"), layers))
    return rows.select("o_orderkey", normalize.check_condition(text).alias("condition"))


@query("normalize_views", "select item_id, 'SELECT ' || item_id::varchar as body from benchmark")
def normalize_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark")
    text = F.concat(F.lit("CREATE VIEW [dbo].[V"), F.col("item_id").cast("string"), F.lit("]\nAS SELECT "), F.col("item_id").cast("string"))
    return rows.select("item_id", normalize.view_body(text).alias("body"))


@query("quoted_defaults", "select c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' as literal from customer")
def quoted_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("field_type"), F.lit("ftString"), F.lit("default_value"), F.concat("c_name", F.lit("'s")))
    return _table(spark, sf_dir, "customer").select("c_custkey", default_literal(attrs).alias("literal"))


@query("routine_keys", "select s_suppkey, upper(s_name) || case when s_suppkey % 2 = 0 then '(INT)' else '' end as object_key from supplier")
def routine_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.when(F.col("s_suppkey") % 2 == 0, "int").otherwise(" ")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", routine_key(F.col("s_name"), signature).alias("object_key"))


# what constraints mean on rows


@query("assert_fk_orphans", "select l.l_orderkey, l.l_linenumber from lineitem l where l.l_orderkey is not null and not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus <> 'F')")
def assert_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return checks.orphans(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], parent, ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("assert_pk_unique", "select o_custkey, o_orderpriority, count(*)::bigint as copies from orders group by 1, 2 having count(*) > 1")
def assert_pk_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@query("assert_pk_violations", "select k as user_id, event_type, count(*)::bigint as copies, case when k is null or event_type is null then 'null' else 'duplicate' end as problem from (select case when event_id % 9 <> 0 then user_id end as k, event_type from events) group by 1, 2 having count(*) > 1 or k is null or event_type is null")
def assert_pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a ninth of the events the user is taken away, so that keys with nulls occur."""
    events = _table(spark, sf_dir, "events").selectExpr("case when event_id % 9 <> 0 then user_id end as user_id", "event_type")
    return checks.key_violations(events, ["user_id", "event_type"])


@query("assert_not_null", "select o_orderkey from orders where o_orderkey % 13 = 0 or o_orderpriority = '5-LOW'")
def assert_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers and all low priorities are taken away, so that nulls occur."""
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 13 <> 0 then o_custkey end as o_custkey", "nullif(o_orderpriority, '5-LOW') as o_orderpriority")
    return checks.null_rows(orders, ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query("assert_check", "select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity <= 45 and l_discount < 0.09)")
def assert_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_violations(_table(spark, sf_dir, "lineitem"), "l_quantity <= 45 and l_discount < 0.09").select("l_orderkey", "l_linenumber", "l_quantity")


@query("assert_many_checks", "select 'positive' as name, count(*) filter (not (c_acctbal > 0))::bigint as violations, count(*)::bigint as checked from customer union all select 'named', count(*) filter (not (c_name like '%1%'))::bigint, count(*)::bigint from customer")
def assert_many_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.violation_counts(_table(spark, sf_dir, "customer"), {"positive": "c_acctbal > 0", "named": "c_name like '%1%'"})


@query("assert_lossy_cast", "select p_partkey from part where p_retailprice is not null and p_retailprice <> round(p_retailprice)")
def assert_lossy_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.lossy_casts(_table(spark, sf_dir, "part"), "p_retailprice", "int").select("p_partkey")


@query("copy_cast", "select l_orderkey, l_linenumber, l_quantity::decimal(18,2) as l_quantity from lineitem")
def copy_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild of one column, on rows: new column, copy with a cast, drop, rename."""
    attrs = {"type_name": "DECIMAL(%p,%s)", "precision": "18", "scale": "2"}
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return applied(rows, [{"op": op, "name": "l_quantity", "attrs": attrs} for op in ("CreateColumnRebuild", "CopyColumnData", "DropColumnRebuild", "RenameColumn")])


@query("backfill", "select doc_id, coalesce(lang, 'und') as lang from documents")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = {"type_name": "VARCHAR(%l)", "default_value": "'und'", "size": "0"}
    return applied(_table(spark, sf_dir, "documents").select("doc_id", "lang"), [{"op": "BackfillColumnData", "name": "lang", "attrs": attrs}])


@query("apply_columns", "select o_orderkey, null::varchar as note, 7::int as grade, upper(o_orderstatus) = 'F' as done from orders")
def apply_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.upper("o_orderstatus") == "F").alias("done"))
    steps = [{"op": "CreateColumn", "name": "note", "attrs": {"type_name": "VARCHAR(%l)"}}, {"op": "CreateColumn", "name": "grade", "attrs": {"type_name": "INTEGER", "default_value": "7"}}, {"op": "DropColumn", "name": "O_CUSTKEY"}]
    return applied(rows, steps)


@query("validators", "select c_custkey, c_acctbal >= 0 as ok_minimum, c_acctbal <= 9000 as ok_maximum, length(c_mktsegment) between 8 and 9 as ok_size, coalesce(c_name, '') <> '' as ok_named from customer")
def validators_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda *x: validators.Rule(*x).holds()
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", rule("c_acctbal", "minimum", 0).alias("ok_minimum"), rule("c_acctbal", "maximum", None, 9000).alias("ok_maximum"), rule("c_mktsegment", "size", 8, 9).alias("ok_size"), rule("c_name", "not_null").alias("ok_named"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_commands(spark, sf_dir)
