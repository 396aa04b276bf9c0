"""Queries over models, snapshots, scripts and execution, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialects as D
from .catalog_queries import _ITEMS, _plan, catalogs, ddl_sql
from .extraction_queries import DETAILS
from .operators import introspect
from .operators.objects import objects
from .operators.sequence import PHASES
from .operators.validators import Rule
from .plans.execute import execute_in_task
from .plans.options import CONTINUE, STOP
from .plans.script import dry_run
from .query_base import _table, query
from .relations import Catalog, shared_folder, written
from .sources import declared as m
from .sources import snapshot

_DETAIL = "case kind " + " ".join(f"when '{kind}' then concat_ws('|', {', '.join(f'attrs[{c!r}]' for c in columns)})" for kind, columns in DETAILS.items()) + " end as detail"


# models


def _models(spark: SparkSession, sf_dir: str) -> m.Registry:
    """A class for each nation."""
    registry = m.Registry()
    for k in sorted(r.k for r in _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) as k").collect()):
        body = {
            "id": m.column("Id", "ftInteger", not_null=True),
            "name": m.column("Name", "ftString", 10 + k, not_null=k % 2 == 0, default=f"N{k}" if k % 3 == 0 else "", description=f"name {k}"),
            "price": m.column("Price", "ftBCD", 99, 10 + k % 5, k % 4),
            "code": m.column("Code", "ftGuid", 0),
            "state": m.enumeration("State", "ftString", ["A", "B"], ["open", "done"]),
            "twice": m.calculated("Twice", "Price * 2"),
            "region": m.join_column("Id", "regions", "r", "region"),
        }
        cls = type(f"Model{k}", (), body)
        if k % 5 == 4:
            registry.register(m.view(f"View{k}")(cls))
            continue
        marks = [m.table(f"Model{k}", f"model {k}"), m.primary_key("Id" if k % 2 else "Id; Code", auto_increment=k % 4 == 1), m.index(f"IX{k}", "Name,Id", unique=k % 2 == 0), m.check(f"CK{k}", f"Price > {k}"), m.sequence(f"SQ{k}", k, k % 3 + 1), m.foreign_key("", "Id", "Model0", "Id", on_delete=snapshot.RULES[k % 4])]
        for mark in marks:
            cls = mark(cls)
        registry.register(cls)
    return registry


_OWN = "with k as (select n_nationkey as k, 'Model' || n_nationkey as t from nation where n_nationkey % 5 <> 4)"


@query(
    "model_objects",
    f"""{_OWN}, b as (select *, case when k % 4 = 1 then 'true' else 'false' end as up from k)
    select 'table' as kind, upper(t) as table_key, '' as object_key, t as name, 'model ' || k as detail from b
    union all select 'column', upper(t), 'ID', 'Id', '0|ftInteger|INTEGER|0|0|0|true|' || up || '|||' from b
    union all select 'column', upper(t), 'NAME', 'Name', concat_ws('|', '1|ftString|VARCHAR(%l)', 10 + k, '0|0', case when k % 2 = 0 then 'true' else 'false' end, 'false', case when k % 3 = 0 then 'N' || k else '' end, '', 'name ' || k) from b
    union all select 'column', upper(t), 'PRICE', 'Price', concat_ws('|', '2|ftBCD|DECIMAL(%p,%s)|0', 10 + k % 5, k % 4, 'false|false|||') from b
    union all select 'column', upper(t), 'CODE', 'Code', '3|ftGuid|CHAR(%l)|38|0|0|false|false|||' from b
    union all select 'column', upper(t), 'STATE', 'State', '4|ftString|VARCHAR(%l)|1|0|0|false|false|||' from b
    union all select 'primary_key', upper(t), '', 'PK_' || t, case when k % 2 = 1 then 'Id' else 'Id, Code' end from b
    union all select 'index', upper(t), 'IX' || k, 'IX' || k, case when k % 2 = 0 then 'true' else 'false' end || '|Name, Id' from b
    union all select 'foreign_key', upper(t), 'FK_MODEL0_ID', 'FK_Model0_Id', 'Model0|MODEL0|None|' || case k % 4 when 0 then 'None' when 1 then 'Cascade' when 2 then 'SetNull' else 'SetDefault' end || '|Id|Id' from b
    union all select 'check', upper(t), 'CK' || k, 'CK' || k, 'Price > ' || k from b
    union all select 'sequence', '', 'SQ' || k, 'SQ' || k, concat_ws('|', t, k, k % 3 + 1) from b
    union all select 'view', '', 'VIEW' || n_nationkey, 'View' || n_nationkey, '' from nation where n_nationkey % 5 = 4""",
)
def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of declared models, in PostgreSQL's types."""
    return objects(_models(spark, sf_dir).catalog(spark, D.POSTGRESQL)).selectExpr("kind", "table_key", "object_key", "name", _DETAIL)


def _described(spark: SparkSession, sf_dir: str) -> list[m.Model]:
    """A class for each nation, with what forms and services show of it."""
    registry = m.Registry()
    for k, name in sorted((r.k, r.n) for r in _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) as k", "n_name as n").collect()):
        body = {
            "id": m.column("Id", "ftInteger", not_null=True, label="key", restrictions=["NoUpdate"]),
            "name": m.column("Name", "ftString", 10, default=name if k % 2 else "'x'", message=f"no name of {name}", alignment="center" if k % 3 else "left", restrictions=["Unique"] if k % 4 == 0 else [], rules=(Rule("Name", "not_empty"),)),
            "born": m.column("Born", "ftDate", display_format="yyyy-MM-dd", edit_mask="0000-00-00", default="CURRENT_DATE"),
            "note": m.column("Note", "ftMemo", lazy=True, null_if_empty=True, restrictions=["Hidden", "NoInsert"], origin="notes"),
            "state": m.enumeration("State", "ftString", ["A", "B"], ["open", "done"]),
            "twice": m.calculated("Twice", "Id * 2", "ftInteger"),
            "others": m.association("OneToMany", "Id", "other", "Ref", lazy=True),
        }
        cls = m.primary_key("ID")(m.table(f"Nation{k}")(type(f"Nation{k}", (), body)))
        if k % 3 == 0:
            cls = m.resource(name.lower())(m.sub_resource(f"part{k}")(cls))
        if k % 4 == 1:
            cls = m.rest("GET")(cls)
        registry.register(m.not_served(cls) if k % 5 == 0 else cls)
    return [registry.model(c) for c in registry.classes()]


@query(
    "model_dictionary",
    """with k as (select n_nationkey as k, n_name as n, 'Nation' || n_nationkey as owner from nation)
    select owner, 'Id' as field, 0 as place, 'column' as kind, 'key' as label, '' as message, '' as default_expression, '' as display_format, '' as edit_mask, 'left' as alignment, owner as origin, 'NoUpdate,NotNull,PrimaryKey' as facts from k
    union all select owner, 'Name', 1, 'column', 'Name', 'no name of ' || n, case when k % 2 = 1 then chr(39) || replace(n, chr(39), chr(39) || chr(39)) || chr(39) else chr(39) || 'x' || chr(39) end, '', '', case when k % 3 > 0 then 'center' else 'left' end, owner, case when k % 4 = 0 then 'Unique,' else '' end || 'Nullable,Validated' from k
    union all select owner, 'Born', 2, 'column', 'Born', '', 'CURRENT_DATE', 'yyyy-MM-dd', '0000-00-00', 'left', owner, 'Date,Nullable' from k union all select owner, 'Note', 3, 'column', 'Note', '', '', '', '', 'left', 'notes', 'Hidden,NoInsert,Blob,Lazy,Nullable,NullIfEmpty' from k
    union all select owner, 'State', 4, 'column', 'State', '', '', '', '', 'left', owner, 'Enumeration,Nullable' from k union all select owner, 'Twice', 5, 'calculated', 'Twice', '', '', '', '', 'left', owner, 'CalcField' from k
    union all select owner, 'Id', 6, 'association', 'Id', '', '', '', '', 'left', owner, 'Association,Lazy' from k""",
)
def model_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forms show of every field of declared models, and what holds of it."""
    return m.dictionary(spark, _described(spark, sf_dir)).drop("attribute").withColumn("facts", F.array_join("facts", ","))


@query("model_services", "select 'Nation' || n_nationkey as owner, case when n_nationkey % 3 = 0 then lower(n_name) else 'Nation' || n_nationkey end as resource, case when n_nationkey % 3 = 0 then 'part' || n_nationkey else '' end as sub_resources, case when n_nationkey % 4 = 1 then 'GET' else 'DELETE,GET,POST,PUT' end as methods, n_nationkey % 5 <> 0 as served from nation")
def model_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.services(spark, _described(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("sub_resources", "methods")})


@m.table("customer")
@m.primary_key("c_custkey")
@m.order_by("c_custkey desc")
class _Customer:
    key = m.column("c_custkey", "ftInteger", not_null=True)
    country = m.join_column("c_nationkey", "nation", "n_nationkey", "n_name", "LeftJoin")
    half = m.calculated("half", "c_acctbal / 2", "ftExtended")
    segment = m.enumeration("segment", "ftString", ["A", "B", "M", "F", "H"], ["cars", "buildings", "machines", "furniture", "households"])
    total = m.aggregate("total", "count(*)", "c_nationkey")
    most = m.aggregate("most", "max(c_custkey)", "c_nationkey")


@query(
    "model_rows",
    "select c_custkey, n_name, c_acctbal / 2 as half, case c_mktsegment[1] when 'A' then 'cars' when 'B' then 'buildings' when 'M' then 'machines' when 'F' then 'furniture' when 'H' then 'households' end as segment from customer left join nation on c_nationkey = n_nationkey",
)
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined and calculated fields of a model, and the labels of its codes."""
    model = m.read_model(_Customer)
    rows = _table(spark, sf_dir, "customer").withColumn("segment", F.substring("c_mktsegment", 1, 1))
    seen = m.rows_of(model, rows, {"nation": _table(spark, sf_dir, "nation")})
    return seen.select("c_custkey", "n_name", "half", m.decoded_enumeration(model.column("segment")).alias("segment"))


@query("model_aggregates", "select c_nationkey, count(*)::bigint as total, max(c_custkey) as most from customer group by 1")
def model_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.aggregated(m.read_model(_Customer), _table(spark, sf_dir, "customer"))


# snapshots


def _read_back(catalog: Catalog) -> Catalog:
    return snapshot.from_entries(snapshot.entries(written(snapshot.entry_rows(catalog))), catalog.spark)


@query(
    "snapshot_objects",
    f"""{_ITEMS} select 'table' as kind, t as table_key, '' as object_key, t as name from tabs where j <> 3 union all select 'column', t, upper(c), c from tabs cross join (values ('ID'), ('Note')) as x(c) where j <> 3
    union all select 'column', t, name, name from cols where s <> 1 and j <> 3 union all select 'primary_key', t, '', 'PK_' || t from tabs where j <> 3 and j % 2 = 0
    union all select case k when 3 then 'index' when 4 then 'check' when 5 then 'trigger' else 'foreign_key' end, t, p || n, p || n from (select *, case k when 3 then 'IX' when 4 then 'CK' when 5 then 'TR' when 6 then 'FK' end as p from items) where k between 3 and 6 and s <> 1 and j <> 3
    union all select case k when 7 then 'view' when 8 then 'sequence' when 9 then 'domain' else 'procedure' end, '', p || n || case when k = 10 and n % 2 = 0 then '(INT)' else '' end, p || n from (select *, case k when 7 then 'V' when 8 then 'SQ' when 9 then 'DM' when 10 then 'P' end as p from items) where k > 6 and s <> 1""",
)
def snapshot_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written as a snapshot's text and read back: no object is lost."""
    return objects(_read_back(catalogs(spark, sf_dir)[0])).select("kind", "table_key", "object_key", "name")


@query("snapshot_differences", "select '' as op, '' as name where false")
def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing differs between a catalog and its snapshot, whatever is compared."""
    from .operators.diff import changes
    from .plans.options import CompareOptions

    desired = catalogs(spark, sf_dir)[0]
    rows = changes(desired, _read_back(desired), CompareOptions(D.FIREBIRD, compare_positions=True, compare_descriptions=True, compare_initial_values=True, strict_keys=True))
    return rows.select(F.explode("ops").alias("op"), F.coalesce(F.col("m")["name"], F.col("t")["name"]).alias("name"))


_FLAG = "case when {} then 'true' else 'false' end"
_RULE = "case {} when 1 then 'Cascade' when 2 then 'SetNull' when 3 then 'SetDefault' else 'None' end"


@query(
    "snapshot_file",
    f"""{_ITEMS}, kinds as (select *, case when c in (1, 4) then 'ftString|VARCHAR(%l)|40|0|0' when c = 2 then 'ftBCD|DECIMAL(%p,%s)|0|12|2' when c = 3 then 'ftDate|DATE|0|0|0' else 'ftInteger|INTEGER|0|0|0' end as told,
        case when s = 3 and v = 2 then case when c in (1, 4) then 'it''s' else '7' end when s = 3 and v = 3 then '' when c = 4 then 'n/a' when c = 5 then '0' else '' end as given,
        case when s = 3 then 'BEGIN x :=  ''a  b''; y := ' || n || '; END' else 'BEGIN  y := ' || n || ';' || chr(9) || 'END ' end as body from items where s <> 1)
    select 'table' as kind, t as table_key, '' as object_key, t as name, 'about ' || t as detail from tabs where j <> 3 union all select 'column', t, 'ID', 'ID', '0|ftInteger|INTEGER|0|0|0|true|false|||' from tabs where j <> 3
    union all select 'column', t, 'NOTE', 'Note', '1|ftString|VARCHAR(%l)|100|0|0|false|false|||' from tabs where j <> 3
    union all select 'column', t, 'C' || n, 'C' || n, concat_ws('|', n + 10, told, {_FLAG.format('s = 3 and v = 1')}, 'false', given, '', 'col ' || n) from kinds where k < 3 and j <> 3
    union all select 'primary_key', t, '', 'PK_' || t, 'ID' from tabs where j <> 3 and j % 2 = 0
    union all select 'index', t, 'IX' || n, 'IX' || n, {_FLAG.format('n % 2 = 0')} || '|ID' || case when n % 3 = 0 then ', Note' else '' end from kinds where k = 3 and j <> 3
    union all select 'check', t, 'CK' || n, 'CK' || n, 'ID > ' || n from kinds where k = 4 and j <> 3 union all select 'trigger', t, 'TR' || n, 'TR' || n, null from kinds where k = 5 and j <> 3
    union all select 'foreign_key', t, 'FK' || n, 'FK' || n, concat_ws('|', 'T0', 'T0', {_RULE.format('n // 4 % 4')}, {_RULE.format('n % 4')}, 'ID', 'ID') from kinds where k = 6 and j <> 3
    union all select 'view', '', 'V' || n, 'V' || n, 'SELECT ' || n || case when s = 3 then ' AS  a' else ' AS b  ' end from kinds where k = 7 union all select 'sequence', '', 'SQ' || n, 'SQ' || n, '|5|1' from kinds where k = 8
    union all select 'domain', '', 'DM' || n, 'DM' || n, concat_ws('|', 'INTEGER', {_FLAG.format('n % 2 = 0')}, case when n % 3 = 0 then '1' else '' end, case when n % 5 = 0 then 'VALUE > 0' else '' end) from kinds where k = 9
    union all select 'procedure', '', 'P' || n || case when n % 2 = 0 then '(INT)' else '' end, 'P' || n, concat_ws('|', case when n % 2 = 0 then 'int' else '' end, {_FLAG.format('n % 3 = 0')}, body) from kinds where k = 10""",
)
def snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written to a file and loaded from it, with all that its objects are made of."""
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}.json"
    snapshot.save(catalogs(spark, sf_dir)[0], path, D.POSTGRESQL, "of the parts")
    return objects(snapshot.load(spark, path).catalog).selectExpr("kind", "table_key", "object_key", "name", _DETAIL)


# questions to a catalog


@query(
    "introspection",
    f"""{_ITEMS} select 'table' as asked, t as name, 0 as place from tabs where j <> 3 union all select 'field', 'ID', 0 union all select 'field', 'Note', 1 union all select 'field', name, n + 10 from cols where j = 2 and s <> 1
    union all select 'primary_key', 'PK_T2', 0 union all select 'member', 'ID', 0 union all select 'index', 'IX' || n, 0 from items where k = 3 and j = 2 and s <> 1 union all select 'foreign_key', 'FK' || n, 0 from items where k = 6 and j = 2 and s <> 1
    union all select 'referencing', 'FK' || n, 0 from items where k = 6 and j <> 3 and s <> 1""",
)
def introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one asks a catalog: its tables, and the fields, keys and indexes of a table."""
    c = catalogs(spark, sf_dir)[0]
    asked = lambda what, rows, name, place="0": rows.selectExpr(f"'{what}' as asked", f"{name} as name", f"{place} as place")
    found = [
        asked("table", introspect.tables(c), "table_name"), asked("field", introspect.fields(c, "t2"), "column_name", "position"), asked("primary_key", introspect.primary_key(c, "T2"), "pk_name"), asked("member", introspect.members(c, "T2", "pk"), "column_name", "position"),
        asked("index", introspect.indexes(c, "T2"), "name"), asked("foreign_key", introspect.foreign_keys(c, "T2"), "name"), asked("referencing", introspect.referencing(c, "T0"), "name"),
    ]
    return reduce(DataFrame.union, found)


# scripts and execution

_EMPTY = {D.POSTGRESQL: "", D.MYSQL: " union all values ('Pre', 'EnableTriggers', '', 'Off', ''), ('Post', 'EnableTriggers', '', 'On', '')"}


@query("dry_run_counts", f"select phase, case when sql = '' then 'Empty' else 'Pending' end as status, count(*)::bigint as n from (select phase, sql from ({ddl_sql(D.MYSQL)}) union all values ('Pre', ''), ('Post', '')) group by 1, 2")
def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dry_run(_plan(spark, sf_dir, D.MYSQL)).groupBy("phase", "status").agg(F.count("*").alias("n"))


class _Refusing:
    """A target that takes all statements but those on named checks."""

    def __init__(self) -> None:
        self.connected, self.in_transaction, self.log = True, False, []

    def start(self) -> None:
        self.in_transaction = True
        self.log.append("start")

    def commit(self) -> None:
        self.in_transaction = False
        self.log.append("commit")

    def rollback(self) -> None:
        self.in_transaction = False
        self.log.append("rollback")

    def execute(self, sql: str) -> None:
        if sql.startswith("ALTER TABLE") and "CONSTRAINT CK" in sql:
            raise RuntimeError("refused")


_RUNS = ((D.POSTGRESQL, CONTINUE), (D.POSTGRESQL, STOP), (D.MYSQL, CONTINUE))


def _report_sql(dialect: str, on_error: str) -> str:
    phases = ", ".join(f"('{p}', {k})" for k, p in enumerate(PHASES))
    stopped = f"o > {PHASES.index('DropChecks')}" if on_error == STOP else "false"
    empty = " union all values ('Pre', ''), ('Post', '')" if dialect == D.MYSQL else ""
    return f"""select '{dialect}' as dialect, '{on_error}' as on_error, phase, case when sql = '' then 'Empty' when {stopped} then 'Skipped' when phase not in ('DropChecks', 'Checks') then 'Succeeded' when place = 1 then 'Failed' else 'Skipped' end as status, count(*)::bigint as n
        from (select phase, sql, o, row_number() over (partition by phase) as place from (select phase, sql from ({ddl_sql(dialect)}){empty}) join (values {phases}) as p(p, o) on p = phase) group by all"""


@query("execution_report", " union all ".join(f"select * from ({_report_sql(d, e)})" for d, e in _RUNS))
def execution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every phase where the target refuses the statements on checks: its phase ends, and the run ends or goes on."""
    runs = [execute_in_task(_plan(spark, sf_dir, d, on_error=e, raise_on_error=False), _Refusing).filter("status is not null").groupBy(F.lit(d).alias("dialect"), F.lit(e).alias("on_error"), "phase", "status") for d, e in _RUNS]
    return reduce(DataFrame.union, [run.agg(F.count("*").alias("n")) for run in runs])


@query("execution_transactions", f"select phase, case when phase in ('DropChecks', 'Checks') then 'rollback' else 'commit' end as ended from (select distinct phase from ({ddl_sql(D.POSTGRESQL)}))")
def execution_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the transaction of every phase ends."""
    plan = _plan(spark, sf_dir, D.POSTGRESQL, on_error=CONTINUE, raise_on_error=False)
    return execute_in_task(plan, _Refusing).filter("ended is not null").select("phase", "ended")


@query("unsequenced_plan", f"select 'Unknown' as phase, op, count(*)::bigint as n from ({ddl_sql(D.SPARK)}) group by 2")
def unsequenced_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without phases the commands keep the order of their generation."""
    return _plan(spark, sf_dir, D.SPARK, sequenced=False).commands.filter("sql <> ''").groupBy("phase", "op").agg(F.count("*").alias("n"))
