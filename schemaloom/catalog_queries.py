"""Queries over a pair of catalogs with every kind of object, each with the SQL that DuckDB answers it by.

Objects are made of the rows of `part` by fixed rules. n is p_partkey; table T<n mod 25> holds the object, n mod 11 is its kind, (n div 11) mod 4 its status:
0 only desired, 1 only current, 2 on both sides and equal in meaning, 3 on both sides and different. T3 is gone, T7 and T8 are new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialects as D
from .functions.render import quoted
from .operators import diff, policy
from .operators.alter import classified, expanded
from .plans.compare import Plan, compare
from .plans.options import ADDITIVE, FULL, REBUILD, CompareOptions
from .query_base import _table, query
from .relations import SCHEMAS, Catalog, local_frame, shared_folder, written
from .sources.system_tables import decoded

SCHEMA = "app"
_RULES = "'None', 'Cascade', 'SetNull', 'SetDefault'"


def _frame(rows: DataFrame, relation: str, **given: str) -> DataFrame:
    """rows as a relation; columns that aren't given are empty, zero or false."""
    empty = {"string": "''", "int": "0", "boolean": "false"}
    columns = [x.split() for x in SCHEMAS[relation].split(",")]
    return rows.selectExpr(*[f"cast({given.get(c, empty[t])} as {t}) as {c}" for c, t in columns])


def catalogs(spark: SparkSession, sf_dir: str) -> tuple[Catalog, Catalog]:
    """(desired, current)"""
    items = written(_items(spark, sf_dir))  # read by many relations
    tables = local_frame(spark, [(k, f"T{k}") for k in range(25)], "j int, t string")
    return _catalog(spark, items, tables, True), _catalog(spark, items, tables, False)


_compared: dict[tuple, tuple[Catalog, Catalog, DataFrame]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """When a file or a folder's files were last written, and their sizes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in files.listStatus(target)))


def compared(spark: SparkSession, sf_dir: str) -> tuple[Catalog, Catalog, DataFrame]:
    """(desired, current, their objects side by side), made once in a session for all queries of this module, and anew if the table or the shared folder is another."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir, _state(spark, f"{sf_dir}/part.parquet"))
    if key not in _compared:
        both = catalogs(spark, sf_dir)
        _compared[key] = (*both, diff.compared(*both))
    return _compared[key]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as n").selectExpr("n", "n % 25 as j", "n % 11 as k", "n div 11 % 4 as s", "n div 44 % 4 as v", "n % 6 as c", "concat('T', n % 25) as t")


def _catalog(spark: SparkSession, items: DataFrame, tables: DataFrame, new: bool) -> Catalog:
    own = tables.filter("j <> 3" if new else "j not in (7, 8)")
    items = items.filter("s <> 1" if new else "s <> 0")
    held = items.filter("j <> 3" if new else "j not in (7, 8)")  # objects of tables
    of = lambda k: f"k = {k}"
    differs = f"(s = 3 and {str(not new).lower()})"  # where the current side has something else
    text = "c in (1, 4)"
    kind = f"case when {text} then 'ftString' when c = 2 then 'ftBCD' when c = 3 then if({differs} and v = 0, 'ftDateTime', 'ftDate') else if({differs} and v = 0, 'ftSmallint', 'ftInteger') end"
    type_name = f"case when {text} then 'VARCHAR(%l)' when c = 2 then 'DECIMAL(%p,%s)' when c = 3 then if({differs} and v = 0, 'TIMESTAMP', 'DATE') else if({differs} and v = 0, 'SMALLINT', 'INTEGER') end"
    usual = "case c when 4 then 'n/a' when 5 then '0' else '' end"
    default = f"case when s = 3 and v = 2 then {f'if({text}, {chr(34)}it{chr(39)}s{chr(34)}, {chr(39)}7{chr(39)})' if new else repr('')} when s = 3 and v = 3 then {repr('') if new else repr('5')} else {usual} end"
    about = "concat('col ', n)" if new else "case n % 5 when 0 then 'old' when 1 then upper(concat('col ', n)) else concat('col ', n) end"
    columns = _frame(held.filter("k < 3"), "columns", table_key="t", position="n + 10", column_name="concat('C', n)", name_key="concat('C', n)", field_type=kind, type_name=type_name,
        size=f"if({text}, if({differs} and v = 0, 80, 40), 0)", precision=f"if(c = 2, if({differs} and v = 0, 18, 12), 0)", scale="if(c = 2, 2, 0)", not_null=f"s = 3 and v = 1 and {str(new).lower()}",
        sorting_order="'NoSort'", default_value=default, description=about)
    ids = _frame(own, "columns", table_key="t", column_name="'ID'", name_key="'ID'", field_type="'ftInteger'", type_name="'INTEGER'", not_null="true", sorting_order="'NoSort'")
    notes = _frame(own, "columns", table_key="t", position="1" if new else "j % 2 + 1", column_name="'Note'", name_key="'NOTE'", field_type="'ftString'", type_name="'VARCHAR(%l)'", size="100", sorting_order="'NoSort'")
    keyed = own.filter("j % 2 = 0" if new else "j % 3 = 0")
    member = lambda rows, kind, key, position, name: _frame(rows, "key_columns", table_key="t", key_kind=f"'{kind}'", object_key=key, position=position, column_name=name, name_key=f"upper({name})", sorting_order="'NoSort'")
    indexes, foreign = held.filter(of(3)), held.filter(of(6))
    members = member(keyed, "pk", "''", "0", "'ID'").union(member(indexes, "index", "concat('IX', n)", "0", "if(n % 3 = 0 and not {}, 'Note', 'ID')".format(str(new).lower()))).union(
        member(indexes.filter("n % 3 = 0"), "index", "concat('IX', n)", "1", "'Note'" if new else "'ID'")
    ).union(member(foreign, "fk_from", "concat('FK', n)", "0", "'ID'")).union(member(foreign, "fk_to", "concat('FK', n)", "0", "'ID'"))
    named = lambda rows, relation, prefix, **given: _frame(rows, relation, object_key=f"concat('{prefix}', n)", name=f"concat('{prefix}', n)", **({"table_key": "t"} if "table_key" in SCHEMAS[relation] else {}), **given)
    body = f"case when s = 3 then {'concat(' + chr(34) + 'BEGIN x :=  ' + chr(39) + 'a  b' + chr(39) + '; y := ' + chr(34) + ', n, ' + chr(34) + '; END' + chr(34) + ')'} else concat('BEGIN  y := ', n, ';', chr(9), 'END ') end"
    if not new:
        body = "case when s = 3 then concat(\"BEGIN x := 'a b'; y := \", n, '; END') else concat('begin y := ', n, '; END') end"
    view = "concat('SELECT ', n, if(s = 3, ' AS  a', ' AS b  '))" if new else "concat('select  ', n, ' AS b')"
    condition = "concat('ID > ', n)" if new else "if(s = 3, concat('ID > ', n + 1), concat('CHECK (( ID > ', n, '))'))"
    return Catalog(spark, "new" if new else "old", SCHEMA, {
        "tables": _frame(own, "tables", table_key="t", table_name="t", description="concat('about ', t)" if new else "case j % 4 when 1 then 'old' when 2 then upper(concat('about ', t)) else concat('about ', t) end"),
        "columns": columns.union(ids).union(notes),
        "primary_keys": _frame(keyed, "primary_keys", table_key="t", pk_name="concat('PK_', t)" if new else "if(j % 12 = 0, 'OLD_PK', concat('PK_', t))"),
        "key_columns": members,
        "indexes": named(indexes, "indexes", "IX", is_unique=f"(n % 2 = 0) <> {differs}"),
        "foreign_keys": named(foreign, "foreign_keys", "FK", parent_table="'T0'", parent_key="'T0'", on_delete=f"element_at(array({_RULES}), n % 4 + 1)", on_update=f"element_at(array({_RULES}), cast((n div 4 + if({differs}, 1, 0)) % 4 + 1 as int))"),
        "checks": named(held.filter(of(4)), "checks", "CK", condition=condition),
        "triggers": named(held.filter(of(5)), "triggers", "TR", script=body),
        "views": named(items.filter(of(7)), "views", "V", script=view),
        "sequences": named(items.filter(of(8)), "sequences", "SQ", initial_value="5", increment=f"if({differs}, if(v = 1, 0, 2), 1)"),
        "domains": named(items.filter(of(9)), "domains", "DM", type_name="'INTEGER'", not_null="n % 2 = 0", default_value="if(n % 3 = 0, '1', '')", check_condition=f"case when {differs} and v = 0 then 'VALUE > 1' when n % 5 = 0 then {'chr(40) || chr(40) ||' if not new else ''} 'VALUE > 0' {'|| chr(41) || chr(41)' if not new else ''} else '' end"),
        "procedures": _frame(items.filter(of(10)), "procedures", object_key="concat('P', n, if(n % 2 = 0, '(INT)', ''))", name="concat('P', n)", signature="if(n % 2 = 0, 'int', '')", is_function="n % 3 = 0", script=body),
    })


# The same rules and their consequences in SQL.

_ITEMS = """with items as (
    select p_partkey as n, p_partkey % 25 as j, p_partkey % 11 as k, p_partkey // 11 % 4 as s, p_partkey // 44 % 4 as v, p_partkey % 6 as c, 'T' || (p_partkey % 25) as t, p_partkey % 25 not in (3, 7, 8) as kept from part
), tabs as (select range as j, 'T' || range as t, range not in (3, 7, 8) as kept from range(25)), cols as (
    select *, 'C' || n as name, case when c in (1, 4) then 'VARCHAR(40)' when c = 2 then 'DECIMAL(12,2)' when c = 3 then 'DATE' else 'INTEGER' end as ty,
        case when s = 3 and v = 2 then case when c in (1, 4) then '''it''''s''' else '7' end when s = 3 and v = 3 then '' when c = 4 then '''n/a''' when c = 5 then '0' else '' end as def,
        case when s = 3 and v = 1 then ' NOT NULL' else '' end as nn from items where k < 3
), ops as (
    select t, name, n, ty, def, nn, c, v, s, unnest(case when s = 0 then ['CreateColumn'] when s = 1 then ['DropColumn'] when s = 3 and v = 2 then ['AlterColumn', 'AlterDefaultValue'] when s = 3 and v = 3 then ['AlterColumn', 'DropDefaultValue']
        when s = 3 then ['AlterColumn'] else [] end) as op from cols where kept
)"""
_TABLES_OPS = "select t, 'PK_' || t as name, case when j % 12 = 0 then ['DropPrimaryKey', 'CreatePrimaryKey'] when j % 6 = 0 then [] when j % 2 = 0 then ['CreatePrimaryKey'] when j % 3 = 0 then ['DropPrimaryKey'] else [] end as ops, j from tabs where kept"
_STATUS = "case s when 0 then ['{0}'] when 1 then ['{1}'] when 3 then {2} else [] end"
_PLAN_OPS = f"""{_ITEMS}, plan as (
    select op, t, name, n, ty, def, nn, 0 as j from ops
    union all select unnest(ops), t, name, 0, '', '', '', j from ({_TABLES_OPS})
    union all select unnest({_STATUS.format('CreateIndexe', 'DropIndexe', "['DropIndexe', 'CreateIndexe']")}), t, 'IX' || n, n, '', '', '', j from items where k = 3 and kept
    union all select unnest({_STATUS.format('CreateCheck', 'DropCheck', "['AlterCheck']")}), t, 'CK' || n, n, '', '', '', j from items where k = 4 and kept
    union all select unnest({_STATUS.format('CreateTrigger', 'DropTrigger', "['DropTrigger', 'CreateTrigger']")}), t, 'TR' || n, n, '', '', '', j from items where k = 5 and kept
    union all select unnest({_STATUS.format('CreateForeignKey', 'DropForeignKey', "['DropForeignKey', 'CreateForeignKey']")}), t, 'FK' || n, n, '', '', '', j from items where k = 6 and kept
    union all select 'CreateForeignKey', t, 'FK' || n, n, '', '', '', j from items where k = 6 and j in (7, 8) and s <> 1
    union all select unnest({_STATUS.format('CreateView', 'DropView', "['DropView', 'CreateView']")}), '', 'V' || n, n, '', '', '', s from items where k = 7
    union all select unnest({_STATUS.format('CreateSequence', 'DropSequence', "case when v = 1 then [] else ['AlterSequence'] end")}), '', 'SQ' || n, n, '', '', '', j from items where k = 8
    union all select unnest({_STATUS.format('CreateDomain', 'DropDomain', '[]')}), '', 'DM' || n, n, '', '', '', j from items where k = 9
    union all select unnest({_STATUS.format('CreateProcedure', 'DropProcedure', "['DropProcedure', 'CreateProcedure']")}), '', 'P' || n, n, '', '', '', s from items where k = 10
    union all select 'SetTableComment', t, t, 0, '', '', '', j from tabs where kept and j % 4 = 1
    union all select 'SetColumnComment', t, name, n, '', '', '', j from cols where kept and s > 1 and n % 5 = 0
    union all select 'DropTable', t, t, 0, '', '', '', j from tabs where j = 3
    union all select 'CreateTable', t, t, 0, '', '', '', j from tabs where j in (7, 8)
)"""


def _changes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return diff.differences(compared(spark, sf_dir)[2], CompareOptions(**{"dialect": D.POSTGRESQL, "compare_descriptions": True, **options}))


def _ops(changes: DataFrame) -> DataFrame:
    """(op, table_name, name) of changes"""
    rows = changes.select("m", "t", F.explode("ops").alias("op"))
    side = lambda c: F.when(F.col("op").startswith("Drop") & (F.col("op") != "DropDefaultValue"), F.col("t")[c]).otherwise(F.col("m")[c]).alias(c)
    return rows.select("op", side("table_name"), side("name"))


def _kind_query(name: str, kinds: tuple[str, ...], like: str) -> None:
    shown = "case when op = 'DropPrimaryKey' and j % 12 = 0 then 'OLD_PK' else name end"

    @query(name, f"{_PLAN_OPS} select op, t as table_name, {shown} as name from plan where {like}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ops(_changes(spark, sf_dir).filter(F.col("kind").isin(*kinds)))


_kind_query("diff_defaults", ("column",), "op in ('CreateColumn', 'DropColumn', 'AlterColumn', 'AlterDefaultValue', 'DropDefaultValue', 'SetColumnComment')")
_kind_query("diff_primary_keys", ("primary_key",), "op like '%PrimaryKey'")
_kind_query("diff_indexes", ("index",), "op like '%Indexe'")
_kind_query("diff_foreign_key_rules", ("foreign_key",), "op like '%ForeignKey'")
_kind_query("diff_checks", ("check",), "op like '%Check'")
_kind_query("diff_triggers", ("trigger",), "op like '%Trigger'")
_kind_query("diff_views", ("view",), "op like '%View'")
_kind_query("diff_sequences", ("sequence",), "op like '%Sequence'")
_kind_query("diff_procedures", ("procedure",), "op like '%Procedure'")
_kind_query("diff_comments", ("table",), "op in ('SetTableComment', 'DropTable', 'CreateTable')")


@query(
    "diff_index_expressions",
    """select case p_partkey % 4 when 3 then 'CreateIndexe' else 'DropIndexe' end as op, 'I' || p_partkey as name from part where p_partkey % 4 in (1, 2, 3) and p_partkey % 8 <> 2
    union all select 'CreateIndexe', 'I' || p_partkey from part where p_partkey % 4 in (1, 2) and p_partkey % 8 <> 2""",
)
def diff_index_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes over expressions as PostgreSQL gives them: other spelling is no difference, but another function, another literal, or a plain column instead is."""
    part = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as n")
    empty = {"columns": "column_name string, position int, native_type string, size int, precision int, scale int, not_null int, auto_increment int, default_value string, charset string, description string", "primary_keys": "pk_name string, column_name string, position int",
        "foreign_keys": "name string, column_name string, position int, parent_table string, parent_column string, on_update string, on_delete string"}

    def side(expression: str, own: DataFrame) -> Catalog:
        rows = own.selectExpr("'t' as table_name", "concat('I', n) as name", "0 as is_unique", "explode(array(1, 2)) as position", "n").selectExpr("*", "if(position = 2, 'b', null) as column_name", f"if(position = 1, {expression}, null) as expression")
        rows = rows.withColumn("column_name", F.when(F.col("expression") == "-", "a").otherwise(F.col("column_name"))).withColumn("expression", F.nullif(F.col("expression"), F.lit("-")))
        given = {"tables": local_frame(spark, [("t", "")], "table_name string, description string"), "indexes": rows, **{k: spark.createDataFrame([], f"table_name string, {v}") for k, v in empty.items()}}
        return decoded(spark, given, D.POSTGRESQL)

    desired = side("case n % 4 when 0 then concat('lower(a || ', chr(39), 'X  ', n, chr(39), ')') when 2 then concat('replace(a, ', chr(39), 'k', chr(39), ')') else 'lower(a)' end", part)
    current = side("case n % 4 when 0 then concat('( LOWER ( A||', chr(39), 'X  ', n, chr(39), ' ) )') when 2 then if(n % 8 = 2, concat('REPLACE(a,', chr(39), 'k', chr(39), ')'), concat('REPLACE(a,', chr(39), 'K', chr(39), ')')) else '-' end", part.filter("n % 4 <> 3"))
    return _ops(diff.changes(desired, current, CompareOptions(D.POSTGRESQL)).filter("kind = 'index'")).select("op", "name")


@query(
    "diff_domains",
    f"""{_PLAN_OPS} select op, name, null as audit from plan where op like '%Domain' union all
    select null, 'DM' || n, 'DIAGNOSTIC: DOMAIN DM' || n || ' diverges (type, default, not null or check) and is not altered automatically' from items where k = 9 and s = 3 and v = 0""",
)
def diff_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are created and dropped; those that differ are only told of."""
    rows = _changes(spark, sf_dir).filter("kind = 'domain'")
    diagnosed = rows.filter("size(ops) = 0").select(F.lit(None).cast("string").alias("op"), F.col("t")["name"].alias("name"), "audit")
    return _ops(rows).select("op", "name", F.lit(None).cast("string").alias("audit")).union(diagnosed)


@query(
    "diff_new_tables",
    f"{_ITEMS} select t as table_name, 'FK' || n as name from items where k = 6 and j in (7, 8) and s <> 1",
)
def diff_new_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys of new tables, which come after all tables."""
    return _ops(_changes(spark, sf_dir).filter("kind = 'foreign_key' and m.table_name in ('T7', 'T8')")).select("table_name", "name")


@query("diff_column_positions", "select 'T' || range as table_name, 'Note' as name, 1 as position from range(25) where range % 2 = 1 and range not in (3, 7, 8) union all "
    f"select t, name, position from ({_ITEMS} select t, 'C' || n as name, n + 10 as position from items where k < 3 and kept and s <> 1 and j % 2 = 1 union all select t, 'ID', 0 from tabs where kept and j % 2 = 1)")  # fmt: skip
def diff_column_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of tables in which one is out of place: all get their positions anew."""
    rows = _changes(spark, sf_dir, dialect=D.FIREBIRD, compare_positions=True).filter(F.array_contains("ops", "AlterColumnPosition"))
    return rows.select(F.col("m")["table_name"].alias("table_name"), F.col("m")["name"].alias("name"), F.col("m")["attrs"]["position"].cast("long").alias("position"))


@query(
    "policy_pairs",
    f"""{_PLAN_OPS}, parts as (select t, n, name, list(op) as ops, max(op like 'Drop%' and op <> 'DropDefaultValue') as drops from plan where op not in ('AlterColumn', 'AlterDefaultValue', 'DropDefaultValue', 'SetColumnComment') group by all)
    select 'RECREATE ' || case name[:2] when 'IX' then 'INDEXE ' when 'FK' then 'FOREIGNKEY ' when 'TR' then 'TRIGGER ' when 'PK' then 'PRIMARYKEY ' end || t || '.' || case when name[:2] = 'PK' then 'OLD_PK' else name end || ' suppressed by policy' as audit
    from parts where len(ops) = 2 and t <> ''""",
)
def policy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change that takes a drop and a creation is held back whole, though the policy would allow the creation."""
    return policy.gated(_changes(spark, sf_dir), ADDITIVE)[1].filter("audit like 'RECREATE %' and audit not like '% VIEW %' and audit not like '% PROCEDURE %'").select("audit")


_NEEDS = {"SetTableComment": "SetComment", "SetColumnComment": "SetComment"}
_HELD = frozenset({"AlterColumn", "CreateIndexe", "SetComment", "AlterSequence"})


@query("policy_classification", f"{_PLAN_OPS} select op, case when op like 'Set%' then 'SetComment' else op end as needs, case when op like 'Set%' then 'SetComment' else op end not in ('AlterColumn', 'CreateIndexe', 'SetComment', 'AlterSequence') as allowed, count(*)::bigint as n from plan group by 1, 2, 3")
def policy_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation that every command needs, and whether a policy without four of them allows it."""
    rows = _ops(_changes(spark, sf_dir)).withColumn("needs", policy.operation(F.col("op")))
    denied = policy.denied(rows, FULL - _HELD).select("op").distinct().withColumn("denied", F.lit(True))
    return rows.join(F.broadcast(denied), "op", "left").select("op", "needs", F.col("denied").isNull().alias("allowed")).groupBy("op", "needs", "allowed").agg(F.count("*").alias("n"))


_CLASS = "case when v = 0 and (c in (1, 2, 4) or d = 'Firebird') and d <> 'SQLite' then 'TypeRebuild' when v = 1 and c in (4, 5) then 'BackfillNotNull' when v = 1 then 'InPlaceWithWarning' else 'InPlace' end"
_REBUILT = "['CreateColumnRebuild', 'CopyColumnData', 'DropColumnRebuild', 'RenameColumn']"


@query("alter_steps", f"""{_ITEMS} select d as dialect, t as table_name, name, {_CLASS} as class, case {_CLASS} when 'TypeRebuild' then array_to_string({_REBUILT}, ' ') when 'BackfillNotNull' then 'BackfillColumnData AlterColumn' else 'AlterColumn' end as steps
    from ops cross join (values ('Firebird'), ('PostgreSQL'), ('SQLite')) as x(d) where op = 'AlterColumn'""")  # fmt: skip
def alter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each changed column is altered in dialects of three kinds, and the steps that it takes."""
    found = None
    for dialect in (D.FIREBIRD, D.POSTGRESQL, D.SQLITE):
        rows = _changes(spark, sf_dir, dialect=dialect).filter(F.array_contains("ops", "AlterColumn"))
        steps = expanded(rows, CompareOptions(dialect, strategy=REBUILD))[0]
        m = F.col("m")
        own = steps.select(F.lit(dialect).alias("dialect"), m["table_name"].alias("table_name"), m["name"].alias("name"), classified(m["attrs"], F.col("t")["attrs"], dialect).alias("class"), F.array_join("ops", " ").alias("steps"))
        found = own if found is None else found.union(own)
    return found


@query("alter_held_back", f"""{_ITEMS} select 'REBUILD COLUMN ' || t || '.' || name || ' suppressed by policy (kept in-place ALTER)' as audit from (select *, 'PostgreSQL' as d from ops) where op = 'AlterColumn' and {_CLASS} in ('TypeRebuild', 'BackfillNotNull')""")
def alter_held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilds that the policy does not allow stay changes in place, and are told of."""
    rows = _changes(spark, sf_dir).filter(F.array_contains("ops", "AlterColumn"))
    return expanded(rows, CompareOptions(D.POSTGRESQL, strategy=REBUILD, policy=FULL - {"RebuildColumn"}))[1].select("audit")


# Statements of every dialect.

_FIREBIRDS = D.FIREBIRD_FAMILY
_GUARDS = {
    D.POSTGRESQL: [("EnableForeignKeys", "Off", "SET session_replication_role = replica;"), ("EnableTriggers", "Off", "SET session_replication_role = replica;"), ("EnableForeignKeys", "On", "SET session_replication_role = DEFAULT;"), ("EnableTriggers", "On", "SET session_replication_role = DEFAULT;")],
    D.MYSQL: [("EnableForeignKeys", "Off", "SET FOREIGN_KEY_CHECKS = 0;"), ("EnableForeignKeys", "On", "SET FOREIGN_KEY_CHECKS = 1;")],
    D.SQLITE: [("EnableForeignKeys", "Off", "PRAGMA foreign_keys = off;"), ("EnableForeignKeys", "On", "PRAGMA foreign_keys = on;")],
}
_OF_PHASE = {
    "DropProcedures": ["DropProcedure"], "DropTriggers": ["DropTrigger"], "DropViews": ["DropView"], "DropForeignKeys": ["DropForeignKey"], "DropChecks": ["DropCheck"], "DropIndexes": ["DropIndexe"], "DropPrimaryKeys": ["DropPrimaryKey"],
    "DropColumns": ["DropColumn", "DropDefaultValue"], "DropTables": ["DropTable"], "DropSequences": ["DropSequence"], "DropDomains": ["DropDomain"], "CreateSequences": ["CreateSequence", "AlterSequence"], "CreateDomains": ["CreateDomain"],
    "CreateTables": ["CreateTable"], "Columns": ["CreateColumn", "AlterColumn", "AlterDefaultValue"], "PrimaryKeys": ["CreatePrimaryKey"], "Indexes": ["CreateIndexe"], "Checks": ["CreateCheck", "AlterCheck"], "ForeignKeys": ["CreateForeignKey"],
    "Views": ["CreateView"], "Triggers": ["CreateTrigger"], "Procedures": ["CreateProcedure"], "Comments": ["SetTableComment", "SetColumnComment"],
}


def ddl_sql(d: str) -> str:
    """DuckDB SQL for the statements of a dialect."""
    a, z = {D.POSTGRESQL: ('"', '"'), D.MSSQL: ("[", "]"), D.SPARK: ("`", "`")}.get(d, ("", ""))
    tab = f"'{a}{SCHEMA}{z}.{a}' || t || '{z}'"
    parent = f"'{a}{SCHEMA}{z}.{a}T0{z}'"
    alter = f"'ALTER TABLE ' || {tab}"
    drop_constraint = f"{alter} || ' DROP CONSTRAINT ' || name || ';'"
    default = "case when def <> '' then ' DEFAULT ' || def else '' end"
    words = lambda event, rule: f"case {rule} when 1 then ' ON {event} CASCADE' when 2 then ' ON {event} SET NULL' when 3 then ' ON {event} SET DEFAULT' else '' end"
    foreign = f"'CONSTRAINT FK' || n || ' FOREIGN KEY (ID) REFERENCES ' || {parent} || '(ID)' || {words('DELETE', 'n % 4')}" + ("" if d == D.ORACLE else f" || {words('UPDATE', 'n // 4 % 4')}")
    index = f"'CREATE ' || case when n % 2 = 0 then 'UNIQUE ' else '' end || 'INDEX IX' || n || ' ON ' || {tab} || ' (ID' || case when n % 3 = 0 then ', Note' else '' end || ');'"
    check = "'CONSTRAINT CK' || n || ' CHECK (ID > ' || n || ')'"
    column = f"name || ' ' || ty || {default} || nn"
    begin = f"{alter} || ' ALTER COLUMN ' || name"
    if d == D.POSTGRESQL:
        changed = f"{begin} || ' TYPE ' || ty || ';' || {begin} || case when def <> '' then ' SET DEFAULT ' || def || ';' else ' DROP DEFAULT;' end || {begin} || case when nn <> '' then ' SET NOT NULL;' else ' DROP NOT NULL;' end || 'COMMENT ON COLUMN ' || {tab} || '.' || name || ' IS ''col ' || n || ''';'"
    elif d in _FIREBIRDS:
        changed = f"{begin} || ' TYPE ' || ty || nn || ';'"
    elif d == D.MYSQL:
        changed = f"{alter} || ' MODIFY COLUMN ' || name || ' ' || ty || nn || ';'"
    elif d == D.ORACLE:
        changed = f"{alter} || ' MODIFY (' || name || ' ' || ty || nn || ');'"
    else:
        changed = f"{begin} || ' ' || ty || nn || ';'"
    set_default, drop_default = f"{begin} || ' SET DEFAULT ' || def || ';'", f"{begin} || ' DROP DEFAULT;'"
    if d == D.ORACLE:
        set_default, drop_default = f"{alter} || ' MODIFY (' || name || ' DEFAULT ' || def || ');'", f"{alter} || ' MODIFY (' || name || ' DEFAULT NULL);'"
    elif d == D.MSSQL:
        set_default, drop_default = f"{alter} || ' ADD CONSTRAINT DF_' || t || '_' || name || ' DEFAULT ' || def || ' FOR ' || name || ';'", f"{alter} || ' DROP CONSTRAINT DF_' || t || '_' || name || ';'"
    sequences = {
        **dict.fromkeys((D.FIREBIRD, D.INTERBASE), ("'CREATE GENERATOR ' || name || ';'", "'ALTER SEQUENCE ' || name || ' RESTART WITH 5;'", "'DROP GENERATOR ' || name || ';'")),
        D.FIREBIRD3: ("'CREATE GENERATOR ' || name || ';'", "'ALTER SEQUENCE ' || name || ' RESTART WITH 5 INCREMENT BY 1;'", "'DROP GENERATOR ' || name || ';'"),
        D.POSTGRESQL: ("'CREATE SEQUENCE \"' || name || '\" INCREMENT 1 START 5;'", "'ALTER SEQUENCE ' || name || ' RESTART WITH 5 INCREMENT BY 1;'", "'DROP SEQUENCE ' || name || ';'"),
        D.MSSQL: ("'CREATE SEQUENCE ' || name || ' AS int START WITH 5 INCREMENT BY 1;'", "'ALTER SEQUENCE ' || name || ' RESTART WITH 5 INCREMENT BY 1;'", "'DROP SEQUENCE ' || name || ';'"),
        D.ORACLE: ("'CREATE SEQUENCE ' || name || ' MINVALUE 1 START WITH 5 INCREMENT BY 1 NOCACHE;'", "'ALTER SEQUENCE ' || name || ' INCREMENT BY 1;'", "'DROP SEQUENCE ' || name || ';'"),
        D.SQLITE: ("'INSERT INTO SQLITE_SEQUENCE(NAME, SEQ) VALUES (''' || name || ''', 0);'", "''", "'DELETE FROM SQLITE_SEQUENCE WHERE NAME = ''' || name || ''';'"),
    }.get(d, ("''", "''", "''"))
    inline_key = "case when j % 2 = 0 then ',\n  CONSTRAINT PK_' || t || ' PRIMARY KEY (ID)' else '' end"
    part = lambda rows, text, order: f"coalesce((select string_agg(',\n  ' || {text}, '' order by {order}) from {rows}), '')"
    inner = lambda k: f"(select n, t from items where k = {k} and s <> 1) i where i.t = p.t"
    create = f"""'CREATE TABLE ' || {tab} || ' (\n  ID INTEGER NOT NULL,\n  Note VARCHAR(100)' || {part(f"(select * from cols where s <> 1) i where i.t = p.t", column, 'n')} || {inline_key}
        || {part(inner(6), foreign, "'FK' || n") if d == D.SQLITE else "''"} || {part(inner(4), check, "'CK' || n")} || '\n);' || coalesce((select string_agg('\n' || {index}, '' order by 'IX' || n) from {inner(3)}), '')"""
    script = """case when j = 3 then 'BEGIN x :=  ''a  b''; y := ' || n || '; END' else 'BEGIN  y := ' || n || ';' || chr(9) || 'END ' end"""
    trigger = """case when n // 11 % 4 = 3 then 'BEGIN x :=  ''a  b''; y := ' || n || '; END' else 'BEGIN  y := ' || n || ';' || chr(9) || 'END ' end"""
    texts = {
        "CreateTable": create, "DropTable": f"'DROP TABLE ' || {tab} || ';'", "CreateColumn": f"{alter} || ' ADD ' || {column} || ';'", "DropColumn": f"{alter} || ' DROP {'' if d in _FIREBIRDS else 'COLUMN '}' || name || ';'",
        "AlterColumn": changed, "AlterDefaultValue": "''" if d == D.SQLITE else set_default, "DropDefaultValue": "''" if d == D.SQLITE else drop_default,
        "CreatePrimaryKey": f"{alter} || ' ADD CONSTRAINT PK_' || t || ' PRIMARY KEY (ID);'",
        "DropPrimaryKey": f"{alter} || ' DROP PRIMARY KEY;'" if d in (D.POSTGRESQL, D.MYSQL, D.ORACLE) else f"{alter} || ' DROP CONSTRAINT ' || case when j % 12 = 0 then 'OLD_PK' else name end || ';'",
        "CreateIndexe": index, "DropIndexe": "'DROP INDEX ' || name || ';'" if d in (*_FIREBIRDS, D.POSTGRESQL, D.ORACLE, D.SQLITE) else f"{alter} || ' DROP INDEX ' || name || ';'" if d == D.MYSQL else f"'DROP INDEX ' || name || ' ON ' || {tab} || ';'",
        "CreateForeignKey": "''" if d == D.SQLITE else f"{alter} || ' ADD ' || {foreign} || '{' ENABLE VALIDATE' if d == D.ORACLE else ''};'", "DropForeignKey": drop_constraint,
        "CreateCheck": f"{alter} || ' ADD ' || {check} || ';'", "AlterCheck": f"{drop_constraint} || {alter} || ' ADD ' || {check} || ';'", "DropCheck": drop_constraint,
        "CreateTrigger": f"'CREATE TRIGGER ' || name || ' AS ' || {trigger} || ';'", "DropTrigger": "'DROP TRIGGER ' || name || ';'",
        "CreateView": "'CREATE VIEW ' || name || ' AS SELECT ' || n || case when j = 3 then ' AS  a' else ' AS b  ' end || ';'", "DropView": "'DROP VIEW ' || name || ';'",
        "CreateSequence": sequences[0], "AlterSequence": sequences[1], "DropSequence": sequences[2],
        "CreateDomain": "'CREATE DOMAIN ' || name || ' AS INTEGER' || case when n % 3 = 0 then ' DEFAULT 1' else '' end || case when n % 2 = 0 then ' NOT NULL' else '' end || case when n % 5 = 0 then ' CHECK (VALUE > 0)' else '' end || ';'",
        "DropDomain": "'DROP DOMAIN ' || name || ';'", "CreateProcedure": script, "DropProcedure": "case when n % 3 = 0 then 'DROP FUNCTION ' else 'DROP PROCEDURE ' end || name || case when n % 2 = 0 then '(int)' else '' end || ';'",
        "SetTableComment": f"'COMMENT ON TABLE ' || {tab} || ' IS ''about ' || t || ''';'", "SetColumnComment": f"'COMMENT ON COLUMN ' || {tab} || '.' || name || ' IS ''col ' || n || ''';'",
    }
    gated = {"Sequence": "sequences", "Domain": "domains", "Procedure": "procedures", "View": "views", "Trigger": "triggers", "Check": "checks"}
    has = D.FEATURES[d]
    left_out = [op for op in texts for word, feature in gated.items() if op.endswith(word) and feature not in has] + [op for op in texts if op.endswith("Comment") and "comments" not in has]
    cases = " ".join(f"when '{op}' then {text}" for op, text in texts.items())
    phases = " ".join(f"when '{op}' then '{phase}'" for phase, own in _OF_PHASE.items() for op in own)
    guards = "".join(f" union all select '{'Pre' if state == 'Off' else 'Post'}', '{op}', '', '{state}', '{sql}'" for op, state, sql in _GUARDS.get(d, []))
    shown = "case when op = 'DropPrimaryKey' and j % 12 = 0 then 'OLD_PK' else name end"
    out = f" and op not in ({', '.join(map(repr, left_out))})" if left_out else ""
    only_new = " and not (op = 'AlterSequence')" if d == D.SQLITE else ""
    return f"""{_PLAN_OPS}, rendered as (select case op {phases} end as phase, op, t as table_name, {shown} as name, case op {cases} end as sql from plan p where true{out}{only_new})
    select * from rendered where sql <> ''{guards}"""


def _plan(spark: SparkSession, sf_dir: str, dialect: str, **options) -> Plan:
    desired, current, rows = compared(spark, sf_dir)
    return compare(desired, current, CompareOptions(dialect, schema=SCHEMA, compare_descriptions=True, **options), rows)


def _ddl_query(dialect: str) -> None:
    guards = "" if dialect in _GUARDS else " and phase not in ('Pre', 'Post')"

    @query(f"ddl_{dialect.lower()}", ddl_sql(dialect))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plan(spark, sf_dir, dialect).commands.filter(f"sql <> ''{guards}").select("phase", "op", "table_name", "name", "sql")


for _dialect in D.DIALECTS:
    _ddl_query(_dialect)


# A dialect that is none of the library's.

_TERSE = "Terse"
D.register(D.Dialect(
    _TERSE, frozenset({"foreign_keys", "checks", "views", "comments"}), {"CreateColumn": "+ {table} {name} {type}{default_clause}{not_null}", "DropColumn": "- {table} {name}", "AlterColumn": "~ {table} {name} {type}{not_null}", "CreateIndexe": "+ {unique}{name} on {table}: {columns}"},
    {"ftInteger": "NUM"}, quotes=("<", ">"),
))


@query(
    "ddl_registered",
    f"""{_PLAN_OPS} select op, t as table_name, name, case op when 'CreateColumn' then '+ <app>.<' || t || '> ' || name || ' ' || ty || case when def <> '' then ' DEFAULT ' || def else '' end || nn when 'DropColumn' then '- <app>.<' || t || '> ' || name
        when 'AlterColumn' then '~ <app>.<' || t || '> ' || name || ' ' || ty || nn else '+ ' || case when n % 2 = 0 then 'UNIQUE ' else '' end || name || ' on <app>.<' || t || '>: ID' || case when n % 3 = 0 then ', Note' else '' end end as sql
    from plan where op in ('CreateColumn', 'DropColumn', 'AlterColumn', 'CreateIndexe')""",
)
def ddl_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a dialect that a user has added as data."""
    return _plan(spark, sf_dir, _TERSE).commands.filter("op in ('CreateColumn', 'DropColumn', 'AlterColumn', 'CreateIndexe')").select("op", "table_name", "name", "sql")


# Statements of rebuilds and positions.

_REBUILDING = (D.FIREBIRD, D.FIREBIRD3, D.INTERBASE, D.POSTGRESQL, D.MYSQL, D.MSSQL, D.ORACLE, D.SPARK)


def rebuild_sql(d: str) -> str:
    """DuckDB SQL for the statements of rebuilt and backfilled columns."""
    a, z = {D.POSTGRESQL: ('"', '"'), D.MSSQL: ("[", "]"), D.SPARK: ("`", "`")}.get(d, ("", ""))
    tab, new = f"'{a}{SCHEMA}{z}.{a}' || t || '{z}'", "name || '_MDBTMP'"
    cast = "case when c in (1, 4) then 'CHAR(40)' when c = 2 then 'DECIMAL(12,2)' when c = 3 then 'DATE' else 'SIGNED' end" if d == D.MYSQL else "ty"
    rename = f"'ALTER TABLE ' || {tab} || ' RENAME COLUMN ' || {new} || ' TO ' || name || ';'"
    if d in D.FIREBIRD_FAMILY:
        rename = f"'ALTER TABLE ' || {tab} || ' ALTER COLUMN ' || {new} || ' TO ' || name || ';'"
    elif d == D.MSSQL:
        rename = f"'EXEC sp_rename ' || chr(39) || {tab} || '.' || {new} || chr(39) || ', ' || chr(39) || name || chr(39) || ', ' || chr(39) || 'COLUMN' || chr(39) || ';'"
    texts = {
        "CreateColumnRebuild": f"'ALTER TABLE ' || {tab} || ' ADD ' || {new} || ' ' || ty || ';'", "CopyColumnData": f"'UPDATE ' || {tab} || ' SET ' || {new} || ' = CAST(' || name || ' AS ' || {cast} || ');'",
        "DropColumnRebuild": f"'ALTER TABLE ' || {tab} || ' DROP {'' if d in D.FIREBIRD_FAMILY else 'COLUMN '}' || name || ';'", "RenameColumn": rename, "BackfillColumnData": f"'UPDATE ' || {tab} || ' SET ' || name || ' = ' || def || ' WHERE ' || name || ' IS NULL;'",
    }
    cases = " ".join(f"when '{op}' then {text}" for op, text in texts.items())
    steps = f"case when v = 0 and {'true' if d in D.FIREBIRD_FAMILY else 'c in (1, 2, 4)'} then {_REBUILT} when v = 1 and c in (4, 5) then ['BackfillColumnData'] else [] end"
    return f"{_ITEMS}, steps as (select *, unnest({steps}) as step from ops where op = 'AlterColumn') select '{d}' as dialect, step as op, t as table_name, name, case step {cases} end as sql from steps"


@query("rebuild_statements", " union all ".join(f"select * from ({rebuild_sql(d)})" for d in _REBUILDING))
def rebuild_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of columns that are rebuilt or filled, in every dialect that can."""
    steps = ("CreateColumnRebuild", "CopyColumnData", "DropColumnRebuild", "RenameColumn", "BackfillColumnData")
    own = lambda d: _plan(spark, sf_dir, d, strategy=REBUILD, policy=frozenset({"AlterColumn", "RebuildColumn"})).commands.filter(F.col("op").isin(*steps)).select(F.lit(d).alias("dialect"), "op", "table_name", "name", "sql")
    return reduce(DataFrame.union, map(own, _REBUILDING))


_MOVED = "select 'T' || range as t, 'Note' as name, 1 as position from range(25) where range % 2 = 1 and range not in (3, 7, 8) union all select t, 'C' || n, n + 10 from items where k < 3 and kept and s <> 1 and j % 2 = 1 union all select t, 'ID', 0 from tabs where kept and j % 2 = 1"


@query("position_statements", f"{_ITEMS} select d as dialect, t as table_name, name, case when d in ('Firebird', 'Firebird3', 'Interbase') then 'ALTER TABLE app.' || t || ' ALTER COLUMN ' || name || ' POSITION ' || (position + 1) || ';' else '' end as sql from ({_MOVED}) cross join (values ('Firebird'), ('Firebird3'), ('Interbase'), ('PostgreSQL'), ('MySQL')) as x(d)")
def position_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are out of place: dialects of one family can move them, others have no statement for it."""
    own = lambda d: _plan(spark, sf_dir, d, compare_positions=True, policy=frozenset({"AlterColumnPosition"})).commands.filter("op = 'AlterColumnPosition'").select(F.lit(d).alias("dialect"), "table_name", "name", "sql")
    return reduce(DataFrame.union, [own(d) for d in (D.FIREBIRD, D.FIREBIRD3, D.INTERBASE, D.POSTGRESQL, D.MYSQL)])
