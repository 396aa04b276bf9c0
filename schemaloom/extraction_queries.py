"""Queries over what system tables give: rows shaped like a database's answers, made of the rows of `part` by fixed rules, are decoded to a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dialects as D
from .operators.objects import objects
from .query_base import _table, query
from .sources.system_tables import DOMAIN_TYPES, NATIVE_TYPES, QUERIES, decoded

DETAILS = {
    "table": ("description",), "column": ("position", "field_type", "type_name", "size", "precision", "scale", "not_null", "auto_increment", "default_value", "charset", "description"), "primary_key": ("columns",),
    "index": ("is_unique", "columns"), "foreign_key": ("parent_table", "parent_key", "on_update", "on_delete", "columns", "to_columns"), "check": ("condition",), "view": ("script",), "sequence": ("table_name", "initial_value", "increment"),
    "domain": ("type_name", "not_null", "default_value", "check_condition"), "procedure": ("signature", "is_function", "script"),
}
_RULES = {D.MSSQL: ["0", "1", "2", "3"]}
_DOMAINS = [*DOMAIN_TYPES, "8.5", "99.0"]


# What some types of each database are to become, written out here and not taken from the library's maps.
_EXPECTED: dict[str, dict[str, tuple[str, str]]] = {
    D.POSTGRESQL: {"VARCHAR": ("ftString", "VARCHAR(%l)"), "INT8": ("ftLargeint", "BIGINT"), "BYTEA": ("ftBlob", "BYTEA"), "NUMERIC": ("ftFloat", "NUMERIC(%p,%s)"), "MONEY": ("ftCurrency", "MONEY"), "TIMESTAMP": ("ftTimeStamp", "TIMESTAMP"), "TEXT": ("ftWideMemo", "TEXT"), "BPCHAR": ("ftFixedChar", "CHAR(%l)")},
    D.MYSQL: {"VARCHAR": ("ftString", "VARCHAR(%l)"), "INT": ("ftInteger", "INT"), "DATETIME": ("ftDateTime", "DATETIME"), "DOUBLE": ("ftExtended", "DOUBLE"), "DECIMAL": ("ftBCD", "DECIMAL(%p,%s)"), "TINYINT": ("ftSmallint", "SMALLINT"), "BIGINT": ("ftLargeint", "NUMERIC(%l)")},
    D.MSSQL: {"NVARCHAR": ("ftWideString", "NVARCHAR(%l)"), "INT": ("ftInteger", "INT"), "BIT": ("ftBoolean", "BIT"), "FLOAT": ("ftFloat", "FLOAT"), "IMAGE": ("ftGraphic", "IMAGE"), "VARBINARY": ("ftBlob", "VARBINARY(MAX)"), "GUID": ("ftGuid", "GUID")},
    D.ORACLE: {"VARCHAR2": ("ftString", "VARCHAR2(%l)"), "DATE": ("ftDateTime", "DATE"), "CLOB": ("ftMemo", "CLOB"), "NCLOB": ("ftWideMemo", "NCLOB"), "BLOB": ("ftOraBlob", "BLOB"), "RAW": ("ftGuid", "NCHAR(%l)"), "CHAR": ("ftFixedChar", "CHAR(%l)")},
    **dict.fromkeys(D.FIREBIRD_FAMILY, {"8": ("ftInteger", "INTEGER"), "16": ("ftLargeint", "BIGINT"), "37": ("ftString", "VARCHAR(%l)"), "261": ("ftMemo", "BLOB SUB_TYPE 1"), "27": ("ftExtended", "DOUBLE PRECISION"), "35": ("ftTimeStamp", "TIMESTAMP"), "14": ("ftFixedChar", "CHAR(%l)"), "16.2": ("ftBCD", "DECIMAL(%p,%s)")}),
}


def _expected(dialect: str, native: str) -> tuple[str, str]:
    logical = NATIVE_TYPES[dialect][native]
    return _EXPECTED[dialect].get(native, (logical, {**D.TYPE_TEMPLATES, **D.TYPE_EXCEPTIONS[dialect]}[logical]))


def _natives(dialect: str) -> list[str]:
    return list(NATIVE_TYPES[dialect])


def _array(texts: list[str]) -> str:
    return "array(" + ", ".join(repr(t) for t in texts) + ")"


def _reads_expressions(dialect: str) -> bool:
    return "expression" in QUERIES[dialect]["indexes"]


def raw(spark: SparkSession, sf_dir: str, dialect: str) -> dict[str, DataFrame]:
    """Answers to the dialect's queries."""
    part = _table(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as n").selectExpr("n", "concat('Tab', n % 25) as t", "n % 11 as k")
    tables = spark.range(25).selectExpr("cast(id as int) as j", "concat('Tab', id) as t")
    given = "'(( 7 ))'" if dialect == D.MSSQL else "' default 7'" if dialect in D.FIREBIRD_FAMILY else "'7'"
    natives, rules = _natives(dialect), _RULES.get(dialect, ["NO ACTION", "CASCADE", "SET NULL", "SET DEFAULT"])
    name = lambda prefix: f"concat('{prefix}', n) as name"
    two = "inline(array(named_struct('column_name', 'b', 'position', 2), named_struct('column_name', 'a', 'position', 1)))"
    found = {
        "tables": tables.selectExpr("t as table_name", "if(j % 2 = 0, concat('about ', j), null) as description"),
        "columns": part.selectExpr(
            "t as table_name", "concat('c', n) as column_name", "n as position", f"element_at({_array(natives)}, n % {len(natives)} + 1) as native_type", f"if({str(dialect == D.MSSQL).lower()} and n % 7 = 0, -1, n % 50 + 1) as size", "if(n % 9 = 0, null, n % 9) as precision",
            "n % 3 as scale", "n % 2 as not_null", "if(n % 4 = 0, 1, 0) as auto_increment", f"case n % 5 when 1 then '0.000' when 2 then {given} when 3 then \"'x'\" when 4 then ' now() ' end as default_value", "if(n % 6 = 0, 'UTF8', null) as charset", "if(n % 8 = 0, 'told', null) as description",
        ),
        "primary_keys": tables.selectExpr("t as table_name", "concat('PK_', t) as pk_name", two),
        "foreign_keys": part.filter("k = 6").selectExpr("t as table_name", name("fk"), "'x' as column_name", "1 as position", "'Tab0' as parent_table", "'id' as parent_column", f"element_at({_array(rules)}, n % 4 + 1) as on_update", f"element_at({_array(rules)}, cast(n div 4 % 4 as int) + 1) as on_delete"),
        "indexes": part.filter("k = 3").selectExpr("t as table_name", name("ix"), "n % 2 as is_unique", "n", two).selectExpr("*", *(["if(n % 2 = 0 and position = 1, 'upper( a )', null) as expression"] if _reads_expressions(dialect) else [])),
        "checks": part.filter("k = 4").selectExpr("t as table_name", name("ck"), "concat('CHECK ((a > ', n, '))') as condition"),
        "views": part.filter("k = 7").selectExpr(name("v"), "if(n % 2 = 0, concat('CREATE VIEW [dbo].[v] AS  SELECT ', n), concat('SELECT ', n)) as script"),
        "sequences": part.filter("k = 8").selectExpr(name("s"), "'' as table_name", "n as initial_value", "if(n % 5 = 0, null, n % 5) as increment"),
        "procedures": part.filter("k = 10").selectExpr(name("p"), "if(n % 2 = 0, 'int', '') as signature", "n % 2 as is_function", "concat('BEGIN ', n, ' END') as script"),
    }
    domains = part.filter("k = 9").selectExpr(
        name("d"), "n", "n % 20 as size", "n % 7 as precision", "n % 4 as scale", f"element_at({_array(_DOMAINS)}, n % {len(_DOMAINS)} + 1) as domain_type", "concat('varchar(', n, ')') as type_name", "n % 2 as not_null", "if(n % 2 = 0, 'DEFAULT 1', null) as default_value",
        "explode(case n % 3 when 0 then array(null) when 1 then array('CHECK ((VALUE > 0))') else array('CHECK ((VALUE > 1))', 'CHECK (VALUE < 9)') end) as check_condition",
    )
    found["domains"] = domains.drop("type_name" if dialect in D.FIREBIRD_FAMILY else "domain_type")
    return {k: v for k, v in found.items() if k in QUERIES[dialect]}


def extraction_sql(d: str) -> str:
    has, firebird = QUERIES[d], d in D.FIREBIRD_FAMILY
    templates = {**D.TYPE_TEMPLATES, **D.TYPE_EXCEPTIONS[d]}
    natives = _natives(d)
    types = ", ".join("({}, '{}', '{}')".format(k, *_expected(d, x)) for k, x in enumerate(natives))
    kind = f"case when f.native = {natives.index('NUMBER')} and n % 9 = 0 then 'ftInteger' else f.ft end" if d == D.ORACLE else "f.ft"
    template = "case when f.ft = 'ftString' and n % 7 = 0 then 'VARCHAR(MAX)' else f.template end" if d == D.MSSQL else f"case when f.native = {natives.index('NUMBER')} and n % 9 = 0 then '{templates['ftInteger']}' else f.template end" if d == D.ORACLE else "f.template"
    default = f"""case n % 5 when 1 then '0' when 2 then '{' 7 ' if d == D.MSSQL else '7'}' when 3 then '''{'X' if firebird else 'x'}''' when 4 then '{'now' if d == D.MSSQL else 'NOW()' if firebird else 'now()'}' else '' end"""
    size = "case when n % 7 = 0 then -1 else n % 50 + 1 end" if d == D.MSSQL else "n % 50 + 1"
    rule = lambda x: f"case {x} when 1 then 'Cascade' when 2 then 'SetNull' when 3 then 'SetDefault' else 'None' end"
    first, first_key = ("case when n % 2 = 0 then 'upper( a )' else 'a' end", "case when n % 2 = 0 then 'UPPER(A)' else 'A' end") if _reads_expressions(d) else ("'a'", "'A'")
    domains = ", ".join(f"({k}, '{DOMAIN_TYPES.get(x, DOMAIN_TYPES.get(x.split('.')[0] + '.0', 'VARCHAR(%l)'))}')" for k, x in enumerate(_DOMAINS))
    domain_type = f"(select replace(replace(replace(x.template, '%l', (n % 20)::varchar), '%p', (n % 7)::varchar), '%s', (n % 4)::varchar) from (values {domains}) as x(k, template) where x.k = n % {len(_DOMAINS)})" if firebird else "'varchar(' || n || ')'"
    truth = lambda x: f"case when {x} then 'true' else 'false' end"
    parts = {
        "tables": "select 'table' as kind, upper(t) as table_key, '' as object_key, t as name, case when j % 2 = 0 then 'about ' || j else '' end as detail from tabs",
        "columns": f"select 'column', upper(t), 'C' || n, 'c' || n, concat_ws('|', n, {kind}, {template}, {size}, n % 9, n % 3, {truth('n % 2 = 1')}, {truth('n % 4 = 0')}, {default}, case when n % 6 = 0 then 'UTF8' else '' end, case when n % 8 = 0 then 'told' else '' end) from items join (values {types}) as f(native, ft, template) on f.native = n % {len(natives)}",
        "primary_keys": "select 'primary_key', upper(t), '', 'PK_' || t, 'a, b' from tabs",
        "foreign_keys": f"select 'foreign_key', upper(t), 'FK' || n, 'fk' || n, concat_ws('|', 'Tab0', 'TAB0', {rule('n % 4')}, {rule('n // 4 % 4')}, 'x', 'id') from items where k = 6",
        "indexes": f"select 'index', upper(t), 'IX' || n, 'ix' || n, concat_ws('|', {truth('n % 2 = 1')}, {first} || ', b', {first_key} || ', B') from items where k = 3",
        "checks": f"select 'check', upper(t), 'CK' || n, 'ck' || n, {"'CHECK ((a > ' || n || '))'" if d == D.ORACLE else "'a > ' || n"} from items where k = 4",
        "views": "select 'view', '', 'V' || n, 'v' || n, 'SELECT ' || n from items where k = 7",
        "sequences": "select 'sequence', '', 'S' || n, 's' || n, concat_ws('|', '', n, n % 5) from items where k = 8",
        "domains": f"select 'domain', '', 'D' || n, 'd' || n, concat_ws('|', {domain_type}, {truth('n % 2 = 1')}, case when n % 2 = 0 then '1' else '' end, case n % 3 when 0 then '' when 1 then 'VALUE > 0' else '(VALUE < 9) AND (VALUE > 1)' end) from items where k = 9",
        "procedures": f"select 'procedure', '', 'P' || n || case when n % 2 = 0 then '(INT)' else '' end, 'p' || n, concat_ws('|', case when n % 2 = 0 then 'int' else '' end, {truth('n % 2 = 1')}, 'BEGIN ' || n || ' END') from items where k = 10",
    }
    return "with items as (select p_partkey as n, 'Tab' || p_partkey % 25 as t, p_partkey % 11 as k from part), tabs as (select range as j, 'Tab' || range as t from range(25)) " + " union all ".join(text for relation, text in parts.items() if relation in has)


def _extraction_query(dialect: str) -> None:
    @query(f"extract_{dialect.lower()}", extraction_sql(dialect))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = objects(decoded(spark, raw(spark, sf_dir, dialect), dialect))
        details = " ".join(f"when '{kind}' then concat_ws('|', {', '.join(f'attrs[{c!r}]' for c in columns)})" for kind, columns in DETAILS.items())
        return rows.selectExpr("kind", "table_key", "object_key", "name", f"concat_ws('|', case kind {details} end, if(kind = 'index', array_join(members, ', '), null)) as detail")


for _dialect in QUERIES:
    _extraction_query(_dialect)
