"""Catalogs of databases from their system tables: one set-based query for each relation, whatever the number of tables.

read takes a query and gives a DataFrame; jdbc_reader makes one of Spark's JDBC source, so that the database does the filtering and joins and
Spark reads the results. All queries return the same column names, and one decoder serves all dialects.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dialects as D
from ..functions import normalize
from ..functions.keys import ascii_upper, qualified_key, routine_key, valid_schema_name
from ..functions.render import choice
from ..functions.types import type_template
from ..relations import Catalog

Reader = Callable[[str], DataFrame]

# Logical types of the names that databases give.
NATIVE_TYPES: dict[str, dict[str, str]] = {
    D.POSTGRESQL: {
        "VARCHAR": "ftString", "REAL": "ftFloat", "DOUBLE PRECISION": "ftExtended", "CHAR": "ftFixedChar", "DECIMAL": "ftBCD", "NUMERIC": "ftFloat", "TEXT": "ftWideMemo", "SMALLINT": "ftSmallint", "INT": "ftInteger", "BIGINT": "ftLargeint",
        "INT4": "ftInteger", "INT8": "ftLargeint", "BYTEA": "ftBlob", "BOOL": "ftBoolean", "TIMESTAMP": "ftTimeStamp", "DATE": "ftDate", "TIME": "ftTime",
        "INT2": "ftSmallint", "FLOAT4": "ftFloat", "FLOAT8": "ftExtended", "BPCHAR": "ftFixedChar", "TIMESTAMPTZ": "ftTimeStampOffset", "MONEY": "ftCurrency",
    },
    D.MYSQL: {
        "BIGINT": "ftLargeint", "BINARY": "ftSmallint", "BIT": "ftSmallint", "BLOB": "ftMemo", "BOOLEAN": "ftBoolean", "CHAR": "ftFixedChar", "DATE": "ftDate", "DATETIME": "ftDateTime", "DECIMAL": "ftBCD", "DOUBLE PRECISION": "ftExtended", "DOUBLE": "ftExtended",
        "FLOAT": "ftFloat", "FLOAT4": "ftFloat", "FLOAT8": "ftFloat", "INT": "ftInteger", "INTEGER": "ftInteger", "INT1": "ftSmallint", "INT2": "ftSmallint", "TINYINT": "ftSmallint", "NCHAR": "ftFixedWideChar", "NVARCHAR": "ftWideString",
        "VARCHAR": "ftString", "REAL": "ftFloat", "NUMERIC": "ftFloat", "TEXT": "ftWideMemo", "SMALLINT": "ftSmallint", "TIMESTAMP": "ftTimeStamp", "TIME": "ftTime",
    },
    D.MSSQL: {
        "BIGINT": "ftLargeint", "BINARY": "ftSmallint", "CHAR": "ftFixedChar", "DATE": "ftDate", "SMALLDATETIME": "ftDateTime", "DATETIME": "ftDateTime", "DATETIME2": "ftDateTime", "DECIMAL": "ftBCD", "DOUBLE PRECISION": "ftExtended", "FLOAT": "ftFloat",
        "TINYINT": "ftInteger", "INT": "ftInteger", "INTEGER": "ftInteger", "NCHAR": "ftFixedWideChar", "NVARCHAR": "ftWideString", "VARCHAR": "ftString", "REAL": "ftFloat", "MONEY": "ftBCD", "NUMERIC": "ftFloat", "VARCHAR(MAX)": "ftWideMemo",
        "TEXT": "ftMemo", "NTEXT": "ftWideMemo", "SMALLINT": "ftSmallint", "TIME": "ftTime", "GUID": "ftGuid", "VARBINARY": "ftBlob", "VARBINARY(MAX)": "ftBlob", "IMAGE": "ftGraphic", "BIT": "ftBoolean",
    },
    D.ORACLE: {
        "CHAR": "ftFixedChar", "BINARY_FLOAT": "ftFloat", "BINARY_DOUBLE": "ftBCD", "BOOLEAN": "ftBoolean", "VARCHAR2": "ftString", "NCHAR": "ftFixedWideChar", "NVARCHAR": "ftWideString", "NVARCHAR2": "ftWideString", "NUMBER": "ftCurrency", "DATE": "ftDateTime",
        "CLOB": "ftMemo", "NCLOB": "ftWideMemo", "BLOB": "ftOraBlob", "TIMESTAMP": "ftTimeStamp", "TIMESTAMP(6)": "ftTimeStamp", "FLOAT": "ftFloat", "BFILE": "ftWideString", "LONG": "ftMemo", "UROWID": "ftWideString", "ROWID": "ftWideString", "RAW": "ftGuid", "LONG RAW": "ftGuid",
    },
    D.SQLITE: {
        "INTEGER": "ftInteger", "DATE": "ftDate", "INT": "ftInteger", "BIGINT": "ftLargeint", "SMALLINT": "ftSmallint", "CHAR": "ftFixedChar", "VARCHAR": "ftString", "NVARCHAR": "ftWideString", "CLOB": "ftMemo", "BLOB": "ftMemo", "TEXT": "ftMemo", "FLOAT": "ftFloat",
        "REAL": "ftFloat", "BOOLEAN": "ftBoolean", "TIME": "ftTime", "DATETIME": "ftDateTime", "TIMESTAMP": "ftTimeStamp", "NUMERIC": "ftBCD", "DECIMAL": "ftBCD", "GUID": "ftGuid",
    },
    D.FIREBIRD: {
        "7": "ftSmallint", "8": "ftInteger", "10": "ftFloat", "12": "ftDate", "13": "ftTime", "14": "ftFixedChar", "16": "ftLargeint", "16.1": "ftCurrency", "16.2": "ftBCD", "17": "ftBoolean", "23": "ftBoolean", "27": "ftExtended", "35": "ftTimeStamp",
        "37": "ftString", "40": "ftWideString", "261": "ftMemo", "261.0": "ftBlob",
    },
}
NATIVE_TYPES[D.FIREBIRD3] = NATIVE_TYPES[D.INTERBASE] = NATIVE_TYPES[D.FIREBIRD]

_SYSTEM = "('pg_catalog', 'information_schema')"
# {schema} becomes a condition on the column before it, or nothing.
QUERIES: dict[str, dict[str, str]] = {
    D.POSTGRESQL: {
        "tables": f"select table_schema as schema_name, table_name, '' as description from information_schema.tables where table_type = 'BASE TABLE' and table_schema not in {_SYSTEM}{{schema:table_schema}}",
        "columns": "select c.table_schema as schema_name, c.table_name, c.column_name, c.ordinal_position - 1 as position, upper(c.udt_name) as native_type, c.character_maximum_length as size, c.numeric_precision as precision, c.numeric_scale as scale, "
        "case when c.is_nullable = 'NO' then 1 else 0 end as not_null, 0 as auto_increment, c.column_default as default_value, c.character_set_name as charset, '' as description "
        f"from information_schema.columns c join information_schema.tables t on t.table_schema = c.table_schema and t.table_name = c.table_name and t.table_type = 'BASE TABLE' where c.table_schema not in {_SYSTEM}{{schema:c.table_schema}}",
        "primary_keys": "select k.table_schema as schema_name, k.table_name, 'PK_' || k.table_name as pk_name, k.column_name, k.ordinal_position as position from information_schema.key_column_usage k join information_schema.table_constraints t "
        f"on t.constraint_schema = k.constraint_schema and t.table_name = k.table_name and t.constraint_name = k.constraint_name where t.constraint_type = 'PRIMARY KEY' and t.table_schema not in {_SYSTEM}{{schema:t.table_schema}}",
        "foreign_keys": "select k.table_schema as schema_name, k.table_name, k.constraint_name as name, k.column_name, k.ordinal_position as position, u.table_schema as parent_schema, u.table_name as parent_table, u.column_name as parent_column, r.update_rule as on_update, r.delete_rule as on_delete "
        "from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_schema = k.constraint_schema and r.constraint_name = k.constraint_name "
        "join information_schema.key_column_usage u on u.constraint_schema = r.unique_constraint_schema and u.constraint_name = r.unique_constraint_name and u.ordinal_position = k.position_in_unique_constraint "
        f"where k.table_schema not in {_SYSTEM}{{schema:k.table_schema}}",
        "indexes": "select n.nspname as schema_name, t.relname as table_name, i.relname as name, case when x.indisunique then 1 else 0 end as is_unique, a.attname as column_name, k.ord as position, "
        "case when k.attnum = 0 then pg_get_indexdef(x.indexrelid, cast(k.ord as integer), true) end as expression from pg_index x join pg_class t on t.oid = x.indrelid "
        "join pg_class i on i.oid = x.indexrelid join pg_namespace n on n.oid = t.relnamespace cross join lateral unnest(x.indkey) with ordinality as k(attnum, ord) left join pg_attribute a on a.attrelid = t.oid and a.attnum = k.attnum and k.attnum <> 0 "
        f"where not x.indisprimary and k.ord <= x.indnkeyatts and n.nspname not in {_SYSTEM}{{schema:n.nspname}}",
        "checks": f"select n.nspname as schema_name, t.relname as table_name, c.conname as name, pg_get_constraintdef(c.oid) as condition from pg_constraint c join pg_class t on t.oid = c.conrelid join pg_namespace n on n.oid = c.connamespace where c.contype = 'c' and n.nspname not in {_SYSTEM}{{schema:n.nspname}}",
        "views": f"select table_schema as schema_name, table_name as name, view_definition as script from information_schema.views where table_schema not in {_SYSTEM} and table_name !~ '^pg_'{{schema:table_schema}}",
        "sequences": "select schemaname as schema_name, sequencename as name, '' as table_name, start_value as initial_value, increment_by as increment from pg_sequences where 1 = 1{schema:schemaname}",
        "domains": "select n.nspname as schema_name, t.typname as name, format_type(t.typbasetype, t.typtypmod) as type_name, case when t.typnotnull then 1 else 0 end as not_null, t.typdefault as default_value, pg_get_constraintdef(c.oid) as check_condition "
        f"from pg_type t join pg_namespace n on n.oid = t.typnamespace left join pg_constraint c on c.contypid = t.oid where t.typtype = 'd' and n.nspname not in {_SYSTEM}{{schema:n.nspname}}",
        "procedures": "select n.nspname as schema_name, p.proname as name, pg_get_function_identity_arguments(p.oid) as signature, case when p.prokind = 'f' then 1 else 0 end as is_function, pg_get_functiondef(p.oid) as script "
        f"from pg_proc p join pg_namespace n on n.oid = p.pronamespace where p.prokind in ('p', 'f') and n.nspname not in {_SYSTEM}{{schema:n.nspname}}",
    },
    D.MYSQL: {
        "tables": "select table_name, table_comment as description from information_schema.tables where table_type = 'BASE TABLE' and table_schema = database()",
        "columns": "select table_name, column_name, ordinal_position - 1 as position, upper(data_type) as native_type, character_maximum_length as size, numeric_precision as `precision`, numeric_scale as scale, case when is_nullable = 'NO' then 1 else 0 end as not_null, "
        "case when extra like '%auto_increment%' then 1 else 0 end as auto_increment, column_default as default_value, '' as charset, column_comment as description from information_schema.columns where table_schema = database()",
        "primary_keys": "select table_name, concat('PK_', table_name) as pk_name, column_name, ordinal_position as position from information_schema.key_column_usage where constraint_name = 'PRIMARY' and table_schema = database()",
        "foreign_keys": "select k.table_name, k.constraint_name as name, k.column_name, k.ordinal_position as position, k.referenced_table_name as parent_table, k.referenced_column_name as parent_column, r.update_rule as on_update, r.delete_rule as on_delete "
        "from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_schema = k.constraint_schema and r.constraint_name = k.constraint_name and r.table_name = k.table_name where k.table_schema = database()",
        "indexes": "select table_name, index_name as name, 1 - non_unique as is_unique, column_name, seq_in_index as position, expression from information_schema.statistics where index_name <> 'PRIMARY' and table_schema = database()",
        "views": "select table_name as name, view_definition as script from information_schema.views where table_schema = database()",
        "procedures": "select routine_name as name, '' as signature, case when routine_type = 'FUNCTION' then 1 else 0 end as is_function, concat('CREATE ', routine_type, ' ', routine_name, '() ', routine_definition) as script "
        "from information_schema.routines where routine_schema = database() and trim(coalesce(routine_definition, '')) <> ''",
    },
    D.MSSQL: {
        "tables": "select schema_name(o.schema_id) as schema_name, o.name as table_name, cast(e.value as nvarchar(4000)) as description from sys.tables o left join sys.extended_properties e on e.class = 1 and e.major_id = o.object_id and e.minor_id = 0 and e.name = 'MS_Description' where o.is_ms_shipped = 0{schema:schema_name(o.schema_id)}",
        "columns": "select schema_name(o.schema_id) as schema_name, o.name as table_name, c.name as column_name, c.column_id - 1 as position, upper(y.name) as native_type, case when c.max_length = -1 then -1 when y.name in ('nchar', 'nvarchar') then c.max_length / 2 else c.max_length end as size, "
        "c.precision, c.scale, case when c.is_nullable = 0 then 1 else 0 end as not_null, cast(c.is_identity as int) as auto_increment, d.definition as default_value, '' as charset, cast(e.value as nvarchar(4000)) as description from sys.tables o join sys.columns c on c.object_id = o.object_id "
        "join sys.types y on y.user_type_id = c.user_type_id left join sys.default_constraints d on d.object_id = c.default_object_id left join sys.extended_properties e on e.class = 1 and e.major_id = o.object_id and e.minor_id = c.column_id and e.name = 'MS_Description' where o.is_ms_shipped = 0{schema:schema_name(o.schema_id)}",
        "primary_keys": "select schema_name(o.schema_id) as schema_name, o.name as table_name, x.name as pk_name, c.name as column_name, i.key_ordinal as position from sys.indexes x join sys.tables o on o.object_id = x.object_id join sys.index_columns i on i.object_id = x.object_id and i.index_id = x.index_id "
        "join sys.columns c on c.object_id = i.object_id and c.column_id = i.column_id where x.is_primary_key = 1{schema:schema_name(o.schema_id)}",
        "foreign_keys": "select schema_name(o.schema_id) as schema_name, o.name as table_name, f.name, c.name as column_name, k.constraint_column_id as position, schema_name(p.schema_id) as parent_schema, p.name as parent_table, q.name as parent_column, cast(f.update_referential_action as varchar(2)) as on_update, cast(f.delete_referential_action as varchar(2)) as on_delete from sys.foreign_keys f "
        "join sys.foreign_key_columns k on k.constraint_object_id = f.object_id join sys.tables o on o.object_id = f.parent_object_id join sys.columns c on c.object_id = k.parent_object_id and c.column_id = k.parent_column_id "
        "join sys.tables p on p.object_id = f.referenced_object_id join sys.columns q on q.object_id = k.referenced_object_id and q.column_id = k.referenced_column_id where 1 = 1{schema:schema_name(o.schema_id)}",
        "indexes": "select schema_name(o.schema_id) as schema_name, o.name as table_name, x.name, cast(x.is_unique as int) as is_unique, c.name as column_name, i.key_ordinal as position from sys.indexes x join sys.tables o on o.object_id = x.object_id join sys.index_columns i on i.object_id = x.object_id and i.index_id = x.index_id "
        "join sys.columns c on c.object_id = i.object_id and c.column_id = i.column_id where x.type = 2 and x.is_primary_key = 0 and i.is_included_column = 0{schema:schema_name(o.schema_id)}",
        "views": "select schema_name(v.schema_id) as schema_name, v.name, m.definition as script from sys.views v join sys.sql_modules m on m.object_id = v.object_id where v.is_ms_shipped = 0{schema:schema_name(v.schema_id)}",
        "sequences": "select schema_name(schema_id) as schema_name, name, '' as table_name, cast(start_value as bigint) as initial_value, cast(increment as bigint) as increment from sys.sequences where 1 = 1{schema:schema_name(schema_id)}",
        "procedures": "select schema_name(o.schema_id) as schema_name, o.name, '' as signature, case when o.type = 'P' then 0 else 1 end as is_function, m.definition as script from sys.objects o join sys.sql_modules m on m.object_id = o.object_id where o.type in ('P', 'FN', 'IF', 'TF') and o.is_ms_shipped = 0{schema:schema_name(o.schema_id)}",
    },
    D.ORACLE: {
        "tables": "select t.table_name, c.comments as description from user_tables t left join user_tab_comments c on c.table_name = t.table_name where t.table_name not like '%$%'",
        "columns": "select c.table_name, c.column_name, c.column_id - 1 as position, c.data_type as native_type, case when c.data_type like '%LOB' then 0 else c.data_length end as \"SIZE\", c.data_precision as precision, c.data_scale as scale, "
        "case when c.nullable = 'N' then 1 else 0 end as not_null, 0 as auto_increment, c.data_default as default_value, '' as charset, m.comments as description from user_tab_cols c join user_tables t on t.table_name = c.table_name "
        "left join user_col_comments m on m.table_name = c.table_name and m.column_name = c.column_name where c.table_name not like '%$%'",
        "primary_keys": "select c.table_name, c.constraint_name as pk_name, k.column_name, k.position from user_constraints c join user_cons_columns k on k.constraint_name = c.constraint_name where c.constraint_type = 'P'",
        "foreign_keys": "select c.table_name, c.constraint_name as name, k.column_name, k.position, p.table_name as parent_table, q.column_name as parent_column, 'NO ACTION' as on_update, c.delete_rule as on_delete from user_constraints c "
        "join user_cons_columns k on k.constraint_name = c.constraint_name join user_constraints p on p.constraint_name = c.r_constraint_name join user_cons_columns q on q.constraint_name = p.constraint_name and q.position = k.position where c.constraint_type = 'R'",
        "indexes": "select i.table_name, i.index_name as name, case when i.uniqueness = 'UNIQUE' then 1 else 0 end as is_unique, k.column_name, k.column_position as position, e.column_expression as expression from user_indexes i join user_ind_columns k on k.index_name = i.index_name "
        "left join user_ind_expressions e on e.index_name = k.index_name and e.column_position = k.column_position left join user_constraints c on c.index_name = i.index_name and c.constraint_type = 'P' where c.constraint_name is null and i.index_type <> 'LOB'",
        "checks": "select table_name, constraint_name as name, search_condition_vc as condition from user_constraints where constraint_type = 'C' and generated = 'USER NAME'",
        "sequences": "select sequence_name as name, '' as table_name, min_value as initial_value, increment_by as increment from user_sequences",
    },
    D.FIREBIRD: {
        "tables": "select trim(rdb$relation_name) as table_name, rdb$description as description from rdb$relations where rdb$view_blr is null and rdb$system_flag = 0",
        "columns": "select trim(r.rdb$relation_name) as table_name, trim(r.rdb$field_name) as column_name, r.rdb$field_position as position, f.rdb$field_type || case when f.rdb$field_type = 16 and f.rdb$field_sub_type in (1, 2) then '.' || f.rdb$field_sub_type when f.rdb$field_type = 261 and f.rdb$field_sub_type = 0 then '.0' else '' end as native_type, "
        "f.rdb$character_length as size, f.rdb$field_precision as precision, -f.rdb$field_scale as scale, coalesce(r.rdb$null_flag, 0) as not_null, 0 as auto_increment, r.rdb$default_source as default_value, "
        "case when c.rdb$character_set_name = 'OCTETS' then 'OCTETS' else '' end as charset, r.rdb$description as description from rdb$relation_fields r join rdb$relations t on t.rdb$relation_name = r.rdb$relation_name "
        "join rdb$fields f on f.rdb$field_name = r.rdb$field_source left join rdb$character_sets c on c.rdb$character_set_id = f.rdb$character_set_id where t.rdb$view_blr is null and t.rdb$system_flag = 0",
        "primary_keys": "select trim(c.rdb$relation_name) as table_name, trim(c.rdb$constraint_name) as pk_name, trim(s.rdb$field_name) as column_name, s.rdb$field_position as position from rdb$relation_constraints c join rdb$index_segments s on s.rdb$index_name = c.rdb$index_name where c.rdb$constraint_type = 'PRIMARY KEY'",
        "foreign_keys": "select trim(c.rdb$relation_name) as table_name, trim(c.rdb$constraint_name) as name, trim(s.rdb$field_name) as column_name, s.rdb$field_position as position, trim(p.rdb$relation_name) as parent_table, trim(q.rdb$field_name) as parent_column, trim(r.rdb$update_rule) as on_update, trim(r.rdb$delete_rule) as on_delete "
        "from rdb$relation_constraints c join rdb$ref_constraints r on r.rdb$constraint_name = c.rdb$constraint_name join rdb$relation_constraints p on p.rdb$constraint_name = r.rdb$const_name_uq join rdb$index_segments s on s.rdb$index_name = c.rdb$index_name "
        "join rdb$index_segments q on q.rdb$index_name = p.rdb$index_name and q.rdb$field_position = s.rdb$field_position where c.rdb$constraint_type = 'FOREIGN KEY'",
        "indexes": "select trim(i.rdb$relation_name) as table_name, trim(i.rdb$index_name) as name, coalesce(i.rdb$unique_flag, 0) as is_unique, trim(s.rdb$field_name) as column_name, coalesce(s.rdb$field_position, 0) as position, i.rdb$expression_source as expression from rdb$indices i left join rdb$index_segments s on s.rdb$index_name = i.rdb$index_name "
        "left join rdb$relation_constraints c on c.rdb$index_name = i.rdb$index_name where i.rdb$system_flag = 0 and (c.rdb$constraint_type is null or c.rdb$constraint_type = 'UNIQUE')",
        "checks": "select trim(c.rdb$relation_name) as table_name, trim(c.rdb$constraint_name) as name, t.rdb$trigger_source as condition from rdb$relation_constraints c join rdb$check_constraints k on k.rdb$constraint_name = c.rdb$constraint_name "
        "join rdb$triggers t on t.rdb$trigger_name = k.rdb$trigger_name where c.rdb$constraint_type = 'CHECK' and t.rdb$trigger_type = 1",
        "views": "select trim(rdb$relation_name) as name, rdb$view_source as script from rdb$relations where rdb$view_blr is not null and rdb$system_flag = 0",
        "sequences": "select trim(rdb$generator_name) as name, '' as table_name, 0 as initial_value, 0 as increment from rdb$generators where rdb$system_flag = 0",
        "domains": "select trim(rdb$field_name) as name, rdb$field_type || '.' || coalesce(rdb$field_sub_type, 0) as domain_type, rdb$character_length as size, rdb$field_precision as precision, -rdb$field_scale as scale, coalesce(rdb$null_flag, 0) as not_null, rdb$default_source as default_value, rdb$validation_source as check_condition "
        "from rdb$fields where coalesce(rdb$system_flag, 0) = 0 and rdb$field_name not like 'RDB$%' and rdb$field_name not like 'SQL$%'",
        "procedures": "select trim(rdb$procedure_name) as name, '' as signature, 0 as is_function, 'CREATE PROCEDURE ' || trim(rdb$procedure_name) || ' AS ' || rdb$procedure_source as script from rdb$procedures where rdb$system_flag = 0",
    },
}
#: What servers without expressions in indexes answer: MySQL before 8.0.13.
OLDER = {D.MYSQL: {"indexes": QUERIES[D.MYSQL]["indexes"].replace(", expression from", " from")}}
QUERIES[D.FIREBIRD]["view_columns"] = QUERIES[D.FIREBIRD]["columns"].replace("t.rdb$view_blr is null", "t.rdb$view_blr is not null")
QUERIES[D.INTERBASE] = QUERIES[D.FIREBIRD]
QUERIES[D.FIREBIRD3] = {
    **QUERIES[D.FIREBIRD],
    **{n: QUERIES[D.FIREBIRD][n].replace("0 as auto_increment", "case when r.rdb$identity_type is null then 0 else 1 end as auto_increment") for n in ("columns", "view_columns")},
    "sequences": "select trim(rdb$generator_name) as name, '' as table_name, rdb$initial_value as initial_value, rdb$generator_increment as increment from rdb$generators where rdb$system_flag = 0",
    "procedures": QUERIES[D.FIREBIRD]["procedures"] + " union all select trim(rdb$function_name), '', 1, 'CREATE FUNCTION ' || trim(rdb$function_name) || ' AS ' || rdb$function_source "
    "from rdb$functions where coalesce(rdb$system_flag, 0) = 0 and rdb$function_source is not null and rdb$package_name is null",
}
#: What these sources can read, in the terms of CompareOptions.extracted.
_extracted = lambda queries: frozenset({n for n in queries if n in ("checks", "views", "sequences", "domains", "procedures")}) | {"foreign_keys", "comments"}
EXTRACTED = {d: _extracted(q) for d, q in QUERIES.items()}

# Types of Firebird's domains by type and subtype; other subtypes are as 0, other types as text.
DOMAIN_TYPES = {
    "7.0": "SMALLINT", "7.1": "NUMERIC(%p,%s)", "7.2": "DECIMAL(%p,%s)", "8.0": "INTEGER", "8.1": "NUMERIC(%p,%s)", "8.2": "DECIMAL(%p,%s)", "16.0": "BIGINT", "16.1": "NUMERIC(%p,%s)", "16.2": "DECIMAL(%p,%s)",
    "10.0": "FLOAT", "12.0": "DATE", "13.0": "TIME", "14.0": "CHAR(%l)", "27.0": "DOUBLE PRECISION", "35.0": "TIMESTAMP", "37.0": "VARCHAR(%l)", "261.0": "BLOB", "261.1": "BLOB SUB_TYPE 1",
}

_ACTIONS = {"CASCADE": "Cascade", "SET NULL": "SetNull", "SET DEFAULT": "SetDefault", "1": "Cascade", "2": "SetNull", "3": "SetDefault"}


def jdbc_reader(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> Reader:
    return lambda query: spark.read.format("jdbc").options(**(properties or {}), url=url, query=query).load()


#: What every database's queries must answer; other relations are as QUERIES has them.
_REQUIRED = ("tables", "columns", "primary_keys", "foreign_keys", "indexes")


def register_source(dialect: str, queries: Mapping[str, str], native_types: Mapping[str, str]) -> None:
    """Makes the system tables of a registered dialect readable: its queries by relation, with the columns that QUERIES have, and logical types by the database's names for types."""
    if dialect in D.DIALECTS:
        raise D.UnsupportedDialect(f"{dialect} is built in")
    D.features(dialect)
    known = {n for given in QUERIES.values() for n in given}
    if wrong := (set(_REQUIRED) - set(queries)) | (set(queries) - known) | (set(native_types.values()) - set(D.TYPE_TEMPLATES)):
        raise D.UnsupportedDialect(f"{dialect}: missing or unknown {sorted(wrong)}")
    QUERIES[dialect], NATIVE_TYPES[dialect] = dict(queries), {k.upper(): v for k, v in native_types.items()}
    EXTRACTED[dialect] = _extracted(queries)


def query_for(dialect: str, relation: str, schema: str = "") -> str:
    """The query with the condition on the schema filled in."""
    text = QUERIES[dialect][relation]
    head, mark, rest = text.partition("{schema:")
    if not mark:
        return text
    return head + (f" and {rest.removesuffix('}')} = '{valid_schema_name(schema)}'" if schema else "")


def queries_for(dialect: str, schema: str = "", older: bool = False) -> dict[str, str]:
    return {n: query_for(dialect, n, schema) for n in QUERIES[dialect]} | (OLDER.get(dialect, {}) if older else {})


def rule_action(text: Column) -> Column:
    """An action as a database names or numbers it; anything else is None."""
    return F.coalesce(choice(F.upper(F.trim(text.cast("string"))), _ACTIONS), F.lit("None"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0))


def _flag(name: str) -> Column:
    return _number(name) == 1


def native_type(name: Column, dialect: str) -> Column:
    """The logical type of a database's name for a type; an unknown name fails the query."""
    plain = F.upper(F.trim(name))
    found = F.coalesce(choice(plain, NATIVE_TYPES[dialect]), choice(F.regexp_extract(plain, r"^[^(]*", 0), NATIVE_TYPES[dialect]))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown column type: "), F.coalesce(name, F.lit("null")))).cast("string"))


def database_catalog(spark: SparkSession, read: Reader, dialect: str, schema: str = "", name: str = "", older: bool = False) -> Catalog:
    """The catalog of a database; schema restricts it where the dialect has schemas, and without it the catalog is qualified, as it may span several. Kinds that the dialect's
    source can't read are empty. older: the server is one that OLDER is for."""
    given = queries_for(dialect, schema, older)
    lowered = lambda rows: rows.toDF(*[c.lower() for c in rows.columns])
    raw = {n: lowered(read(q)) for n, q in given.items()}
    return decoded(spark, raw, dialect, schema, name)


def decoded(spark: SparkSession, raw: Mapping[str, DataFrame], dialect: str, schema: str = "", name: str = "") -> Catalog:
    """Rows of the queries as the relations of a catalog. Where no schema is given and the rows have theirs, the catalog is qualified."""
    several = not schema and "schema_name" in raw["tables"].columns
    with_schema = lambda column, k: qualified_key(_text(column), k) if several else k
    own = lambda: with_schema("schema_name", ascii_upper(F.col("table_name"))).alias("table_key")
    key = lambda: ascii_upper(F.col("name")).alias("object_key")
    free = lambda: with_schema("schema_name", ascii_upper(F.col("name"))).alias("object_key")
    theirs = [_text("schema_name").alias("schema_name")] if several else []
    none = F.lit("").alias("description")
    frames: dict[str, DataFrame] = {"tables": raw["tables"].select(*(theirs or [F.lit(schema).alias("schema_name")]), own(), F.col("table_name"), _text("description").alias("description"))}

    default = F.trim(_text("default_value"))
    if dialect == D.MSSQL:
        default = F.translate(default, "()", "")
    elif dialect in D.FIREBIRD_FAMILY:
        default = normalize.default_value(default)
    default = F.when(default == "0.000", "0").otherwise(default)

    def fields(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("field_type", native_type(F.col("native_type").cast("string"), dialect))
        if dialect == D.ORACLE:
            whole = (F.col("native_type") == "NUMBER") & (_number("precision") == 0)
            rows = rows.withColumn("field_type", F.when(whole, "ftInteger").otherwise(F.col("field_type")))
        return rows.select(*shown)

    shown = (
        own(), F.col("position").cast("int").alias("position"), "column_name", ascii_upper(F.col("column_name")).alias("name_key"), "field_type", type_template(F.col("field_type"), dialect, _number("size")).alias("type_name"), _number("size").alias("size"),
        _number("precision").alias("precision"), _number("scale").alias("scale"), _flag("not_null").alias("not_null"), _flag("auto_increment").alias("auto_increment"), F.lit("NoSort").alias("sorting_order"),
        default.alias("default_value"), _text("charset").alias("charset"), _text("description").alias("description"),
    )

    def members(rows: DataFrame, kind: str, column: str, object_key: Column) -> DataFrame:
        position = (F.row_number().over(Window.partitionBy(own(), object_key).orderBy(F.col("position").cast("int"))) - 1).alias("position")
        name = F.col(column)
        shown, name_key = name, ascii_upper(name)
        if kind == "index" and "expression" in rows.columns:  # a member that is an expression is known by its canonical form
            shown, name_key = F.coalesce("expression", name), F.coalesce(normalize.expression(F.col("expression")), name_key)
        return rows.select(own(), F.lit(kind).alias("key_kind"), object_key.alias("object_key"), position, shown.alias("column_name"), name_key.alias("name_key"), F.lit("NoSort").alias("sorting_order"))

    keys = raw["primary_keys"]
    all_members = members(keys, "pk", "column_name", F.lit(""))
    columns = fields(raw["columns"])
    pk_columns = all_members.select("table_key", "name_key", F.lit(True).alias("is_primary_key"))
    frames["columns"] = columns.join(pk_columns, ["table_key", "name_key"], "left").withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False))).select([c.split()[0] for c in _columns_of("columns")])
    frames["primary_keys"] = keys.select(own(), "pk_name", (_flag("auto_increment") if "auto_increment" in keys.columns else F.lit(False)).alias("auto_increment")).distinct().select("*", none)
    foreign = raw["foreign_keys"]
    frames["foreign_keys"] = foreign.select(own(), key(), "name", "parent_table", with_schema("parent_schema", ascii_upper(F.col("parent_table"))).alias("parent_key"), *([_text("parent_schema").alias("parent_schema")] if several else []), rule_action(F.col("on_update")).alias("on_update"), rule_action(F.col("on_delete")).alias("on_delete"), none).distinct()
    indexes = raw["indexes"]
    frames["indexes"] = indexes.select(own(), key(), "name", _flag("is_unique").alias("is_unique"), none).distinct()
    name_key = ascii_upper(F.col("name"))
    frames["key_columns"] = all_members.union(members(indexes, "index", "column_name", name_key)).union(members(foreign, "fk_from", "column_name", name_key)).union(members(foreign, "fk_to", "parent_column", name_key))
    if "checks" in raw:
        condition = _text("condition") if dialect == D.ORACLE else normalize.check_condition(_text("condition"))
        frames["checks"] = raw["checks"].select(own(), key(), "name", condition.alias("condition"), none)
    if "views" in raw:
        frames["views"] = raw["views"].select(free(), *theirs, "name", normalize.view_body(_text("script")).alias("script"), none)
    if "view_columns" in raw:
        frames["view_columns"] = fields(raw["view_columns"]).withColumn("is_primary_key", F.lit(False)).select([c.split()[0] for c in _columns_of("columns")])
    if "sequences" in raw:
        frames["sequences"] = raw["sequences"].select(free(), *theirs, "name", _text("table_name").alias("table_name"), _number("initial_value").alias("initial_value"), _number("increment").alias("increment"), none)
    if "domains" in raw:
        frames["domains"] = _domains(raw["domains"], dialect, free(), theirs)
    if "procedures" in raw:
        frames["procedures"] = raw["procedures"].select(with_schema("schema_name", routine_key(F.col("name"), _text("signature"))).alias("object_key"), *theirs, "name", _text("signature").alias("signature"), _flag("is_function").alias("is_function"), _text("script").alias("script"), none)
    return Catalog(spark, name, schema, frames, several)


def _columns_of(relation: str) -> list[str]:
    from ..relations import SCHEMAS

    return [c.strip() for c in SCHEMAS[relation].split(",")]


def _domains(rows: DataFrame, dialect: str, key: Column | None = None, schema: Sequence[Column] = ()) -> DataFrame:
    """One row per domain; several checks become one condition."""
    if "type_name" not in rows.columns:
        kind = F.col("domain_type")
        template = F.coalesce(choice(kind, DOMAIN_TYPES), choice(F.concat(F.regexp_extract(kind, r"^[0-9]*", 0), F.lit(".0")), DOMAIN_TYPES), F.lit("VARCHAR(%l)"))
        for mark, column in (("%l", "size"), ("%p", "precision"), ("%s", "scale")):
            template = F.replace(template, F.lit(mark), _number(column).cast("string"))
        rows = rows.withColumn("type_name", template)
    checks = F.array_sort(F.filter(F.collect_list(normalize.check_condition(_text("check_condition"))), lambda x: x != ""))
    key = ascii_upper(F.col("name")).alias("object_key") if key is None else key
    grouped = rows.groupBy(key, *schema, "name", "type_name", _flag("not_null").alias("not_null"), normalize.default_value(_text("default_value")).alias("default_value")).agg(checks.alias("c"))
    several = F.array_join(F.transform("c", lambda x: F.concat(F.lit("("), x, F.lit(")"))), " AND ")
    return grouped.select("object_key", *(["schema_name"] if schema else []), "name", "type_name", "not_null", "default_value", F.when(F.size("c") > 1, several).otherwise(F.array_join("c", "")).alias("check_condition"), F.lit("").alias("description"))
