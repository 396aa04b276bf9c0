"""What differs between database dialects, as data: features, names of types, and how statements are written. register adds a dialect to those that are here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

FIREBIRD, FIREBIRD3, INTERBASE = "Firebird", "Firebird3", "Interbase"
POSTGRESQL, MYSQL, MSSQL, ORACLE, SQLITE = "PostgreSQL", "MySQL", "MSSQL", "Oracle", "SQLite"
SPARK = "Spark"
DIALECTS = (FIREBIRD, FIREBIRD3, INTERBASE, POSTGRESQL, MYSQL, MSSQL, ORACLE, SQLITE, SPARK)
FIREBIRD_FAMILY = (FIREBIRD, FIREBIRD3, INTERBASE)

BASE_FEATURES = frozenset({"sequences", "foreign_keys", "checks", "views", "triggers"})
FEATURES = {
    FIREBIRD: BASE_FEATURES | {"domains", "procedures", "comments"},
    FIREBIRD3: BASE_FEATURES | {"domains", "procedures"},
    INTERBASE: BASE_FEATURES | {"domains", "comments"},
    POSTGRESQL: BASE_FEATURES | {"domains", "procedures", "comments"},
    MYSQL: BASE_FEATURES - {"sequences"} | {"procedures"},
    MSSQL: BASE_FEATURES | {"procedures"},
    ORACLE: BASE_FEATURES | {"comments"},
    SQLITE: BASE_FEATURES,
    SPARK: frozenset({"foreign_keys", "checks", "views", "comments"}),
}
#: Dialects whose definition statements can be rolled back.
TRANSACTIONAL = {FIREBIRD, FIREBIRD3, INTERBASE, POSTGRESQL, MSSQL, SQLITE}
#: Signs around names that stand after a schema.
QUOTES = {POSTGRESQL: ('"', '"'), MSSQL: ("[", "]"), SPARK: ("`", "`")}
#: Dialects whose references say nothing of updates.
WITHOUT_UPDATES = {ORACLE}

# Templates of physical types by logical type; %l, %p and %s stand for size, precision and scale.
TYPE_TEMPLATES = {
    "ftBoolean": "Boolean",
    "ftByte": "SMALLINT", "ftShortint": "SMALLINT", "ftSmallint": "SMALLINT", "ftWord": "SMALLINT",
    "ftInteger": "INTEGER", "ftLongWord": "INTEGER", "ftLargeint": "NUMERIC(%l)",
    "ftString": "VARCHAR(%l)", "ftWideString": "NVARCHAR(%l)", "ftFixedChar": "CHAR(%l)", "ftFixedWideChar": "NCHAR(%l)",
    "ftDate": "DATE", "ftTime": "TIME", "ftDateTime": "DATETIME",
    "ftTimeStamp": "TIMESTAMP", "ftOraTimeStamp": "TIMESTAMP", "ftTimeStampOffset": "TIMESTAMP",
    "ftFloat": "FLOAT", "ftSingle": "REAL", "ftExtended": "DOUBLE PRECISION", "ftCurrency": "NUMERIC(%p,%s)",
    "ftBCD": "DECIMAL(%p,%s)", "ftFMTBcd": "DECIMAL(%p,%s)",
    "ftBlob": "BLOB", "ftOraBlob": "BLOB", "ftGraphic": "BLOB",
    "ftWideMemo": "TEXT", "ftMemo": "TEXT", "ftOraClob": "TEXT", "ftGuid": "GUID",
}
# Where a dialect has another template.
TYPE_EXCEPTIONS = {
    POSTGRESQL: {"ftLargeint": "BIGINT", "ftDateTime": "TIMESTAMP", "ftFloat": "NUMERIC(%p,%s)", "ftCurrency": "MONEY", "ftBlob": "BYTEA", "ftOraBlob": "BYTEA", "ftGuid": "CHAR(%l)"},
    FIREBIRD: {"ftLargeint": "BIGINT", "ftWideString": "VARCHAR(%l)", "ftDateTime": "TIMESTAMP", "ftWideMemo": "BLOB SUB_TYPE 1", "ftMemo": "BLOB SUB_TYPE 1", "ftOraClob": "BLOB SUB_TYPE 1", "ftGuid": "CHAR(%l)"},
    MYSQL: {"ftInteger": "INT", "ftLongWord": "INT", "ftExtended": "DOUBLE", "ftGuid": "CHAR(%l)"},
    MSSQL: {"ftBoolean": "BIT", "ftInteger": "INT", "ftLongWord": "INT", "ftExtended": "FLOAT", "ftCurrency": "MONEY", "ftBlob": "VARBINARY(MAX)", "ftOraBlob": "VARBINARY(MAX)", "ftGraphic": "IMAGE", "ftWideMemo": "NTEXT"},
    ORACLE: {
        "ftByte": "NUMBER", "ftShortint": "NUMBER", "ftSmallint": "NUMBER", "ftWord": "NUMBER", "ftInteger": "NUMBER", "ftLongWord": "NUMBER", "ftLargeint": "NUMBER",
        "ftString": "VARCHAR2(%l)", "ftWideString": "NVARCHAR2(%l)", "ftTime": "DATE", "ftDateTime": "DATE", "ftTimeStamp": "DATE", "ftOraTimeStamp": "DATE", "ftTimeStampOffset": "DATE",
        "ftSingle": "NUMBER(%p,%s)", "ftExtended": "BINARY_DOUBLE", "ftCurrency": "NUMBER(%p,%s)", "ftBCD": "NUMBER(%p,%s)", "ftFMTBcd": "NUMBER(%p,%s)",
        "ftWideMemo": "NCLOB", "ftMemo": "CLOB", "ftOraClob": "CLOB", "ftGuid": "NCHAR(%l)",
    },
    SQLITE: {"ftFloat": "FLOAT(%p,%s)", "ftExtended": "DOUBLE", "ftCurrency": "MONEY", "ftBCD": "FLOAT(%p,%s)", "ftFMTBcd": "FLOAT(%p,%s)"},
    SPARK: {
        "ftBoolean": "BOOLEAN", "ftInteger": "INT", "ftLongWord": "BIGINT", "ftLargeint": "BIGINT", "ftString": "STRING", "ftWideString": "STRING", "ftFixedChar": "STRING", "ftFixedWideChar": "STRING",
        "ftTime": "STRING", "ftDateTime": "TIMESTAMP_NTZ", "ftTimeStamp": "TIMESTAMP_NTZ", "ftOraTimeStamp": "TIMESTAMP_NTZ", "ftTimeStampOffset": "TIMESTAMP",
        "ftFloat": "DOUBLE", "ftSingle": "FLOAT", "ftExtended": "DOUBLE", "ftCurrency": "DECIMAL(%p,%s)", "ftBlob": "BINARY", "ftOraBlob": "BINARY", "ftGraphic": "BINARY",
        "ftWideMemo": "STRING", "ftMemo": "STRING", "ftOraClob": "STRING", "ftGuid": "STRING",
    },
}
TYPE_EXCEPTIONS[FIREBIRD3] = TYPE_EXCEPTIONS[INTERBASE] = TYPE_EXCEPTIONS[FIREBIRD]

#: Logical types that compare as one.
TYPE_CLASSES = {
    **dict.fromkeys(("ftCurrency", "ftFloat", "ftBCD", "ftExtended", "ftSingle", "ftFMTBcd"), "ftCurrency"),
    **dict.fromkeys(("ftString", "ftFixedChar", "ftWideString", "ftFixedWideChar", "ftGuid"), "ftString"),
    **dict.fromkeys(("ftInteger", "ftShortint", "ftSmallint", "ftLargeint"), "ftInteger"),
    **dict.fromkeys(("ftMemo", "ftFmtMemo", "ftWideMemo"), "ftMemo"),
}
TEXT_TYPES = ("ftString", "ftWideString", "ftFixedChar", "ftFixedWideChar", "ftMemo", "ftWideMemo")


_ALTER = "ALTER TABLE {table}"
# Statements by command; what stands in braces is filled in for each row (see functions.render.VALUES). Guards are named with their state.
STATEMENTS = {
    "CreateTable": "{sql}", "DropTable": "DROP TABLE {table};",
    "CreateColumn": f"{_ALTER} ADD {{name}} {{type}}{{default_clause}}{{not_null}};", "DropColumn": f"{_ALTER} DROP COLUMN {{name}};", "AlterColumn": f"{_ALTER} ALTER COLUMN {{name}} {{type}}{{not_null}};",
    "AlterColumnPosition": "", "AlterDefaultValue": f"{_ALTER} ALTER COLUMN {{name}} SET DEFAULT {{default}};", "DropDefaultValue": f"{_ALTER} ALTER COLUMN {{name}} DROP DEFAULT;",
    "CreateColumnRebuild": f"{_ALTER} ADD {{new_name}} {{type}};", "CopyColumnData": "UPDATE {table} SET {new_name} = CAST({name} AS {type});", "BackfillColumnData": "UPDATE {table} SET {name} = {default} WHERE {name} IS NULL;",
    "DropColumnRebuild": f"{_ALTER} DROP COLUMN {{name}};", "RenameColumn": f"{_ALTER} RENAME COLUMN {{new_name}} TO {{name}};",
    "CreatePrimaryKey": f"{_ALTER} ADD CONSTRAINT {{name}} PRIMARY KEY ({{columns}});", "DropPrimaryKey": f"{_ALTER} DROP CONSTRAINT {{name}};",
    "CreateForeignKey": f"{_ALTER} ADD CONSTRAINT {{name}} FOREIGN KEY ({{columns}}) REFERENCES {{parent}}({{to_columns}}){{on_delete}}{{on_update}};", "DropForeignKey": f"{_ALTER} DROP CONSTRAINT {{name}};",
    "CreateIndexe": "CREATE {unique}INDEX {name} ON {table} ({columns});", "DropIndexe": "DROP INDEX {name} ON {table};",
    "CreateCheck": f"{_ALTER} ADD CONSTRAINT {{name}} CHECK ({{condition}});", "AlterCheck": f"{_ALTER} DROP CONSTRAINT {{name}};{_ALTER} ADD CONSTRAINT {{name}} CHECK ({{condition}});", "DropCheck": f"{_ALTER} DROP CONSTRAINT {{name}};",
    "CreateView": "CREATE VIEW {name} AS {script};", "DropView": "DROP VIEW {name};", "CreateTrigger": "CREATE TRIGGER {name} AS {script};", "DropTrigger": "DROP TRIGGER {name};",
    "CreateSequence": "", "AlterSequence": "", "DropSequence": "", "CreateDomain": "CREATE DOMAIN {name} AS {domain_type};", "DropDomain": "DROP DOMAIN {name};", "CreateProcedure": "{script}", "DropProcedure": "DROP {routine} {name}{signature};",
    "SetTableComment": "COMMENT ON TABLE {table} IS {comment};", "SetColumnComment": "COMMENT ON COLUMN {table}.{name} IS {comment};",
}
_RESTART = "ALTER SEQUENCE {name} RESTART WITH {first} INCREMENT BY {step};"
_DROP_KEY, _DROP_INDEX = f"{_ALTER} DROP PRIMARY KEY;", "DROP INDEX {name};"
_FIREBIRD = {
    "DropColumn": f"{_ALTER} DROP {{name}};", "DropColumnRebuild": f"{_ALTER} DROP {{name}};", "AlterColumn": f"{_ALTER} ALTER COLUMN {{name}} TYPE {{type}}{{not_null}};", "AlterColumnPosition": f"{_ALTER} ALTER COLUMN {{name}} POSITION {{place}};",
    "RenameColumn": f"{_ALTER} ALTER COLUMN {{new_name}} TO {{name}};", "DropIndexe": _DROP_INDEX, "CreateSequence": "CREATE GENERATOR {name};", "AlterSequence": "ALTER SEQUENCE {name} RESTART WITH {first};", "DropSequence": "DROP GENERATOR {name};",
}
_FIREBIRD_TRIGGERS = (
    "UPDATE RDB$TRIGGERS SET RDB$TRIGGER_INACTIVE = %d WHERE RDB$TRIGGER_SOURCE IS NOT NULL AND ((RDB$SYSTEM_FLAG = 0) OR (RDB$SYSTEM_FLAG IS NULL)) "
    "AND NOT EXISTS (SELECT 1 FROM RDB$CHECK_CONSTRAINTS CK WHERE CK.RDB$TRIGGER_NAME = RDB$TRIGGERS.RDB$TRIGGER_NAME);"
)
_FIREBIRD_GUARDS = {"EnableTriggers Off": _FIREBIRD_TRIGGERS % 1, "EnableTriggers On": _FIREBIRD_TRIGGERS % 0}
_ORACLE_KEYS = "BEGIN\n  FOR c IN (SELECT table_name, constraint_name FROM user_constraints WHERE constraint_type = 'R') LOOP\n    EXECUTE IMMEDIATE 'ALTER TABLE \"' || c.table_name || '\" %s CONSTRAINT \"' || c.constraint_name || '\"';\n  END LOOP;\nEND;"
_ORACLE_TRIGGERS = "BEGIN\n  FOR t IN (SELECT trigger_name FROM user_triggers) LOOP\n    EXECUTE IMMEDIATE 'ALTER TRIGGER \"' || t.trigger_name || '\" %s';\n  END LOOP;\nEND;"
#: Where a dialect writes a statement in its own way.
OWN_STATEMENTS: dict[str, dict[str, str]] = {
    FIREBIRD: _FIREBIRD | _FIREBIRD_GUARDS, INTERBASE: _FIREBIRD | _FIREBIRD_GUARDS, FIREBIRD3: _FIREBIRD | {"AlterSequence": _RESTART},
    POSTGRESQL: {
        "AlterColumn": f"{_ALTER} ALTER COLUMN {{name}} TYPE {{type}};{_ALTER} ALTER COLUMN {{name}}{{default_change}};{_ALTER} ALTER COLUMN {{name}}{{not_null_change}};COMMENT ON COLUMN {{table}}.{{name}} IS {{description}};",
        "DropPrimaryKey": _DROP_KEY, "DropIndexe": _DROP_INDEX, "CreateSequence": 'CREATE SEQUENCE "{name}" INCREMENT {step} START {first};', "AlterSequence": _RESTART, "DropSequence": "DROP SEQUENCE {name};",
        **{f"{guard} {state}": f"SET session_replication_role = {role};" for guard in ("EnableForeignKeys", "EnableTriggers") for state, role in (("Off", "replica"), ("On", "DEFAULT"))},
    },
    MYSQL: {
        "AlterColumn": f"{_ALTER} MODIFY COLUMN {{name}} {{type}}{{not_null}};", "CopyColumnData": "UPDATE {table} SET {new_name} = CAST({name} AS {cast_type});", "DropPrimaryKey": _DROP_KEY, "DropIndexe": f"{_ALTER} DROP INDEX {{name}};",
        "EnableForeignKeys Off": "SET FOREIGN_KEY_CHECKS = 0;", "EnableForeignKeys On": "SET FOREIGN_KEY_CHECKS = 1;",
    },
    MSSQL: {
        "AlterDefaultValue": f"{_ALTER} ADD CONSTRAINT DF_{{table_name}}_{{name}} DEFAULT {{default}} FOR {{name}};", "DropDefaultValue": f"{_ALTER} DROP CONSTRAINT DF_{{table_name}}_{{name}};",
        "RenameColumn": "EXEC sp_rename '{table}.{new_name}', '{name}', 'COLUMN';", "CreateSequence": "CREATE SEQUENCE {name} AS int START WITH {first} INCREMENT BY {step};", "AlterSequence": _RESTART, "DropSequence": "DROP SEQUENCE {name};",
        "EnableForeignKeys Off": 'EXEC sp_MSforeachtable "ALTER TABLE ? NOCHECK CONSTRAINT all";', "EnableForeignKeys On": 'EXEC sp_MSforeachtable "ALTER TABLE ? WITH CHECK CHECK CONSTRAINT all";',
        "EnableTriggers Off": 'EXEC sp_MSforeachtable "ALTER TABLE ? DISABLE TRIGGER ALL";', "EnableTriggers On": 'EXEC sp_MSforeachtable "ALTER TABLE ? ENABLE TRIGGER ALL";',
    },
    ORACLE: {
        "AlterColumn": f"{_ALTER} MODIFY ({{name}} {{type}}{{not_null}});", "AlterDefaultValue": f"{_ALTER} MODIFY ({{name}} DEFAULT {{default}});", "DropDefaultValue": f"{_ALTER} MODIFY ({{name}} DEFAULT NULL);",
        "DropPrimaryKey": _DROP_KEY, "DropIndexe": _DROP_INDEX, "CreateForeignKey": STATEMENTS["CreateForeignKey"].replace(";", " ENABLE VALIDATE;"),
        "CreateSequence": "CREATE SEQUENCE {name} MINVALUE 1 START WITH {first} INCREMENT BY {step} NOCACHE;", "AlterSequence": "ALTER SEQUENCE {name} INCREMENT BY {step};", "DropSequence": "DROP SEQUENCE {name};",
        "EnableForeignKeys Off": _ORACLE_KEYS % "DISABLE", "EnableForeignKeys On": _ORACLE_KEYS % "ENABLE", "EnableTriggers Off": _ORACLE_TRIGGERS % "DISABLE", "EnableTriggers On": _ORACLE_TRIGGERS % "ENABLE",
    },
    SQLITE: {
        "AlterDefaultValue": "", "DropDefaultValue": "", "CreateForeignKey": "", "DropIndexe": _DROP_INDEX, "CreateSequence": "INSERT INTO SQLITE_SEQUENCE(NAME, SEQ) VALUES ({name_literal}, 0);",
        "DropSequence": "DELETE FROM SQLITE_SEQUENCE WHERE NAME = {name_literal};", "EnableForeignKeys Off": "PRAGMA foreign_keys = off;", "EnableForeignKeys On": "PRAGMA foreign_keys = on;",
    },
    SPARK: {},
}


def statements(dialect: str) -> dict[str, str]:
    """All statements of a dialect by command."""
    return {**STATEMENTS, **OWN_STATEMENTS[dialect]}


@dataclass(frozen=True)
class Dialect:
    """A dialect that a user adds. What it leaves out is as most dialects have it: statements by command as in STATEMENTS, with the placeholders there; types by logical type as in
    TYPE_TEMPLATES; quotes around names that stand after a schema."""

    name: str
    features: frozenset[str]
    statements: Mapping[str, str] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    transactional: bool = False
    quotes: tuple[str, str] = ("", "")
    references_tell_of_updates: bool = True


def register(dialect: Dialect) -> None:
    """Makes a dialect known to comparison, rendering, scripts and execution; one of the same name is replaced, built-in ones can't be."""
    if dialect.name in DIALECTS:
        raise UnsupportedDialect(f"{dialect.name} is built in")
    known = BASE_FEATURES | {"domains", "procedures", "comments"}
    guards = {f"{guard} {state}" for guard in ("EnableForeignKeys", "EnableTriggers") for state in ("Off", "On")}
    if unknown := (dialect.features - known) | (set(dialect.statements) - set(STATEMENTS) - guards) | (set(dialect.types) - set(TYPE_TEMPLATES)):
        raise UnsupportedDialect(f"{dialect.name}: unknown {sorted(unknown)}")
    FEATURES[dialect.name], OWN_STATEMENTS[dialect.name], TYPE_EXCEPTIONS[dialect.name], QUOTES[dialect.name] = frozenset(dialect.features), dict(dialect.statements), dict(dialect.types), dialect.quotes
    for names, belongs in ((TRANSACTIONAL, dialect.transactional), (WITHOUT_UPDATES, not dialect.references_tell_of_updates)):
        (names.add if belongs else names.discard)(dialect.name)


class UnsupportedDialect(ValueError):
    """A dialect that is not in DIALECTS."""


def features(dialect: str) -> frozenset[str]:
    if dialect not in FEATURES:
        raise UnsupportedDialect(dialect)
    return FEATURES[dialect]
