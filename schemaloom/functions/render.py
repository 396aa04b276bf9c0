"""Statements as text, from the templates of dialects (see dialects.STATEMENTS).

Statements are whole in every dialect: constraints on existing tables come as ALTER TABLE ... ADD CONSTRAINT. Inside CREATE TABLE parts are joined by commas.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dialects as D
from .types import mysql_cast_type, rendered_type

GUARDS = ("EnableForeignKeys", "EnableTriggers")

def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def choice(key: Column, texts: dict[str, Column | str]) -> Column:
    """A CASE with one branch for each entry of texts."""
    (first, value), *rest = texts.items()
    found = F.when(key == first, value)
    for which, value in rest:
        found = found.when(key == which, value)
    return found


def quoted(text: Column) -> Column:
    return cat("'", F.replace(text, F.lit("'"), F.lit("''")), "'")


def default_literal(attrs: Column) -> Column:
    """The default of a column; textual ones are quoted unless they are so already or are a known function."""
    value = attrs["default_value"]
    done = (F.length(value) >= 2) & value.startswith("'") & value.endswith("'")
    known = F.upper(F.trim(value)).isin("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME", "NOW()", "NULL")
    return F.when(attrs["field_type"].isin(*D.TEXT_TYPES) & ~done & ~known, quoted(value)).otherwise(value)


def qualified(schema: Column, name: Column, dialect: str) -> Column:
    a, z = D.QUOTES.get(dialect, ("", ""))
    return F.when(schema != "", cat(a, schema, z, ".", a, name, z)).otherwise(name)


def _not_null(attrs: Column) -> Column:
    return F.when(attrs["not_null"] == "true", " NOT NULL").otherwise("")


def _has_default(attrs: Column) -> Column:
    return F.coalesce(attrs["default_value"], F.lit("")) != ""


def column_definition(name: Column, attrs: Column, dialect: str) -> Column:
    default = F.when(_has_default(attrs), cat(" DEFAULT ", default_literal(attrs))).otherwise("")
    return cat(name, " ", rendered_type(attrs), default, _not_null(attrs))


def counts_up(attrs: Column) -> Column:
    """Whether SQLite can count the key column up: it takes AUTOINCREMENT for no type but INTEGER, which holds all integers."""
    return F.upper(F.trim(attrs["type_name"])).isin("INTEGER", "INT", "SMALLINT", "BIGINT", "TINYINT", "MEDIUMINT")


def counting_key(name: Column, attrs: Column, key_name: Column) -> Column:
    """SQLite's definition of a key column that counts up."""
    named = F.when(F.trim(key_name) != "", cat(" CONSTRAINT ", key_name)).otherwise("")
    return cat(name, " INTEGER", _not_null(attrs), named, " PRIMARY KEY AUTOINCREMENT")


def _rule(event: str, action: Column) -> Column:
    words = F.when(action == "Cascade", "CASCADE").when(action == "SetNull", "SET NULL").when(action == "SetDefault", "SET DEFAULT")
    return F.when(words.isNull(), "").otherwise(cat(f" ON {event} ", words))


def _actions(attrs: Column, dialect: str) -> Column:
    return cat(_rule("DELETE", attrs["on_delete"]), F.lit("") if dialect in D.WITHOUT_UPDATES else _rule("UPDATE", attrs["on_update"]))


def constraint(kind: Column, name: Column, schema: Column, attrs: Column, dialect: str) -> Column:
    """CONSTRAINT ... of a primary key, a foreign key or a check."""
    key = cat("PRIMARY KEY (", attrs["columns"], ")")
    foreign = cat("FOREIGN KEY (", attrs["columns"], ") REFERENCES ", qualified(F.coalesce(attrs["parent_schema"], schema), attrs["parent_table"], dialect), "(", attrs["to_columns"], ")", _actions(attrs, dialect))
    check = cat("CHECK (", attrs["condition"], ")")
    return cat("CONSTRAINT ", name, " ", F.when(kind == "primary_key", key).when(kind == "foreign_key", foreign).otherwise(check))


def create_index(name: Column, table: Column, attrs: Column) -> Column:
    return cat("CREATE ", F.when(attrs["is_unique"] == "true", "UNIQUE ").otherwise(""), "INDEX ", name, " ON ", table, " (", attrs["columns"], ");")


# What a command is called in plans.
LABELS = {
    "CreateTable": "Create Table: ", "DropTable": "Drop Table: ", "CreateColumn": "Create Column: ", "DropColumn": "Drop Column: ", "AlterColumn": "Alter Column: ",
    "AlterColumnPosition": "Alter Column Position: ", "AlterDefaultValue": "Set Default: ", "DropDefaultValue": "Drop Default: ", "CreateColumnRebuild": "Create Column: ",
    "DropColumnRebuild": "Drop Column: ", "BackfillColumnData": "Backfill Column Data: ", "CreatePrimaryKey": "Create PrimaryKey: ", "DropPrimaryKey": "Drop PrimaryKey: ",
    "CreateForeignKey": "Create ForeignKey: ", "DropForeignKey": "Drop ForeignKey: ", "CreateIndexe": "Create Indexe: ", "DropIndexe": "Drop Indexe: ", "CreateCheck": "Create Check: ",
    "AlterCheck": "Create Check: ", "DropCheck": "Drop Check: ", "CreateView": "Create View: ", "DropView": "Drop View: ", "CreateTrigger": "Create Trigger: ", "DropTrigger": "Drop Trigger: ",
    "CreateSequence": "Create Sequence: ", "AlterSequence": "Alter Sequence: ", "DropSequence": "Drop Sequence: ", "CreateDomain": "Create Domain: ", "DropDomain": "Drop Domain: ",
    "CreateProcedure": "Create Procedure: ", "DropProcedure": "Drop Procedure: ", "EnableForeignKeys": "Enable ForeignKeys: ", "EnableTriggers": "Enable Triggers: ",
}


_NEW_NAMES = {"CreateColumnRebuild": "Create Column: {new_name}", "CopyColumnData": "Copy Column Data: {name} -> {new_name}", "RenameColumn": "Rename Column: {new_name} TO {name}", "SetTableComment": "Set Comment: {name}", "SetColumnComment": "Set Comment: {table_name}.{name}"}
_LABEL_TEMPLATES = {which: prefix + "{name}" for which, prefix in LABELS.items()} | _NEW_NAMES


def values(dialect: str) -> dict[str, Column]:
    """What placeholders in statements stand for. Rows have op, schema, table_name, name, attrs and extra."""
    attrs, extra, name, schema, table_name = (F.col(c) for c in ("attrs", "extra", "name", "schema", "table_name"))
    domain = cat(attrs["type_name"], F.when(F.trim(attrs["default_value"]) != "", cat(" DEFAULT ", attrs["default_value"])).otherwise(""), _not_null(attrs), F.when(F.trim(attrs["check_condition"]) != "", cat(" CHECK (", attrs["check_condition"], ")")).otherwise(""))
    default = default_literal(attrs)
    return {
        "sql": extra["sql"], "table": qualified(schema, table_name, dialect), "table_name": table_name, "name": name, "new_name": extra["new_name"], "name_literal": quoted(name),
        "type": rendered_type(attrs), "cast_type": mysql_cast_type(attrs), "default": default, "default_clause": F.when(_has_default(attrs), cat(" DEFAULT ", default)).otherwise(""), "not_null": _not_null(attrs),
        "default_change": F.when(_has_default(attrs), cat(" SET DEFAULT ", default)).otherwise(" DROP DEFAULT"), "not_null_change": F.when(attrs["not_null"] == "true", " SET NOT NULL").otherwise(" DROP NOT NULL"),
        "place": (attrs["position"].cast("int") + 1).cast("string"), "description": quoted(attrs["description"]), "comment": F.when(F.trim(attrs["description"]) == "", "NULL").otherwise(quoted(attrs["description"])),
        "columns": attrs["columns"], "to_columns": attrs["to_columns"], "parent": qualified(F.coalesce(attrs["parent_schema"], schema), attrs["parent_table"], dialect), "on_delete": _rule("DELETE", attrs["on_delete"]),
        "on_update": F.lit("") if dialect in D.WITHOUT_UPDATES else _rule("UPDATE", attrs["on_update"]), "condition": attrs["condition"], "unique": F.when(attrs["is_unique"] == "true", "UNIQUE ").otherwise(""), "script": attrs["script"],
        "first": attrs["initial_value"], "step": attrs["increment"], "domain_type": domain, "routine": F.when(attrs["is_function"] == "true", "FUNCTION").otherwise("PROCEDURE"),
        "signature": F.when(F.trim(attrs["signature"]) != "", cat("(", attrs["signature"], ")")).otherwise(""),
    }


def parts(template: str) -> list[str]:
    """The template cut at its placeholders."""
    return [x for x in re.split(r"(\{[a-z_]+\})", template) if x]


def rendered(rows: DataFrame, dialect: str) -> DataFrame:
    """rows with sql, '' if the dialect has no statement for a row's op, and label.

    One expression serves all dialects: a template is a short list of texts and placeholders, found by a join with the dialect's few templates, and each placeholder is
    looked up among the row's values, of which only those are made that its command needs. What values contain is never read as a template.
    """
    templates = [(op, parts(text), parts(_LABEL_TEMPLATES.get(op.split(" ")[0], ""))) for op, text in D.statements(dialect).items()]
    found = {op for op, _, _ in templates}
    templates += [(key, [], parts(_LABEL_TEMPLATES[op])) for op in GUARDS for key in (f"{op} Off", f"{op} On") if key not in found]
    table = rows.sparkSession.createDataFrame(templates, "_key string, _statement array<string>, _label array<string>")
    uses: dict[str, set[str]] = {}  # the commands that need a placeholder: for others its value is not made
    for op, *texts in templates:
        for part in itertools.chain(*texts):
            uses.setdefault(part, set()).add(op.split(" ")[0])
    made = {p: F.when(F.col("op").isin(*sorted(uses[p])), v) for n, v in values(dialect).items() if (p := f"{{{n}}}") in uses}
    known = F.create_map(*[x for p, v in made.items() for x in (F.lit(p), F.coalesce(v, F.lit("")))])
    key = F.when(F.col("op").isin(*GUARDS), F.concat_ws(" ", "op", "name")).otherwise(F.col("op"))
    filled = lambda c: F.coalesce(F.array_join(F.transform(c, lambda p: F.coalesce(F.try_element_at("_values", p), p)), ""), F.lit(""))
    rows = rows.withColumns({"_key": key, "_values": known}).join(F.broadcast(table), "_key", "left")  # as many rows as there are commands
    return rows.withColumns({"sql": filled("_statement"), "label": filled("_label")}).drop("_key", "_values", "_statement", "_label")
