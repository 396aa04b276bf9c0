"""Differences of two catalogs as rows.

All kinds of objects meet in one full outer join on their identity. A join with the tables that are new or gone tells each row whether its table
is kept. Every difference becomes an action: the commands it takes, the operations a policy must allow for them, and what
the audit says if it doesn't.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dialects as D
from ..functions.render import cat, column_definition, constraint, counting_key, counts_up, create_index, qualified
from ..plans.options import CompareOptions
from ..relations import Catalog, DuplicateObject, written
from . import digest
from .objects import objects
from .schemas import aligned

#: Kinds by the feature that a dialect needs for them; other kinds are always compared.
FEATURE_OF = {"foreign_key": "foreign_keys", "check": "checks", "trigger": "triggers", "view": "views", "sequence": "sequences", "domain": "domains", "procedure": "procedures"}
# Places of kinds in the order of generation.
STAGES = {"domain": 1, "view": 3, "sequence": 4, "procedure": 5, "foreign_key": 7}
STEPS = {"column": 0, "primary_key": 1, "index": 2, "check": 3, "trigger": 4}
COMMENT_STAGE, TABLE_STAGE, LAST_STAGE = 6, 2, 8

ACTIONS = "array<struct<ops:array<string>,needs:array<string>,audit:string>>"
_IDENTITY = ("kind", "table_key", "object_key")
_SIDE = ("schema", "table_name", "name", "attrs", "members", "to_members")


def joined(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Both sides of every object as structs m and t (null where absent), status, and the status of its table."""
    side = lambda frame, name: frame.select(*_IDENTITY, F.struct(*_SIDE).alias(name))
    both = side(desired, "m").join(side(current, "t"), list(_IDENTITY), "full_outer")
    both = both.selectExpr("*", "case when t is null then 'create' when m is null then 'drop' else 'keep' end as status", "case when table_key = '' then concat_ws(' ', kind, object_key) else table_key end as own")
    sides = [frame.filter("kind = 'table'").selectExpr("table_key as own", f"true as {name}") for frame, name in ((desired, "mine"), (current, "theirs"))]
    changed = sides[0].join(sides[1], "own", "full_outer").filter("mine is null or theirs is null").groupBy("own").agg(F.max(F.expr("if(theirs is null, 'create', 'drop')")).alias("changed"))
    return _beside(both, changed).selectExpr(*both.columns, "coalesce(changed, 'keep') as table_status")


def _beside(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows with what tables, one row each, say of theirs. Written, tables have a known size, so a short list is sent to all tasks. A window by table instead would hold all rows of a table in one task."""
    return rows.join(written(tables), "own", "left")


# What follows is text of SQL expressions over m and t.

_TYPES = " ".join(f"when '{t}' then '{c}'" for t, c in D.TYPE_CLASSES.items())


def _class(side: str) -> str:
    return f"case {side}.attrs['field_type'] {_TYPES} else {side}.attrs['field_type'] end"


def _differ(a: str, b: str) -> str:
    return f"(not ({a} <=> {b}))"


def _attrs_differ(*names: str, form: str = "{}") -> str:
    return "(" + " or ".join(_differ(form.format(f"m.attrs['{n}']"), form.format(f"t.attrs['{n}']")) for n in names) + ")"


def _texts(names: list[str]) -> str:
    return "cast(array(" + ", ".join(f"'{n}'" for n in names) + ") as array<string>)"


#: By everything but the description and the position; the character set only where the desired one is given.
COLUMN_DIFFERS = (
    f"({_differ(_class('m'), _class('t'))} or {_attrs_differ('type_name', 'size', 'precision', 'scale', 'not_null', 'auto_increment', 'sorting_order', 'default_value')} "
    "or (m.attrs['charset'] <> '' and m.attrs['charset'] <> t.attrs['charset']))"
)


def _action(when: str, ops: list[str], audit: str, needs: list[str] | None = None) -> str:
    return f"case when {when} then named_struct('ops', {_texts(ops)}, 'needs', {_texts(ops if needs is None else needs)}, 'audit', {audit}) end"


def _suppressed(words: str, *names: str) -> str:
    return f"concat('{words} ', " + ", '.', ".join(names) + ", ' suppressed by policy')"


def _pair(differs: str, word: str, create: str, drop: str, names: list[str]) -> str:
    """Drop and create again, both or neither."""
    return _action(differs, [drop, create], _suppressed(f"RECREATE {word}", *names))


def _listed(found: list[str]) -> str:
    return f"array_compact(array({', '.join(found)}))"


def _simple(kind: str, word: str, create: str, drop: str, differs: str | None, created: str, dropped: str, by_table: bool, extra: list[str] | None = None) -> str:
    """Actions of a kind whose objects are created, dropped and, if they differ, made anew."""
    names = lambda s: [f"{s}.table_name", f"{s}.name"] if by_table else [f"{s}.name"]
    found = [
        _action(f"status = 'create' and {created}", [create], _suppressed(f"CREATE {word}", *names("m"))),
        _action(f"status = 'drop' and {dropped}", [drop], _suppressed(f"DROP {word}", *names("t"))),
    ]
    if differs is not None:
        found.append(_pair(f"status = 'keep' and {differs}", word, create, drop, names("t")))
    return f"when kind = '{kind}' then {_listed([*found, *(extra or [])])}"


def _members_differ(name: str, strict: bool) -> str:
    return _differ(f"m.{name}", f"t.{name}") if strict else _differ(f"array_sort(array_distinct(m.{name}))", f"array_sort(array_distinct(t.{name}))")


def actions(options: CompareOptions) -> Column:
    """The actions of a row of joined."""
    kept, both = "table_status = 'keep'", "status = 'keep'"
    model, yes, no = options.model_mode, "true", "false"
    named = ["m.table_name", "m.name"]

    default, has_default = _attrs_differ("default_value"), "m.attrs['default_value'] <> ''"
    column = [
        _action(f"{both} and {kept} and {COLUMN_DIFFERS}", ["AlterColumn"], _suppressed("ALTER COLUMN", *named)),
        _action(f"{both} and {kept} and {default} and {has_default}", ["AlterDefaultValue"], _suppressed("ALTER DEFAULT", *named)),
        _action(f"{both} and {kept} and {default} and not ({has_default})", ["DropDefaultValue"], _suppressed("DROP DEFAULT", *named)),
    ]
    if options.compare_positions:
        column.append(_action(f"moved and status <> 'drop' and {kept}", ["AlterColumnPosition"], _suppressed("ALTER COLUMN POSITION", *named)))

    mine, theirs, my_name, their_name = "coalesce(m.members, array())", "coalesce(t.members, array())", "coalesce(m.name, '')", "coalesce(t.name, '')"
    missing = f"(size(array_except({mine}, {theirs})) > 0" + (f" or (size({mine}) > 0 and {_differ(mine, theirs)})" if options.strict_keys else "") + ")"
    drop_key = f"(trim({their_name}) <> '' and (lower({my_name}) <> lower({their_name}) or {missing}))"
    make_key = f"({missing} or ({drop_key} and size({mine}) > 0))"
    table_name = "coalesce(t.table_name, m.table_name)"
    primary_key = "when kind = 'primary_key' then " + _listed([
        _pair(f"{kept} and {drop_key} and {make_key}", "PRIMARYKEY", "CreatePrimaryKey", "DropPrimaryKey", [table_name, their_name]),
        _action(f"{kept} and {drop_key} and not {make_key}", ["DropPrimaryKey"], _suppressed("DROP PRIMARYKEY", table_name, their_name)),
        _action(f"{kept} and not {drop_key} and {make_key}", ["CreatePrimaryKey"], _suppressed("CREATE PRIMARYKEY", table_name, my_name)),
    ])

    strict = options.strict_keys
    index_differs = f"({_attrs_differ('is_unique')} or {_members_differ('members', strict)})"
    foreign_differs = f"({_attrs_differ('parent_key', 'on_delete', 'on_update')} or {_members_differ('members', strict)} or {_members_differ('to_members', strict)})"
    foreign_created = kept if options.dialect == D.SQLITE else "table_status in ('keep', 'create')"
    canonical_differs = _attrs_differ("canonical", form="lower({})")
    view_given = "trim(coalesce(m.attrs['script'], '')) <> ''" if model else yes
    unless_model = no if model else yes
    sequence_differs = "(t.attrs['increment'] <> '0' and m.attrs['increment'] <> t.attrs['increment'])"
    if options.compare_initial_values:
        sequence_differs = f"({sequence_differs} or m.attrs['initial_value'] <> t.attrs['initial_value'])"
    altered = [] if options.dialect == D.SQLITE else [_action(f"{both} and {sequence_differs}", ["AlterSequence"], _suppressed("ALTER SEQUENCE", "m.name"))]
    domain_differs = f"({_attrs_differ('type_name', 'not_null', 'default_value', form='lower(trim({}))')} or {canonical_differs})"
    diagnostic = _action(f"{both} and {domain_differs}", [], "concat('DIAGNOSTIC: DOMAIN ', t.name, ' diverges (type, default, not null or check) and is not altered automatically')", [])

    cases = [
        _simple("column", "COLUMN", "CreateColumn", "DropColumn", None, kept, kept, True, column),
        primary_key,
        _simple("index", "INDEXE", "CreateIndexe", "DropIndexe", f"{kept} and {index_differs}", kept, kept, True),
        _simple("foreign_key", "FOREIGNKEY", "CreateForeignKey", "DropForeignKey", f"{kept} and {foreign_differs}", foreign_created, kept, True),
        _simple("check", "CHECK", "CreateCheck", "DropCheck", None, kept, kept, True, [_action(f"{both} and {kept} and {canonical_differs}", ["AlterCheck"], _suppressed("ALTER CHECK", *named))]),
        _simple("trigger", "TRIGGER", "CreateTrigger", "DropTrigger", f"{kept} and {canonical_differs}", kept, kept, True),
        _simple("view", "VIEW", "CreateView", "DropView", f"{view_given} and {canonical_differs}", view_given, unless_model, False),
        _simple("sequence", "SEQUENCE", "CreateSequence", "DropSequence", None, yes, yes, False, altered),
        _simple("domain", "DOMAIN", "CreateDomain", "DropDomain", None, yes, unless_model, False, [diagnostic]),
        _simple("procedure", "PROCEDURE", "CreateProcedure", "DropProcedure", f"{unless_model} and {canonical_differs}", unless_model, unless_model, False),
        _simple("table", "TABLE", "CreateTable", "DropTable", None, no, yes, False),
    ]
    found = f"coalesce(case {' '.join(cases)} end, cast(array() as {ACTIONS}))"
    if options.compare_descriptions and options.compares("comments"):
        changed = f"{both} and {kept} and {_attrs_differ('description', form='lower(trim({}))')}"
        comments = _listed([
            _action(f"{changed} and kind = 'table'", ["SetTableComment"], _suppressed("COMMENT ON TABLE", "m.name"), ["SetComment"]),
            _action(f"{changed} and kind = 'column'", ["SetColumnComment"], _suppressed("COMMENT ON COLUMN", *named), ["SetComment"]),
        ])
        found = f"concat({found}, {comments})"
    return F.expr(found)


_CHANGE = ("kind", "table_key", "object_key", "m", "t")


def created_tables(rows: DataFrame, dialect: str) -> DataFrame:
    """One row per new table with its whole statement: columns, primary key, checks and indexes, and in SQLite the foreign keys."""
    m, kind = F.col("m"), F.col("kind")
    table = qualified(m["schema"], m["table_name"], dialect)
    inline = ["column", "primary_key", "check"] + ["foreign_key"] * (dialect == D.SQLITE)
    text = F.when(kind == "column", column_definition(m["name"], m["attrs"], dialect)).when(kind == "index", create_index(m["name"], table, m["attrs"])).otherwise(constraint(kind, m["name"], m["schema"], m["attrs"], dialect))
    wanted = ~((kind == "primary_key") & (F.size(m["members"]) == 0))
    rows = rows.filter((F.col("table_status") == "create") & (F.col("status") == "create"))
    if dialect == D.SQLITE:  # a key that counts up is part of its column
        of_table = Window.partitionBy("table_key")
        sole = (kind == "primary_key") & (F.size(m["members"]) == 1)
        key = F.struct(F.get(m["members"], F.lit(0)).alias("column"), m["name"].alias("name"), (m["attrs"]["auto_increment"] == "true").alias("up"))
        rows = rows.withColumn("_key", F.max(F.when(sole, key)).over(of_table))
        up = F.col("_key.up") | (m["attrs"]["auto_increment"] == "true")
        rows = rows.withColumn("_counts", F.coalesce((kind == "column") & (F.col("object_key") == F.col("_key.column")) & up & counts_up(m["attrs"]), F.lit(False)))
        rows = rows.withColumn("_inline", F.max("_counts").over(of_table))
        text = F.when(F.col("_counts"), counting_key(m["name"], m["attrs"], F.col("_key.name"))).otherwise(text)
        wanted = wanted & ~((kind == "primary_key") & F.col("_inline"))
    place = F.when(kind == "column", F.lpad(m["attrs"]["position"], 6, "0")).otherwise(F.col("object_key"))
    step = F.when(kind == "column", 0).when(kind == "primary_key", 1).when(kind == "foreign_key", 2).otherwise(3)
    part = F.struct(step.alias("step"), place.alias("place"), text.alias("text"))
    grouped = (
        rows.groupBy("table_key")
        .agg(
            F.first(F.when(kind == "table", m), ignorenulls=True).alias("m"),
            F.sort_array(F.collect_list(F.when(kind.isin(*inline) & wanted, part))).alias("parts"),
            F.sort_array(F.collect_list(F.when(kind == "index", part))).alias("indexes"),
        )
    )
    lines = lambda c, join: F.array_join(F.col(c).getField("text"), join)
    table = qualified(m["schema"], m["name"], dialect)
    body = cat("CREATE TABLE ", table, " (\n  ", lines("parts", ",\n  "), "\n);", F.when(F.size("indexes") > 0, cat("\n", lines("indexes", "\n"))).otherwise(""))
    return grouped.select(F.lit("table").alias("kind"), "table_key", F.lit("").alias("object_key"), "m", F.lit(None).alias("t"), body.alias("sql"))


def compared(desired: Catalog, current: Catalog, schemas: Sequence[tuple[str, str]] = (), narrow: bool | None = None) -> DataFrame:
    """joined of two catalogs' objects, written once. Of all options it depends on schemas alone, so it serves plans for several dialects and policies.

    Tables and objects that are equal on both sides leave first (see digest), if the catalogs are large or narrow says so. DuplicateObject if a side has an identity twice.
    """
    desired, current = aligned(desired, current, schemas)
    if digest.worthwhile(desired, current) if narrow is None else narrow:
        desired, current = digest.narrowed(desired, current)
    rows = written(joined(objects(desired), objects(current)))
    twice = rows.groupBy(*_IDENTITY).count().filter("count > 1").limit(5).collect()
    if twice:
        raise DuplicateObject(", ".join(" ".join(filter(None, (r.kind, r.table_key, r.object_key))) for r in twice))
    return rows


def changes(desired: Catalog, current: Catalog, options: CompareOptions) -> DataFrame:
    """differences of two catalogs."""
    return differences(compared(desired, current, options.schemas), options)


def differences(rows: DataFrame, options: CompareOptions) -> DataFrame:
    """Every difference in rows (see compared): place (order of generation), ops, needs, audit, the two sides, and the statement of new tables.

    Either catalog may be empty. Differences inside dropped tables are not listed.
    """
    gone = [k for k, f in FEATURE_OF.items() if not options.compares(f)]
    new_foreign = (F.col("kind") == "foreign_key") & (F.col("table_status") == "create")
    rows = rows.filter(~F.col("kind").isin(*gone) | new_foreign) if gone else rows
    if options.compare_positions:
        moved = (F.col("kind") == "column") & (F.col("status") == "keep") & (F.col("m")["attrs"]["position"] != F.col("t")["attrs"]["position"])
        tables = rows.filter(moved).select("own").distinct().withColumn("any_moved", F.lit(True))
        rows = _beside(rows, tables).withColumn("moved", (F.col("kind") == "column") & F.coalesce("any_moved", F.lit(False)))

    found = rows.select(*_CHANGE, "status", F.posexplode(actions(options)).alias("part", "action"))
    comment = "coalesce(get(action.ops, 0), '') in ('SetTableComment', 'SetColumnComment')"
    stage = " ".join(f"when '{k}' then {at}" for k, at in STAGES.items())
    step = " ".join(f"when '{k}' then {at}" for k, at in STEPS.items())
    place = f"""named_struct('stage', case when {comment} then {COMMENT_STAGE} else case kind {stage} else {TABLE_STAGE} end end, 'sub', if(get(action.ops, 0) <=> 'DropTable', 0, 1), 'own', table_key,
        'step', 2 * (case kind {step} else 0 end) + if(status = 'drop', 0, 1),
        'item', concat_ws(' ', if(kind = 'column' and status <> 'drop', lpad(m.attrs['position'], 6, '0'), ''), object_key), 'part', part)"""
    listed = found.selectExpr(f"{place} as place", *_CHANGE, "action.ops as ops", "action.needs as needs", "action.audit as audit", "cast(null as string) as sql")

    place = f"named_struct('stage', {TABLE_STAGE}, 'sub', 1, 'own', table_key, 'step', 0, 'item', '', 'part', 0)"
    made = created_tables(rows, options.dialect).withColumn("t", F.lit(None).cast(rows.schema["t"].dataType))
    made = made.selectExpr(f"{place} as place", *_CHANGE, "array('CreateTable') as ops", "array('CreateTable') as needs", f"{_suppressed('CREATE TABLE', 'm.name')} as audit", "sql")
    return listed.unionByName(made)
