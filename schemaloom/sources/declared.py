"""Declared models: Python classes that say what tables should be, and what can be done with their rows.

    @table("CLIENTE", "customers")
    @primary_key("ID", auto_increment=True)
    @check("CK_IDADE", "IDADE >= 0")
    class Customer:
        id = column("ID", "ftInteger", not_null=True)
        name = column("NOME", "ftString", size=60, not_null=True, default="SEM NOME")

Columns keep the order of their declaration, those of base classes first.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dialects as D
from ..functions.types import resolved_types
from ..operators.validators import Rule
from ..relations import Catalog, from_rows, local_frame

RESTRICTIONS = frozenset({"NotNull", "NoInsert", "NoUpdate", "NoValidate", "Unique", "Hidden", "VirtualData"})
CASCADES = frozenset({"CascadeNone", "CascadeAutoInc", "CascadeInsert", "CascadeUpdate", "CascadeDelete"})
MULTIPLICITIES = ("OneToOne", "OneToMany", "ManyToOne", "ManyToMany")
JOINS = {"InnerJoin": "inner", "LeftJoin": "left", "RightJoin": "right", "FullJoin": "full_outer"}
FIELD_EVENTS = ("onChange", "onGetText", "onSetText", "onValidate")


FACTS = (*sorted(RESTRICTIONS), "PrimaryKey", "JoinColumn", "CalcField", "AggregateField", "Association", "Enumeration", "Blob", "Date", "Time", "DateTime", "Lazy", "Nullable", "NullIfEmpty", "Validated")
ALIGNMENTS = ("left", "right", "center")


class ModelError(ValueError):
    """A declaration that can't be used."""


class NotRegistered(ModelError):
    """A class without a table or a view."""


@dataclass(frozen=True)
class ColumnMapping:
    """A column; join, calculated and association fields are no columns of the table."""

    name: str
    field_type: str = "ftString"
    size: int = 0
    precision: int = 0
    scale: int = 0
    default: str = ""
    restrictions: frozenset[str] = frozenset()
    description: str = ""
    label: str = ""
    display_format: str = ""
    edit_mask: str = ""
    message: str = ""
    alignment: str = "left"
    origin: str = ""
    nullable: bool = True
    rules: tuple[Rule, ...] = ()
    lazy: bool = False
    null_if_empty: bool = False
    kind: str = "column"
    extra: dict[str, Any] = field(default_factory=dict, compare=False)
    attribute: str = ""

    @property
    def not_null(self) -> bool:
        return "NotNull" in self.restrictions

    def has(self, restriction: str) -> bool:
        return restriction in self.restrictions

    @property
    def is_blob(self) -> bool:
        return self.field_type in ("ftBlob", "ftGraphic", "ftOraBlob", "ftOraClob", "ftMemo", "ftWideMemo")

    @property
    def default_expression(self) -> str:
        """The default as text of an expression: texts are quoted, unless they are so already or are a known function."""
        known = self.default.strip().upper() in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME", "NOW()", "NULL")
        done = len(self.default) >= 2 and self.default[0] == self.default[-1] == "'"
        return "'" + self.default.replace("'", "''") + "'" if self.default and self.field_type in D.TEXT_TYPES and not (known or done) else self.default

    def facts(self, key: Iterable[str] = ()) -> frozenset[str]:
        """What holds of the field, by the names in FACTS. key: the columns of the primary key."""
        found = {r for r in RESTRICTIONS if self.has(r)}
        found |= {name for name, holds in (
            ("PrimaryKey", self.kind == "column" and self.name.upper() in {k.upper() for k in key}), ("JoinColumn", self.kind == "join"), ("CalcField", self.kind == "calculated"), ("AggregateField", self.kind == "aggregate"), ("Association", self.kind == "association"),
            ("Enumeration", "values" in self.extra), ("Blob", self.kind == "column" and self.is_blob), ("Date", self.field_type == "ftDate"), ("Time", self.field_type == "ftTime"), ("DateTime", self.is_time and self.field_type not in ("ftDate", "ftTime")),
            ("Lazy", self.lazy), ("Nullable", self.kind == "column" and self.nullable and not self.not_null), ("NullIfEmpty", self.null_if_empty), ("Validated", bool(self.rules) and not self.has("NoValidate")),
        ) if holds}
        return frozenset(found)

    @property
    def is_time(self) -> bool:
        return self.field_type in ("ftDate", "ftTime", "ftDateTime", "ftTimeStamp", "ftTimeStampOffset", "ftOraTimeStamp")


def column(name: str, field_type: str, size: int = 0, precision: int = 0, scale: int = 0, *, not_null: bool = False, unique: bool = False, default: str = "", restrictions: Iterable[str] = (), **more: Any) -> ColumnMapping:
    found = frozenset(restrictions) | ({"NotNull"} if not_null else set()) | ({"Unique"} if unique else set())
    if unknown := found - RESTRICTIONS:
        raise ModelError(f"{name}: unknown restrictions {sorted(unknown)}")
    if field_type not in D.TYPE_TEMPLATES:
        raise ModelError(f"{name}: unknown field type {field_type}")
    if more.get("alignment", "left") not in ALIGNMENTS:
        raise ModelError(f"{name}: unknown alignment {more['alignment']}")
    return ColumnMapping(name, field_type, 0 if precision else size, precision, scale, default, found, **more)


def join_column(name: str, reference_table: str, reference_column: str, shown_column: str, how: str = "InnerJoin", alias: str = "") -> ColumnMapping:
    """A column of another table, found by name = reference_column."""
    if how not in JOINS:
        raise ModelError(f"{name}: unknown join {how}")
    return ColumnMapping(name, kind="join", extra={"table": reference_table, "column": reference_column, "shown": shown_column, "how": JOINS[how], "alias": alias or shown_column})


def calculated(name: str, expression: str, field_type: str = "ftString", size: int = 0) -> ColumnMapping:
    return ColumnMapping(name, field_type, size, kind="calculated", extra={"expression": expression})


def aggregate(name: str, expression: str, group: str = "", active: bool = True) -> ColumnMapping:
    return ColumnMapping(name, kind="aggregate", extra={"expression": expression, "group": [x.strip() for x in re.split("[,;]", group) if x.strip()], "active": active})


def association(multiplicity: str, columns: str, table: str, reference: str, *, lazy: bool = False, cascade: Iterable[str] = ("CascadeNone",)) -> ColumnMapping:
    if multiplicity not in MULTIPLICITIES or not set(cascade) <= CASCADES:
        raise ModelError(f"association with {table}: {multiplicity}, {sorted(cascade)}")
    return ColumnMapping(columns, kind="association", lazy=lazy, extra={"multiplicity": multiplicity, "table": table, "reference": reference, "cascade": frozenset(cascade)})


def enumeration(name: str, field_type: str, values: Iterable[str], labels: Iterable[str] = (), size: int = 1) -> ColumnMapping:
    """A column that holds codes. Codes are upper-case letters and digits."""
    codes = tuple(values)
    if bad := [v for v in codes if not re.fullmatch("[A-Z0-9]+", v)]:
        raise ModelError(f"{name}: codes {bad}")
    return ColumnMapping(name, field_type, size, extra={"values": codes, "labels": tuple(labels)})


@dataclass(frozen=True)
class Model:
    """What the decorators of a class said."""

    cls: type
    table: str = ""
    view: str = ""
    description: str = ""
    columns: tuple[ColumnMapping, ...] = ()
    parts: tuple[tuple[str, dict], ...] = ()

    def of(self, kind: str) -> list[dict]:
        return [p for k, p in self.parts if k == kind]

    def column(self, name: str) -> ColumnMapping:
        return next(c for c in self.columns if c.name.upper() == name.upper() and c.kind == "column")


def _part(kind: str, **values: Any) -> Callable[[type], type]:
    def mark(cls: type) -> type:
        cls.__dict__.get("_parts") or setattr(cls, "_parts", [])
        cls._parts.insert(0, (kind, values))
        return cls

    return mark


def _names(text: str) -> list[str]:
    return [x.strip() for x in re.split("[,;]", text) if x.strip()]


def table(name: str, description: str = "") -> Callable[[type], type]:
    return _part("table", name=name, description=description)


def view(name: str, description: str = "") -> Callable[[type], type]:
    return _part("view", name=name, description=description)


def primary_key(columns: str, *, auto_increment: bool = False, generator: str = "NoneInc", sorting: str = "NoSort", unique: bool = False, description: str = "") -> Callable[[type], type]:
    return _part("primary_key", columns=_names(columns), auto_increment=auto_increment, generator=generator, sorting=sorting, unique=unique, description=description)


def foreign_key(name: str, columns: str, parent: str, parent_columns: str, on_delete: str = "None", on_update: str = "None", description: str = "") -> Callable[[type], type]:
    """Without a name it is FK_<parent>_<first column>."""
    own = _names(columns)
    return _part("foreign_key", name=name or f"FK_{parent}_{own[0]}", columns=own, parent=parent, parent_columns=_names(parent_columns), on_delete=on_delete, on_update=on_update, description=description)


def index(name: str, columns: str, *, unique: bool = False, sorting: str = "NoSort", description: str = "") -> Callable[[type], type]:
    return _part("index", name=name, columns=_names(columns), unique=unique, sorting=sorting, description=description)


def check(name: str, condition: str, description: str = "") -> Callable[[type], type]:
    return _part("check", name=name, condition=condition, description=description)


def sequence(name: str, initial: int = 0, increment: int = 1) -> Callable[[type], type]:
    return _part("sequence", name=name, initial=initial, increment=increment)


def trigger(name: str, description: str = "") -> Callable[[type], type]:
    return _part("trigger", name=name, description=description)


def order_by(columns: str) -> Callable[[type], type]:
    return _part("order_by", columns=_names(columns))


def resource(name: str, **options: Any) -> Callable[[type], type]:
    """How services name the model; kept as it is."""
    return _part("resource", name=name, **options)


def sub_resource(name: str) -> Callable[[type], type]:
    """A part of the resource by a name of its own."""
    return _part("sub_resource", name=name)


METHODS = ("DELETE", "GET", "POST", "PUT")


def rest(*methods: str) -> Callable[[type], type]:
    """The methods that services allow on the model; GET alone makes it read-only."""
    if not methods or not set(methods) <= set(METHODS):
        raise ModelError(f"methods: {methods}")
    return _part("rest", methods=tuple(sorted(set(methods))))


def not_served(cls: type) -> type:
    """The model is no service's."""
    return _part("not_served")(cls)


class Registry:
    """Classes with their models, read once each; safe for many threads."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._classes: dict[type, None] = {}
        self._models: dict[type, Model] = {}

    def register(self, *classes: type) -> None:
        """Classes that are known already are passed over."""
        with self._lock:
            for cls in classes:
                self._classes.setdefault(cls)

    def classes(self) -> list[type]:
        with self._lock:
            return list(self._classes)

    def model(self, cls: type) -> Model:
        with self._lock:
            if cls not in self._models:
                self._models[cls] = read_model(cls)
            return self._models[cls]

    def catalog(self, spark: SparkSession, dialect: str, schema: str = "", guid_as_octets: bool = False) -> Catalog:
        return model_catalog(spark, [self.model(c) for c in self.classes()], dialect, schema, guid_as_octets)


def read_model(cls: type) -> Model:
    parts = [p for base in reversed(cls.__mro__) for p in base.__dict__.get("_parts", ())]
    heads = [(k, p) for k, p in parts if k in ("table", "view")]
    if not heads:
        raise NotRegistered(cls.__name__)
    kind, head = heads[-1]
    columns = [replace(v, attribute=k) for base in reversed(cls.__mro__) for k, v in vars(base).items() if isinstance(v, ColumnMapping)]
    last = {c.attribute: c for c in columns}
    return Model(cls, head["name"] if kind == "table" else "", head["name"] if kind == "view" else "", head["description"], tuple(last.values()), tuple(x for x in parts if x[0] not in ("table", "view")))


def model_catalog(spark: SparkSession, models: list[Model], dialect: str, schema: str = "", guid_as_octets: bool = False) -> Catalog:
    """The catalog that models describe, with the dialect's types. Views and triggers have no text; primary keys are named PK_<table>."""
    rows: dict[str, list[dict]] = {k: [] for k in ("tables", "columns", "primary_keys", "key_columns", "indexes", "foreign_keys", "checks", "triggers", "views", "sequences")}

    def members(model: Model, kind: str, name: str, columns: list[str], sorting: str = "NoSort") -> None:
        rows["key_columns"] += [{"table": model.table, "key_kind": kind, "object": name, "position": k, "column_name": c, "sorting_order": sorting} for k, c in enumerate(columns)]

    for m in models:
        if m.view:
            rows["views"].append({"name": m.view, "description": m.description})
            continue
        key = next(iter(m.of("primary_key")), {"columns": [], "auto_increment": False, "sorting": "NoSort", "description": ""})
        rows["tables"].append({"schema_name": schema, "table_name": m.table, "description": m.description})
        plain = [c for c in m.columns if c.kind == "column"]
        for k, c in enumerate(plain):
            rows["columns"].append({
                "table": m.table, "position": k, "column_name": c.name, "field_type": c.field_type, "size": c.size, "precision": c.precision, "scale": c.scale, "not_null": c.not_null,
                "default_value": c.default, "is_primary_key": c.name in key["columns"], "auto_increment": key["auto_increment"] and c.name in key["columns"], "description": c.description,
            })
        rows["primary_keys"].append({"table": m.table, "pk_name": f"PK_{m.table}" if key["columns"] else "", "auto_increment": key["auto_increment"], "description": key["description"]})
        members(m, "pk", "", key["columns"], key["sorting"])
        for x in m.of("index"):
            rows["indexes"].append({"table": m.table, "name": x["name"], "is_unique": x["unique"], "description": x["description"]})
            members(m, "index", x["name"], x["columns"], x["sorting"])
        for x in m.of("foreign_key"):
            rows["foreign_keys"].append({"table": m.table, "name": x["name"], "parent_table": x["parent"], "on_update": x["on_update"], "on_delete": x["on_delete"], "description": x["description"]})
            members(m, "fk_from", x["name"], x["columns"])
            members(m, "fk_to", x["name"], x["parent_columns"])
        rows["checks"] += [{"table": m.table, "name": x["name"], "condition": x["condition"], "description": x["description"]} for x in m.of("check")]
        rows["triggers"] += [{"table": m.table, "name": x["name"], "description": x["description"]} for x in m.of("trigger")]
        if dialect != D.MYSQL:
            rows["sequences"] += [{"name": x["name"], "table_name": m.table, "initial_value": x["initial"], "increment": x["increment"]} for x in m.of("sequence")]
    catalog = from_rows(spark, "", schema, **rows)
    return catalog.replaced(columns=resolved_types(catalog.columns, dialect, guid_as_octets)).assert_unique()


def dictionary(spark: SparkSession, models: Iterable[Model]) -> DataFrame:
    """(owner, field, attribute, place, kind, label, message, default_expression, display_format, edit_mask, alignment, origin, facts) of every field of models. A field without a label shows
    its name, and one without an origin comes from its own table."""
    rows = []
    for model in models:
        owner, key = model.table or model.view, next(iter(model.of("primary_key")), {"columns": []})["columns"]
        for k, c in enumerate(model.columns):
            facts = c.facts(key)
            rows.append((owner, c.name, c.attribute, k, c.kind, c.label or c.name, c.message, c.default_expression, c.display_format, c.edit_mask, c.alignment, c.origin or owner, ",".join(f for f in FACTS if f in facts)))
    schema = "owner string,field string,attribute string,place int,kind string,label string,message string,default_expression string,display_format string,edit_mask string,alignment string,origin string,facts string"
    return local_frame(spark, rows, schema).withColumn("facts", F.filter(F.split("facts", ","), lambda x: x != ""))


def services(spark: SparkSession, models: Iterable[Model]) -> DataFrame:
    """(owner, resource, sub_resources, methods, served) of models: how services name them, by default as the table is named, and what they allow, by default all."""
    rows = []
    for model in models:
        own = next(iter(model.of("resource")), {"name": ""})["name"] or model.table or model.view
        rows.append((model.table or model.view, own, ",".join(x["name"] for x in model.of("sub_resource")), ",".join(next(iter(model.of("rest")), {"methods": METHODS})["methods"]), not model.of("not_served")))
    return local_frame(spark, rows, "owner string,resource string,sub_resources string,methods string,served boolean").withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in ("sub_resources", "methods")})


# what models say about rows


def decoded_enumeration(c: ColumnMapping) -> Column:
    """The label of a code; null for unknown ones."""
    pairs = [F.lit(x) for pair in zip(c.extra["values"], c.extra["labels"], strict=True) for x in pair]
    return F.element_at(F.create_map(*pairs), F.col(c.name))


def rules_of(model: Model) -> list[Rule]:
    """The rules of all columns that are to be validated."""
    return [r for c in model.columns if not c.has("NoValidate") for r in c.rules]


def rows_of(model: Model, rows: DataFrame, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """rows with the model's joined and calculated fields, in its order."""
    for c in model.columns:
        if c.kind == "join":
            x = c.extra
            other = (others or {})[x["table"]].select(F.col(x["column"]).alias("_ref"), F.col(x["shown"]).alias(x["alias"]))
            rows = rows.join(other, rows[c.name] == other["_ref"], x["how"]).drop("_ref")
        elif c.kind == "calculated":
            rows = rows.withColumn(c.name, F.expr(c.extra["expression"]))
    for x in model.of("order_by"):
        rows = rows.orderBy(*[F.desc(c.rsplit(" ", 1)[0]) if c.upper().endswith(" DESC") else F.asc(c) for c in x["columns"]])
    return rows


def aggregated(model: Model, rows: DataFrame) -> DataFrame:
    """The model's active aggregate fields; fields of one grouping come together, so all must have the same one."""
    fields = [c for c in model.columns if c.kind == "aggregate" and c.extra["active"]]
    if not fields or any(c.extra["group"] != fields[0].extra["group"] for c in fields):
        raise ModelError("aggregate fields need one grouping")
    return rows.groupBy(*fields[0].extra["group"]).agg(*[F.expr(c.extra["expression"]).alias(c.name) for c in fields])


#: The most rows of the model and of the other table that may share a key, by multiplicity; None is any number.
_BOUNDS = {"OneToOne": (1, 1), "OneToMany": (1, None), "ManyToOne": (None, 1), "ManyToMany": (None, None)}


def association_violations(models: Iterable[Model], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(association, key, own_rows, other_rows) of the keys that have more rows on a side than the multiplicity of an association allows, for all associations of the models at once.

    tables: rows by table name. Each table is read once, however many associations name it; rows become counts of (association, key) before they are shuffled, so a key that a third of all rows
    have is one small row of each task. Associations that allow any number on both sides take no part. Keys with a null refer to nothing and don't count; key is the JSON text of the key's values,
    made of those that are returned alone, so keys of several columns and any types are told apart.
    """
    wanted: dict[str, list[Column]] = {}
    bounds: list[tuple[int, str, int, int]] = []
    free = False
    for model in models:
        for c in model.columns:
            if c.kind != "association":
                continue
            own, other = _BOUNDS[c.extra["multiplicity"]]
            if own is None and other is None:
                free = True
                continue
            number = len(bounds)
            bounds.append((number, f"{model.table}.{c.attribute}", -1 if own is None else own, -1 if other is None else other))
            for table, columns, side in ((model.table, c.name, (1, 0)), (c.extra["table"], c.extra["reference"], (0, 1))):
                names = _names(columns)
                key = F.array(*[F.col(f"`{x}`").cast("string") for x in names])
                given = reduce(Column.__and__, [F.col(f"`{x}`").isNotNull() for x in names])
                wanted.setdefault(table, []).append(F.when(given, F.struct(F.lit(number).alias("number"), key.alias("key"), F.lit(side[0]).alias("own"), F.lit(side[1]).alias("other"))))
    if not wanted:
        if not free:
            raise ModelError("the models have no associations")
        return next(iter(tables.values())).sparkSession.createDataFrame([], "association string, key string, own_rows long, other_rows long")
    rows = reduce(DataFrame.union, [tables[t].select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*") for t, parts in wanted.items()])
    counted = rows.groupBy("number", "key").agg(F.sum("own").alias("own_rows"), F.sum("other").alias("other_rows"))
    limits = local_frame(rows.sparkSession, bounds, "number int, association string, most_own int, most_other int")
    kept = counted.join(F.broadcast(limits), "number").filter("(most_own >= 0 and own_rows > most_own and other_rows > 0) or (most_other >= 0 and other_rows > most_other and own_rows > 0)")
    return kept.select("association", F.to_json("key").alias("key"), "own_rows", "other_rows")
