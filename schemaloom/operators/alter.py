"""Column changes that an ALTER COLUMN could not do safely become steps that keep the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dialects as D
from ..functions.render import cat
from ..functions.types import base_type, is_char_type, type_category
from ..plans.options import REBUILD, CompareOptions

TEMPORARY = "_MDBTMP"
RISK_REBUILT = "RISK: SET NOT NULL after the rebuild fails if the column has nulls, for there is no default to fill them with"
RISK_IN_PLACE = "RISK: NOT NULL is added to a column without a default; rows with nulls make it fail"
_REBUILD_STEPS = ("CreateColumnRebuild", "CopyColumnData", "DropColumnRebuild", "RenameColumn")


def requires_rebuild(new: Column, old: Column, dialect: str) -> Column:
    """Whether values may not survive the change in place; new and old are attrs of a column."""
    if dialect == D.SQLITE:
        return F.lit(False)
    a, b = base_type(new["type_name"]), base_type(old["type_name"])
    number = lambda x, name: x[name].cast("int")
    narrower = number(new, "size") < number(old, "size")
    if dialect in D.FIREBIRD_FAMILY:
        same = (a == b) & (number(new, "size") == number(old, "size")) & (number(new, "precision") == number(old, "precision")) & (number(new, "scale") == number(old, "scale"))
        return F.when((a == b) & is_char_type(a), narrower).otherwise(~same)
    p, q = number(new, "precision"), number(old, "precision")
    return (type_category(a) != type_category(b)) | (is_char_type(a) & narrower) | ((p > 0) & (q > 0) & (p < q))


def classified(new: Column, old: Column, dialect: str) -> Column:
    """TypeRebuild, BackfillNotNull, InPlaceWithWarning or InPlace."""
    stricter = (new["not_null"] == "true") & (old["not_null"] != "true")
    has_default = F.trim(new["default_value"]) != ""
    return F.when(requires_rebuild(new, old, dialect), "TypeRebuild").when(stricter & has_default, "BackfillNotNull").when(stricter, "InPlaceWithWarning").otherwise("InPlace")


def expanded(changes: DataFrame, options: CompareOptions) -> tuple[DataFrame, DataFrame]:
    """(changes with the steps of unsafe column changes in ops and risks in notes, audit of rebuilds that the policy does not allow)"""
    refused = changes.sparkSession.createDataFrame([], changes.select("place", "audit").schema)
    if options.strategy != REBUILD:
        return changes.withColumn("notes", F.array().cast("array<string>")), refused
    new = F.col("m")["attrs"]
    kind = F.when(F.array_contains("ops", "AlterColumn"), classified(new, F.col("t")["attrs"], options.dialect)).otherwise("None")
    changes = changes.withColumn("_kind", kind)
    unsafe = F.col("_kind").isin("TypeRebuild", "BackfillNotNull")
    if "RebuildColumn" not in options.policy:
        text = cat("REBUILD COLUMN ", F.col("m")["table_name"], ".", F.col("m")["name"], " suppressed by policy (kept in-place ALTER)")
        refused = changes.filter(unsafe).select("place", text.alias("audit"))
        changes = changes.withColumn("_kind", F.when(unsafe, "InPlace").otherwise(F.col("_kind")))
    not_null, has_default = new["not_null"] == "true", F.trim(new["default_value"]) != ""
    steps = lambda *names: F.array(*[F.lit(n) for n in names])
    rebuilt = F.when(not_null & has_default, steps(*_REBUILD_STEPS, "BackfillColumnData", "AlterColumn")).when(not_null, steps(*_REBUILD_STEPS, "AlterColumn")).otherwise(steps(*_REBUILD_STEPS))
    ops = F.when(F.col("_kind") == "TypeRebuild", rebuilt).when(F.col("_kind") == "BackfillNotNull", steps("BackfillColumnData", "AlterColumn")).otherwise(F.col("ops"))
    notes = F.when((F.col("_kind") == "TypeRebuild") & not_null & ~has_default, F.array(F.lit(RISK_REBUILT))).when(F.col("_kind") == "InPlaceWithWarning", F.array(F.lit(RISK_IN_PLACE))).otherwise(F.array().cast("array<string>"))
    return changes.withColumns({"ops": ops, "notes": notes}).drop("_kind"), refused
