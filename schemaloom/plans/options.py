"""Settings of a comparison."""

from __future__ import annotations

from dataclasses import dataclass

from .. import dialects as D
from ..functions.keys import ascii_upper_text, valid_schema_name

# The operations that a policy can allow.
OPERATIONS = (
    "CreateTable", "DropTable", "CreateColumn", "DropColumn", "AlterColumn", "AlterColumnPosition", "AlterDefaultValue", "DropDefaultValue", "RebuildColumn",
    "CreatePrimaryKey", "DropPrimaryKey", "CreateForeignKey", "DropForeignKey", "CreateIndexe", "DropIndexe", "CreateCheck", "AlterCheck", "DropCheck",
    "CreateView", "DropView", "CreateTrigger", "DropTrigger", "CreateSequence", "AlterSequence", "DropSequence", "CreateDomain", "DropDomain",
    "CreateProcedure", "DropProcedure", "SetComment",
)
FULL = frozenset(OPERATIONS)
ADDITIVE = frozenset({"CreateTable", "CreateColumn", "CreatePrimaryKey", "CreateForeignKey"})
#: The operation that a policy must allow for a command; guards need none; other commands are denied.
COMMAND_OPERATIONS = {
    **{x: x for x in OPERATIONS if x not in ("RebuildColumn", "SetComment")},
    **dict.fromkeys(("CreateColumnRebuild", "CopyColumnData", "BackfillColumnData", "DropColumnRebuild", "RenameColumn"), "RebuildColumn"),
    **dict.fromkeys(("SetTableComment", "SetColumnComment"), "SetComment"),
}
GUARDS = ("EnableForeignKeys", "EnableTriggers")

IN_PLACE, REBUILD = "in_place", "rebuild"
STOP, CONTINUE = "stop", "continue"


class InvalidOption(ValueError):
    """An option with a value that it can't take."""


@dataclass(frozen=True)
class CompareOptions:
    """How two catalogs are compared and how the plan is applied.

    model_mode: the desired side is a set of declared models, which have no views' or routines' texts. strict_keys also compares the order of key
    columns and extra ones. extracted: the kinds that the current side's source can read (None: all); others are not compared. schema: the schema that
    statements name, for catalogs of one. schemas: for catalogs of several, (desired, current) names of schemas that stand for each other; statements name the current one.
    """

    dialect: str = D.SPARK
    policy: frozenset[str] = FULL
    model_mode: bool = False
    compare_positions: bool = False
    compare_initial_values: bool = False
    compare_descriptions: bool = False
    strict_keys: bool = False
    strategy: str = IN_PLACE
    sequenced: bool = True
    on_error: str = STOP
    raise_on_error: bool = True
    schema: str = ""
    extracted: frozenset[str] | None = None
    schemas: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        D.features(self.dialect)
        valid_schema_name(self.schema)
        desired, current = zip(*self.schemas) if self.schemas else ((), ())
        if len({ascii_upper_text(x) for x in desired}) < len(desired) or len({ascii_upper_text(x) for x in current}) < len(current):
            raise InvalidOption(f"schemas: {self.schemas}")
        if unknown := self.policy - FULL:
            raise InvalidOption(f"policy: {sorted(unknown)}")
        if self.strategy not in (IN_PLACE, REBUILD):
            raise InvalidOption(f"strategy: {self.strategy}")
        if self.on_error not in (STOP, CONTINUE):
            raise InvalidOption(f"on_error: {self.on_error}")

    def compares(self, feature: str) -> bool:
        return feature in D.features(self.dialect) and (self.extracted is None or feature in self.extracted)
