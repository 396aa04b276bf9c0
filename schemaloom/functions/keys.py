"""Identities of catalog objects. Case is folded for ASCII letters only, so identifiers in other scripts stay as they are."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SCHEMA_NAME = 128
_FOLD = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)


class InvalidSchemaName(ValueError):
    """A schema name that can't be used unquoted."""


def ascii_upper_text(text: str) -> str:
    return text.translate(_FOLD)


def ascii_upper(text: Column | str) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, string.ascii_lowercase, string.ascii_uppercase)


def schema_prefix_text(schema: str) -> str:
    """What keys of a schema's objects begin with. A schema with a dot or a quote is quoted, so no two schemas have prefixes of which one begins with the other."""
    key = ascii_upper_text(schema)
    return ('"' + key.replace('"', '""') + '"' if "." in key or '"' in key else key) + "."


def schema_prefix(schema: Column) -> Column:
    key = ascii_upper(schema)
    quoted = F.concat(F.lit('"'), F.replace(key, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat(F.when(key.contains(".") | key.contains('"'), quoted).otherwise(key), F.lit("."))


def qualified_key(schema: Column, key: Column) -> Column:
    """A key of an object in a catalog of several schemas."""
    return F.concat(schema_prefix(schema), key)


def position_key(position: Column | str) -> Column:
    """Positions as text of six digits, which sorts as the positions do."""
    return F.lpad((F.col(position) if isinstance(position, str) else position).cast("string"), 6, "0")


def routine_key(name: Column, signature: Column) -> Column:
    """Identity of a routine: overloads differ by their signature."""
    return ascii_upper(F.when(F.trim(signature) != "", F.concat(name, F.lit("("), signature, F.lit(")"))).otherwise(name))


def valid_schema_name(name: str) -> str:
    """name, if it is empty or an unquoted identifier of at most MAX_SCHEMA_NAME characters."""
    if name and (len(name) > MAX_SCHEMA_NAME or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name, re.ASCII)):
        raise InvalidSchemaName(repr(name[:200]))
    return name
