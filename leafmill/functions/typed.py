"""Typed values of options as VARIANT: a value keeps the type that it was set with, and accessors give it only if asked for in that type.

A value is an array (of truth values, whole numbers or floating ones) or a string; one that is not set is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a VARIANT names what it holds.
ARRAYS = {"boolean": "ARRAY<BOOLEAN>", "int": "ARRAY<BIGINT>", "double": "ARRAY<DOUBLE>"}


def typed(values: Column) -> Column:
    """An array or a string as a VARIANT, with its type."""
    return values.cast("variant")


def _only(value: Column, kind: str) -> Column:
    """The single element of an array of that kind; null for other types, no or several elements, a null element, and numbers beyond the type."""
    alone = F.size(F.try_variant_get(value, "$", "array<variant>")) == 1
    return F.when((F.schema_of_variant(value) == ARRAYS[kind]) & alone, F.try_variant_get(value, "$[0]", kind))


def as_bool(value: Column) -> Column:
    return _only(value, "boolean")


def as_int(value: Column) -> Column:
    return _only(value, "int")


def as_double(value: Column) -> Column:
    return _only(value, "double")


def as_string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
