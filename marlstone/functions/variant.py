"""Navigation in variant values, as expressions that stay in the JVM.

A step that does not fit (a field of a list, a value of another type) gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path such as `$.a[0].b`, as a SQL type."""
    return F.try_variant_get(v, path, kind)


def kind(v: Column) -> Column:
    """The type of a value, objects and lists with what they hold."""
    return F.schema_of_variant(v)


def fields(v: Column) -> Column:
    """Fields of an object by name."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def field_names(v: Column) -> Column:
    return F.sort_array(F.map_keys(fields(v)))


def field_count(v: Column) -> Column:
    return F.array_size(F.map_keys(fields(v)))


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def element_count(v: Column) -> Column:
    return F.array_size(elements(v))


def element(v: Column, index: int) -> Column:
    return F.get(elements(v), index)
