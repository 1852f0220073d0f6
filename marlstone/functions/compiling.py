"""Predicates to Spark columns that keep their meaning with Parquet pushdown on.

Pushdown evaluates comparisons on floating columns by its own rules for NaN and zeros, so those are
written in forms whose pushed parts can only be true where the whole is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce
from uuid import UUID

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from . import geometry
from .predicate import Always, And, BoxTest, Compare, GeometryFiltered, GeometryTest, In, IsNotNull, IsNull, Not, Or, Predicate, Quantified, RowsExcluded, normal
from .temporal import ntz_micros

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
MAX_LISTED = 1_000


@dataclass(frozen=True)
class Leaf:
    """A resolved column: its expression, its type, and whether it is repeated; a repeated leaf's
    expression is one flat array."""

    path: str
    value: Column
    type: T.DataType
    repeated: bool


def resolve(schema: T.StructType, path: str) -> Leaf:
    """Find a leaf by its dotted path. Inside lists the steps `list.element` may be left out or
    written; maps are entered by `key_value.key`, `key_value.value`, `key` or `value`."""
    steps, at = path.split("."), 0
    names = {f.name: f.dataType for f in schema.fields}
    if path in names:
        steps = [path]
    if steps[0] not in names:
        raise SchemaError(f"there is no column {path!r}")
    value, kind, repeated = F.col(f"`{steps[0]}`"), names[steps[0]], False
    at = 1
    while True:
        if isinstance(kind, T.ArrayType):
            if repeated:
                value = F.flatten(F.filter(value, lambda x: x.isNotNull()))
            kind, repeated = kind.elementType, True
            if steps[at : at + 2] in (["list", "element"], ["list", "item"]):
                at += 2
            elif steps[at : at + 1] in (["element"], ["array"]) and not (isinstance(kind, T.StructType) and steps[at] in kind.names):
                at += 1
            continue
        if at == len(steps):
            break
        if isinstance(kind, T.MapType):
            at += steps[at] == "key_value"
            part = steps[at] if at < len(steps) else ""
            if part not in ("key", "value"):
                raise SchemaError(f"{path!r} does not name the key or the value of a map")
            take = F.map_keys if part == "key" else F.map_values
            value = F.flatten(F.transform(F.filter(value, lambda m: m.isNotNull()), take)) if repeated else take(value)
            kind, repeated = (kind.keyType if part == "key" else kind.valueType), True
            at += 1
        elif isinstance(kind, T.StructType) and steps[at] in kind.names:
            name = steps[at]
            value = F.transform(value, lambda s: s.getField(name)) if repeated else value.getField(name)
            kind = kind[name].dataType
            at += 1
        else:
            raise SchemaError(f"{path!r}: {steps[at]!r} is not a member of {kind.simpleString()}")
    if isinstance(kind, (T.StructType, T.MapType)):
        raise SchemaError(f"{path!r} is a group, not a leaf")
    return Leaf(path, value, kind, repeated)


def _literal(leaf: Leaf, v) -> tuple[Column, Column] | None:
    """(column, literal) ready to compare, or an error naming both types."""
    c, t = leaf.value, leaf.type

    def wrong() -> SchemaError:
        return SchemaError(f"column {leaf.path!r} of type {t.simpleString()} cannot be compared with {type(v).__name__} {v!r}")

    if isinstance(v, bool):
        if not isinstance(t, T.BooleanType):
            raise wrong()
        return c, F.lit(v)
    if isinstance(t, T.BooleanType):
        raise wrong()
    if isinstance(t, WHOLE):
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise wrong()
            return c, F.lit(v)
        raise wrong()
    if isinstance(t, T.DecimalType):
        if isinstance(v, Decimal):
            return c, F.lit(v)
        raise wrong()
    if isinstance(t, T.StringType):
        if isinstance(v, str):
            return c, F.lit(v)
        raise wrong()
    if isinstance(t, T.BinaryType):
        if isinstance(v, UUID):
            return c, F.lit(bytearray(v.bytes))
        if isinstance(v, (bytes, bytearray)):
            return c, F.lit(bytearray(v))
        if isinstance(v, str):
            return c, F.lit(bytearray(v.encode()))
        raise wrong()
    if isinstance(t, T.DateType):
        if isinstance(v, date) and not isinstance(v, datetime):
            return c, F.lit(v)
        if isinstance(v, int):
            return F.unix_date(c), F.lit(v)
        raise wrong()
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(v, datetime):
            if (v.tzinfo is None) != isinstance(t, T.TimestampNTZType):
                raise wrong()
            text = v.isoformat(sep=" ")
            return c, F.lit(text).cast("timestamp_ntz" if v.tzinfo is None else "timestamp")
        if isinstance(v, int):
            return (F.unix_micros(c) if isinstance(t, T.TimestampType) else ntz_micros(c)), F.lit(v)
        raise wrong()
    if t.simpleString().startswith("time") and isinstance(v, time):
        return c, F.lit(v)
    raise wrong()


def _floating(leaf: Leaf, op: str, v) -> Column:
    c = leaf.value
    if isinstance(v, bool) or not isinstance(v, (int, float, np.floating)):
        raise SchemaError(f"column {leaf.path!r} of type {leaf.type.simpleString()} cannot be compared with {v!r}")
    x, nan = float(v), F.isnan(c)
    if math.isnan(x):
        return {"eq": nan, "ne": c.isNotNull() & ~nan}.get(op, F.lit(False))
    kind = "double"
    if isinstance(leaf.type, T.FloatType):
        # a literal that is written as some float is written is that float; any other stays exact
        with np.errstate(over="ignore"):
            near = np.float32(x)
        if isinstance(v, np.float32) or str(near) == repr(x) or float(near) == x:
            kind, x = "float", float(near)
        else:
            c = c.cast("double")
    lit = lambda y: F.lit(y).cast(kind)
    if x == 0:
        zero, minus = lit(0.0), lit(-0.0)
        either = (c == zero) | (c == minus)
        return {"eq": either, "ne": ~either | nan, "lt": c < minus, "ge": (c >= minus) & ~nan, "le": (c <= zero) & ~nan, "gt": (c > zero) & ~nan}[op]
    y = lit(x)
    return {"eq": c == y, "ne": (c != y) | nan, "lt": c < y, "le": (c <= y) & ~nan, "gt": (c > y) & ~nan, "ge": (c >= y) & ~nan}[op]


OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def _leaf(p: Predicate, leaf: Leaf) -> Column:
    """A predicate on one value."""
    match p:
        case Compare(_, op, v):
            if v is None:
                raise SchemaError(f"column {leaf.path!r}: null is tested with IS NULL")
            if isinstance(leaf.type, FLOATING):
                return _floating(leaf, op, v)
            return OPS[op](*_literal(leaf, v))
        case In(c, values):
            if isinstance(leaf.type, FLOATING):
                return reduce(Column.__or__, (_floating(leaf, "eq", v) for v in values), F.lit(False))
            pairs = [_literal(leaf, v) for v in values]
            return pairs[0][0].isin([x for _, x in pairs]) if pairs else F.lit(False)
        case IsNull():
            return leaf.value.isNull()
        case IsNotNull():
            return leaf.value.isNotNull()
        case And(parts):
            return reduce(Column.__and__, (_leaf(x, leaf) for x in parts))
        case Or(parts):
            return reduce(Column.__or__, (_leaf(x, leaf) for x in parts))
        case Always(v):
            return F.lit(v)
    raise SchemaError(f"{type(p).__name__} is no condition on an element")


def _quantified(kind: str, part: Predicate, schema: T.StructType) -> Column:
    from .predicate import columns

    names = columns(part)
    if len(names) != 1:
        raise SchemaError("a quantified condition is on exactly one column")
    leaf = resolve(schema, names.pop())
    if not leaf.repeated:
        raise SchemaError(f"{leaf.path!r} is not repeated")
    if isinstance(leaf.type, T.DecimalType):
        raise SchemaError(f"{leaf.path!r}: decimal elements cannot be quantified")
    _leaf(part, leaf)  # validates even where no element is read
    items = F.coalesce(leaf.value, F.array().cast(T.ArrayType(leaf.type)))
    test = lambda e: F.coalesce(_leaf(part, Leaf(leaf.path, e, leaf.type, False)), F.lit(False))
    if kind == "any":
        return F.exists(items, test)
    if kind == "all":
        return F.forall(items, test)
    return F.size(F.filter(items, test)) == 1


def _absent(where: Column, positions: np.ndarray) -> Column:
    """Positions not among many sorted ones, which would not fit a plan."""

    @F.pandas_udf(T.BooleanType())
    def absent(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(positions[np.minimum(np.searchsorted(positions, at), len(positions) - 1)] != at)

    return absent(where)


def compiled(p: Predicate, schema: T.StructType, coverings: dict[str, str] | None = None, position: Column | None = None) -> Column:
    """One Spark column for a predicate over a schema; every name and literal is checked here.
    `coverings` maps geometry columns to struct columns xmin, ymin, xmax, ymax that hold their
    boxes; tests on them come first and reach the scan."""
    coverings = coverings or {}

    def go(q: Predicate) -> Column:
        match q:
            case Always(v):
                return F.lit(v)
            case And(parts):
                return reduce(Column.__and__, map(go, parts))
            case Or(parts):
                return reduce(Column.__or__, map(go, parts))
            case Not(Quantified() as part):
                return ~go(part)
            case Not(part):
                leaf = resolve(schema, part.column)
                return leaf.value.isNotNull() & ~go(part)
            case Quantified(kind, part):
                return _quantified(kind, part, schema)
            case BoxTest(c, relation, box):
                leaf = resolve(schema, c)
                if not isinstance(leaf.type, T.BinaryType):
                    raise SchemaError(f"{c!r} is not a geometry column")
                test = geometry.box_test(geometry.envelope(leaf.value), relation, box)
                return geometry.covering(coverings[c], relation, box) & test if c in coverings else test
            case GeometryTest(c, relation, wkb, distance):
                leaf = resolve(schema, c)
                if not isinstance(leaf.type, T.BinaryType):
                    raise SchemaError(f"{c!r} is not a geometry column")
                test = geometry.relation(leaf.value, relation, wkb, distance)
                need = geometry.pruning(relation, wkb, distance)
                if need and c in coverings:
                    test = geometry.covering(coverings[c], *need) & test
                return test
            case GeometryFiltered(test):
                from .hooks import geometry_gate

                leaf = resolve(schema, test.column)
                if not isinstance(leaf.type, T.BinaryType):
                    raise SchemaError(f"{test.column!r} is not a geometry column")
                gate, need = geometry_gate(leaf.value, test), test.box()
                return geometry.covering(coverings[test.column], *need) & gate if need and test.column in coverings else gate
            case RowsExcluded(positions):
                where = position if position is not None else F.col("_metadata.row_index")
                if len(positions) <= MAX_LISTED:
                    return ~where.isin(sorted(positions)) if positions else F.lit(True)
                return _absent(where, np.array(sorted(positions), np.int64))
            case _:
                leaf = resolve(schema, q.column)
                if leaf.repeated:
                    raise SchemaError(f"{q.column!r} is repeated: a condition on it needs ANY, ALL or ONE")
                return _leaf(q, leaf)

    return go(normal(p))
