"""Where a caller's own code comes in: row and batch materializers, geometry filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol, TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import geometry

A = TypeVar("A")


def materialized(df: DataFrame, make: Callable[[T.StructType, Row], A]) -> Iterator[A]:
    """`make(schema, row)` of every row, lazily, a partition at a time."""
    schema = df.schema
    for row in df.toLocalIterator():
        yield make(schema, row)


def mapped(df: DataFrame, make: Callable[[Row], Any], schema: str) -> DataFrame:
    """`make(row)`, a tuple or dict in the order of `schema`, of every row, on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = [f.name for f in arrow]

    def run(batches):
        for b in batches:
            made = [make(Row(**r)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([m if isinstance(m, dict) else dict(zip(names, m)) for m in made], arrow)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def mapped_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`make(batch)` of every Arrow batch, on the executors."""

    def run(batches):
        for b in batches:
            yield make(b)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class GeometryFilter(Protocol):
    """An exact test of a geometry column. `box` gives the box test that a match implies, as
    (relation, Box), or None; `matches` is asked only where it holds."""

    column: str

    def box(self) -> tuple[str, Any] | None: ...

    def matches(self, shape: geometry.Shape) -> bool: ...


def geometry_gate(column: Column, test: GeometryFilter) -> Column:
    """A filter as one boolean column; null geometries do not match. Envelopes of a batch are tested
    at once, and only geometries that pass are decoded."""
    need = test.box()

    @F.pandas_udf(T.BooleanType())
    def gate(values: pd.Series) -> pd.Series:
        values = [v if v is None else bytes(v) for v in values]
        could = np.fromiter((v is not None for v in values), bool, len(values))
        if need:
            could &= geometry.boxes_related(geometry._boxes(values), *need)
        return pd.Series([bool(c) and bool(test.matches(geometry.read(v))) for c, v in zip(could, values)])

    return F.coalesce(gate(column), F.lit(False))
