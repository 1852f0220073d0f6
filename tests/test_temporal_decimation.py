"""Temporal relations against their definitions, and thinning with large geometries."""

from datetime import datetime

import pytest

from marlstone.errors import FilterError
from marlstone.functions import geometry
from marlstone.functions.predicate import Always, Box, col
from marlstone.functions.temporal import related
from marlstone.operators.decimation import decimated

A, B = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_relations():
    t = col("t")
    assert related("t", "contains", A, B, literal_first=True) == related("t", "during", A, B)
    assert related("t", "begun_by", A, B, literal_first=True) == t.eq(A)
    assert related("t", "ended_by", A, B, literal_first=True) == t.eq(B)
    assert related("t", "before", A, B, literal_first=True) == t.gt(B)
    assert related("t", "equals", A) == t.eq(A) and related("t", "before", A) == t.lt(A)
    for r in ("meets", "met_by", "overlaps", "overlapped_by", "contains", "begun_by", "equals"):
        assert related("t", r, A, B) == Always(False)
    for r in ("during", "begins", "ends"):
        assert related("t", r, A) == Always(False)
    with pytest.raises(FilterError):
        related("t", "near", A)


def test_decimation_keeps_large(spark):
    rows = [(1, bytearray(geometry.write_point(1, 1))), (2, bytearray(geometry.write_point(1.5, 1.5))), (3, bytearray(geometry.rectangle(0, 0, 50, 50))), (4, bytearray(geometry.rectangle(0, 0, 50, 50))), (5, None), (6, bytearray(geometry.write_point(200, 1)))]
    df = spark.createDataFrame(rows, "id int, g binary")
    assert sorted(r["id"] for r in decimated(df, "g", Box(0, 0, 100, 100), 10, 10, "id").collect()) == [1, 3, 4]
    assert decimated(df.where("false"), "g", Box(0, 0, 100, 100), 10, 10, "id").count() == 0
