"""The float grid with pushdown on and off, quantifiers, errors, texts, partitions and geometry."""

import math
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from marlstone.errors import FilterError, SchemaError
from marlstone.functions import geometry
from marlstone.functions.compiling import compiled
from marlstone.functions.predicate import And, Box, BoxTest, Not, Or, RowsExcluded, col, columns, normal
from marlstone.plans.explain import explain, file_stats
from marlstone.plans.query import Constant, Null, Physical, Promoted, Query, RowPosition, of_leaves
from marlstone.plans.sqlfilter import parse
from marlstone.sources.fileset import open_fileset, open_per_file, partition_values, spelled_type
from marlstone.streaming import read_files, run

nan, inf = math.nan, math.inf
GRID = [[1.0, 2.0, nan], [1.0, 1.0, nan], [-0.0, -0.0], [0.0, 0.0], [nan, None], [-0.0, 0.0, None, nan, 5.0, -inf, inf], [-5.0, -0.0]]


def expected(op, x, v):
    if x is None:
        return False
    if math.isnan(x) or math.isnan(v):
        both = math.isnan(x) and math.isnan(v)
        return both if op == "eq" else not both if op == "ne" else False
    return {"eq": x == v, "ne": x != v, "lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v}[op]


@pytest.mark.parametrize("kind", [pa.float64(), pa.float32()])
def test_float_grid(spark, tmp_path, kind):
    for i, values in enumerate(GRID):
        pq.write_table(pa.table({"f": pa.array([i] * len(values)), "x": pa.array(values, kind)}), tmp_path / f"{i}.parquet")
    for push in ("true", "false"):
        spark.conf.set("spark.sql.parquet.filterPushdown", push)
        try:
            for i, values in enumerate(GRID):
                df = spark.read.parquet(str(tmp_path / f"{i}.parquet"))
                parts, want = [], []
                for op in ("eq", "ne", "lt", "le", "gt", "ge"):
                    for v in (0.0, -0.0, 1.0, 2.0, nan, inf, 5.0):
                        p = getattr(col("x"), op)(v)
                        parts.append(df.where(compiled(p, df.schema)).selectExpr(f"{len(want)} as k"))
                        want.append(sum(expected(op, x, v) for x in values))
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionAll(p)
                got = [0] * len(want)
                for r in out.collect():
                    got[r.k] += 1
                assert got == want, (push, i)
        finally:
            spark.conf.unset("spark.sql.parquet.filterPushdown")


def test_plan_prunes_and_pushes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    q = Query(predicate=col("l_quantity").ge(45) & col("l_returnflag").eq("R"), columns=(Physical("l_orderkey"),))
    plan = q.rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag)" in plan
    assert "l_extendedprice" not in plan and "Exchange" not in plan


def test_normal_form():
    p = Not(And((col("a").gt(5), Or((col("b").is_null(), col("c").any().eq(1))))))
    assert columns(normal(p)) == {"a", "b", "c"}
    assert normal(Not(col("a").isin())) == normal(Not(Not(normal(Not(col("a").isin())))))




def test_errors(spark):
    df = spark.createDataFrame([], "i int, s string, d decimal(9,2), l array<int>, ld array<decimal(9,2)>, t timestamp_ntz, st struct<a:int>, g binary")
    bad = [col("no").eq(1), col("i").eq("x"), col("i").eq(1.5), col("s").eq(1), col("d").eq(1), col("l").eq(1), col("i").any().eq(1), col("ld").any().eq(Decimal(1)), col("st").eq(1), col("i").eq(None), col("i").eq(True), BoxTest("s", "intersects", Box(0, 0, 1, 1))]
    for p in bad:
        with pytest.raises(SchemaError):
            compiled(p, df.schema)
    for text in ("upper(s) = 'x'", "s > 'a'", "i =", "i = 1 1", "1 = i", "s = x", "i BETWEEN 1", "ST_Touches(ST_Extent(g), ST_MakeEnvelope(0,0,1,1))", "i = 99999999999999999999", "s LIKE 'a%'", "i ; 1"):
        with pytest.raises((FilterError, SchemaError)):
            parse(text, df.schema)
    assert FilterError.exit_code == 5 and SchemaError.exit_code == 3


def test_produced_columns(spark):
    df = spark.createDataFrame([(1, (1.0, "a")), (2, None)], "i int, s struct<x:double,y:string>")
    with pytest.raises(ValueError):
        Query(columns=(Physical("i"), Physical("i"))).rows(df)
    with pytest.raises(SchemaError):
        Query(columns=(Promoted("i", "i", "string"),)).rows(df)
    out = Query(columns=(Promoted("i", "i", "bigint"), Constant("c", 2.5), Null("n", "date"))).rows(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "double", "date"]
    leaves = df.select(*of_leaves(df.schema, ["s.y", "i"]))
    assert leaves.columns == ["i", "s"] and leaves.schema["s"].dataType.names == ["y"]
    assert [r.s for r in leaves.orderBy("i").collect()][1] is None


def test_positions(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    q = Query(predicate=RowsExcluded(frozenset({1, 2})) & col("id").lt(6), columns=(Physical("id"), RowPosition("p", 100)))
    assert [tuple(r) for r in q.rows(df, in_order=True).collect()] == [(0, 100), (3, 103), (4, 104), (5, 105)]


def test_hive_and_schemas(spark, tmp_path):
    assert [spelled_type(v) for v in (["01", "2"], ["1", "2"], ["1", "2.5"], ["2.5"], ["2020-01-01"], ["x"])] == ["string", "bigint", "string", "double", "date", "string"]
    assert partition_values("a/k=x%20y/=1/b=/f.parquet") == {"k": "x y"}
    for k, n in (("1", 1), ("22", 2)):
        (tmp_path / "t" / f"k={k}").mkdir(parents=True)
        pq.write_table(pa.table({"id": [n]}), tmp_path / "t" / f"k={k}" / "f.parquet")
    fs = open_fileset(spark, str(tmp_path / "t"))
    df = fs.frame()
    assert df.schema["k"].dataType.simpleString() == "bigint"
    assert [tuple(r) for r in df.where(compiled(col("k").gt(5), df.schema)).collect()] == [(2, 22)]
    with pytest.raises(SchemaError):
        open_per_file(spark, str(tmp_path / "t"))
    (tmp_path / "t" / "k=3").mkdir()
    pq.write_table(pa.table({"other": ["x"]}), tmp_path / "t" / "k=3" / "f.parquet")
    with pytest.raises(SchemaError, match="differ"):
        open_fileset(spark, str(tmp_path / "t"))


def test_explain(spark, tmp_path):
    pq.write_table(pa.table({"a": list(range(100)), "b": [None] * 50 + [1.0] * 50}), tmp_path / "f.parquet", row_group_size=50)
    path = str(tmp_path / "f.parquet")
    see = lambda p: [r.verdict for r in explain(spark, [path], p).orderBy("row_group").collect()]
    assert see(col("a").lt(50)) == ["all", "none"]
    assert see(col("a").ge(60)) == ["none", "some"]
    assert see(col("b").is_null()) == ["all", "none"]
    assert see(col("b").eq(1.0)) == ["none", "some"]
    assert see(col("a").lt(50) | col("a").ge(50)) == ["all", "all"]
    assert file_stats(spark, [path]).count() == 4


def test_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    df = read_files(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType())]))
    out = run(df, Query(predicate=col("id").ge(15), columns=(Physical("n", "id"),)))
    q = out.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("seen").collect()) == [15, 16, 17, 18, 19]


def test_wkb_forms():
    import struct

    forms = [
        struct.pack("<BIdd", 1, 1, 3, 4), struct.pack(">BIdd", 0, 1, 3, 4), struct.pack("<BIIdd", 1, 0x20000001, 4326, 3, 4),
        struct.pack("<BIddd", 1, 1001, 3, 4, 9), struct.pack("<BIdddd", 1, 3001, 3, 4, 9, 9), struct.pack("<BIddd", 1, 0x80000001, 3, 4, 9),
    ]
    assert {geometry.box_of(f) for f in forms} == {(3.0, 4.0, 3.0, 4.0)}
    assert geometry.box_of(struct.pack("<BIdd", 1, 1, nan, nan)) is None
    assert geometry.box_of(geometry.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 7, 5 5)))")) == (0, 0, 6, 7)


NAMES = {"intersects": "intersects", "disjoint": "disjoint", "touches": "touches", "crosses": "crosses", "overlaps": "overlaps", "contains": "contains", "within": "within", "covers": "covers", "covered_by": "coveredBy"}
SHAPES = [
    "POINT (1 1)", "POINT (0 0)", "POINT (5 5)", "LINESTRING (0 0, 4 0)", "LINESTRING (1 1, 3 3)", "LINESTRING (-1 1, 5 1)", "LINESTRING (2 0, 6 0)",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))", "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))",
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1))", "MULTIPOINT ((1 1), (9 9))",
]


def test_relations_against_jts(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    theirs = [reader.read(s) for s in SHAPES]
    ours = [geometry.read(geometry.from_wkt(s)) for s in SHAPES]
    wrong = []
    for i, a in enumerate(ours):
        for j, b in enumerate(ours):
            for name, method in NAMES.items():
                if geometry.related(a, b, name) != getattr(theirs[i], method)(theirs[j]):
                    wrong.append((SHAPES[i], name, SHAPES[j]))
            if abs(geometry.distance(a, b) - theirs[i].distance(theirs[j])) > 1e-9:
                wrong.append((SHAPES[i], "distance", SHAPES[j]))
    assert not wrong


def test_dates_in_texts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 12),)], "t timestamp_ntz")
    assert df.where(compiled(parse("t >= '2024-01-01 12:00:00'", df.schema), df.schema)).count() == 1
