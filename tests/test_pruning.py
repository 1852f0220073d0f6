"""What statistics, paths and constants tell is held against the rows; writers, hooks and footers."""

import io
import json
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from marlstone.errors import CapabilityError, FilterError, FormatError, MalformedError, NotColumnarError, SchemaError, TableFormatError, WriteError
from marlstone.functions import geometry, hooks, variantjson
from marlstone.functions.compiling import compiled
from marlstone.functions.folding import folded, holds
from marlstone.functions.predicate import Always, And, Box, BoxTest, Compare, GeometryFiltered, GeometryTest, In, IsNotNull, IsNull, Not, Or, RowsExcluded, col, normal
from marlstone.operators.decimation import decimated
from marlstone.plans import counting, explain
from marlstone.plans.verdicts import Finding, Stats, leaf, stats_of, verdict
from marlstone.sources import geo, sinks
from marlstone.sources.fileset import open_fileset
from marlstone.sources.tables import Table
from marlstone.sources.tablewriter import TableWriter
from marlstone.sources.writer import Bloom, RowBuilder, WriteOptions, write

NAN = float("nan")


def matches(p, x) -> bool:
    match p:
        case And(parts):
            return all(matches(q, x) for q in parts)
        case Or(parts):
            return any(matches(q, x) for q in parts)
        case Compare(_, op, v):
            return holds(op, x, v)
        case In(_, values):
            return any(holds("eq", x, v) for v in values)
        case IsNull():
            return x is None
        case IsNotNull():
            return x is not None
    raise TypeError(p)


def leaves(v, w):
    a = col("a")
    return [a.eq(v), a.ne(v), a.lt(v), a.le(v), a.gt(v), a.ge(v), a.isin(v, w), a.isin(), a.is_null(), a.is_not_null()]


@pytest.mark.parametrize("kind", ["int", "float", "str"])
def test_verdicts_hold_for_the_rows(kind):
    rnd = random.Random(kind)
    some = {"int": [1, 2, 3, 4], "float": [1.0, 2.0, 3.0, NAN, NAN], "str": ["a", "b", "c"]}[kind]
    seen = set()
    for _ in range(4000):
        cells = [rnd.choice([None, *some]) for _ in range(rnd.randrange(1, 5))]
        real = [c for c in cells if c is not None and c == c]
        nulls = sum(c is None for c in cells)
        nans = sum(c is not None and c != c for c in cells) if kind == "float" and rnd.random() < 0.5 else None
        s = Stats(min(real) if real else None, max(real) if real else None, nulls if rnd.random() < 0.9 else None, nans, kind == "str")
        v, w = rnd.choice(some), rnd.choice(some)
        for p in [*leaves(v, w), And((col("a").ge(v), col("a").ne(w))), Or((col("a").lt(v), col("a").is_null())), Not(col("a").gt(v)), Not(Or((col("a").eq(v), col("a").is_null())))]:
            p = normal(p)
            told = verdict(p, {"a": s}, len(cells))[0]
            got = [matches(p, c) if not isinstance(p, Always) else p.value for c in cells]
            assert told != "none" or not any(got), (p, cells, s)
            assert told != "all" or all(got), (p, cells, s)
            if not isinstance(p, (And, Or, Always)):
                seen.add(leaf(p, {"a": s}, len(cells)))
    if kind == "float":
        assert {Finding.ONLY_NAN, Finding.NO_NAN, Finding.NAN_BESIDE_NULLS, Finding.EACH_CELL_NAN, Finding.NO_NAN_NOR_NULL, Finding.NO_NAN_BESIDE_NULLS, Finding.NAN_OUTSIDE_BOUNDS, Finding.NAN_ORDERS_NOTHING} <= seen


def test_findings():
    s = {"a": stats_of(1, 5, 0)}
    for p, want in ((col("a").eq(9), Finding.OUTSIDE_BOUNDS), (col("a").eq(3), Finding.WITHIN_BOUNDS), (col("a").eq("x"), Finding.LITERAL_OF_ANOTHER_TYPE), (col("b").eq(1), Finding.NO_STATISTICS), (col("a").ne(9), Finding.BOUNDS_MATCH), (col("a").is_null(), Finding.NO_NULLS), (col("a").is_not_null(), Finding.NO_NULLS_MATCH), (In("a", ()), Finding.NOTHING_LISTED)):
        assert leaf(p, s, 10) == want
    assert leaf(col("a").eq(4), {"a": stats_of(4, 4, 0)}, 3) == Finding.SINGLE_VALUE_MATCHES
    assert leaf(col("a").ne(4), {"a": stats_of(4, 4, 1)}, 3) == Finding.EACH_CELL_EQUAL
    assert leaf(col("a").eq("x"), {"a": stats_of("x", "x", 0)}, 3) == Finding.WITHIN_BOUNDS
    assert leaf(col("a").lt("z"), {"a": stats_of("x", "y", 0)}, 3) == Finding.BOUNDS_MATCH_PARTLY
    assert leaf(col("a").is_null(), {"a": stats_of(1, 2, None)}, 3) == Finding.NO_NULL_COUNT
    assert len(Finding) == 24 and {f.value[0] for f in Finding} == {"none", "some", "all", "unknown"}


def test_box_verdicts():
    boxes = {"g": (Box(0, 0, 10, 10), True)}
    see = lambda p, b=boxes: verdict(normal(p), {}, 5, b)[0]
    test = lambda r, *b: BoxTest("g", r, Box(*b))
    for r in ("intersects", "covered_by", "equals", "contains"):
        assert see(test(r, 20, 20, 30, 30)) == "none" and see(test(r, 20, 20, 30, 30), {}) == "unknown"
    assert see(test("intersects", -1, -1, 11, 11)) == see(test("covered_by", 0, 0, 10, 10)) == "all"
    assert see(test("intersects", -1, -1, 11, 11), {"g": (Box(0, 0, 10, 10), False)}) == see(test("equals", 0, 0, 10, 10)) == see(test("contains", 1, 1, 2, 2)) == "some"
    assert see(test("contains", 5, 5, 11, 6)) == "none"
    assert see(Not(test("intersects", 20, 20, 30, 30))) == "unknown"
    assert see(And((test("intersects", 20, 20, 30, 30), col("a").eq(1)))) == "none"
    assert see(Or((test("intersects", 20, 20, 30, 30), test("contains", 20, 20, 30, 30)))) == "none"
    assert see(GeometryTest("g", "intersects", geometry.rectangle(20, 20, 30, 30))) == "none"
    assert see(GeometryTest("g", "disjoint", geometry.rectangle(20, 20, 30, 30))) == "unknown"


def test_folding():
    p = (col("k").eq(1) | col("a").gt(2)) & ~col("n").is_not_null()
    assert folded(p, {"k": 1, "n": None}) == Always(True)
    assert folded(p, {"k": 2, "n": None}) == col("a").gt(2)
    assert folded(p, {"k": 2, "n": 5}) == Always(False)
    assert folded(col("k").isin(1, 2), {"k": None}) == folded(~col("k").eq(3), {"k": None}) == Always(False)
    assert folded(col("x").ne(1.0), {"x": NAN}) == Always(True) and folded(col("x").gt(1.0), {"x": NAN}) == Always(False)
    for bad in (col("k").eq("x"), col("k").any().eq(1)):
        with pytest.raises(SchemaError):
            folded(bad, {"k": 1})


def test_counts_and_boxes_from_footers(spark, tmp_path):
    rows = [(i, bytearray(geometry.rectangle(i, i, i + 1, i + 2))) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g binary")
    for n in range(4):
        geo.write(df.where(f"id div 25 = {n}").coalesce(1), str(tmp_path / f"k={n}"), "g", covering="double", row_group_rows=10)
    fs = open_fileset(spark, str(tmp_path))
    count = lambda p: fs.count(p).first()[0]
    assert (count(None), count(col("id").lt(25)), count(col("id").lt(30)), count(col("k").ge(2)), count(col("k").eq(9))) == (100, 25, 30, 50, 0)
    opened = lambda p: counting.decided(spark, list(fs.files), p).where("open").count()
    assert (opened(Always(True)), opened(col("id").lt(50)), opened(col("id").lt(51))) == (0, 0, 1)
    inside = BoxTest("g", "intersects", Box(-5, -5, 26, 200))
    assert count(inside) == 27 and opened(BoxTest("g", "intersects", Box(-5, -5, 200, 200))) == 0
    box = lambda p: tuple(fs.bounds("g", p).first())
    assert box(None) == (0, 0, 100, 101) and box(col("k").eq(1)) == (25, 25, 50, 51) and box(col("id").eq(7)) == (7, 7, 8, 9) and box(col("k").eq(9)) == (None,) * 4
    assert [f for f, _ in fs.surviving(col("k").eq(1))] == [f for f in fs.files if "/k=1/" in f]
    assert fs.capabilities.partitions == "hive"
    with pytest.raises(CapabilityError):
        fs.capabilities.require(merge_on_read=True)


def test_antimeridian_box(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    meta = {"primary_column": "g", "version": "1.1.0", "columns": {"g": {"encoding": "WKB", "geometry_types": [], "bbox": [170.0, -5.0, -170.0, 5.0]}}}
    t = pa.table({"g": [geometry.write_point(175, 0), geometry.write_point(-175, 5)]}).replace_schema_metadata({"geo": json.dumps(meta)})
    pq.write_table(t, path)
    assert tuple(counting.bounds(spark, [path], Always(True), "g").first()) == (-180, -5, 180, 5)


def test_broken_files(spark, tmp_path):
    for name, data, error in (("a", b"no", NotColumnarError), ("b", b"x" * 100, NotColumnarError), ("c", b"PAR1" + b"x" * 8 + (1 << 20).to_bytes(4, "little") + b"PAR1", MalformedError), ("d", b"PAR1" + b"x" * 100 + (50).to_bytes(4, "little") + b"PAR1", MalformedError)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(error):
            explain._footer(spark, str(tmp_path / name))
        assert issubclass(error, FormatError) and error("x").exit_code == 4


def test_write_options(spark, tmp_path):
    for bad in ({"codec": "zip"}, {"page_rows": 0}, {"row_group_bytes": 1 << 31}, {"entries": {"geo": "x"}}, {"page_version": 3}, {"geo_metadata": "3"}):
        with pytest.raises(WriteError):
            WriteOptions(**bad)
    assert WriteOptions(page_version=1, geo_metadata="2.0").geo_metadata == "1.1" and WriteOptions(page_version=2, geo_metadata="2.0").geo_metadata == "2.0"
    df = spark.range(1000).withColumnRenamed("id", "a")
    with pytest.raises(SchemaError):
        write(df, str(tmp_path / "x"), WriteOptions(bloom={"b": Bloom()}))
    write(df, str(tmp_path / "y"), WriteOptions(codec="gzip", bloom={"a": Bloom(1000)}, dictionary={"a": False}))
    c = pq.read_metadata(next((tmp_path / "y").glob("*.parquet"))).row_group(0).column(0)
    assert c.compression == "GZIP" and not c.has_dictionary_page


def test_row_builder(spark):
    schema = T._parse_datatype_string("a long not null, s struct<x: int not null, y: string>, l array<int>, m map<string, double>")
    b = RowBuilder(schema)
    with b.set("a", 1).group("s") as g:
        g.set("x", 2)
    b.add("l", 5).add("l", None).put("m", "k", 1.5).end()
    b.set("a", 2).end()
    got = b.frame(spark).collect()
    assert got[0].asDict(True) == {"a": 1, "s": {"x": 2, "y": None}, "l": [5, None], "m": {"k": 1.5}} and got[1].s is None and got[1].l is None
    for wrong, error in ((lambda: b.set("z", 1), SchemaError), (lambda: b.set("a", "x"), SchemaError), (lambda: b.set("a", None), WriteError), (lambda: b.set("s", {}), SchemaError), (lambda: b.add("a", 1), SchemaError), (b.end, WriteError), (b.close, WriteError)):
        with pytest.raises(error):
            wrong()
    with pytest.raises(WriteError):
        RowBuilder(schema).set("a", 1).group("s").close()


def test_hooks(spark):
    rows = [(i, bytearray(geometry.rectangle(i, 0, i + i % 3 + 1, 1)) if i != 4 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, g binary")

    class Wide:
        column = "g"

        def box(self):
            return "intersects", Box(0, 0, 6, 1)

        def matches(self, shape):
            xs = [p[0] for p in shape.coordinates()]
            return max(xs) - min(xs) >= 2

    got = df.where(compiled(GeometryFiltered(Wide()), df.schema)).select("id")
    assert sorted(r.id for r in got.collect()) == [1, 2, 5]
    assert sorted(r.id for r in df.where(compiled(Not(GeometryFiltered(Wide())), df.schema)).select("id").collect()) == [0, 3, 6, 7, 8, 9]
    with pytest.raises(SchemaError):
        compiled(GeometryFiltered(Wide()), T._parse_datatype_string("g int"))
    assert sorted(hooks.materialized(df.select("id"), lambda schema, r: (schema.names[0], r.id)))[:2] == [("id", 0), ("id", 1)]


def test_excluded_rows_in_number(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for gone in (set(range(0, 5000, 2)), set(range(3, 2000)), set()):
        assert df.where(compiled(RowsExcluded(frozenset(gone)), df.schema)).count() == 5000 - len(gone)


def test_variant_text(spark):
    row = spark.sql("""select to_variant_object(named_struct('a', array(1, null, 3000000000, -1.50bd), 'b', x'0102', 'd', date'1970-01-03', 'f', cast(0.1 as float), 'g', cast(1e300 as double), 'n', timestamp_ntz'1970-01-01 00:00:01', 's', concat('é"', repeat('x', 70)), 't', true, 'z', cast('NaN' as double))) as v, cast(null as variant) as w""")
    made = row.select(variantjson.variant_json(row["v"]).alias("v"), variantjson.variant_json(row["w"]).alias("w")).first()
    got = json.loads(made["v"])
    assert got == {"a": [1, None, 3000000000, -1.5], "b": "AQI=", "d": 2, "f": 0.1, "g": 1e300, "n": 1000000, "s": 'é"' + "x" * 70, "t": True, "z": "NaN"} and made["w"] is None
    with pytest.raises(FormatError):
        variantjson.text(b"\x02\x09", b"\x01\x00\x00")
    line = sinks.json_rows(row.select("v")).first()[0]
    assert json.loads(line)["v"]["d"] == 2


def test_arrow_streams(spark):
    df = spark.range(1000).repartition(3)
    sink = io.BytesIO()
    sinks.write_arrow(df, sink)
    assert sorted(pa.ipc.open_stream(sink.getvalue()).read_all()["id"].to_pylist()) == list(range(1000))
    g = spark.createDataFrame([(1, bytearray(geometry.write_point(1, 2)))], "id int, g binary")
    reader = sinks.arrow_batches(g, {"g": "{}"})
    assert hasattr(reader, "__arrow_c_stream__") and reader.schema.field("g").metadata[b"ARROW:extension:name"] == b"geoarrow.wkb"
    assert sinks.arrow_batches(df.where("false")).read_all().num_rows == 0


def test_nested_ids_must_agree(spark, tmp_path):
    kind = {"type": "struct", "fields": [{"id": 3, "name": "x", "type": "int"}]}
    w = TableWriter(spark, str(tmp_path / "t"), [(1, "a", "long"), (2, "s", kind)])
    w.append(spark.sql("select 1L as a, named_struct('x', 7) as s"))
    w.commit()
    assert Table(spark, str(tmp_path / "t")).frame().first().s.x == 7
    w.evolve([(1, "a", "long"), (2, "s", {"type": "struct", "fields": [{"id": 9, "name": "x", "type": "int"}]})])
    w.commit()
    with pytest.raises(TableFormatError):
        Table(spark, str(tmp_path / "t")).frame()


def test_reference_systems():
    doc = lambda **c: {"primary_column": "g", "columns": {"g": c}}
    geo.check_crs(doc(), "g", "EPSG:4326")
    geo.check_crs(doc(crs=None), "g", "EPSG:3857")
    geo.check_crs(doc(crs={"id": {"authority": "EPSG", "code": 3857}}), "g", "EPSG:3857")
    for bad in (lambda: geo.check_crs(doc(), "g", "EPSG:3857"), lambda: geo.check_crs(doc(), "h", None)):
        with pytest.raises(SchemaError):
            bad()


def test_envelopes_and_points_of_a_batch():
    rnd = random.Random(2)
    texts = ["POINT (1 2)", "LINESTRING (0 0, 3 1, -2 5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT (1 1, -3 7)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"]
    import struct

    values = [geometry.from_wkt(t) for t in texts] + [None, struct.pack("<BIdd", 1, 1, NAN, NAN), struct.pack("<BII", 1, 2, 0), struct.pack(">BIdd", 0, 1, 3, 4), struct.pack("<BIddd", 1, 1001, 3, 4, 5), struct.pack("<BIIdd", 1, 0x20000001, 4326, 7, 8), struct.pack("<BIIdddd", 1, 2, 2, NAN, 1, 2, 3)]
    rnd.shuffle(values)
    for v, e in zip(values, geometry._boxes(values)):
        want = geometry.box_of(v) if v is not None else None
        assert tuple(e) == want if want else all(map(math.isnan, e))
    with pytest.raises(FormatError):
        geometry._boxes([geometry.from_wkt(texts[1])[:-3]])
    for text in ("POLYGON ((0 0, 40 0, 0 40, 0 0))", texts[3], texts[5]):
        q = geometry.read(geometry.from_wkt(text))
        at = [(rnd.randrange(-2, 44) / 2, rnd.randrange(-2, 44) / 2) for _ in range(500)]
        import numpy as np

        place = geometry._where(np.array(at), q)
        assert [geometry.locate(q, p) for p in at] == place.tolist()
        for name, rule in geometry.POINT_IN.items():
            for p, w in list(zip(at, place))[:150]:
                assert bool(rule(w)) == geometry.related(geometry.read(geometry.write_point(*p)), q, name), (name, p, text)


def test_decimation_among_columns_of_its_names(spark):
    rows = [(1, bytearray(geometry.write_point(1, 1)), "b"), (2, bytearray(geometry.write_point(1.5, 1.5)), "c"), (3, bytearray(geometry.rectangle(0, 0, 50, 50)), "d")]
    df = spark.createDataFrame(rows, "key int, x binary, Box string")
    got = sorted(tuple(r) for r in decimated(df, "x", Box(0, 0, 100, 100), 10, 10, "key").select("key", "Box").collect())
    assert got == [(1, "b"), (3, "d")]


def test_filter_errors():
    with pytest.raises(FilterError):
        geometry.from_wkt("CIRCLE (1 2)")
