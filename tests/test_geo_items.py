"""GeoParquet files, catalogs of items, and the commands that copy and describe."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.cli import main
from marlstone.errors import FormatError, SchemaError
from marlstone.functions import geometry
from marlstone.functions.predicate import Box
from marlstone.sources import geo
from marlstone.sources.items import catalog, item_table, touches


@pytest.fixture
def shapes(spark):
    rows = [(i, bytearray(geometry.write_point(i + 0.1, -i - 0.1))) for i in range(50)] + [(50, None), (51, bytearray(geometry.from_wkt("POLYGON ((0 0, 9 0, 9 9, 0 0))")))]
    return spark.createDataFrame(rows, "id int, geometry binary").repartition(3)


def test_geoparquet(spark, shapes, tmp_path):
    files = geo.write(shapes, str(tmp_path / "g"), row_group_rows=10)
    assert files and not [p for p in (tmp_path / "g").iterdir() if p.name.startswith("_")]
    got = spark.read.parquet(str(tmp_path / "g")).collect()
    assert {r["id"] for r in got} == set(range(52))
    for r in got:
        if r["geometry"] is None:
            assert r["bbox"] is None
            continue
        box = geometry.box_of(bytes(r["geometry"]))
        b = r["bbox"]
        assert b["xmin"] <= box[0] and b["ymin"] <= box[1] and b["xmax"] >= box[2] and b["ymax"] >= box[3]
        assert np.float32(b["xmin"]) == b["xmin"] and b["xmax"] - box[2] < 1e-5
    docs = {f: geo.metadata(spark, f) for f in files}
    doc = geo.joined(docs)
    assert doc["columns"]["geometry"]["geometry_types"] == ["Point", "Polygon"] and geo.geometry_columns(doc) == ["geometry"]
    assert geo.estimated_bounds(spark, files) == [0.0, -49.1, 49.1, 9.0]
    with pytest.raises(FormatError):
        geo.write(shapes, str(tmp_path / "g"))
    with pytest.raises(SchemaError):
        geo.write(shapes, str(tmp_path / "h"), "id")
    with pytest.raises(SchemaError):
        geo.write(shapes, str(tmp_path / "h"), entries={"geo": "{}"})
    other = json.loads(json.dumps(doc))
    other["columns"]["geometry"]["crs"] = {"id": {"authority": "EPSG", "code": "3857"}}
    with pytest.raises(SchemaError):
        geo.joined({"a": doc, "b": other})
    del other["columns"]["geometry"]["crs"], other["columns"]["geometry"]["bbox"]
    assert geo.joined({"a": doc, "b": other})["columns"]["geometry"]["bbox"] is None


def test_own_box_is_kept(spark, shapes, tmp_path):
    own = shapes.selectExpr("*", "struct(1d AS ymax, 2d AS xmin, 3d AS ymin, 4d AS xmax) AS bbox")
    files = geo.write(own, str(tmp_path / "g"), crs="EPSG:3857")
    row = spark.read.parquet(*files).first()
    assert row["bbox"].asDict() == {"xmin": 2.0, "ymin": 3.0, "xmax": 4.0, "ymax": 1.0}
    assert geo.metadata(spark, files[0])["columns"]["geometry"]["crs"]["id"] == {"authority": "EPSG", "code": "3857"}
    assert geo.kind_of(b"\0\0\0\x03\xe9") == "Point Z"


def make_catalog(root):
    (root / "c").mkdir()
    for n in (1, 2, 3):
        pq.write_table(pa.table({"id": [n]}), root / "c" / f"{n}.parquet")
    items = [{"type": "Feature", "id": str(n), "bbox": b, "assets": {"data": {"href": f"./{n}.parquet", "type": "application/vnd.apache.parquet"}, "look": {"href": "look.png"}}} for n, b in ((1, [0, 0, 5, 5]), (2, [170, 0, -170, 5]), (3, None))]
    for i in items:
        (root / "c" / f"{i['id']}.json").write_text(json.dumps(i))
    (root / "c" / "collection.json").write_text(json.dumps({"type": "Collection", "id": "c", "extent": {"spatial": {"bbox": [[-180, 0, 180, 5]]}}, "links": [{"rel": "item", "href": f"./{n}.json"} for n in (1, 2, 3)] + [{"rel": "parent", "href": "../catalog.json"}]}))
    (root / "old.json").write_text(json.dumps({"type": "Catalog", "id": "old", "links": []}))
    (root / "catalog.json").write_text(json.dumps({"type": "Catalog", "id": "top", "links": [{"rel": "child", "href": "./old.json"}, {"rel": "child", "href": "./c/collection.json", "title": "latest"}]}))
    return str(root / "catalog.json")


def test_catalog(spark, tmp_path):
    got = catalog(spark, make_catalog(tmp_path))
    assert set(got) == {"c"} and got["c"].extent == (-180, 0, 180, 5)
    ids = lambda b: sorted(r["id"] for r in got["c"].frame(b).collect())
    assert ids(None) == [1, 2, 3] and ids(Box(4, 4, 10, 10)) == [1, 3] and ids(Box(175, 1, 176, 2)) == [2, 3]
    assert touches(None, Box(0, 0, 1, 1)) and not touches((0, 0, 1, 1), Box(0, 2, 1, 3))
    with pytest.raises(FormatError):
        catalog(spark, str(tmp_path / "c" / "1.json"))


def test_item_table(spark, tmp_path):
    make_catalog(tmp_path)
    rows = [{"id": str(n), "bbox": None if n == 3 else {"xmin": float(n), "ymin": 0.0, "xmax": n + 0.5, "ymax": 1.0}, "assets": {"data": {"href": str(tmp_path / "c" / f"{n}.parquet"), "type": "application/vnd.apache.parquet"}}, "collection": "c"} for n in (1, 2, 3)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "items.parquet")
    got = item_table(spark, str(tmp_path / "items.parquet"), Box(2.2, 0, 9, 9))
    assert sorted(r["id"] for r in got["c"].frame().collect()) == [2, 3]
    assert item_table(spark, str(tmp_path / "items.parquet"), collection="none") == {}


def test_commands(spark, shapes, tmp_path, capsys):
    shapes.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = str(tmp_path / "in")

    def says(*args):
        code = main(list(args), spark)
        return code, capsys.readouterr().out.splitlines()

    assert says("cp", source, str(tmp_path / "out"), "--filter", "id < 10", "--columns", "id") == (0, [])
    assert says("row-count", str(tmp_path / "out")) == (0, ["10"])
    assert says("cp", source, str(tmp_path / "geo"), "--geometry", "geometry")[0] == 0
    assert any('"key":"geo"' in x for x in says("meta", str(tmp_path / "geo"), "--format", "json")[1])
    assert len(says("row-groups", source)[1]) == 1
    assert says("cp", source)[0] == 2 and says("schema", source, "x")[0] == 2
