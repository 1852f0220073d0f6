"""Avro containers, deletion vectors, and a table with evolution and every kind of delete."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.errors import FormatError
from marlstone.functions.predicate import col
from marlstone.sources import avro, deletion
from marlstone.sources.tables import ENTRY, LIST, Table, warehouse

ROW = {"type": "record", "name": "row", "fields": [{"name": "a", "type": "int"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": {"type": "array", "items": "double"}}, {"name": "e", "type": {"type": "enum", "name": "kind", "symbols": ["X", "Y"]}}, {"name": "m", "type": {"type": "map", "values": "bytes"}}]}


@pytest.mark.parametrize("codec", sorted(avro.PACK))
def test_container_round_trip(codec):
    rows = [{"a": i - 50, "b": None if i % 3 else "é" * i, "c": [i / 2] * (i % 4), "e": "XY"[i % 2], "m": {"k": bytes([i])} if i % 2 else {}} for i in range(100)]
    assert list(avro.records(avro.write(ROW, rows, codec, block_bytes=300))) == rows
    assert list(avro.records(avro.write(ROW, [], codec))) == []


def test_container_resolution():
    data = avro.write(ROW, [{"a": 7, "b": "t", "c": [], "e": "Y", "m": {}}])
    reader = {"type": "record", "name": "row", "fields": [{"name": "wide", "aliases": ["a"], "type": "double"}, {"name": "new", "type": "string", "default": "d"}, {"name": "e", "type": {"type": "enum", "name": "kind", "symbols": ["X"], "default": "X"}}]}
    assert list(avro.records(data, reader)) == [{"wide": 7.0, "new": "d", "e": "X"}]
    with pytest.raises(FormatError):
        list(avro.records(data, {"type": "record", "name": "row", "fields": [{"name": "z", "type": "int"}]}))
    with pytest.raises(FormatError):
        list(avro.records(data, {"type": "record", "name": "row", "fields": [{"name": "b", "type": "int"}]}))
    with pytest.raises(FormatError):
        list(avro.records(data[:-1] + b"?"))
    with pytest.raises(FormatError):
        list(avro.records(b"nothing"))


def test_unions_and_decimals():
    read = lambda w, r, v: next(avro.records(avro.write({"type": "record", "name": "x", "fields": [{"name": "a", "type": w}]}, [{"a": v}]), {"type": "record", "name": "x", "fields": [{"name": "a", "type": r}]}))["a"]
    # the first branch that takes the value, though a later one is exact
    assert isinstance(read("int", ["double", "int"], 3), float) and isinstance(read("int", ["string", "int"], 3), int)
    decimal = {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}
    assert read("bytes", decimal, b"\x01") == read(decimal, "bytes", b"\x01") == read(decimal, decimal, b"\x01") == b"\x01"
    with pytest.raises(FormatError):
        read(decimal, {**decimal, "scale": 3}, b"\x01")
    inner = lambda *fields: {"type": "record", "name": "in", "fields": [{"name": f, "type": "int"} for f in fields]}
    assert read(inner("p"), ["null", inner("q"), inner("p")], {"p": 1}) == {"p": 1}


def test_container_frame(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.avro").write_bytes(avro.write(ROW, [{"a": n, "b": None, "c": [1.0], "e": "X", "m": {"k": b"v"}}] * n))
    got = avro.frame(spark, [str(tmp_path / "*.avro")], ROW).collect()
    assert sorted(r["a"] for r in got) == [1, 2, 2] and got[0]["m"] == {"k": b"v"}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 1 << 34), max_size=50), st.integers(0, 70000), st.integers(0, 6000))
def test_deletion_vector(some, start, dense):
    want = sorted(some | set(range(start, start + dense)))
    assert deletion.positions(deletion.blob(want), len(want)).tolist() == want


def test_deletion_vector_runs():
    import struct
    import zlib

    # one 32-bit bitmap with one run container: 5 to 9
    inner = struct.pack("<I", deletion.MAGIC) + struct.pack("<QI", 1, 0) + struct.pack("<IBHHHHH", deletion.COOKIE_RUNS, 1, 0, 4, 1, 5, 4)
    made = struct.pack(">I", len(inner)) + inner + struct.pack(">I", zlib.crc32(inner))
    assert deletion.positions(made, 5).tolist() == [5, 6, 7, 8, 9]
    for bad in (made[:-1], made[:-1] + b"\0", b"", made[:4] + b"\0" + made[5:]):
        with pytest.raises(FormatError):
            deletion.positions(bad)
    with pytest.raises(FormatError):
        deletion.positions(made, 4)


def parquet(path, ids, **columns):
    t = pa.table(columns)
    fields = [f.with_metadata({"PARQUET:field_id": str(i)}) if i else f for f, i in zip(t.schema, ids)]
    pq.write_table(t.cast(pa.schema(fields)), path)
    return str(path)


def make_table(root, identity=False, mapping=False):
    """id 1 'n' long (an int at first, then named 'k'), id 2 'v' string, id 3 'w' with a default."""
    (root / "metadata").mkdir(parents=True)
    d = str(root)
    old = parquet(root / "a b+c.parquet", [0, 0] if mapping else [1, 2], k=pa.array(range(10), pa.int32()), v=[f"v{i}" for i in range(10)])
    new = parquet(root / "new.parquet", [1, 3, 2], n=pa.array(range(100, 110), pa.int64()), w=pa.array([None] + ["W"] * 9), v=pa.array(["x"] * 10))
    positions = parquet(root / "pos.parquet", [2147483546, 2147483545], file_path=[old, old], pos=pa.array([0, 3], pa.int64()))
    equality = parquet(root / "eq.parquet", [1], n=pa.array([5, 105], pa.int64()))
    blob = deletion.blob([1, 2])
    (root / "dv.puffin").write_bytes(b"PFA1" + blob)

    def entry(path, content=0, sequence=None, rows=10, lo=None, hi=None, **more):
        file = {"content": content, "file_path": path, "file_format": "PUFFIN" if path.endswith("puffin") else "PARQUET", "record_count": rows, **more}
        if lo is not None:
            file["lower_bounds"] = [{"key": 1, "value": lo.to_bytes(8, "little")}]
            file["upper_bounds"] = [{"key": 1, "value": hi.to_bytes(8, "little")}]
        if identity:
            file["partition"] = {"p": "P" if path == old else "Q"}
        return {"status": 1, "sequence_number": sequence, "data_file": file}

    schema = json.loads(json.dumps(ENTRY))
    if identity:
        schema["fields"][2]["type"]["fields"].append({"name": "partition", "type": {"type": "record", "name": "r102", "fields": [{"name": "p", "type": ["null", "string"], "default": None}]}})
    data = [entry(old, sequence=1, lo=0, hi=9), entry(new, sequence=2, lo=100, hi=109)]
    deletes = [entry(positions, 1, 2, 2), entry(equality, 2, 2, 2, equality_ids=[1]), entry(f"{d}/dv.puffin", 1, 2, 2, referenced_data_file=new, content_offset=4, content_size_in_bytes=len(blob))]
    if identity:
        deletes = []
    (root / "metadata" / "m0.avro").write_bytes(avro.write(schema, data))
    (root / "metadata" / "m1.avro").write_bytes(avro.write(schema, deletes))
    lists = [{"manifest_path": f"{d}/metadata/m0.avro", "partition_spec_id": 0, "content": 0, "sequence_number": 1, "first_row_id": 1000}, {"manifest_path": f"{d}/metadata/m1.avro", "partition_spec_id": 0, "content": 1, "sequence_number": 2, "first_row_id": None}]
    (root / "metadata" / "list.avro").write_bytes(avro.write(LIST, lists))
    fields = [{"id": 1, "name": "n", "type": "long"}, {"id": 2, "name": "v", "type": "string"}, {"id": 3, "name": "w", "type": "string", **({} if identity else {"initial-default": "D"})}]
    if identity:
        fields.append({"id": 4, "name": "p", "type": "string"})
    first = [{"id": 1, "name": "k", "type": "int"}, {"id": 2, "name": "v", "type": "string"}]
    meta = {"format-version": 3, "current-snapshot-id": 7, "current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": first}, {"schema-id": 1, "fields": fields}], "partition-specs": [{"spec-id": 0, "fields": [{"name": "p", "transform": "identity", "source-id": 4, "field-id": 1000}] if identity else []}], "snapshots": [{"snapshot-id": 7, "schema-id": 1, "manifest-list": f"{d}/metadata/list.avro"}], "properties": {}}
    if mapping:
        meta["properties"]["schema.name-mapping.default"] = json.dumps([{"field-id": 1, "names": ["n", "k"]}, {"field-id": 2, "names": ["v"]}])
    (root / "metadata" / "v2.metadata.json").write_text(json.dumps(meta))
    (root / "metadata" / "v1.metadata.json").write_text("{}")
    return d


@pytest.mark.parametrize("mapping", [False, True])
def test_table(spark, tmp_path, mapping):
    t = Table(spark, make_table(tmp_path / "t", mapping=mapping))
    got = {r["n"]: (r["v"], r["w"]) for r in t.frame().collect()}
    # positions 0 and 3 and the equal value 5 go from the old file; of the new file, as old as
    # the equality deletes, only the vector's rows go
    want = {n: (f"v{n}", "D") for n in (1, 2, 4, 6, 7, 8, 9)} | {n: ("x", "W" if n > 100 else None) for n in (100, 103, 104, 105, 106, 107, 108, 109)}
    assert got == want
    assert {r["n"] for r in t.frame(col("n").ge(108) & col("w").eq("W"), ["n"]).collect()} == {108, 109}
    assert [e.path.rsplit("/", 1)[1] for e in t.pruned([e for e in t.entries() if e.content == 0], col("n").gt(50))] == ["new.parquet"]
    assert t.frame(col("n").gt(5000)).count() == 0
    ids = {r["n"]: (r["_row_id"], r["_last_updated_sequence_number"]) for r in t.frame(lineage=True).collect()}
    assert ids[9] == (1009, 1) and ids[105] == (1015, 2)


def test_table_partition_constants(spark, tmp_path):
    t = Table(spark, make_table(tmp_path / "ns" / "t", identity=True))
    got = {(r["n"], r["w"], r["p"]) for r in t.frame(columns=["n", "w", "p"]).collect()}
    assert (3, None, "P") in got and (101, "W", "Q") in got and len(got) == 20
    assert set(warehouse(spark, str(tmp_path))) == {"ns.t"}
    with pytest.raises(FormatError):
        Table(spark, t.root, snapshot_id=1)
    with pytest.raises(FormatError):
        Table(spark, str(tmp_path))


def test_fileset_schemas(spark, tmp_path):
    from marlstone.errors import SchemaError
    from marlstone.sources.fileset import open_fileset

    for n in range(40):
        (tmp_path / "a" / f"k={n:02}").mkdir(parents=True)
        pq.write_table(pa.table({"x": [n]}), tmp_path / "a" / f"k={n:02}" / "f.parquet")
    got = open_fileset(spark, str(tmp_path / "a"))
    assert got.partitions == (("k", "string"),) and got.frame().where("k = '07'").first()["x"] == 7
    pq.write_table(pa.table({"x": ["text"]}), tmp_path / "a" / "odd.parquet")
    with pytest.raises(SchemaError, match="odd.parquet"):
        open_fileset(spark, str(tmp_path / "a"))
