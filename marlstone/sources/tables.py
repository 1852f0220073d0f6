"""Iceberg tables, formats v1 to v3, read without a catalog service.

Manifests are decoded on the executors; only the entries of live files come to the driver, one
small row per file, as any file listing does. All data files are read in one scan: Spark resolves
columns by field id, so renamed, reordered, added and dropped columns cost nothing. What differs
from file to file (sequence number, first row id, partition constants) is joined on the file's
path only when asked for. Deletes are anti-joins, one for positions and deletion vectors together
and one per set of equality columns.

Defined cases: a field that a file lacks is null, its initial default, or its identity partition
constant; files without field ids are read by the table's name mapping; a name that once
belonged to another field is read under a private name, so that no filter reaches a wrong column.
Files whose bounds exclude the predicate are left out before the scan.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError, SchemaError, TableFormatError
from ..functions.compiling import compiled
from ..functions.folding import folded
from ..functions.predicate import Always, Box, Predicate, normal
from ..plans.explain import footer_rows, footers
from ..plans.verdicts import Stats, stats_of, verdict
from ..session import ship
from . import avro, deletion
from .fileset import Capabilities

# Fixed values of the format: what a manifest list and a manifest hold that reading needs, types by
# name, and the ids of reserved columns.
ROW_ID, SEQUENCE, DELETED_FILE, DELETED_POSITION = 2147483540, 2147483539, 2147483546, 2147483545
#: More deletes than this, by their manifest entries, are never broadcast: their files say little of their
#: size, as a file of positions holds each path once.
BROADCAST_DELETES = 200_000
LIST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        {"name": "manifest_path", "type": "string"},
        {"name": "partition_spec_id", "type": "int", "default": 0},
        {"name": "content", "type": "int", "default": 0},
        {"name": "sequence_number", "type": "long", "default": 0},
        {"name": "first_row_id", "type": ["null", "long"], "default": None},
    ],
}


def _bounds(name: str) -> dict:
    pair = {"type": "record", "name": f"{name}_pair", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}
    return {"type": "array", "items": pair, "logicalType": "map"}


def _optional(name: str, kind: Any) -> dict:
    return {"name": name, "type": ["null", kind], "default": None}


#: The part of a manifest entry that reading needs; partitions follow from the table's spec.
FILE_FIELDS = [
    {"name": "content", "type": "int", "default": 0},
    {"name": "file_path", "type": "string"},
    {"name": "file_format", "type": "string"},
    {"name": "record_count", "type": "long"},
    _optional("lower_bounds", _bounds("lower")),
    _optional("upper_bounds", _bounds("upper")),
    _optional("equality_ids", {"type": "array", "items": "int"}),
    _optional("first_row_id", "long"),
    _optional("referenced_data_file", "string"),
    _optional("content_offset", "long"),
    _optional("content_size_in_bytes", "long"),
]
ENTRY = {
    "type": "record",
    "name": "manifest_entry",
    "fields": [{"name": "status", "type": "int"}, _optional("sequence_number", "long"), {"name": "data_file", "type": {"type": "record", "name": "data_file", "aliases": ["r2"], "fields": FILE_FIELDS}}],
}

PLAIN = {
    "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double",
    "date": "date", "time": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "timestamp_ns": "bigint", "timestamptz_ns": "bigint", "string": "string", "binary": "binary",
    "uuid": "binary", "unknown": "void", "variant": "variant",
}


def spark_type(t: Any) -> T.DataType:
    """A table's type as Spark's, field ids in the metadata of nested fields."""
    if isinstance(t, str):
        if m := re.fullmatch(r"decimal\((\d+), *(\d+)\)", t):
            return T.DecimalType(int(m[1]), int(m[2]))
        if t.startswith(("fixed", "geometry", "geography")):
            return T.BinaryType()
        if t not in PLAIN:
            raise SchemaError(f"type {t!r} is unknown")
        return T._parse_datatype_string(PLAIN[t]) if t != "unknown" else T.NullType()
    match t["type"]:
        case "struct":
            return T.StructType([_spark_field(f["id"], f["name"], f["type"]) for f in t["fields"]])
        case "list":
            return T.ArrayType(spark_type(t["element"]))
        case "map":
            return T.MapType(spark_type(t["key"]), spark_type(t["value"]))
    raise SchemaError(f"type {t['type']!r} is unknown")


def _spark_field(id_: int, name: str, kind: Any, ids: bool = True) -> T.StructField:
    return T.StructField(name, spark_type(kind), True, {"parquet.field.id": id_} if ids else {})


def bound(data: bytes, kind: Any) -> Any:
    """A single value in its binary form; None where it has no order to prune by."""
    if kind in ("int", "date"):
        v = int.from_bytes(data, "little", signed=True)
        return date(1970, 1, 1) + timedelta(days=v) if kind == "date" else v
    if kind == "long":
        return int.from_bytes(data, "little", signed=True)  # 4 bytes if written before a promotion
    if kind in ("float", "double"):
        v = struct.unpack("<f" if len(data) == 4 else "<d", data)[0]
        return None if v != v else v
    if kind in ("timestamp", "timestamptz"):
        zone = timezone.utc if kind == "timestamptz" else None
        return datetime(1970, 1, 1, tzinfo=zone) + timedelta(microseconds=int.from_bytes(data, "little", signed=True))
    if kind == "string":
        return data.decode(errors="ignore")
    if kind == "boolean":
        return data != b"\0"
    if isinstance(kind, str) and (m := re.fullmatch(r"decimal\(\d+, *(\d+)\)", kind)):
        return Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-int(m[1]))
    return None


@dataclass(frozen=True)
class Entry:
    """A live file of a snapshot."""

    path: str
    content: int
    format: str
    rows: int
    sequence: int
    spec: int
    partition: str
    constants: dict[int, Any] = field(hash=False)
    lower: dict[int, bytes] = field(hash=False)
    upper: dict[int, bytes] = field(hash=False)
    equality: tuple[int, ...] = ()
    first_row_id: int | None = None
    referenced: str | None = None
    offset: int | None = None
    size: int | None = None
    ranges: dict[int, tuple[Any, Any]] = field(default_factory=dict, hash=False)  # what partition values bound


def _read(spark: SparkSession, path: str) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def metadata_file(spark: SparkSession, root: str) -> str:
    """The file that version-hint.text names, or else the one of the highest version."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/metadata")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    if "version-hint.text" in names:
        hint = _read(spark, f"{root}/metadata/version-hint.text").decode().strip()
        for name in (f"v{hint}.metadata.json", f"{hint}.metadata.json", hint):
            if name in names:
                return f"{root}/metadata/{name}"
    found = [(int(m[1]), n) for n in names if (m := re.match(r"v?(\d+)(?:-[^/]*)?\.metadata\.json$", n))]
    if not found:
        raise TableFormatError(f"there is no table metadata in {root}")
    return f"{root}/metadata/{max(found)[1]}"


class Table:
    """A table at one snapshot: the current one, or the one asked for."""

    def __init__(self, spark: SparkSession, root: str, snapshot_id: int | None = None, metadata: str | None = None):
        self.spark, self.root = ship(spark), root.rstrip("/")
        self.meta = json.loads(_read(spark, metadata or metadata_file(spark, self.root)))
        self.version = self.meta["format-version"]
        if self.version not in (1, 2, 3):
            raise TableFormatError(f"format version {self.version} is unknown")
        wanted = snapshot_id if snapshot_id is not None else self.meta.get("current-snapshot-id")
        self.snapshot = next((s for s in self.meta.get("snapshots", ()) if s["snapshot-id"] == wanted), None)
        if snapshot_id is not None and self.snapshot is None:
            raise TableFormatError(f"snapshot {snapshot_id} is not in the table")
        schemas = self.meta.get("schemas") or [self.meta["schema"]]
        at = (self.snapshot or {}).get("schema-id") if snapshot_id is not None else None
        at = self.meta.get("current-schema-id", 0) if at is None else at
        self.schema = next((s for s in schemas if s.get("schema-id", 0) == at), schemas[-1])
        self.specs = {s["spec-id"]: s["fields"] for s in self.meta.get("partition-specs", ())} or {0: self.meta.get("partition-spec", [])}
        self.fields = {f["id"]: f for f in self.schema["fields"]}
        owners: dict[str, set[int]] = {}
        for s in schemas:
            for f in s["fields"]:
                owners.setdefault(f["name"], set()).add(f["id"])
        self.known = {f["id"]: f for s in schemas for f in s["fields"]}
        self.alias = {i: f["name"] if owners[f["name"]] == {i} else f"_field_{i}" for i, f in self.fields.items()}
        mapping = self.meta.get("properties", {}).get("schema.name-mapping.default")
        self.mapping = {n: m["field-id"] for m in json.loads(mapping) if "field-id" in m for n in m["names"]} if mapping else {}

    # --- files ------------------------------------------------------------------------------

    def entries(self) -> list[Entry]:
        if self.snapshot is None:
            return []
        if "manifest-list" in self.snapshot:
            lists = list(avro.records(_read(self.spark, self.snapshot["manifest-list"]), LIST))
        else:
            lists = [{"manifest_path": p, "partition_spec_id": 0, "content": 0, "sequence_number": 0, "first_row_id": None} for p in self.snapshot.get("manifests", ())]
        out: list[Entry] = []
        by_spec: dict[int, list[dict]] = {}
        for m in lists:
            by_spec.setdefault(m["partition_spec_id"], []).append(m)
        for spec, manifests in by_spec.items():
            of = {_plain(m["manifest_path"]): m for m in manifests}
            next_row = {k: m["first_row_id"] for k, m in of.items()}
            frame = avro.frame(self.spark, [m["manifest_path"] for m in manifests], self._entry_schema(spec))
            for r in frame.where("status <> 2").toLocalIterator():
                key = _plain(r["_file"])
                f = r["data_file"]
                sequence = r["sequence_number"] if r["sequence_number"] is not None else of[key]["sequence_number"]
                first = f["first_row_id"]
                if first is None and f["content"] == 0 and next_row[key] is not None:
                    first = next_row[key]
                    next_row[key] += f["record_count"]
                part = f["partition"].asDict() if "partition" in f else {}
                out.append(
                    Entry(
                        path=f["file_path"],
                        content=f["content"],
                        format=f["file_format"].lower(),
                        rows=f["record_count"],
                        sequence=sequence,
                        spec=spec,
                        partition=repr(sorted(part.items())),
                        constants=self._constants(spec, part),
                        lower={p["key"]: bytes(p["value"]) for p in f["lower_bounds"] or ()},
                        upper={p["key"]: bytes(p["value"]) for p in f["upper_bounds"] or ()},
                        equality=tuple(sorted(f["equality_ids"] or ())),
                        first_row_id=first,
                        referenced=f["referenced_data_file"],
                        offset=f["content_offset"],
                        size=f["content_size_in_bytes"],
                        ranges=self._ranges(spec, part),
                    )
                )
        return out

    def _entry_schema(self, spec: int) -> dict:
        parts = [_optional(p["name"], self._partition_type(p)) for p in self.specs.get(spec, ())]
        out = json.loads(json.dumps(ENTRY))
        if parts:
            kind = {"type": "record", "name": f"r102_{spec}", "aliases": ["r102"], "fields": parts}
            out["fields"][2]["type"]["fields"].append({"name": "partition", "type": kind})
        return out

    def _partition_type(self, p: dict) -> Any:
        if p["transform"] in ("year", "month", "day", "hour") or p["transform"].startswith("bucket"):
            return "int"
        kind = self.known.get(p["source-id"], {"type": "string"})["type"]
        if m := re.fullmatch(r"decimal\((\d+), *(\d+)\)", str(kind)):
            precision = int(m[1])
            size = next(n for n in range(1, 17) if 10**precision <= 1 << (8 * n - 1))
            return {"type": "fixed", "name": f"decimal_{p['field-id']}", "size": size, "logicalType": "decimal", "precision": precision, "scale": int(m[2])}
        if m := re.fullmatch(r"fixed\[(\d+)\]", str(kind)):
            return {"type": "fixed", "name": f"fixed_{p['field-id']}", "size": int(m[1])}
        return {"boolean": "boolean", "int": "int", "date": "int", "float": "float", "double": "double", "string": "string", "binary": "bytes"}.get(kind, "long")

    def _constants(self, spec: int, part: dict[str, Any]) -> dict[int, Any]:
        """Identity partition values by field id, as Spark's values."""
        out = {}
        for p in self.specs.get(spec, ()):
            if p["transform"] == "identity" and p["source-id"] in self.fields:
                v, kind = part.get(p["name"]), self.fields[p["source-id"]]["type"]
                if v is not None and kind in ("date", "timestamp", "timestamptz"):
                    zone = timezone.utc if kind == "timestamptz" else None
                    v = date(1970, 1, 1) + timedelta(days=v) if kind == "date" else datetime(1970, 1, 1, tzinfo=zone) + timedelta(microseconds=v)
                elif v is not None and kind.startswith("decimal"):
                    v = bound(v, kind)
                out[p["source-id"]] = v
        return out

    def _ranges(self, spec: int, part: dict[str, Any]) -> dict[int, tuple[Any, Any]]:
        """Least and greatest value of the fields that partition values are made of."""
        out = {}
        for p in self.specs.get(spec, ()):
            v, f = part.get(p["name"]), self.fields.get(p["source-id"])
            if v is not None and f is not None and (r := _range(p["transform"], v, f["type"])) is not None:
                out[p["source-id"]] = r
        return out

    def _boxes(self, e: Entry) -> dict[str, tuple[Box, bool]]:
        """Boxes around geometries: bounds are their least and greatest coordinates."""
        out = {}
        for i, f in self.fields.items():
            if str(f["type"]).startswith("geometry") and len(e.lower.get(i, b"")) >= 16 and len(e.upper.get(i, b"")) >= 16:
                (x0, y0), (x1, y1) = struct.unpack_from("<dd", e.lower[i]), struct.unpack_from("<dd", e.upper[i])
                if x0 <= x1:  # otherwise it spans the antimeridian
                    out[f["name"]] = Box(x0, y0, x1, y1), False
        return out

    def _stats(self, e: Entry) -> dict[str, Stats]:
        out = {self.fields[i]["name"]: Stats(lo, hi, None, None, True) for i, (lo, hi) in e.ranges.items()}
        for i, f in self.fields.items():
            if i in e.lower and i in e.upper:
                lo, hi = bound(e.lower[i], f["type"]), bound(e.upper[i], f["type"])
                if lo is not None and hi is not None:
                    out[f["name"]] = stats_of(lo, hi, None)
        return out

    def pruned(self, files: list[Entry], predicate: Predicate | None) -> list[Entry]:
        """Data files whose partition values and bounds leave the predicate a chance."""
        if predicate is None:
            return files
        p, out = normal(predicate), []
        for e in files:
            constants = {self.fields[i]["name"]: v for i, v in e.constants.items() if not isinstance(v, bytes)}
            if verdict(folded(p, constants), self._stats(e), e.rows, self._boxes(e))[0] != "none":
                out.append(e)
        return out

    def files(self, predicate: Predicate | None = None) -> DataFrame:
        """Files of the snapshot, or those that a predicate leaves: path, content, rows, sequence."""
        every = self.entries()
        data = self.pruned([e for e in every if e.content == 0], predicate)
        rows = [(e.path, e.content, e.rows, e.sequence) for e in [*data, *[e for e in every if e.content]]]
        return self.spark.createDataFrame(rows, "path string, content int, rows long, sequence long")

    @property
    def capabilities(self) -> Capabilities:
        keyed = any(p["transform"] == "identity" for fields in self.specs.values() for p in fields)
        return Capabilities(True, "identity" if keyed else "none", "manifests")

    def count(self, predicate: Predicate | None = None) -> DataFrame:
        """One row `n`. Without deletes, files whose bounds or partition values decide are counted by
        their manifest entry and not opened."""
        every = self.entries()
        if any(e.content for e in every):
            return self.frame(predicate).agg(F.count(F.lit(1)).alias("n"))
        p = normal(predicate) if predicate is not None else Always(True)
        known, left = 0, []
        for e in self.pruned([e for e in every if e.content == 0], p):
            constants = {self.fields[i]["name"]: v for i, v in e.constants.items() if not isinstance(v, bytes)}
            if folded(p, constants) == Always(True):
                known += e.rows
            else:
                left.append(e)
        if not left:
            return self.spark.createDataFrame([(known,)], "n long")
        return self._present(left, [], False).where(compiled(p, self.spark_schema())).agg((F.count(F.lit(1)) + F.lit(known)).alias("n"))

    def spark_schema(self) -> T.StructType:
        return T.StructType([_spark_field(f["id"], f["name"], f["type"], False) for f in self.schema["fields"]])

    def _present(self, data: list[Entry], deletes: list[Entry], lineage: bool) -> DataFrame:
        """Rows of data files under the table's names."""
        return self._rows(data, deletes, lineage).select(*[f"`{f['name']}`" for f in self.schema["fields"]])

    # --- rows -------------------------------------------------------------------------------

    def frame(self, predicate: Predicate | None = None, columns: list[str] | None = None, lineage: bool = False) -> DataFrame:
        """Rows at the snapshot. Lineage columns, in format v3, come only when asked for."""
        if lineage and self.version < 3:
            raise SchemaError("row lineage needs format version 3")
        every = self.entries()
        data = self.pruned([e for e in every if e.content == 0], predicate)
        if bad := next((e for e in data if e.format != "parquet"), None):
            raise FormatError(f"{bad.path} is not a Parquet file")
        names = [f["name"] for f in self.schema["fields"]]
        schema = T.StructType([_spark_field(f["id"], f["name"], f["type"], False) for f in self.schema["fields"]])
        extra = ["_row_id", "_last_updated_sequence_number"] if lineage else []
        if not data:
            for n in extra:
                schema = schema.add(n, "long")
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self._deleted(self._rows(data, [e for e in every if e.content], lineage), [e for e in every if e.content], data)
            rows = rows.select(*names, *extra)
        if predicate is not None:
            rows = rows.where(compiled(predicate, rows.schema))
        return rows.select(*(columns if columns is not None else names), *extra)

    def _scan(self, paths: list[str], lineage: bool, lacking: frozenset[int]) -> DataFrame:
        """One scan by field id; files without ids are renamed by the name mapping."""
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        self.spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
        wanted = [_spark_field(i, self.alias[i], f["type"]) for i, f in self.fields.items()]
        if lineage:
            wanted += [T.StructField("_stored_row_id", T.LongType(), True, {"parquet.field.id": ROW_ID}), T.StructField("_stored_sequence", T.LongType(), True, {"parquet.field.id": SEQUENCE})]
        df = self.spark.read.schema(T.StructType(wanted)).parquet(*paths)
        made: list[Column] = []
        for i, f in self.fields.items():
            c = F.col(f"`{self.alias[i]}`")
            if i in lacking and f.get("initial-default") is not None:
                c = F.lit(f["initial-default"]).cast(spark_type(f["type"]))
            made.append(c.alias(f["name"]))
        kept = [F.col("_stored_row_id"), F.col("_stored_sequence")] if lineage else []
        return df.select(*made, *kept, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))

    def _by_name(self, paths: list[str], names: dict[str, int], lineage: bool) -> DataFrame:
        df = self.spark.read.parquet(*paths)
        made = []
        for i, f in self.fields.items():
            name = next((n for n in df.columns if names.get(n) == i), None)
            default = F.lit(f.get("initial-default"))
            made.append((F.col(f"`{name}`") if name else default).cast(spark_type(f["type"])).alias(f["name"]))
        stored = [(F.col(n) if n in df.columns else F.lit(None)).cast("long").alias(a) for n, a in (("_row_id", "_stored_row_id"), ("_last_updated_sequence_number", "_stored_sequence"))] if lineage else []
        return df.select(*made, *stored, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))

    def _groups(self, data: list[Entry]) -> list[tuple[str, Any, list[str]]]:
        """Files by how they are read. Footers are opened only where the table has initial
        defaults or a name mapping; otherwise every file is read alike."""
        defaults = {i for i, f in self.fields.items() if f.get("initial-default") is not None}
        if not defaults and not self.mapping:
            return [("ids", frozenset(), [e.path for e in data])]
        out: dict[tuple[str, Any], list[str]] = {}
        for path, meta in footers(self.spark, [e.path for e in data]):
            fields = list(meta.schema.to_arrow_schema())
            ids = {int(f.metadata[b"PARQUET:field_id"]) for f in fields if f.metadata and b"PARQUET:field_id" in f.metadata}
            key = ("ids", frozenset(defaults - ids)) if ids or not self.mapping else ("names", frozenset(f.name for f in fields))
            out.setdefault(key, []).append(path)
        return [(*k, v) for k, v in out.items()]

    def _guard(self, paths: list[str]) -> None:
        """Members of groups are read by id, so a file whose groups have other ids than the table's
        would give nulls: that is an error."""
        want = {i: _members(f["type"]) for i, f in self.fields.items() if _members(f["type"])}
        if not want:
            return

        def differing(path, meta):
            for f in meta.schema.to_arrow_schema():
                i = _field_id(f)
                if i in want and pa.types.is_struct(f.type):
                    for child in f.type:
                        if _field_id(child) not in want[i]:
                            yield path, f"{f.name}.{child.name}"

        bad = footer_rows(self.spark, paths, differing, "path string, member string").first()
        if bad is not None:
            raise TableFormatError(f"member {bad['member']!r} of {bad['path']} has no id of the table's")

    def _rows(self, data: list[Entry], deletes: list[Entry], lineage: bool) -> DataFrame:
        if not self.mapping:
            self._guard([e.path for e in data])
        frames = [self._scan(paths, lineage, what) if how == "ids" else self._by_name(paths, self.mapping, lineage) for how, what, paths in self._groups(data)]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        identity = sorted({i for e in data for i in e.constants})
        if not identity and not deletes and not lineage:
            return rows
        info = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_raw", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_part", T.StringType()), T.StructField("_no", T.IntegerType())])
        for i in identity:
            info = info.add(f"_const_{i}", spark_type(self.fields[i]["type"]))
        told = self.spark.createDataFrame([(_plain(e.path), e.path, e.sequence, e.first_row_id, f"{e.spec}:{e.partition}", n, *[e.constants.get(i) for i in identity]) for n, e in enumerate(data)], info)
        # one row per file, of whose size Spark knows nothing: it would broadcast or shuffle the rows instead
        rows = rows.withColumn("_key", _key(F.col("_path"))).join(F.broadcast(told), "_key", "left")
        for i in identity:
            name = self.fields[i]["name"]
            rows = rows.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.col(f"_const_{i}")))
        if lineage:
            rows = rows.withColumn("_row_id", F.coalesce("_stored_row_id", F.col("_first") + F.col("_at"))).withColumn("_last_updated_sequence_number", F.coalesce("_stored_sequence", "_seq"))
        return rows

    def _deleted(self, rows: DataFrame, deletes: list[Entry], data: list[Entry]) -> DataFrame:
        places = [e for e in deletes if e.content == 1]
        gone = self._positions(places, {e.path for e in data})
        if gone is not None:
            # files by their numbers, so that rows need not travel with paths
            numbers = self.spark.createDataFrame([(e.path, n) for n, e in enumerate(data)], "_gone_file string, _gone_no int")
            gone = gone.join(F.broadcast(numbers), "_gone_file").drop("_gone_file")
            on = (F.col("_no") == F.col("_gone_no")) & (F.col("_at") == F.col("_gone_pos")) & (F.col("_seq") <= F.col("_gone_seq"))
            rows = rows.join(_unless_many(gone, places), on, "left_anti")
        sets: dict[tuple[int, ...], list[Entry]] = {}
        for e in deletes:
            if e.content == 2:
                sets.setdefault(e.equality, []).append(e)
        for ids, files in sets.items():
            rows = rows.join(_unless_many(self._equal(ids, files), files), self._equal_on(ids), "left_anti")
        return rows

    def _sequenced(self, df: DataFrame, files: list[Entry]) -> DataFrame:
        info = self.spark.createDataFrame([(_plain(e.path), e.sequence, f"{e.spec}:{e.partition}" if self.specs.get(e.spec) else None) for e in files], "_gone_key string, _gone_seq long, _gone_part string")
        return df.withColumn("_gone_key", _key(F.col("_metadata.file_path"))).join(F.broadcast(info), "_gone_key")

    def _positions(self, files: list[Entry], paths: set[str]) -> DataFrame | None:
        plain = [e for e in files if e.format == "parquet"]
        vectors = [e for e in files if e.format == "puffin" and e.referenced in paths]
        parts = []
        if plain:
            df = self.spark.read.schema("file_path string, pos long").parquet(*[e.path for e in plain])
            gone = self._sequenced(df, plain).select(F.col("file_path").alias("_gone_file"), F.col("pos").alias("_gone_pos"), "_gone_seq")
            if vectors:  # a vector supersedes the position files of its data file
                gone = gone.join(F.broadcast(self.spark.createDataFrame([(e.referenced,) for e in vectors], "_gone_file string")), "_gone_file", "left_anti")
            parts.append(gone)
        if vectors:
            parts.append(self._vectors(vectors))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _vectors(self, files: list[Entry]) -> DataFrame:
        told = self.spark.createDataFrame([(_plain(e.path), e.referenced, e.offset, e.size, e.rows, e.sequence) for e in files], "_k string, _gone_file string, _o long, _n long, _c long, _gone_seq long")
        blobs = self.spark.read.format("binaryFile").load(sorted({e.path for e in files})).select(F.regexp_replace("path", "^[A-Za-z0-9]+:/+", "/").alias("_k"), "content")
        blobs = blobs.join(F.broadcast(told), "_k").select("_gone_file", "_gone_seq", F.expr("substring(content, cast(_o + 1 as int), cast(_n as int))").alias("blob"), "_c")

        def decode(batches):
            for b in batches:
                for file, seq, blob, count in zip(*[c.to_pylist() for c in b.columns]):
                    at = deletion.positions(blob, count)
                    for s in range(0, len(at), 100_000):
                        piece = at[s : s + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(piece), pa.string()), pa.array(piece, pa.int64()), pa.array([seq] * len(piece), pa.int64())], ["_gone_file", "_gone_pos", "_gone_seq"])

        return blobs.mapInArrow(decode, "_gone_file string, _gone_pos long, _gone_seq long")

    def _equal(self, ids: tuple[int, ...], files: list[Entry]) -> DataFrame:
        self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        schema = T.StructType([_spark_field(i, f"_gone_{i}", self.known[i]["type"]) for i in ids])
        df = self.spark.read.schema(schema).parquet(*[e.path for e in files])
        return self._sequenced(df, files).drop("_gone_key").distinct()

    def _equal_on(self, ids: tuple[int, ...]) -> Column:
        on = (F.col("_seq") < F.col("_gone_seq")) & (F.col("_gone_part").isNull() | (F.col("_gone_part") == F.col("_part")))
        for i in ids:
            if i not in self.fields:
                raise SchemaError(f"deletes compare field {i}, which the table dropped")
            on = on & F.col(f"`{self.fields[i]['name']}`").eqNullSafe(F.col(f"_gone_{i}"))
        return on


def _unless_many(gone: DataFrame, files: list[Entry]) -> DataFrame:
    """Deletes as Spark wants to join them, or by sorting if they are many."""
    return gone.hint("merge") if sum(e.rows for e in files) > BROADCAST_DELETES else gone


def _range(transform: str, v: Any, kind: Any) -> tuple[Any, Any] | None:
    """Least and greatest source value of a partition value; None where it bounds nothing."""
    if transform in ("year", "month", "day", "hour") and kind in ("date", "timestamp", "timestamptz"):
        if isinstance(v, date):
            v = (v - date(1970, 1, 1)).days
        if transform in ("year", "month"):
            months = v * 12 if transform == "year" else v
            start = lambda m: datetime(1970 + m // 12, m % 12 + 1, 1)
            lo, end = start(months), start(months + (12 if transform == "year" else 1))
        else:
            unit = timedelta(days=1) if transform == "day" else timedelta(hours=1)
            lo = datetime(1970, 1, 1) + v * unit
            end = lo + unit
        if kind == "date":
            return lo.date(), (end - timedelta(days=1)).date()
        zone = timezone.utc if kind == "timestamptz" else None
        return lo.replace(tzinfo=zone), (end - timedelta(microseconds=1)).replace(tzinfo=zone)
    if m := re.fullmatch(r"truncate\[(\d+)\]", transform):
        if kind in ("int", "long"):
            return v, v + int(m[1]) - 1
        if kind == "string":
            return v, v + chr(0x10FFFF)
    return None


def _members(kind: Any) -> set[int]:
    """Ids of a group's members that any schema of the table could give."""
    return {f["id"] for f in kind["fields"]} if isinstance(kind, dict) and kind["type"] == "struct" else set()


def _field_id(f: pa.Field) -> int | None:
    held = (f.metadata or {}).get(b"PARQUET:field_id")
    return int(held) if held is not None else None


def _plain(path: str) -> str:
    """A path without its scheme."""
    return re.sub("^[A-Za-z0-9]+:/+", "/", path)


def _key(path: Column) -> Column:
    """The same of a path that Spark's file metadata gives, which is escaped as a URI."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[A-Za-z0-9]+:/+", "/")


def warehouse(spark: SparkSession, root: str) -> dict[str, Table]:
    """Tables below a folder by dotted name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, Table] = {}

    def walk(path, names):
        below = {s.getPath().getName(): s.getPath() for s in fs.listStatus(path) if s.isDirectory()}
        if "metadata" in below:
            out[".".join(names)] = Table(spark, path.toString())
            return
        for name, child in sorted(below.items()):
            walk(child, [*names, name])

    walk(p, [])
    return out
