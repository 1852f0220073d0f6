"""GeoParquet: writing with metadata and coverings, reading and joining the metadata of files.

Spark's own writer cannot put the `geo` entry into footers, so tasks write part files with Arrow
under names of their own attempt; the driver then moves the files of the attempts that counted
into place. A lost executor leaves only files that are removed with the working folder.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import FormatError, SchemaError
from ..functions.geometry import _boxes
from ..plans.explain import _footer, footers
from ..session import ship

# fixed values of the format
KINDS = ["Geometry", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
DEGREES = {None, "OGC:CRS84", "EPSG:4326"}
SIDES = ["xmin", "ymin", "xmax", "ymax"]


def kind_of(wkb: bytes) -> str:
    """Name of a geometry's type, with its Z, from the first bytes."""
    code = int.from_bytes(wkb[1:5], "little" if wkb[0] == 1 else "big")
    z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
    base = (code & 0xFFFF) % 1000
    if base >= len(KINDS):
        raise FormatError(f"geometry type {base} is unknown")
    return KINDS[base] + (" Z" if z else "")


def _covering(boxes: np.ndarray, single: bool) -> pa.StructArray:
    """Boxes as a struct column, rounded outward where they are held in single precision."""
    parts = []
    missing = np.isnan(boxes).any(axis=1)
    for i in range(4):
        v = boxes[:, i]
        if single:
            f = v.astype(np.float32)
            out = f > v if i < 2 else f < v
            f[out] = np.nextafter(f[out], np.float32(-np.inf if i < 2 else np.inf))
            v = f
        parts.append(pa.array(v))
    return pa.StructArray.from_arrays(parts, SIDES, mask=pa.array(missing))


class NativeWkb(pa.ExtensionType):
    """WKB that is written as the native type GEOMETRY; the writer gathers its statistics."""

    def __init__(self, about: bytes = b"{}"):
        self.about = about
        super().__init__(pa.binary(), "geoarrow.wkb")

    def __arrow_ext_serialize__(self) -> bytes:
        return self.about

    @classmethod
    def __arrow_ext_deserialize__(cls, storage, about):
        return cls(about)


#: what files tell: only the entry; native types beside it; native types and the newer entry
VERSIONS = {"1.1": ("1.1.0", False), "dual": ("1.1.0", True), "2.0": ("2.0.0", True)}


def write(df: DataFrame, path: str, geometry: str = "geometry", crs: Any = None, covering: str | None = "auto", metadata: str = "1.1", row_group_rows: int = 100_000, compression: str = "zstd", entries: dict[str, str] | None = None) -> list[str]:
    """Write rows as GeoParquet files below `path`, which must not exist; returns the files.

    metadata: 1.1 (the entry `geo` alone), dual (native types and box statistics beside it) or 2.0.
    covering: float, double, auto (float for longitude and latitude, else double) or None. A
    column that is already called bbox is kept and must have the four sides. `crs` is an
    authority code or a PROJJSON document.
    """
    spark = ship(df.sparkSession)
    if geometry not in df.columns or df.schema[geometry].dataType.simpleString() != "binary":
        raise SchemaError(f"{geometry!r} is not a column of WKB")
    if covering not in ("auto", "float", "double", None):
        raise SchemaError(f"covering {covering!r} is unknown")
    if metadata not in VERSIONS:
        raise SchemaError(f"metadata {metadata!r} is unknown")
    version, native = VERSIONS[metadata]
    if entries and "geo" in entries:
        raise SchemaError("the entry 'geo' is reserved")
    has_box = "bbox" in df.columns
    if has_box and [f.name for f in getattr(df.schema["bbox"].dataType, "fields", ())] != SIDES:
        df = df.withColumn("bbox", _reordered(df))
    single = covering == "float" or (covering == "auto" and (crs if not isinstance(crs, dict) else "?") in DEGREES)
    adds = covering is not None and not has_box
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FormatError(f"{path} exists")
    target = fs.makeQualified(target)
    work = jvm.org.apache.hadoop.fs.Path(target, f"_working-{uuid.uuid4().hex}")
    fs.mkdirs(work)
    uri = work.toString()
    plain = to_arrow_schema(df.schema)
    at = df.columns.index(geometry)
    box_type = pa.struct([(s, pa.float32() if single else pa.float64()) for s in SIDES])
    schema = plain.append(pa.field("bbox", box_type)) if adds else plain
    if native:
        kind = NativeWkb(json.dumps({} if crs in (None, "OGC:CRS84") else {"crs": crs}).encode())
        schema = schema.set(at, pa.field(geometry, kind))
    authority = {} if crs is None or crs == "OGC:CRS84" else {"crs": crs if isinstance(crs, dict) else {"id": {"authority": crs.partition(":")[0], "code": crs.partition(":")[2]}}}

    def part(batches):
        where, folder = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        kinds: set[str] = set()
        low, high = np.full(2, np.inf), np.full(2, -np.inf)
        writer, rows, held, waiting = None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).to_pylist()
            kinds |= {kind_of(v[:5]) for v in values if v is not None}
            boxes = _boxes(values)
            real = boxes[~np.isnan(boxes).any(axis=1)]
            if len(real):
                low, high = np.minimum(low, real[:, :2].min(axis=0)), np.maximum(high, real[:, 2:].max(axis=0))
            columns = [c.cast(f.type) for c, f in zip(batch.columns, plain)] + ([_covering(boxes, single)] if adds else [])
            if native:
                columns[at] = pa.ExtensionArray.from_storage(schema.field(at).type, columns[at])
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{name}", schema, filesystem=where, compression=compression)
            held.append(pa.RecordBatch.from_arrays(columns, schema=schema))
            waiting += batch.num_rows
            rows += batch.num_rows
            if waiting >= row_group_rows:
                writer.write_table(pa.Table.from_batches(held), row_group_size=row_group_rows)
                held, waiting = [], 0
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=row_group_rows)
            column: dict[str, Any] = {"encoding": "WKB", "geometry_types": sorted(kinds), **authority}
            if np.isfinite(low).all():
                column["bbox"] = [*low.tolist(), *high.tolist()]
            if adds or has_box:
                column["covering"] = {"bbox": {s: ["bbox", s] for s in SIDES}}
            geo = {"version": version, "primary_column": geometry, "columns": {geometry: column}}
            writer.add_key_value_metadata({"geo": json.dumps(geo), **(entries or {})})
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]})

    try:
        made = [r["name"] for r in df.mapInArrow(part, "name string, rows long").collect()]
        out = []
        for name in sorted(made):
            to = jvm.org.apache.hadoop.fs.Path(target, name)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(work, name), to):
                raise FormatError(f"{name} could not be moved into {path}")
            out.append(to.toString())
        return out
    finally:
        fs.delete(work, True)


def _reordered(df: DataFrame):
    from pyspark.sql import functions as F

    have = [f.name for f in getattr(df.schema["bbox"].dataType, "fields", ())]
    if not set(SIDES) <= set(have):
        raise SchemaError("the column bbox has not the four sides")
    return F.struct(*[F.col(f"bbox.{s}").alias(s) for s in SIDES])


def metadata(spark: SparkSession, path: str) -> dict | None:
    """The `geo` document of a file."""
    return _document(_footer(spark, path))


def _document(footer: pq.FileMetaData) -> dict | None:
    entry = (footer.metadata or {}).get(b"geo")
    return json.loads(entry) if entry is not None else None


def geometry_columns(doc: dict | None) -> list[str]:
    """Geometry columns, the primary one first."""
    if doc is None:
        return []
    first = doc["primary_column"]
    return [first, *sorted(c for c in doc["columns"] if c != first)]


def joined(docs: dict[str, dict]) -> dict:
    """One document for files: columns and types united, CRS, encoding and primary column must
    agree; a box is known only if every file that has the column declares it."""
    out: dict[str, Any] = {}
    for path, doc in docs.items():
        if not out:
            out = {"version": doc["version"], "primary_column": doc["primary_column"], "columns": {}}
        if doc["primary_column"] != out["primary_column"]:
            raise SchemaError(f"the primary column of {path} differs")
        for name, c in doc["columns"].items():
            have = out["columns"].get(name)
            if have is None:
                out["columns"][name] = {**c, "bbox": _flat(c.get("bbox"))}
                continue
            for key in ("crs", "encoding"):
                if have.get(key, "none") != c.get(key, "none"):
                    raise SchemaError(f"{key} of {name!r} in {path} differs")
            a, b = have["bbox"], _flat(c.get("bbox"))
            have["bbox"] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])] if a and b else None
            have["geometry_types"] = sorted({*have["geometry_types"], *c["geometry_types"]})
    return out


def _flat(box: list | None) -> list | None:
    return None if box is None else [box[0], box[1], box[3], box[4]] if len(box) == 6 else list(box)


def estimated_bounds(spark: SparkSession, paths: list[str]) -> list | None:
    """A box around all primary geometries from footers alone; None if a file does not tell."""
    docs = {p: _document(m) for p, m in footers(spark, paths)}
    if not docs or any(d is None for d in docs.values()):
        return None
    doc = joined(docs)
    return doc["columns"][doc["primary_column"]]["bbox"]


def check_crs(doc: dict | None, column: str, crs: Any) -> None:
    """A query geometry in another reference system than the column's is an error: nothing is
    reprojected. A column without one is in degrees; a null one is unknown and takes any."""
    if doc is None or column not in doc["columns"]:
        raise SchemaError(f"{column!r} is not a geometry column")
    have = doc["columns"][column].get("crs", "OGC:CRS84")
    if have is None or crs is None:
        return
    if _code(have) != _code(crs):
        raise SchemaError(f"{column!r} is in {_code(have)}, the query in {_code(crs)}")


def _code(crs: Any) -> str:
    if isinstance(crs, dict):
        given = crs.get("id", {})
        crs = f"{given['authority']}:{given['code']}" if given else json.dumps(crs, sort_keys=True)
    return "OGC:CRS84" if crs in DEGREES else crs
