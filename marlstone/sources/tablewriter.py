"""Writing Iceberg tables: data files, deletes, manifests and snapshots, without a catalog service.

Data files are written by Spark with field ids; what the driver handles is one entry per file, with
the bounds from its footer. A commit writes its manifests, a manifest list and the next metadata file,
which readers find by its number; nothing that is there already is changed.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions import geometry
from ..plans.explain import footers
from ..session import ship
from . import avro, deletion
from .fileset import listed, partition_values
from .tables import DELETED_FILE, DELETED_POSITION, ENTRY, LIST, _optional, _plain, spark_type

EPOCH = datetime(1970, 1, 1)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    try:
        stream.write(data)
    finally:
        stream.close()


def single_value(v: Any, kind: Any) -> bytes | None:
    """A bound in its binary form; None where the type has none."""
    if isinstance(v, datetime):
        v = v.astimezone(timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        return int((v - EPOCH).total_seconds() * 1_000_000).to_bytes(8, "little", signed=True)
    if isinstance(v, date):
        return (v - EPOCH.date()).days.to_bytes(4, "little", signed=True)
    match kind:
        case "boolean":
            return bytes([v])
        case "int" | "long":
            return v.to_bytes(4 if kind == "int" else 8, "little", signed=True)
        case "float" | "double":
            return struct.pack("<f" if kind == "float" else "<d", v)
        case "string":
            return v.encode()
    if isinstance(v, Decimal):
        n = int(v.scaleb(-v.as_tuple().exponent))
        return n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True)
    return None


class TableWriter:
    """Builds a table at `root`. Fields are (id, name, type) or (id, name, type, initial default)."""

    def __init__(self, spark: SparkSession, root: str, fields: list[tuple], version: int = 2, partition: str | None = None, properties: dict[str, str] | None = None, transform: str = "identity"):
        self.spark, self.root, self.version = ship(spark), root.rstrip("/"), version
        self.schemas: list[dict] = []
        self.entries: list[dict] = []
        self.snapshots: list[dict] = []
        self.sequence = self.commits = 0
        self.next_row = 0
        self.properties = properties or {}
        self.partition, self.transform = partition, transform
        self.evolve(fields)

    def evolve(self, fields: list[tuple]) -> None:
        """The schema from now on; ids tell which fields are which."""
        made = [{"id": f[0], "name": f[1], "type": f[2], "required": False, **({"initial-default": f[3]} if len(f) > 3 else {})} for f in fields]
        self.schemas.append({"type": "struct", "schema-id": len(self.schemas), "fields": made})
        self.fields = {f["name"]: f for f in made}

    # --- files ------------------------------------------------------------------------------

    def append(self, df: DataFrame, constant: Any = None, ids: bool = True, known: dict[str, tuple[int, Any]] | None = None, by: list[str] | None = None) -> list[str]:
        """Add the rows as data files; returns them. `known` gives (id, type) of columns by the names
        they have in the files, by default the table's own; with `ids` false files carry none."""
        known = known if known is not None else {n: (f["id"], f["type"]) for n, f in self.fields.items()}
        files = self._written(df, {n: i for n, (i, _) in known.items()} if ids else {}, by or [])
        kinds = {n: (i, k) for n, (i, k) in known.items()}
        for path, meta in footers(self.spark, files):
            low, high = self._bounds(meta, kinds)
            e = self._entry(path, 0, meta.num_rows, lower_bounds=low, upper_bounds=high)
            if self.partition is not None:
                e["data_file"]["partition"] = {self.partition: constant}
            self.entries.append(e)
        self._boxes(files, [n for n, (_, k) in kinds.items() if str(k).startswith("geometry")])
        return files

    def append_split(self, df: DataFrame, by: list[str], constant: Callable[[dict[str, str]], Any]) -> list[str]:
        """Add the rows as data files that leave out the columns `by`, each file with one value of them;
        `constant` gives the partition value of the values as paths spell them."""
        before = len(self.entries)
        files = self.append(df, by=by)
        for e in self.entries[before:]:
            e["data_file"]["partition"] = {self.partition: constant(partition_values(e["data_file"]["file_path"]))}
        return files

    def _boxes(self, files: list[str], names: list[str]) -> None:
        """Bounds of geometry columns, which footers do not hold."""
        made = {_plain(e["data_file"]["file_path"]): e["data_file"] for e in self.entries}
        for name in names:
            rows = self.spark.read.parquet(*files).select(F.regexp_replace("_metadata.file_path", "^[A-Za-z0-9]+:/+", "/").alias("f"), geometry.envelope(F.col(f"`{name}`")).alias("e"))
            for r in rows.groupBy("f").agg(F.min("e.xmin"), F.min("e.ymin"), F.max("e.xmax"), F.max("e.ymax")).collect():
                if r[1] is not None:
                    i = self.fields[name]["id"]
                    made[r[0]]["lower_bounds"].append({"key": i, "value": struct.pack("<dd", r[1], r[2])})
                    made[r[0]]["upper_bounds"].append({"key": i, "value": struct.pack("<dd", r[3], r[4])})

    def delete_positions(self, rows: DataFrame) -> None:
        """Delete (file_path, pos)."""
        ids = {"file_path": DELETED_FILE, "pos": DELETED_POSITION}
        rows = rows.select(F.col("file_path").cast("string"), F.col("pos").cast("long"))
        for path, meta in footers(self.spark, self._written(rows, ids)):
            self.entries.append(self._entry(path, 1, meta.num_rows))

    def delete_equal(self, rows: DataFrame, names: list[str]) -> None:
        """Delete the rows that agree with one of `rows` in the named columns, null with null."""
        ids = {n: self.fields[n]["id"] for n in names}
        for path, meta in footers(self.spark, self._written(rows.select(*names), ids)):
            self.entries.append(self._entry(path, 2, meta.num_rows, equality_ids=sorted(ids.values())))

    def delete_vector(self, file: str, positions: Any) -> None:
        """Delete positions of one data file by a deletion vector."""
        self._vector(file, deletion.blob(np.asarray(positions, np.int64)), len(positions))

    def delete_vectors(self, rows: DataFrame) -> None:
        """Delete (file_path, pos), each once, by a deletion vector for each data file; tasks make them."""

        def made(table: pa.Table) -> pa.Table:
            at = table["pos"].to_numpy()
            return pa.table({"file_path": table["file_path"][:1], "blob": [deletion.blob(at)], "n": [len(at)]})

        told = rows.select(F.col("file_path").cast("string"), F.col("pos").cast("long")).groupBy("file_path")
        for r in told.applyInArrow(lambda table: made(table), "file_path string, blob binary, n long").collect():
            self._vector(r["file_path"], bytes(r["blob"]), r["n"])

    def _vector(self, file: str, blob: bytes, rows: int) -> None:
        path = f"{self.root}/data/dv-{uuid.uuid4().hex}.puffin"
        write_bytes(self.spark, path, b"PFA1" + blob)
        self.entries.append(self._entry(path, 1, rows, referenced_data_file=file, content_offset=4, content_size_in_bytes=len(blob)))

    def positions_of(self, files: list[str], condition, schema: str) -> DataFrame:
        """(file_path, pos) of rows of the files that meet a condition on their columns."""
        names = {_plain(f): f for f in files}
        told = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        df = self.spark.read.schema(schema).parquet(*files).where(condition)
        plain = F.regexp_replace("_metadata.file_path", "^[A-Za-z0-9]+:/+", "/")
        return df.select(told[plain].alias("file_path"), F.col("_metadata.row_index").alias("pos"))

    def _written(self, df: DataFrame, ids: dict[str, int], by: list[str] | None = None) -> list[str]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        kinds = {f["id"]: spark_type(f["type"]) for f in self.fields.values() if isinstance(f["type"], dict)}
        if any(ids.get(n) in kinds for n in df.columns):  # members of groups have ids too
            df = df.to(T.StructType([T.StructField(f.name, kinds.get(ids.get(f.name), f.dataType)) for f in df.schema.fields]))
        shaped = df.select(*[F.col(f"`{n}`").alias(n, metadata={"parquet.field.id": ids[n]} if n in ids else {}) for n in df.columns])
        shaped.write.partitionBy(*by or []).option("parquet.block.size", 1 << 20).parquet(folder)
        return listed(self.spark, folder)

    def _entry(self, path: str, content: int, rows: int, **more: Any) -> dict:
        file = {"content": content, "file_path": path, "file_format": "PUFFIN" if path.endswith(".puffin") else "PARQUET", "record_count": rows, **more}
        return {"status": 1, "sequence_number": None, "data_file": file}

    @staticmethod
    def _bounds(meta, kinds: dict[str, tuple[int, Any]]) -> tuple[list[dict], list[dict]]:
        low: dict[int, Any] = {}
        high: dict[int, Any] = {}
        bad: set[int] = set()
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for i in range(group.num_columns):
                c = group.column(i)
                if c.path_in_schema in kinds:
                    n, s = kinds[c.path_in_schema][0], c.statistics
                    if s is None or not s.has_min_max or s.min != s.min:
                        bad.add(n)
                        continue
                    low[n] = min(low.get(n, s.min), s.min)
                    high[n] = max(high.get(n, s.max), s.max)
        types = {i: k for i, k in kinds.values()}
        told = lambda of: [{"key": n, "value": b} for n, v in sorted(of.items()) if n not in bad and (b := single_value(v, types[n])) is not None]
        return told(low), told(high)

    # --- commits ----------------------------------------------------------------------------

    def commit(self) -> int:
        """A snapshot with what was added since the last one; returns its id."""
        self.commits += 1
        self.sequence += 1
        schema = json.loads(json.dumps(ENTRY))
        if self.partition is not None:
            if self.partition not in self.fields:
                raise SchemaError(f"{self.partition!r} is not a field of the table")
            source = self.fields[self.partition]["type"]
            held = "int" if self.transform in ("year", "month", "day", "hour") else {"int": "int", "date": "int", "string": "string"}.get(source, "long")
            kind = {"type": "record", "name": "r102", "fields": [_optional(self.partition, held)]}
            schema["fields"][2]["type"]["fields"].append({"name": "partition", "type": kind})
        lists = list(self.snapshots[-1]["_lists"]) if self.snapshots else []
        for content, chosen in ((0, [e for e in self.entries if e["data_file"]["content"] == 0]), (1, [e for e in self.entries if e["data_file"]["content"]])):
            if chosen:
                if self.partition is not None:
                    for e in chosen:
                        e["data_file"].setdefault("partition", {self.partition: None})
                path = f"{self.root}/metadata/m-{self.commits}-{content}.avro"
                write_bytes(self.spark, path, avro.write(schema, chosen))
                first = self.next_row if content == 0 and self.version > 2 else None
                lists.append({"manifest_path": path, "partition_spec_id": 0, "content": content, "sequence_number": self.sequence, "first_row_id": first})
                if content == 0:
                    self.next_row += sum(e["data_file"]["record_count"] for e in chosen)
        where = f"{self.root}/metadata/snap-{self.commits}.avro"
        write_bytes(self.spark, where, avro.write(LIST, lists))
        self.snapshots.append({"snapshot-id": 1000 + self.commits, "sequence-number": self.sequence, "schema-id": len(self.schemas) - 1, "manifest-list": where, "_lists": lists})
        spec = [{"name": self.partition, "transform": self.transform, "source-id": self.fields[self.partition]["id"], "field-id": 1000}] if self.partition is not None else []
        meta = {
            "format-version": self.version,
            "table-uuid": str(uuid.uuid5(uuid.NAMESPACE_URL, self.root)),
            "location": self.root,
            "last-sequence-number": self.sequence,
            "schemas": self.schemas,
            "current-schema-id": len(self.schemas) - 1,
            "partition-specs": [{"spec-id": 0, "fields": spec}],
            "default-spec-id": 0,
            "properties": self.properties,
            "current-snapshot-id": self.snapshots[-1]["snapshot-id"],
            "snapshots": [{k: v for k, v in s.items() if k != "_lists"} for s in self.snapshots],
        }
        write_bytes(self.spark, f"{self.root}/metadata/v{self.commits}.metadata.json", json.dumps(meta).encode())
        self.entries = []
        return self.snapshots[-1]["snapshot-id"]
