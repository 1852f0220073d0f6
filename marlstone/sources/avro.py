"""Avro object container files: blocks decoded under a reader's schema, and a writer.

Files are decoded on the executors, one task per group of files. A file is held whole by its task,
so it must stay below Spark's limit for one binary value (2 GB).
"""

from __future__ import annotations

import bz2
import io
import json
import lzma
import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import ContainerFormatError
from ..session import ship

MAGIC = b"Obj\x01"
PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}
WIDENED = {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}


# --- codecs -----------------------------------------------------------------------------------


def _snappy(data: bytes) -> bytes:
    body, crc = data[:-4], struct.unpack(">I", data[-4:])[0]
    size, _ = _varint(body, 0)
    out = pa.decompress(body, decompressed_size=size, codec="snappy", asbytes=True)
    if zlib.crc32(out) != crc:
        raise ContainerFormatError("the checksum of a snappy block is wrong")
    return out


def _deflated(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


UNPACK: dict[str, Callable[[bytes], bytes]] = {
    "null": bytes,
    "deflate": lambda b: zlib.decompress(b, -15),
    "snappy": _snappy,
    "zstandard": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b),
    "bzip2": bz2.decompress,
    "xz": lzma.decompress,
}
PACK: dict[str, Callable[[bytes], bytes]] = {
    "null": bytes,
    "deflate": _deflated,
    "snappy": lambda b: pa.compress(b, codec="snappy", asbytes=True) + struct.pack(">I", zlib.crc32(b)),
    "zstandard": lambda b: zstandard.ZstdCompressor().compress(b),
    "bzip2": bz2.compress,
    "xz": lzma.compress,
}


# --- schemas ----------------------------------------------------------------------------------


def _names(schema: Any, into: dict[str, Any], space: str = "") -> Any:
    """The schema with short type names replaced by full ones; definitions are put into `into`."""
    if isinstance(schema, list):
        return [_names(s, into, space) for s in schema]
    if isinstance(schema, str):
        return schema if schema in PRIMITIVES or "." in schema or not space else f"{space}.{schema}"
    kind = schema["type"]
    if kind in ("record", "enum", "fixed"):
        name = schema["name"]
        full = name if "." in name or not schema.get("namespace", space) else f"{schema.get('namespace', space)}.{name}"
        out = {**schema, "name": full}
        into[full] = out
        if kind == "record":
            inner = full.rpartition(".")[0]
            out["fields"] = [{**f, "type": _names(f["type"], into, inner)} for f in schema["fields"]]
        return out
    if kind == "array":
        return {**schema, "items": _names(schema["items"], into, space)}
    if kind == "map":
        return {**schema, "values": _names(schema["values"], into, space)}
    if isinstance(kind, (dict, list)):
        return _names(kind, into, space)
    return schema


def _kind(s: Any) -> str:
    return "union" if isinstance(s, list) else s if isinstance(s, str) else s["type"]


class _Schemas:
    """Decoders from a writer's schema to a reader's, made once per pair of named types."""

    def __init__(self, writer: Any, reader: Any):
        self.wn: dict[str, Any] = {}
        self.rn: dict[str, Any] = {}
        self.made: dict[tuple[str, str], Callable] = {}
        self.root = self.pair(_names(writer, self.wn), _names(reader, self.rn))

    def pair(self, w: Any, r: Any) -> Callable[[io.BytesIO], Any]:
        if isinstance(w, str) and w not in PRIMITIVES:
            w = self.wn[w]
        if isinstance(r, str) and r not in PRIMITIVES:
            r = self.rn[r]
        wk, rk = _kind(w), _kind(r)
        if wk == "union":
            parts = [self._late(b, r) for b in w]
            return lambda f: parts[_long(f)](f)
        if rk == "union":
            for b in r:  # the first that takes the writer's type, widening included
                try:
                    return self.pair(w, b)
                except ContainerFormatError:
                    continue
            raise ContainerFormatError(f"no branch of the reader's union takes {wk}")
        if not self._fits(w, r):
            raise ContainerFormatError(f"{wk} cannot be read as {rk}")
        if wk == "record":
            key = (w["name"], r["name"])
            if key not in self.made:
                held: list[Callable] = []
                self.made[key] = lambda f: held[0](f)
                try:
                    held.append(self._record(w, r))
                except ContainerFormatError:
                    del self.made[key]
                    raise
            return self.made[key]
        if wk == "array":
            item = self.pair(w["items"], r["items"])
            return lambda f: [item(f) for _ in _counted(f)]
        if wk == "map":
            value = self.pair(w["values"], r["values"])
            return lambda f: {_text(f): value(f) for _ in _counted(f)}
        if wk == "enum":
            symbols, known, default = w["symbols"], set(r["symbols"]), r.get("default")

            def symbol(f):
                s = symbols[_long(f)]
                if s not in known and default is None:
                    raise ContainerFormatError(f"symbol {s!r} is unknown to the reader")
                return s if s in known else default

            return symbol
        if wk == "fixed":
            size = w["size"]
            return lambda f: f.read(size)
        read = READ[wk]
        if wk == rk:
            return read
        if rk in ("float", "double"):
            return lambda f: float(read(f))
        if rk == "string":
            return lambda f: read(f).decode()
        if rk == "bytes":
            return lambda f: read(f).encode()
        return read

    def _late(self, w: Any, r: Any) -> Callable:
        """A union's branch fails only when a value takes it."""
        try:
            return self.pair(w, r)
        except ContainerFormatError as e:
            said = str(e)

            def fail(_):
                raise ContainerFormatError(said)

            return fail

    def _fits(self, w: Any, r: Any) -> bool:
        w = self.wn.get(w, w) if isinstance(w, str) else w
        r = self.rn.get(r, r) if isinstance(r, str) else r
        wk, rk = _kind(w), _kind(r)
        if isinstance(w, dict) and isinstance(r, dict) and w.get("logicalType") == r.get("logicalType") == "decimal":
            if w.get("precision") != r.get("precision") or w.get("scale", 0) != r.get("scale", 0):
                return False
        if wk != rk:
            return (wk, rk) in WIDENED
        if wk == "fixed":
            return w["size"] == r["size"] and self._named(w, r)
        return wk not in ("record", "enum") or self._named(w, r)

    @staticmethod
    def _named(w: dict, r: dict) -> bool:
        short = [n.rpartition(".")[2] for n in (w["name"], r["name"], *r.get("aliases", ()))]
        return short[0] in short[1:]

    def _record(self, w: dict, r: dict) -> Callable:
        steps, seen = [], set()
        for f in w["fields"]:
            to = next((g for g in r["fields"] if g["name"] == f["name"] or f["name"] in g.get("aliases", ())), None)
            steps.append((to["name"] if to else None, self.pair(f["type"], to["type"] if to else self._as_reader(f["type"]))))
            if to:
                seen.add(to["name"])
        fixed = {}
        for g in r["fields"]:
            if g["name"] not in seen:
                if "default" not in g:
                    raise ContainerFormatError(f"field {g['name']!r} is not in the file and has no default")
                fixed[g["name"]] = g["default"]

        def record(f):
            out = dict(fixed)
            for name, step in steps:
                v = step(f)
                if name is not None:
                    out[name] = v
            return out

        return record

    def _as_reader(self, s: Any) -> Any:
        """A skipped field is read under its own schema."""
        self.rn = {**self.wn, **self.rn}
        return s


# --- values -----------------------------------------------------------------------------------


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if b[at - 1] < 128:
            return out, at


def _long(f) -> int:
    out = shift = 0
    while True:
        c = f.read(1)
        if not c:
            raise ContainerFormatError("the file ends within a value")
        out |= (c[0] & 127) << shift
        shift += 7
        if c[0] < 128:
            return (out >> 1) ^ -(out & 1)


def _bytes(f) -> bytes:
    n = _long(f)
    out = f.read(n)
    if n < 0 or len(out) != n:
        raise ContainerFormatError("the file ends within a value")
    return out


def _text(f) -> str:
    return _bytes(f).decode()


def _counted(f) -> Iterator[None]:
    while n := _long(f):
        if n < 0:
            _long(f)
        for _ in range(abs(n)):
            yield


READ: dict[str, Callable] = {
    "null": lambda f: None,
    "boolean": lambda f: f.read(1) == b"\x01",
    "int": _long,
    "long": _long,
    "float": lambda f: struct.unpack("<f", f.read(4))[0],
    "double": lambda f: struct.unpack("<d", f.read(8))[0],
    "bytes": _bytes,
    "string": _text,
}


def header(f) -> tuple[dict[str, bytes], bytes]:
    if f.read(4) != MAGIC:
        raise ContainerFormatError("this is not an Avro container file")
    meta = {_text(f): _bytes(f) for _ in _counted(f)}
    return meta, f.read(16)


def records(data: bytes, reader: Any = None) -> Iterator[Any]:
    """Values of a container file, under the reader's schema or its own."""
    f = io.BytesIO(data)
    meta, sync = header(f)
    writer = json.loads(meta["avro.schema"])
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in UNPACK:
        raise ContainerFormatError(f"codec {codec!r} is unknown")
    decode = _Schemas(writer, writer if reader is None else reader).root
    while f.tell() < len(data):
        n = _long(f)
        block = io.BytesIO(UNPACK[codec](_bytes(f)))
        for _ in range(n):
            yield decode(block)
        if f.read(16) != sync:
            raise ContainerFormatError("a block's sync marker is wrong")


# --- writing ----------------------------------------------------------------------------------


def _put_long(out: bytearray, v: int) -> None:
    v = (v << 1) ^ (v >> 63)
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)


def _branch(v: Any, s: Any, names: dict[str, Any]) -> bool:
    s = names.get(s, s) if isinstance(s, str) else s
    match _kind(s):
        case "null":
            return v is None
        case "boolean":
            return isinstance(v, bool)
        case "int" | "long":
            return isinstance(v, int) and not isinstance(v, bool)
        case "float" | "double":
            return isinstance(v, float)
        case "string" | "enum":
            return isinstance(v, str)
        case "bytes" | "fixed":
            return isinstance(v, (bytes, bytearray))
        case "array":
            return isinstance(v, list)
        case _:
            return isinstance(v, dict)


def _put(out: bytearray, v: Any, s: Any, names: dict[str, Any]) -> None:
    s = names.get(s, s) if isinstance(s, str) else s
    match _kind(s):
        case "null":
            pass
        case "union":
            at = next((i for i, b in enumerate(s) if _branch(v, b, names)), None)
            if at is None:
                raise ContainerFormatError(f"no branch of the union takes {v!r}")
            _put_long(out, at)
            _put(out, v, s[at], names)
        case "boolean":
            out.append(1 if v else 0)
        case "int" | "long":
            _put_long(out, v)
        case "float":
            out += struct.pack("<f", v)
        case "double":
            out += struct.pack("<d", v)
        case "bytes" | "string":
            b = v.encode() if isinstance(v, str) else v
            _put_long(out, len(b))
            out += b
        case "fixed":
            out += v
        case "enum":
            _put_long(out, s["symbols"].index(v))
        case "array" | "map" as kind:
            if v:
                _put_long(out, len(v))
                for x in v if kind == "array" else v.items():
                    if kind == "map":
                        _put(out, x[0], "string", names)
                    _put(out, x if kind == "array" else x[1], s["items" if kind == "array" else "values"], names)
            out.append(0)
        case "record":
            for g in s["fields"]:
                if g["name"] not in v and "default" not in g:
                    raise ContainerFormatError(f"field {g['name']!r} has no value")
                _put(out, v.get(g["name"], g.get("default")), g["type"], names)


def write(schema: Any, rows: Iterable[Any], codec: str = "deflate", block_bytes: int = 64_000, sync: bytes | None = None) -> bytes:
    """A container file of the rows."""
    names: dict[str, Any] = {}
    full = _names(schema, names)
    sync = sync or os.urandom(16)
    out = bytearray(MAGIC)
    _put(out, {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}, {"type": "map", "values": "bytes"}, {})
    out += sync
    block, n = bytearray(), 0

    def flush():
        nonlocal block, n
        if n:
            packed = PACK[codec](bytes(block))
            _put_long(out, n)
            _put_long(out, len(packed))
            out.extend(packed + sync)
        block, n = bytearray(), 0

    for row in rows:
        _put(block, row, full, names)
        n += 1
        if len(block) >= block_bytes:
            flush()
    flush()
    return bytes(out)


# --- Spark ------------------------------------------------------------------------------------


def spark_type(schema: Any, names: dict[str, Any] | None = None) -> T.DataType:
    """Logical types stay their physical values."""
    names = {} if names is None else names
    s = _names(schema, names)
    s = names.get(s, s) if isinstance(s, str) else s
    match _kind(s):
        case "union":
            rest = [b for b in s if b != "null"]
            if len(rest) != 1:
                raise ContainerFormatError("a union of several types is no column")
            return spark_type(rest[0], names)
        case "record":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in s["fields"]])
        case "array":
            return T.ArrayType(spark_type(s["items"], names))
        case "map":
            return T.MapType(T.StringType(), spark_type(s["values"], names))
        case kind:
            return {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "fixed": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "null": T.NullType()}[kind]


def frame(spark: SparkSession, paths: list[str], reader: Any) -> DataFrame:
    """Records of container files under the reader's schema, with the file each is from."""
    ship(spark)
    schema = T.StructType([T.StructField("_file", T.StringType()), *spark_type(reader).fields])
    arrow = to_arrow_schema(schema)

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                for r in records(content.as_py(), reader):
                    rows.append({**r, "_file": file})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, schema)


def encoded(df: DataFrame, schema: Any, codec: str = "deflate") -> DataFrame:
    """Container files of the rows, one per Arrow batch, as rows of (content, rows)."""
    ship(df.sparkSession)

    def encode(batches):
        for batch in batches:
            content = write(schema, batch.to_pylist(), codec)
            yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary()), "rows": pa.array([batch.num_rows], pa.int64())})

    return df.mapInArrow(encode, "content binary, rows long")


def decoded(df: DataFrame, reader: Any) -> DataFrame:
    """Records of the container files in a column `content`, under the reader's schema."""
    ship(df.sparkSession)
    schema = spark_type(reader)
    arrow = to_arrow_schema(schema)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                if content.is_valid:
                    rows = list(records(content.as_py(), reader))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select("content").mapInArrow(decode, schema)
