"""Writing Parquet: options checked before a row is written, and rows built by typed setters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SchemaError, WriteError

MAX_ROW_GROUP_BYTES = (1 << 31) - (1 << 20)
CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw", "brotli", "lzo")


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter for a column: distinct values expected, and false positives allowed."""

    distinct: int = 100_000
    false_positives: float = 0.01


@dataclass(frozen=True)
class WriteOptions:
    """How files are written. `page_version` 1 holds no native geometry, so it forces the older
    GeoParquet metadata; the entry `geo` belongs to the geometry writer."""

    codec: str = "zstd"
    level: int | None = None
    page_version: int = 1
    row_group_bytes: int = 128 << 20
    page_bytes: int = 1 << 20
    page_rows: int = 20_000
    dictionary_bytes: int = 1 << 20
    dictionary: dict[str, bool] = field(default_factory=dict)
    bloom: dict[str, Bloom] = field(default_factory=dict)
    entries: dict[str, str] = field(default_factory=dict)
    geo_metadata: str = "dual"

    def __post_init__(self):
        if self.codec not in CODECS:
            raise WriteError(f"codec {self.codec!r} is unknown")
        for name in ("row_group_bytes", "page_bytes", "page_rows", "dictionary_bytes"):
            if getattr(self, name) <= 0:
                raise WriteError(f"{name} must be positive")
        if self.row_group_bytes > MAX_ROW_GROUP_BYTES:
            raise WriteError(f"row_group_bytes is above {MAX_ROW_GROUP_BYTES}")
        if self.page_version not in (1, 2) or self.geo_metadata not in ("1.1", "2.0", "dual"):
            raise WriteError("the page version is 1 or 2, the geometry metadata 1.1, 2.0 or dual")
        if "geo" in self.entries:
            raise WriteError("the entry 'geo' is reserved")
        if self.page_version == 1:
            object.__setattr__(self, "geo_metadata", "1.1")

    def settings(self) -> dict[str, Any]:
        """The writer's settings by name."""
        out: dict[str, Any] = {
            "compression": self.codec,
            "parquet.writer.version": f"v{self.page_version}",
            "parquet.block.size": self.row_group_bytes,
            "parquet.page.size": self.page_bytes,
            "parquet.page.row.count.limit": self.page_rows,
            "parquet.dictionary.page.size": self.dictionary_bytes,
        }
        if self.level is not None and self.codec == "zstd":
            out["parquet.compression.codec.zstd.level"] = self.level
        for name, on in self.dictionary.items():
            out[f"parquet.enable.dictionary#{name}"] = str(on).lower()
        for name, b in self.bloom.items():
            out[f"parquet.bloom.filter.enabled#{name}"] = "true"
            out[f"parquet.bloom.filter.expected.ndv#{name}"] = b.distinct
            out[f"parquet.bloom.filter.fpp#{name}"] = b.false_positives
        return out


def write(df: DataFrame, path: str, options: WriteOptions | None = None, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write rows as Parquet files below `path`. Columns that options name must exist."""
    options = options or WriteOptions()
    names = {f.name for f in df.schema.fields}
    for name in (*options.dictionary, *options.bloom, *partition_by):
        if name.split(".")[0] not in names:
            raise SchemaError(f"there is no column {name!r}")
    if options.entries:
        raise WriteError("key-value entries need the geometry writer, which writes files itself")
    made = df.write.mode(mode).options(**options.settings())
    (made.partitionBy(*partition_by) if partition_by else made).parquet(path)


class RowBuilder:
    """Rows of a schema by typed setters: `set("a", 1)`, `with row.group("s"):`, `row.add("list", x)`,
    `end()`. A field that is not set is null if it may be, and an error if it must not be."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows = schema, []
        self._row: dict[str, Any] = {}
        self._scopes: list[tuple[T.StructType, dict]] = [(schema, self._row)]

    def _field(self, name: str) -> T.StructField:
        schema = self._scopes[-1][0]
        if name not in schema.names:
            raise SchemaError(f"there is no column {name!r}")
        return schema[name]

    def set(self, name: str, value: Any) -> RowBuilder:
        f = self._field(name)
        if isinstance(f.dataType, T.StructType) and value is not None:
            raise SchemaError(f"{name!r} is a group: open it")
        self._check(f, value)
        self._scopes[-1][1][name] = value
        return self

    def add(self, name: str, value: Any) -> RowBuilder:
        """One more element of a list."""
        f = self._field(name)
        if not isinstance(f.dataType, T.ArrayType):
            raise SchemaError(f"{name!r} is not a list")
        self._check(T.StructField(name, f.dataType.elementType, f.dataType.containsNull), value)
        self._scopes[-1][1].setdefault(name, []).append(value)
        return self

    def put(self, name: str, key: Any, value: Any) -> RowBuilder:
        """One more entry of a map."""
        f = self._field(name)
        if not isinstance(f.dataType, T.MapType):
            raise SchemaError(f"{name!r} is not a map")
        self._check(T.StructField(name, f.dataType.keyType, False), key)
        self._check(T.StructField(name, f.dataType.valueType, f.dataType.valueContainsNull), value)
        self._scopes[-1][1].setdefault(name, {})[key] = value
        return self

    def group(self, name: str) -> RowBuilder:
        """Open a group; `with` closes it."""
        f = self._field(name)
        if not isinstance(f.dataType, T.StructType):
            raise SchemaError(f"{name!r} is not a group")
        made: dict[str, Any] = {}
        self._scopes[-1][1][name] = made
        self._scopes.append((f.dataType, made))
        return self

    def __enter__(self) -> RowBuilder:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        if len(self._scopes) < 2:
            raise WriteError("no group is open")
        self._filled(*self._scopes.pop())

    @staticmethod
    def _check(f: T.StructField, value: Any) -> None:
        if value is None:
            if not f.nullable:
                raise WriteError(f"{f.name!r} must not be null")
            return
        try:
            T._make_type_verifier(f.dataType, f.nullable)(value)
        except Exception as e:
            raise SchemaError(f"{f.name!r} of type {f.dataType.simpleString()} does not take {value!r}") from e

    @staticmethod
    def _filled(schema: T.StructType, row: dict) -> None:
        for f in schema.fields:
            if f.name not in row:
                if not f.nullable:
                    raise WriteError(f"{f.name!r} is not set and must not be null")
                row[f.name] = None

    def end(self) -> RowBuilder:
        """The row is complete."""
        if len(self._scopes) > 1:
            raise WriteError("a group is still open")
        self._filled(self.schema, self._row)
        self.rows.append(self._row)
        self._row = {}
        self._scopes = [(self.schema, self._row)]
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        if self._row:
            raise WriteError("the last row is not ended")

        def tuples(schema: T.StructType, row: dict | None):
            return None if row is None else tuple(tuples(f.dataType, row[f.name]) if isinstance(f.dataType, T.StructType) else row[f.name] for f in schema.fields)

        return spark.createDataFrame([tuples(self.schema, r) for r in self.rows], self.schema)
