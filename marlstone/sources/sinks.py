"""Rows as text and Arrow: JSON by physical values, delimited text without quoting, IPC streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import ntz_micros
from ..functions.variantjson import variant_json


def _physical(c: Column, t: T.DataType) -> Column:
    """Dates, timestamps and decimals as the numbers they are stored as; groups member by member;
    maps whose keys are not text as arrays of key and value."""
    if isinstance(t, T.DateType):
        return F.unix_date(c)
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.TimestampNTZType):
        return ntz_micros(c)
    if isinstance(t, T.DecimalType):
        return (c * F.lit(10**t.scale).cast("decimal(38,0)")).cast("decimal(38,0)") if t.precision + t.scale > 18 else (c * F.lit(10**t.scale)).cast("long")
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    if isinstance(t, T.VariantType):
        return F.parse_json(variant_json(c))
    if isinstance(t, T.StructType):
        inner = F.struct(*[_member(c.getField(f.name), f).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: _physical(e, t.elementType))
    if isinstance(t, T.MapType):
        if isinstance(t.keyType, T.StringType):
            return F.transform_values(c, lambda _, v: _physical(v, t.valueType))
        pairs = F.map_entries(c)
        return F.transform(pairs, lambda e: F.struct(_physical(e.key, t.keyType).alias("key"), _physical(e.value, t.valueType).alias("value")))
    return c


def uuid_text(c: Column) -> Column:
    """Sixteen bytes in the usual spelling of a UUID."""
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _member(c: Column, f: T.StructField) -> Column:
    """A field; metadata `logical`: `uuid` marks sixteen bytes as a UUID."""
    return uuid_text(c) if f.metadata.get("logical") == "uuid" else _physical(c, f.dataType)


def json_rows(df: DataFrame) -> DataFrame:
    """One column `json`, an object per row; null members are left out."""
    made = F.struct(*[_member(F.col(f"`{f.name}`"), f).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(made, {"ignoreNullFields": "true"}).alias("json"))


def json_lines(df: DataFrame, array: bool = False) -> Iterator[str]:
    """Text of the rows, a partition at a time: an object a line, or one array over all lines."""
    first = True
    for (row,) in json_rows(df).toLocalIterator():
        yield row if not array else ("[" if first else ",") + row
        first = False
    if array:
        yield "[]" if first else "]"


def _cell(c: Column, t: T.DataType, metadata: dict | None = None) -> Column:
    if (metadata or {}).get("logical") == "uuid":
        text = uuid_text(c)
    elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(_physical(c, t), {"ignoreNullFields": "true"})
    elif isinstance(t, T.VariantType):
        text = variant_json(c)
    else:
        text = F.base64(c) if isinstance(t, T.BinaryType) else c.cast("string")
    return F.coalesce(text, F.lit(""))


def delimited_rows(df: DataFrame, separator: str = ",") -> DataFrame:
    """One column `line`: cells joined as they are, null as nothing, groups as JSON."""
    return df.select(F.concat_ws(separator, *[_cell(F.col(f"`{f.name}`"), f.dataType, f.metadata) for f in df.schema.fields]).alias("line"))


def header(df: DataFrame, separator: str = ",") -> str:
    return separator.join(df.columns)


def text_rows(df: DataFrame) -> DataFrame:
    """One column `line`: name=value, comma between."""
    return df.select(F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}="), F.coalesce(_cell(F.col(f"`{f.name}`"), f.dataType, f.metadata), F.lit(""))) for f in df.schema.fields]).alias("line"))


def arrow_schema(df: DataFrame, geometry: dict[str, str] | None = None) -> pa.Schema:
    """The rows' Arrow schema; geometry columns carry their WKB tag, variants theirs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    tags = {name: {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": crs} for name, crs in (geometry or {}).items()}
    tags |= {f.name: {"ARROW:extension:name": "arrow.parquet.variant", "ARROW:extension:metadata": ""} for f in df.schema.fields if isinstance(f.dataType, T.VariantType)}
    for name, tag in tags.items():
        i = schema.get_field_index(name)
        schema = schema.set(i, schema.field(i).with_metadata(tag))
    return schema


def arrow_batches(df: DataFrame, geometry: dict[str, str] | None = None) -> pa.RecordBatchReader:
    """The rows as a stream of Arrow batches, pulled a partition at a time; the reader also hands the
    stream over by Arrow's C interface (`__arrow_c_stream__`)."""
    schema = arrow_schema(df, geometry)

    def pack(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_pydict({"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def pulled():
        for (data,) in df.mapInArrow(pack, "data binary").toLocalIterator():
            for b in pa.ipc.open_stream(data):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema)

    return pa.RecordBatchReader.from_batches(schema, pulled())


def write_arrow(df: DataFrame, sink, geometry: dict[str, str] | None = None) -> None:
    """An Arrow stream of the rows."""
    batches = arrow_batches(df, geometry)
    with pa.ipc.new_stream(sink, batches.schema) as out:
        for batch in batches:
            out.write_batch(batch)
