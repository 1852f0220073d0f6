"""Opening Parquet files as rows, those with native geometry types included."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .explain import _footer


def native_geometries(meta: pq.FileMetaData) -> list[str]:
    """Columns of the native types GEOMETRY and GEOGRAPHY."""
    columns = (meta.schema.column(i) for i in range(len(meta.schema)))
    return [c.path for c in columns if str(c.logical_type).startswith(("Geometry", "Geography"))]


def native_schema(meta: pq.FileMetaData) -> T.StructType | None:
    """The rows' types where Spark does not tell them itself: geometries are read as their WKB."""
    if not native_geometries(meta):
        return None

    def plain(t: pa.DataType) -> pa.DataType:
        return plain(t.storage_type) if isinstance(t, pa.BaseExtensionType) else t

    schema = meta.schema.to_arrow_schema()
    return from_arrow_schema(pa.schema([f.with_type(plain(f.type)) for f in schema]))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of files of one schema; one footer is opened to learn of native geometries."""
    schema = native_schema(_footer(spark, paths[0]))
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(*paths)
