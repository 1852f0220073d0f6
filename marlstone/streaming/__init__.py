"""Predicates and produced columns over unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compiling import compiled
from ..plans.query import Query, produce


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(df: DataFrame, query: Query) -> DataFrame:
    """A query without a window over a stream; each row is decided by itself, so no state is kept."""
    if query.offset or query.limit is not None:
        raise ValueError("a stream has no offset or limit")
    out = df.where(compiled(query.predicate, df.schema))
    return out.select(*[produce(df.schema, c) for c in query.columns]) if query.columns else out


def counts(df: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per time window and key, rows later than `late` left out."""
    at = F.window(time, width)
    return df.withWatermark(time, late).groupBy(at.alias("span"), *keys).agg(F.count(F.lit(1)).alias("n"))
