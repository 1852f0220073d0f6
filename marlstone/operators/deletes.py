"""Row-level deletes as anti-joins; Spark broadcasts the deletes if they are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_positions(rows: DataFrame, deletes: DataFrame, file: str = "file_path", pos: str = "pos") -> DataFrame:
    """Rows whose (file, position) is not deleted. `rows` must come straight from files."""
    names = rows.columns
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
    gone = deletes.select(F.col(file).alias("_gone_file"), F.col(pos).alias("_gone_pos")).distinct()
    on = (F.col("_file") == F.col("_gone_file")) & (F.col("_pos") == F.col("_gone_pos"))
    return marked.join(gone, on, "left_anti").select(*names)


def without_equal(rows: DataFrame, deletes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that agree with no delete on `columns`; null agrees with null, NaN with NaN."""
    gone = deletes.select(*[F.col(c).alias(f"_gone_{c}") for c in columns]).distinct()
    on: Column = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns))
    return rows.join(gone, on, "left_anti")
