"""Data files of older schemas presented under the table's schema, by field id."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.query import Constant, Null, Physical, Produced, Promoted, produce


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str
    default: Any = None


def columns(table: list[Field], file: dict[int, tuple[str, str]], constants: dict[int, Any] | None = None) -> list[Produced]:
    """How a file with fields {id: (name, type)} gives the table's fields: renamed, widened,
    partition constants, initial defaults or nulls."""
    out: list[Produced] = []
    for f in table:
        if f.id in file:
            name, kind = file[f.id]
            out.append(Physical(f.name, name) if kind == f.type else Promoted(f.name, name, f.type))
        elif constants and f.id in constants:
            out.append(Constant(f.name, constants[f.id]))
        elif f.default is not None:
            out.append(Constant(f.name, f.default))
        else:
            out.append(Null(f.name, f.type))
    return out


def reconciled(table: list[Field], parts: list[tuple[DataFrame, dict[int, tuple[str, str]]]]) -> DataFrame:
    """One DataFrame over files of several schemas, one projection per schema."""
    frames = []
    for df, file in parts:
        made = columns(table, file)
        frames.append(df.select(*[produce(df.schema, c).cast(f.type).alias(f.name) for c, f in zip(made, table)]))
    if not frames:
        raise SchemaError("there are no files to reconcile")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lineage(df: DataFrame, first_row_id: int, sequence: int, stored: bool = False) -> DataFrame:
    """`_row_id` and `_last_updated_sequence_number`, stored values first."""
    position = F.col("_metadata.row_index") + F.lit(first_row_id)
    if stored:
        return df.select("*", F.coalesce("_row_id", position).alias("_row_id_"), F.coalesce("_last_updated_sequence_number", F.lit(sequence)).alias("_sequence_")).drop("_row_id", "_last_updated_sequence_number").withColumnsRenamed({"_row_id_": "_row_id", "_sequence_": "_last_updated_sequence_number"})
    return df.select("*", position.cast("long").alias("_row_id"), F.lit(sequence).cast("long").alias("_last_updated_sequence_number"))
