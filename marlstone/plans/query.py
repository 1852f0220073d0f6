"""A query over one source: which rows, which produced columns, which of them in which order, and
the window; lowered to one DataFrame that Catalyst prunes and pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.compiling import compiled, resolve
from ..functions.predicate import Always, Predicate

ROW_INDEX = "_metadata.row_index"
WIDER = {("int", "bigint"), ("smallint", "bigint"), ("tinyint", "bigint"), ("smallint", "int"), ("tinyint", "int"), ("float", "double")}


@dataclass(frozen=True)
class Physical:
    """A column of the source, passed through or under another name; a dotted source keeps its
    struct shape when it is not renamed."""

    name: str
    source: str | None = None


@dataclass(frozen=True)
class Constant:
    name: str
    value: Any


@dataclass(frozen=True)
class Null:
    name: str
    type: str


@dataclass(frozen=True)
class Promoted:
    """A sanctioned widening: int to bigint, float to double, decimal to more digits."""

    name: str
    source: str
    type: str


@dataclass(frozen=True)
class RowPosition:
    """`first` plus the row's position in its file; filters leave gaps."""

    name: str
    first: int = 0


@dataclass(frozen=True)
class Coalesce:
    """The source, its nulls replaced by a constant or a row position."""

    name: str
    source: str
    fallback: Constant | RowPosition


Produced = Physical | Constant | Null | Promoted | RowPosition | Coalesce


def produce(schema: T.StructType, column: Produced) -> Column:
    match column:
        case Physical(name, source):
            return resolve_any(schema, source or name).alias(name)
        case Constant(name, v):
            if not isinstance(v, (bool, int, float, str, date)):
                raise SchemaError(f"a constant cannot be a {type(v).__name__}")
            return F.lit(v).alias(name)
        case Null(name, kind):
            return F.lit(None).cast(kind).alias(name)
        case Promoted(name, source, kind):
            leaf = resolve(schema, source)
            have, want = leaf.type.simpleString(), kind
            digits = isinstance(leaf.type, T.DecimalType) and want.startswith("decimal(")
            if digits:
                p, s = map(int, want[8:-1].split(","))
                digits = s == leaf.type.scale and p >= leaf.type.precision
            if have != want and (have, want) not in WIDER and not digits:
                raise SchemaError(f"column {source!r} of type {have} is not widened to {want}")
            return leaf.value.cast(want).alias(name)
        case RowPosition(name, first):
            return (F.col(ROW_INDEX) + F.lit(first)).cast("bigint").alias(name)
        case Coalesce(name, source, fallback):
            if name != source and name in schema.names:
                raise SchemaError(f"{name!r} is a column of the source already")
            other = F.col(ROW_INDEX) + F.lit(fallback.first) if isinstance(fallback, RowPosition) else F.lit(fallback.value)
            return F.coalesce(resolve_any(schema, source), other).alias(name)
    raise TypeError(column)


def resolve_any(schema: T.StructType, path: str) -> Column:
    if path in schema.names:
        return F.col(f"`{path}`")
    return resolve(schema, path).value


def of_leaves(schema: T.StructType, leaves: list[str]) -> list[Column]:
    """Listed leaves in schema order, nested ones in their structs pruned to what is listed."""
    if not leaves or len(set(leaves)) != len(leaves):
        raise ValueError("a projection lists one column at least, and none twice")

    def build(kind: T.StructType, wanted: list[list[str]], at: Column | None) -> list[Column]:
        out, known = [], set(kind.names)
        for w in wanted:
            if w[0] not in known:
                raise SchemaError(f"there is no column {'.'.join(w)!r}")
        for f in kind.fields:
            mine = [w[1:] for w in wanted if w[0] == f.name]
            if not mine:
                continue
            value = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            if all(mine) and isinstance(f.dataType, T.StructType):
                inner = F.struct(*build(f.dataType, mine, value))
                value = F.when(value.isNotNull(), inner)
            elif not all(len(m) == 0 for m in mine):
                raise SchemaError(f"{f.name!r} has no members to choose")
            out.append(value.alias(f.name))
        return out

    return build(schema, [x.split(".") for x in leaves], None)


@dataclass(frozen=True)
class Query:
    predicate: Predicate = field(default_factory=lambda: Always(True))
    columns: tuple[Produced, ...] | None = None
    output: tuple[str, ...] | None = None
    offset: int = 0
    limit: int | None = None

    def filtered(self, df: DataFrame, coverings: dict[str, str] | None = None) -> DataFrame:
        """Matching rows. The predicate may name produced columns that rename or widen others."""
        names = {c.name: c.source for c in self.columns or () if isinstance(c, (Physical, Promoted)) and c.source}
        from ..functions.predicate import renamed

        p = renamed(self.predicate, {k: v for k, v in names.items() if v and k not in df.schema.names})
        return df.where(compiled(p, df.schema, coverings))

    def rows(self, df: DataFrame, coverings: dict[str, str] | None = None, in_order: bool = False) -> DataFrame:
        """The result. `in_order` sorts by file and position, which Spark does not promise."""
        made = self.filtered(df, coverings)
        if in_order:
            made = made.orderBy("_metadata.file_path", ROW_INDEX)
        if self.offset:
            made = made.offset(self.offset)
        if self.limit is not None:
            made = made.limit(self.limit)
        if self.columns is not None:
            names = [c.name for c in self.columns]
            if not names or len(set(names)) != len(names):
                raise ValueError("a query produces one column at least, and none twice")
            wanted = [c for c in self.columns if self.output is None or any(o.split(".")[0] == c.name for o in self.output)]
            made = made.select(*[produce(df.schema, c) for c in wanted])
        if self.output is not None:
            schema = made.schema
            made = made.select(*[resolve_any(schema, o).alias(o.split(".")[-1]) for o in self.output])
        return made

    def count(self, df: DataFrame, coverings: dict[str, str] | None = None) -> DataFrame:
        """One row `n`: matching rows, window left aside."""
        return self.filtered(df, coverings).agg(F.count(F.lit(1)).alias("n"))

    def bounds(self, df: DataFrame, geometry: str, coverings: dict[str, str] | None = None) -> DataFrame:
        """One row xmin, ymin, xmax, ymax over matching rows, window left aside; null if none."""
        from ..functions.geometry import envelope

        e = self.filtered(df, coverings).select(envelope(F.col(geometry)).alias("e"))
        return e.agg(F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"), F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"))
