"""Files as datasets: equal schemas or an error that names both files; partition values typed by
their spelling."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CapabilityError, SchemaError
from ..functions.compiling import compiled
from ..functions.folding import folded
from ..functions.predicate import Always, Predicate
from ..plans.counting import bounds, count
from ..plans.explain import _footer, footer_rows, footers
from ..plans.reading import read_files
from ..plans.verdicts import Stats, stats_of, verdict
from ..session import ship

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def listed(spark: SparkSession, root: str, pattern: str = r".*\.parquet$") -> list[str]:
    """Files below a path, sorted, through Hadoop's file systems; hidden ones left out. Spark lists them,
    folders in parallel: asked one by one, a local file system starts a process for each file's owner."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isFile():
        return [root]
    base = fs.makeQualified(path)
    below, base = len(base.toUri().getPath()), base.toString()
    found = []
    every = ship(spark).read.format("binaryFile").options(recursiveFileLookup=True, __globPaths__=False).load(root)
    for uri in every.inputFiles():
        rest = unquote(urlsplit(uri).path)[below:]
        if re.search(pattern, base + rest) and not any(x[:1] in "._" for x in rest.strip("/").split("/")):
            found.append(base + rest)
    return sorted(found)


def partition_values(path: str) -> dict[str, str]:
    """key=value segments, values unescaped; segments without a key or a value are none."""
    out = {}
    for segment in path.split("/")[:-1]:
        key, mark, value = segment.partition("=")
        if mark and key and value:
            out[key] = unquote(value)
    return out


def spelled_type(values: list[str]) -> str:
    """bigint, double, date or string: what all values of a key are written as. Digits with a
    leading zero are text, and values of several kinds make text."""

    def one(v: str) -> str:
        if re.fullmatch(r"-?0\d+", v):
            return "string"
        if re.fullmatch(r"[+-]?\d+", v) and -(1 << 63) <= int(v) < 1 << 63:
            return "bigint"
        try:
            float(v)
            return "double"
        except ValueError:
            pass
        try:
            date.fromisoformat(v)
            return "date" if re.fullmatch(r"\d{4}-\d\d-\d\d", v) else "string"
        except ValueError:
            return "string"

    kinds = {one(v) for v in values}
    return kinds.pop() if len(kinds) == 1 else "string"


@dataclass(frozen=True)
class Capabilities:
    """What a dataset offers: deletes merged on read, how it is partitioned, whose statistics prune."""

    merge_on_read: bool = False
    partitions: str = "none"  # none, hive or identity
    statistics: str = "footers"  # footers, partitions, manifests or items

    def require(self, **wanted: bool | str) -> Capabilities:
        for name, value in wanted.items():
            if getattr(self, name) != value:
                raise CapabilityError(f"the dataset has {name} {getattr(self, name)!r}, not {value!r}")
        return self


@dataclass(frozen=True)
class Fileset:
    """Files read as one table. `partitions` maps path-only keys to types, `own` keys that are columns
    of the files, whose paths only tell which files to leave out."""

    spark: SparkSession
    name: str
    files: tuple[str, ...]
    partitions: tuple[tuple[str, str], ...] = ()
    own: tuple[tuple[str, str], ...] = ()

    @property
    def capabilities(self) -> Capabilities:
        keyed = self.partitions or self.own
        return Capabilities(False, "hive" if keyed else "none", "partitions" if keyed else "footers")

    def constants(self, file: str) -> dict[str, Any]:
        """Typed values of path-only keys."""
        told = partition_values(file)
        return {k: typed(told[k], kind) for k, kind in self.partitions if k in told}

    def statistics(self, file: str) -> dict[str, Stats]:
        """What the path tells of the file's own columns: it takes the place of footer statistics."""
        told = partition_values(file)
        return {k: stats_of(v, v, 0) for k, kind in self.own if k in told and (v := typed(told[k], kind)) is not None}

    def surviving(self, predicate: Predicate | None) -> list[tuple[str, Predicate]]:
        """Files that can hold matching rows, each with what is left of the predicate."""
        out = []
        for f in self.files:
            left = folded(predicate if predicate is not None else Always(True), self.constants(f))
            if left != Always(False) and verdict(left, self.statistics(f), 1)[0] != "none":
                out.append((f, left))
        return out

    def frame(self, predicate: Predicate | None = None) -> DataFrame:
        """Rows, or those that match; files whose path excludes the predicate are not read."""
        files = list(self.files) if predicate is None else [f for f, _ in self.surviving(predicate)]
        df = read_files(self.spark, files or list(self.files[:1]))
        if self.partitions:
            path = F.col("_metadata.file_path")
            extra = []
            for key, kind in self.partitions:
                raw = F.regexp_extract(path, f"/{re.escape(key)}=([^/]+)/", 1)
                extra.append(F.url_decode(raw).cast(kind).alias(key))
            df = df.select(*df.columns, *extra)
        if predicate is not None:
            df = df.where(compiled(predicate, df.schema))
        return df if files else df.where("false")

    def count(self, predicate: Predicate | None = None) -> DataFrame:
        """One row `n`: counted from footers where paths and footers decide, file by file."""
        by: dict[Predicate, list[str]] = {}
        for f, left in self.surviving(predicate):
            by.setdefault(left, []).append(f)
        parts = [count(self.spark, files, left) for left, files in by.items()]
        if not parts:
            return self.spark.createDataFrame([(0,)], "n long")
        return reduce(DataFrame.unionByName, parts).agg(F.sum("n").cast("long").alias("n"))

    def bounds(self, geometry: str, predicate: Predicate | None = None, coverings: dict[str, str] | None = None) -> DataFrame:
        """One row xmin, ymin, xmax, ymax over matching rows; nulls if there are none."""
        by: dict[Predicate, list[str]] = {}
        for f, left in self.surviving(predicate):
            by.setdefault(left, []).append(f)
        parts = [bounds(self.spark, files, left, geometry, coverings) for left, files in by.items()]
        if not parts:
            return self.spark.createDataFrame([(None,) * 4], "xmin double, ymin double, xmax double, ymax double")
        return reduce(DataFrame.unionByName, parts).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def typed(text: str, kind: str) -> Any:
    """A key's value by its type; None where the text is not of it."""
    try:
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return int(text)
        if kind in ("double", "float"):
            return float(text)
        if kind == "date":
            return date.fromisoformat(text)
        if kind == "boolean":
            return {"true": True, "false": False}.get(text)
    except ValueError:
        return None
    return text if kind == "string" else None


def _schema(spark: SparkSession, file: str):
    return read_files(spark, [file]).schema


def check_schemas(spark: SparkSession, files: list[str]) -> None:
    """Files of different schemas are an error that names the first file and the first that differs."""
    told = _footer(spark, files[0])

    def differing(path, meta):
        if not meta.schema.equals(told.schema):
            yield (path,)

    try:
        other = footer_rows(spark, files, differing, "path string").agg(F.min("path")).first()[0]
    except PythonException:
        for _ in footers(spark, files):  # tells by its own error which file cannot be read
            pass
        raise
    if other is not None:
        raise SchemaError(f"the schemas of {files[0]} and {other} differ")


def open_fileset(spark: SparkSession, root: str, name: str | None = None, hive: bool = True) -> Fileset:
    files = listed(spark, root)
    if not files:
        raise SchemaError(f"there are no files in {root}")
    check_schemas(spark, files)
    first = _schema(spark, files[0])
    keys: dict[str, list[str]] = {}
    if hive:
        for f in files:
            for k, v in partition_values(f[f.index(root.rstrip("/").split("://")[-1]) :] if root.split("://")[-1] in f else f).items():
                keys.setdefault(k, []).append(v)
    fixed, own = [], []
    for k, vs in keys.items():
        if k in first.names:
            if not isinstance(first[k].dataType, T.AtomicType):
                raise SchemaError(f"partition {k!r} is a group or a list in the files")
            if NULL_PARTITION not in vs:
                own.append((k, first[k].dataType.simpleString()))
            continue  # a file's own column keeps its values
        if NULL_PARTITION in vs:
            raise SchemaError(f"partition {k!r} has null values and no column")
        fixed.append((k, spelled_type(vs)))
    return Fileset(spark, name or root.rstrip("/").split("/")[-1], tuple(files), tuple(fixed), tuple(own))


def open_per_file(spark: SparkSession, root: str) -> dict[str, Fileset]:
    out: dict[str, Fileset] = {}
    for f in listed(spark, root):
        stem = f.split("/")[-1].rsplit(".", 1)[0]
        if stem in out:
            raise SchemaError(f"two files are named {stem!r}")
        out[stem] = Fileset(spark, stem, (f,))
    return out


def by_file(parts: dict[str, Fileset], name: str = "name") -> DataFrame:
    """Rows of per-file datasets of one schema in one scan, each row with the name of its dataset: a plan
    that does not grow with the number of files."""
    (spark,) = {fs.spark for fs in parts.values()}
    files = [f for fs in parts.values() for f in fs.files]
    check_schemas(spark, files)
    df = read_files(spark, files)
    return df.select("*", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias(name))
