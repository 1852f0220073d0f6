"""Which row groups a predicate can skip, and why, from footers alone; facts of footers as rows.

Footers are read by tasks where Python can open the store, so a dataset's files cost the driver one
row each; for other stores threads of the driver read them through Hadoop's file systems.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import MalformedError, NotColumnarError
from ..functions.predicate import Box, Predicate, normal
from ..session import ship
from .verdicts import Stats, stats_of, verdict

FILES_A_TASK = 64


def leaf_stats(group) -> dict[str, Stats]:
    """Statistics per leaf path of a row group, list steps left out."""
    out = {}
    for i in range(group.num_columns):
        c = group.column(i)
        s = c.statistics
        path = c.path_in_schema.replace(".list.element", "")
        lo, hi = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
        if isinstance(lo, float) and (math.isnan(lo) or math.isnan(hi)):
            lo = hi = None
        out[path] = stats_of(lo, hi, s.null_count if s is not None and s.has_null_count else None)
    return out


def group_boxes(meta: pq.FileMetaData, group, stats: dict[str, Stats]) -> dict[str, tuple[Box, bool]]:
    """A box around the geometries of each column of a row group, from native statistics or from the
    column's covering, and whether every row has a geometry with an extent."""
    out: dict[str, tuple[Box, bool]] = {}
    for i in range(group.num_columns):
        c = group.column(i)
        g = c.geo_statistics if c.is_geo_stats_set else None
        if g is not None and g.xmin is not None and g.xmin <= g.xmax and g.ymin <= g.ymax:
            out[c.path_in_schema] = Box(g.xmin, g.ymin, g.xmax, g.ymax), False
    entry = (meta.metadata or {}).get(b"geo")
    for name, column in (json.loads(entry)["columns"] if entry else {}).items():
        paths = column.get("covering", {}).get("bbox", {})
        sides = {s: stats.get(".".join(paths[s])) for s in ("xmin", "ymin", "xmax", "ymax") if s in paths}
        if len(sides) == 4 and all(s is not None and s.bounded for s in sides.values()):
            box = Box(sides["xmin"].low, sides["ymin"].low, sides["xmax"].high, sides["ymax"].high)
            out[name] = box, all(s.nulls == 0 for s in sides.values())
    return out


def group_verdict(p: Predicate, meta: pq.FileMetaData, g: int) -> tuple[int, str, str]:
    """(rows, verdict, reason) of a row group for a predicate in normal form."""
    group = meta.row_group(g)
    if not group.num_rows:
        return 0, "none", "empty row group"
    stats = leaf_stats(group)
    return group.num_rows, *verdict(p, stats, group.num_rows, group_boxes(meta, group, stats))


def explain(spark: SparkSession, paths: list[str], p: Predicate) -> DataFrame:
    """One row per row group: file, row_group, rows, verdict, reason."""
    p = normal(p)

    def told(path: str, meta: pq.FileMetaData):
        for g in range(meta.num_row_groups):
            yield path, g, *group_verdict(p, meta, g)

    return footer_rows(spark, paths, told, "file string, row_group int, rows long, verdict string, reason string")


def file_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per column chunk: file, row_group, column, num_values, nulls, min, max as text."""

    def told(path: str, meta: pq.FileMetaData):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for i in range(group.num_columns):
                c = group.column(i)
                s = c.statistics
                bounds = s is not None and s.has_min_max
                yield path, g, c.path_in_schema, c.num_values, s.null_count if s is not None and s.has_null_count else None, str(s.min) if bounds else None, str(s.max) if bounds else None

    return footer_rows(spark, paths, told, "file string, row_group int, column string, num_values long, nulls long, min string, max string")


def row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per row group: file, row_group, rows, columns, bytes, compressed."""

    def told(path: str, meta: pq.FileMetaData):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            packed = sum(group.column(i).total_compressed_size for i in range(group.num_columns))
            yield path, g, group.num_rows, group.num_columns, group.total_byte_size, packed

    return footer_rows(spark, paths, told, "file string, row_group int, rows long, columns int, bytes long, compressed long")


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """File facts and key-value entries of footers: file, key, value."""

    def told(path: str, meta: pq.FileMetaData):
        facts = {"created_by": meta.created_by, "format_version": meta.format_version, "rows": str(meta.num_rows), "row_groups": str(meta.num_row_groups)}
        stored = {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items() if k != b"ARROW:schema"}
        for k, v in {**facts, **stored}.items():
            yield path, k, v

    return footer_rows(spark, paths, told, "file string, key string, value string")


def footer_rows(spark: SparkSession, paths: list[str], rows_of: Callable, schema: str) -> DataFrame:
    """Rows that `rows_of(path, footer)` gives for each file."""
    if not all(_opens(p) for p in paths):
        return spark.createDataFrame([r for p, m in footers(spark, paths) for r in rows_of(p, m)], schema)
    if paths:
        _footer(spark, paths[0])  # a first file that is none is told here, not by a task
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                with where.open_input_file(name) as f:
                    try:
                        meta = pq.read_metadata(f)
                    except pa.ArrowInvalid as e:
                        raise MalformedError(f"the footer of {path} cannot be read: {e}") from e
                made = list(rows_of(path, meta))
                columns = list(zip(*made)) if made else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    tasks = max(1, min(len(paths) // FILES_A_TASK, 2_000))
    files = ship(spark).createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return files.mapInArrow(read, schema)


def _opens(path: str) -> bool:
    """Whether Python opens such a path as tasks see it."""
    scheme = path.partition(":")[0] if ":" in path.partition("/")[0] else "file"
    return scheme in ("file", "s3", "gs", "gcs")


def footers(spark: SparkSession, paths: list[str], threads: int = 32) -> Iterator[tuple[str, pq.FileMetaData]]:
    """Footers in the order of the paths. Some are read at once, for a store's latency, not the
    driver's CPU, bounds this; a part of the list at a time, so that few are held."""
    with ThreadPoolExecutor(threads) as pool:
        for at in range(0, len(paths), 8 * threads):
            part = paths[at : at + 8 * threads]
            yield from zip(part, pool.map(lambda p: _footer(spark, p), part))


def _footer(spark: SparkSession, path: str) -> pq.FileMetaData:
    """A footer through Hadoop's file system, so any store Spark reads will do: only the last
    bytes travel."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    if size < 12:
        raise NotColumnarError(f"{path} is not a Parquet file")
    stream = fs.open(p)
    try:
        def tail(n: int) -> bytes:
            stream.seek(size - n)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        end = tail(8)
        if end[4:] != b"PAR1":
            raise NotColumnarError(f"{path} is not a Parquet file")
        length = int.from_bytes(end[:4], "little") + 8
        if length + 4 > size:
            raise MalformedError(f"the footer of {path} is longer than the file")
        footer = tail(length)
    finally:
        stream.close()
    try:
        return pq.read_metadata(pa.BufferReader(b"PAR1" + footer))
    except (pa.ArrowInvalid, OSError) as e:
        raise MalformedError(f"the footer of {path} cannot be read: {e}") from e
