"""Counts and boxes from footers as far as those decide, and from rows only where they do not."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicate import Predicate, normal
from .explain import footer_rows, group_verdict
from .query import Query
from .reading import read_files

DECIDED = "path string, rows long, open boolean, box array<double>"


def decided(spark: SparkSession, paths: list[str], p: Predicate, geometry: str | None = None) -> DataFrame:
    """One row per file: rows that match for certain, whether some row group leaves the file open, and
    the declared box of a geometry column where every row of the file matches."""
    p = normal(p)

    def told(path, meta):
        got = [group_verdict(p, meta, g) for g in range(meta.num_row_groups)]
        is_open = any(v in ("some", "unknown") for _, v, _ in got)
        rows = 0 if is_open else sum(n for n, v, _ in got if v == "all")
        box = None
        if geometry is not None and not is_open and rows:
            entry = (meta.metadata or {}).get(b"geo")
            box = json.loads(entry)["columns"].get(geometry, {}).get("bbox") if entry and rows == meta.num_rows else None
            is_open = box is None
            box = box and [float(x) for x in (box if len(box) == 4 else [box[0], box[1], box[3], box[4]])]
        yield path, rows, is_open, box

    return footer_rows(spark, paths, told, DECIDED)


def count(spark: SparkSession, paths: list[str], p: Predicate) -> DataFrame:
    """One row `n`. Files whose row groups all match or all cannot are not opened for rows."""
    told = decided(spark, paths, p)
    # one job over all footers; a local iterator would run one for each of their tasks, in turn
    known, left = told.agg(F.sum(F.when(~F.col("open"), F.col("rows"))), F.collect_list(F.when(F.col("open"), F.col("path")))).first()
    known = known or 0
    if not left:
        return spark.createDataFrame([(known,)], "n long")
    return Query(p).count(read_files(spark, left)).select((F.col("n") + F.lit(known)).cast("long").alias("n"))


def bounds(spark: SparkSession, paths: list[str], p: Predicate, geometry: str, coverings: dict[str, str] | None = None) -> DataFrame:
    """One row xmin, ymin, xmax, ymax over matching rows; files of which every row matches give the
    box that they declare. A declared box whose west is greater than its east spans the antimeridian
    and counts as all longitudes."""
    told = decided(spark, paths, p, geometry)
    box = F.col("box")
    wraps = box[0] > box[2]
    sides = [F.when(wraps, -180.0).otherwise(box[0]), box[1], F.when(wraps, 180.0).otherwise(box[2]), box[3]]
    names = ("xmin", "ymin", "xmax", "ymax")
    parts = told.where("box is not null").select(*[s.alias(n) for s, n in zip(sides, names)])
    left = [r["path"] for r in told.where("open").select("path").collect()]
    if left:
        parts = parts.unionByName(Query(p).bounds(read_files(spark, left), geometry, coverings))
    return parts.agg(*[(F.min if n in ("xmin", "ymin") else F.max)(n).alias(n) for n in names])
