"""Thinning geometries for a screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import envelope
from ..functions.predicate import Box


def decimated(df: DataFrame, geometry: str, box: Box, width: int, height: int, key: str) -> DataFrame:
    """Rows that touch the box, and of those within one pixel, by their box's centre, only the one
    with the least `key`, which must tell rows apart. Larger geometries all stay and are not
    shuffled. Null and empty geometries go.

    Winners are found over keys and boxes alone, by hash aggregation that reduces a full pixel
    before the shuffle; there are at most width x height of them, and whole rows are read once
    more to meet them, so no row is sorted or shuffled for its other columns unless Spark finds
    the winners too large to broadcast.
    """
    px, py = (box.xmax - box.xmin) / width, (box.ymax - box.ymin) / height
    name = "box"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    e = {s: F.col(f"{name}.{s}") for s in ("xmin", "ymin", "xmax", "ymax")}
    inside = (e["xmin"] <= box.xmax) & (e["xmax"] >= box.xmin) & (e["ymin"] <= box.ymax) & (e["ymax"] >= box.ymin)
    small = (e["xmax"] - e["xmin"] < px) & (e["ymax"] - e["ymin"] < py)
    column = F.floor(((e["xmin"] + e["xmax"]) / 2 - box.xmin) / px)
    row = F.floor(((e["ymin"] + e["ymax"]) / 2 - box.ymin) / py)
    # the tests stand in the aggregate, not in a filter, which would work out boxes a second time
    fits = inside & small
    boxed = df.select(F.col(key).alias("key"), envelope(geometry).alias(name))
    pixels = boxed.select(F.when(fits, F.col("key")).alias("key"), F.when(fits, column).alias("x"), F.when(fits, row).alias("y"))
    winners = pixels.groupBy("x", "y").agg(F.min("key").alias(f"{name}key")).select(f"{name}key")
    large = df.withColumn(name, envelope(geometry)).where(inside & ~small).select(*df.columns)
    return large.unionByName(df.join(winners, F.col(key) == F.col(f"{name}key"), "left_semi"))
