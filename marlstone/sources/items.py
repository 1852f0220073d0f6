"""STAC catalogs: a dataset per collection, files chosen by the boxes of their items.

A JSON catalog is walked by the driver over its links; an item table (one row per item, in
Parquet) is filtered by Spark, so of a large index only the items that can match come back.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogFormatError
from ..functions.predicate import Box
from ..plans.reading import read_files
from ..session import ship
from .tables import _read

# fixed values of the format
PARQUET = {"application/vnd.apache.parquet", "application/x-parquet", "application/parquet"}


@dataclass(frozen=True)
class Item:
    id: str
    box: tuple[float, float, float, float] | None
    files: tuple[str, ...]


def _box(values: list | None) -> tuple[float, float, float, float] | None:
    if not values:
        return None
    n = len(values) // 2
    return (values[0], values[1], values[n], values[n + 1])


def _files(assets: dict[str, Any], base: str) -> tuple[str, ...]:
    return tuple(_at(base, a["href"]) for _, a in sorted(assets.items()) if a.get("type", "").split(";")[0].strip() in PARQUET or a["href"].split("?")[0].endswith(".parquet"))


def _at(base: str, href: str) -> str:
    """A link against the file it is in; urljoin knows only web schemes."""
    if re.match(r"[A-Za-z][\w+.-]*:/", href) or href.startswith("/"):
        return href
    scheme, mark, rest = base.rpartition("://")
    return f"{scheme}{mark}" + urljoin("/" + rest.lstrip("/"), href).lstrip("/" if mark and not rest.startswith("/") else "")


def touches(a: tuple | None, b: Box | None) -> bool:
    """Whether a file may hold rows of a box; unknown boxes may. A box whose west is greater than
    its east spans the antimeridian."""
    if a is None or b is None:
        return True
    if a[1] > b.ymax or a[3] < b.ymin:
        return False
    return (a[0] <= b.xmax and a[2] >= b.xmin) if a[0] <= a[2] else (b.xmax >= a[0] or b.xmin <= a[2])


class Collection:
    """Items of one collection."""

    def __init__(self, spark: SparkSession, name: str, items: list[Item], extent: tuple | None = None):
        self.spark, self.name, self.items, self.extent = ship(spark), name, items, extent

    def files(self, box: Box | None = None) -> list[str]:
        return [f for i in self.items if touches(i.box, box) for f in i.files]

    def frame(self, box: Box | None = None) -> DataFrame:
        """Rows of the files that may touch the box; the exact filter is the caller's."""
        files = self.files(box)
        if not files:
            every = self.files()
            if not every:
                raise CatalogFormatError(f"collection {self.name!r} has no Parquet files")
            return read_files(self.spark, every[:1]).where("false")
        return read_files(self.spark, files)


def catalog(spark: SparkSession, path: str) -> dict[str, Collection]:
    """Collections below a catalog by id. Where a catalog names one of its children `latest`,
    only that one is followed."""
    out: dict[str, Collection] = {}
    seen: set[str] = set()

    def load(at: str) -> dict:
        try:
            return json.loads(_read(spark, at))
        except ValueError as e:
            raise CatalogFormatError(f"{at} is not JSON") from e

    def item(doc: dict, at: str) -> Item:
        return Item(doc["id"], _box(doc.get("bbox")), _files(doc.get("assets", {}), at))

    def walk(at: str, inside: str | None) -> None:
        if at in seen:
            return
        seen.add(at)
        doc = load(at)
        kind = doc.get("type")
        if kind not in ("Catalog", "Collection"):
            raise CatalogFormatError(f"{at} is neither catalog nor collection")
        if kind == "Collection":
            inside = doc["id"]
            extent = (doc.get("extent", {}).get("spatial", {}).get("bbox") or [None])[0]
            out.setdefault(inside, Collection(spark, inside, [], _box(extent)))
            direct = _files(doc.get("assets", {}), at)
            if direct:
                out[inside].items.append(Item(inside, _box(extent), direct))
        links = doc.get("links", [])
        for link in links:
            if link["rel"] in ("item", "items") and inside is not None:
                to = _at(at, link["href"])
                got = load(to)
                out[inside].items.extend(item(d, to) for d in got.get("features", [got]))
        children = [x for x in links if x["rel"] == "child"]
        latest = [x for x in children if x.get("latest") or x.get("title") == "latest"]
        for link in latest or children:
            walk(_at(at, link["href"]), inside)

    walk(path, None)
    return out


def item_table(spark: SparkSession, path: str, box: Box | None = None, collection: str | None = None) -> dict[str, Collection]:
    """Collections of an item table with columns id, bbox (struct), assets (struct or map of
    structs with href and type) and collection."""
    df = ship(spark).read.parquet(path)
    if box is not None:
        b = {s: F.col(f"bbox.{s}") for s in ("xmin", "ymin", "xmax", "ymax")}
        inside = (b["ymin"] <= box.ymax) & (b["ymax"] >= box.ymin) & F.when(b["xmin"] <= b["xmax"], (b["xmin"] <= box.xmax) & (b["xmax"] >= box.xmin)).otherwise((b["xmin"] <= box.xmax) | (b["xmax"] >= box.xmin))
        df = df.where(F.col("bbox").isNull() | inside)
    if collection is not None:
        df = df.where(F.col("collection") == collection)
    out: dict[str, Collection] = {}
    for r in df.select("id", "bbox", "assets", "collection").toLocalIterator():
        made = r.asDict(recursive=True)
        assets = {k: a for k, a in (made["assets"] or {}).items() if a and a.get("href")}
        for a in assets.values():
            a["type"] = a.get("type") or ""
        b = made["bbox"]
        name = made["collection"] or ""
        out.setdefault(name, Collection(spark, name, [])).items.append(Item(made["id"], (b["xmin"], b["ymin"], b["xmax"], b["ymax"]) if b else None, _files(assets, path)))
    return out
