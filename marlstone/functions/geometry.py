"""Geometries in WKB: envelopes, box tests and exact relations, in Arrow batches.

WKB is read in ISO and extended form, either byte order, with Z and M left aside. The relations
work on points, lines and polygons and their collections: segments are split where they meet the
other geometry, and each piece is told inside, on the edge or outside by its midpoint.
"""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FilterError, FormatError

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])


class Shape:
    """Points, lines and polygons (lists of rings), as coordinate lists; `kind` is the WKB type."""

    def __init__(self, kind: int):
        self.kind = kind
        self.points: list[tuple[float, float]] = []
        self.lines: list[list[tuple[float, float]]] = []
        self.polygons: list[list[list[tuple[float, float]]]] = []
        self.parts: list = []

    def coordinates(self) -> list[tuple[float, float]]:
        return self.points + [p for x in self.lines for p in x] + [p for x in self.polygons for r in x for p in r]

    def add(self, o: Shape) -> None:
        self.points += o.points
        self.lines += o.lines
        self.polygons += o.polygons
        self.parts.append(o)


def read(data: bytes) -> Shape:
    try:
        shape, _ = _read(bytes(data), 0)
    except (struct.error, IndexError) as e:
        raise FormatError("a geometry is cut short") from e
    return shape


def _read(b: bytes, at: int) -> tuple[Shape, int]:
    e = "<" if b[at] == 1 else ">"
    code = struct.unpack_from(e + "I", b, at + 1)[0]
    at += 5
    z, m = bool(code & 0x80000000), bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x1FFFFFFF
    z, m, code = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3), code % 1000
    dims = 2 + z + m
    out = Shape(code)

    def coords(at: int, n: int):
        raw = struct.unpack_from(f"{e}{n * dims}d", b, at)
        return list(zip(raw[0::dims], raw[1::dims])), at + 8 * n * dims

    def many(at: int):
        n = struct.unpack_from(e + "I", b, at)[0]
        return coords(at + 4, n)

    if code == 1:
        p, at = coords(at, 1)
        out.points = [x for x in p if not (math.isnan(x[0]) or math.isnan(x[1]))]
    elif code == 2:
        line, at = many(at)
        out.lines = [line] if line else []
    elif code == 3:
        n = struct.unpack_from(e + "I", b, at)[0]
        at += 4
        rings = []
        for _ in range(n):
            r, at = many(at)
            rings.append(r)
        out.polygons = [rings] if rings and rings[0] else []
    elif code in (4, 5, 6, 7):
        n = struct.unpack_from(e + "I", b, at)[0]
        at += 4
        for _ in range(n):
            part, at = _read(b, at)
            out.add(part)
    else:
        raise FormatError(f"geometry type {code} is not supported")
    return out, at


def write_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def from_wkt(text: str) -> bytes:
    """WKB of POINT, LINESTRING, POLYGON and their multiples in WKT."""
    m = re.fullmatch(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(\(.*\))\s*", text, re.I | re.S)
    if not m:
        raise FilterError(f"not a geometry text that is understood: {text!r}")
    code = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3}[m[2].upper()]
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    pair = lambda s: [(float(a), float(b)) for a, b in re.findall(rf"({number})\s+({number})", s)]

    def one(s: str) -> bytes:
        if code == 1:
            return write_point(*pair(s)[0])
        if code == 2:
            return struct.pack("<BI", 1, 2) + _ring(pair(s))
        rings = [pair(r) for r in re.findall(r"\(([^()]*)\)", s)]
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_ring, rings))

    if not m[1]:
        return one(m[3])
    inner = m[3].strip()[1:-1]
    if code == 1:
        parts = [x if "(" in x else f"({x})" for x in inner.split(",")]
    else:
        parts = re.findall(r"\([^()]*\)" if code == 2 else r"\((?:\s*\([^()]*\)\s*,?)+\)", inner)
    return struct.pack("<BII", 1, code + 3, len(parts)) + b"".join(map(one, parts))


def _ring(ps: list[tuple[float, float]]) -> bytes:
    return struct.pack("<I", len(ps)) + struct.pack(f"<{2 * len(ps)}d", *[v for p in ps for v in p])


def rectangle(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return struct.pack("<BII", 1, 3, 1) + _ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def box_of(wkb: bytes) -> tuple[float, float, float, float] | None:
    ps = [p for p in read(wkb).coordinates() if not (math.isnan(p[0]) or math.isnan(p[1]))]
    return (min(p[0] for p in ps), min(p[1] for p in ps), max(p[0] for p in ps), max(p[1] for p in ps)) if ps else None


#: first bytes of geometries that are one run of plain coordinates, and where it begins
RUNS = {b"\1\1\0\0\0": 5, b"\1\2\0\0\0": 9, b"\1\3\0\0\0\1\0\0\0": 13, b"\0\0\0\0\1": 5, b"\0\0\0\0\2": 9, b"\0\0\0\0\3\0\0\0\1": 13}
POINTS = (b"\1\1\0\0\0", b"\0\0\0\0\1")


def _run(v: bytes | None) -> int:
    """Where the coordinates of a plain point, line or polygon of one ring begin; 0 for others."""
    if v is None:
        return 0
    at = RUNS.get(v[:5]) or RUNS.get(v[:9]) or 0
    size = len(v) - at
    if not at or size < 16 or size != (16 if at == 5 else 16 * int.from_bytes(v[at - 4 : at], "little" if v[0] else "big")):
        return 0
    return at


def _boxes(values) -> np.ndarray:
    """n x 4; rows of null or empty geometries are NaN. The coordinates of all plain geometries of a
    batch are laid side by side and their extremes taken at once; others are read ring by ring."""
    out = np.full((len(values), 4), np.nan)
    values = [v if v is None or isinstance(v, bytes) else bytes(v) for v in values]
    begin = np.fromiter((_run(v) for v in values), np.int64, len(values))
    little = np.fromiter((b > 0 and v[0] == 1 for b, v in zip(begin, values)), bool, len(values))
    for order, plain in (("<f8", np.flatnonzero(little)), (">f8", np.flatnonzero((begin > 0) & ~little))):
        if not len(plain):
            continue
        xy = np.frombuffer(b"".join(values[i][begin[i] :] for i in plain), order).reshape(-1, 2).astype(np.float64)
        count = np.fromiter(((len(values[i]) - begin[i]) // 16 for i in plain), np.int64, len(plain))
        starts = np.cumsum(count) - count
        whole = ~np.isnan(xy).any(axis=1)
        low, high = np.where(whole[:, None], xy, np.inf), np.where(whole[:, None], xy, -np.inf)
        out[plain] = np.hstack([np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)])
        out[np.isinf(out[:, 0]) & (out[:, 0] > out[:, 2])] = np.nan
    for i in np.flatnonzero(begin == 0):
        if values[i] is not None:
            box = _walked(values[i])
            if box is not None:
                out[i] = box
    return out


def _walked(b: bytes) -> tuple[float, float, float, float] | None:
    """The envelope of any geometry, a ring or line at a time."""
    low, high = np.full(2, np.inf), np.full(2, -np.inf)

    def take(at: int, n: int, e: str, dims: int) -> int:
        end = at + 8 * n * dims
        if end > len(b):
            raise FormatError("a geometry is cut short")
        xy = np.frombuffer(b, e + "f8", n * dims, at).reshape(n, dims)[:, :2]
        xy = xy[~np.isnan(xy).any(axis=1)]
        if len(xy):
            np.minimum(low, xy.min(axis=0), out=low)
            np.maximum(high, xy.max(axis=0), out=high)
        return end

    def walk(at: int) -> int:
        e = "<" if b[at] == 1 else ">"
        code = struct.unpack_from(e + "I", b, at + 1)[0]
        at += 9 if code & 0x20000000 else 5
        flags, code = code & 0xC0000000, code & 0x1FFFFFFF
        dims = 2 + (bool(flags & 0x80000000) or code // 1000 in (1, 3)) + (bool(flags & 0x40000000) or code // 1000 in (2, 3))
        code %= 1000
        if code == 1:
            return take(at, 1, e, dims)
        if code not in (2, 3, 4, 5, 6, 7):
            raise FormatError(f"geometry type {code} is not supported")
        n = struct.unpack_from(e + "I", b, at)[0]
        at += 4
        if code == 2:
            return take(at, n, e, dims)
        for _ in range(n):
            at = take(at + 4, struct.unpack_from(e + "I", b, at)[0], e, dims) if code == 3 else walk(at)
        return at

    try:
        walk(0)
    except (struct.error, IndexError) as x:
        raise FormatError("a geometry is cut short") from x
    return (*low, *high) if low[0] <= high[0] else None


def _where(xy: np.ndarray, s: Shape) -> np.ndarray:
    """`locate` for many points against polygons: 1 inside, 0 on the edge, -1 outside."""
    best = np.full(len(xy), -1)
    x, y = xy[:, 0], xy[:, 1]
    for rings in s.polygons:
        inside, edge = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
        for a, b in (seg for r in rings for seg in _segments(r)):
            side = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
            near = np.abs(side) <= 1e-12 * (1 + abs(a[0]) + abs(b[0]) + abs(a[1]) + abs(b[1])) * max(1e-300, math.dist(a, b), 1e-3)
            edge |= near & (min(a[0], b[0]) - 1e-12 <= x) & (x <= max(a[0], b[0]) + 1e-12) & (min(a[1], b[1]) - 1e-12 <= y) & (y <= max(a[1], b[1]) + 1e-12)
            if a[1] != b[1]:
                cross = (a[1] > y) != (b[1] > y)
                inside ^= cross & (a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x)
        best = np.maximum(best, np.where(edge, 0, np.where(inside, 1, -1)))
    return best


#: what a point's place against polygons says of a relation
POINT_IN = {"intersects": lambda w: w >= 0, "disjoint": lambda w: w < 0, "within": lambda w: w == 1, "covered_by": lambda w: w >= 0, "touches": lambda w: w == 0, "contains": lambda w: w > 1, "covers": lambda w: w > 1, "overlaps": lambda w: w > 1, "crosses": lambda w: w > 1, "equals": lambda w: w > 1}


@F.pandas_udf(BOX)
def envelope(wkb: pd.Series) -> pd.DataFrame:
    """2D envelope of each geometry; all null for null and empty ones."""
    got = pd.DataFrame(_boxes(list(wkb)), columns=["xmin", "ymin", "xmax", "ymax"])
    return got.astype(object).where(got.notna(), None)


def boxes_related(e: np.ndarray, relation: str, b) -> np.ndarray:
    """`box_test` for an array of envelopes; rows of NaN match nothing."""
    with np.errstate(invalid="ignore"):
        return {
            "intersects": (e[:, 0] <= b.xmax) & (e[:, 2] >= b.xmin) & (e[:, 1] <= b.ymax) & (e[:, 3] >= b.ymin),
            "contains": (e[:, 0] <= b.xmin) & (e[:, 2] >= b.xmax) & (e[:, 1] <= b.ymin) & (e[:, 3] >= b.ymax),
            "covered_by": (e[:, 0] >= b.xmin) & (e[:, 2] <= b.xmax) & (e[:, 1] >= b.ymin) & (e[:, 3] <= b.ymax),
            "equals": (e[:, 0] == b.xmin) & (e[:, 2] == b.xmax) & (e[:, 1] == b.ymin) & (e[:, 3] == b.ymax),
        }[relation]


def box_test(e: Column, relation: str, b) -> Column:
    """An envelope against a box; a null envelope matches nothing."""
    x0, y0, x1, y1 = (e.getField(n) for n in ("xmin", "ymin", "xmax", "ymax"))
    test = {
        "intersects": (x0 <= b.xmax) & (x1 >= b.xmin) & (y0 <= b.ymax) & (y1 >= b.ymin),
        "contains": (x0 <= b.xmin) & (x1 >= b.xmax) & (y0 <= b.ymin) & (y1 >= b.ymax),
        "covered_by": (x0 >= b.xmin) & (x1 <= b.xmax) & (y0 >= b.ymin) & (y1 <= b.ymax),
        "equals": (x0 == b.xmin) & (x1 == b.xmax) & (y0 == b.ymin) & (y1 == b.ymax),
    }[relation]
    return F.coalesce(test, F.lit(False))


def covering(column: str, relation: str, b) -> Column:
    """The condition on a covering column that a box test implies; covering boxes may be larger
    than the geometry's, so only enclosing directions stay."""
    c = lambda n: F.col(f"`{column}`.{n}")
    if relation in ("contains", "equals"):
        return (c("xmin") <= b.xmin) & (c("xmax") >= b.xmax) & (c("ymin") <= b.ymin) & (c("ymax") >= b.ymax)
    return (c("xmin") <= b.xmax) & (c("xmax") >= b.xmin) & (c("ymin") <= b.ymax) & (c("ymax") >= b.ymin)


def pruning(relation: str, wkb: bytes, distance: float = 0.0):
    """(box relation, box) that an exact relation implies, or None."""
    from .predicate import Box

    box = box_of(wkb)
    if relation == "disjoint" or box is None:
        return None
    if relation == "dwithin":
        return "intersects", Box(box[0] - distance, box[1] - distance, box[2] + distance, box[3] + distance)
    kind = {"contains": "contains", "covers": "contains", "within": "covered_by", "covered_by": "covered_by", "equals": "equals"}
    return kind.get(relation, "intersects"), Box(*box)


# --- exact relations -----------------------------------------------------------------------


def _side(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p) -> bool:
    near = abs(_side(a, b, p)) <= 1e-12 * (1 + abs(a[0]) + abs(b[0]) + abs(a[1]) + abs(b[1])) * max(1e-300, math.dist(a, b), 1e-3)
    return near and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def _segments(ps):
    return list(zip(ps, ps[1:]))


def _in_polygon(rings, p) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    inside = False
    for r in rings:
        for a, b in _segments(r):
            if _on(a, b, p):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]):
                x = a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
                inside ^= x > p[0]
    return 1 if inside else -1


def locate(s: Shape, p) -> int:
    """1 in the interior of a shape, 0 on its boundary, -1 outside."""
    best, ends = -1, 0
    for rings in s.polygons:
        best = max(best, _in_polygon(rings, p))
    for line in s.lines:
        if any(_on(a, b, p) for a, b in _segments(line)):
            closed = line[0] == line[-1]
            ends += 0 if closed else (p == line[0]) + (p == line[-1])
            best = max(best, 1)
    if best == 1 and ends % 2 and not any(_in_polygon(r, p) == 1 for r in s.polygons):
        best = 0
    return 1 if p in s.points else best


def _cuts(a, b, segments) -> list:
    """The points at which a segment meets others, its own ends included, in order."""
    ts = {0.0, 1.0}
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    for c, d in segments:
        if max(c[0], d[0]) < min(a[0], b[0]) - 1e-12 or min(c[0], d[0]) > max(a[0], b[0]) + 1e-12 or max(c[1], d[1]) < min(a[1], b[1]) - 1e-12 or min(c[1], d[1]) > max(a[1], b[1]) + 1e-12:
            continue
        den = dx * (d[1] - c[1]) - dy * (d[0] - c[0])
        if den:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
            u = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / den
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                ts.add(min(1.0, max(0.0, t)))
        for p in (c, d):
            if size and _on(a, b, p):
                ts.add(min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)))
    return [(a if t == 0 else b if t == 1 else (a[0] + t * dx, a[1] + t * dy)) for t in sorted(ts)]


def _all_segments(s: Shape):
    return [x for line in s.lines for x in _segments(line)] + [x for rings in s.polygons for r in rings for x in _segments(r)]


def _inner_point(rings):
    """A point inside a polygon: between two crossings of a level that meets no vertex."""
    ys = sorted({p[1] for r in rings for p in r})
    if len(ys) < 2:
        return rings[0][0]
    y = (ys[0] + ys[1]) / 2
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rings for a, b in _segments(r) if (a[1] > y) != (b[1] > y))
    return ((xs[0] + xs[1]) / 2, y)


def _meeting(a: Shape, b: Shape) -> dict[str, bool]:
    """What parts of `a` (interior i, boundary b) meet of `b` (interior i, boundary b, exterior e),
    and how large the largest interior meeting is: keys such as "ib", and "line", "area"."""
    out = dict.fromkeys(("ii", "ib", "ie", "bi", "bb", "be", "line", "area"), False)
    other = _all_segments(b)
    name = {1: "i", 0: "b", -1: "e"}
    for p in a.points:
        out["i" + name[locate(b, p)]] = True
    for line in a.lines:
        for s, t in _segments(line):
            cut = _cuts(s, t, other)
            for p in cut:
                own = locate(a, p)
                if own >= 0:
                    out[name[own] + name[locate(b, p)]] = True
            for p, q in zip(cut, cut[1:]):
                w = locate(b, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2))
                out["i" + name[w]] = True
                out["line"] |= w == 1
    for rings in a.polygons:
        for r in rings:
            for s, t in _segments(r):
                cut = _cuts(s, t, other)
                for p in cut:
                    out["b" + name[locate(b, p)]] = True
                for p, q in zip(cut, cut[1:]):
                    w = locate(b, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2))
                    out["b" + name[w]] = True
                    # next to an edge lies the interior: an edge inside or outside b has it on both sides of itself
                    if w == 1 and b.polygons:
                        out["ii"] = out["area"] = True
                    if w == -1:
                        out["ie"] = True
        w = locate(b, _inner_point(rings))
        out["i" + name[w]] = True
        out["area"] |= w == 1 and bool(b.polygons)
        for q in b.points:
            out["ii"] |= _in_polygon(rings, q) == 1
            out["ie"] = True
    return out


def _dim(s: Shape) -> int:
    return 2 if s.polygons else 1 if s.lines else 0 if s.points else -1


def _matrix(a: Shape, b: Shape) -> dict[str, bool]:
    m, n = _meeting(a, b), _meeting(b, a)
    flip = {"ii": "ii", "ib": "bi", "bi": "ib", "bb": "bb"}
    out = {k: m[k] or n[v] for k, v in flip.items()}
    out |= {"ie": m["ie"], "be": m["be"], "ei": n["ie"], "eb": n["be"], "area": m["area"] or n["area"], "line": m["line"] or n["line"]}
    if _dim(a) > _dim(b):
        out["ie"] = True
    if _dim(b) > _dim(a):
        out["ei"] = True
    # where the edge of one is inside an area, what lies next to the edge is inside it too
    if out["bi"] and b.polygons or out["ib"] and a.polygons:
        out["ii"] = True
    return out


def distance(a: Shape, b: Shape) -> float:
    if not a.coordinates() or not b.coordinates():
        return math.inf
    if _touch(a, b):
        return 0.0

    def to_segments(ps, segments):
        best = math.inf
        for p in ps:
            for c, d in segments:
                dx, dy = d[0] - c[0], d[1] - c[1]
                size = dx * dx + dy * dy
                t = 0 if not size else min(1, max(0, ((p[0] - c[0]) * dx + (p[1] - c[1]) * dy) / size))
                best = min(best, math.hypot(p[0] - c[0] - t * dx, p[1] - c[1] - t * dy))
        return best

    pa, pb = a.coordinates(), b.coordinates()
    least = min(to_segments(pa, _all_segments(b)), to_segments(pb, _all_segments(a)))
    if a.points and b.points:
        least = min(least, min(math.dist(p, q) for p in a.points for q in b.points))
    return least


def _touch(a: Shape, b: Shape) -> bool:
    if any(locate(b, p) >= 0 for p in a.coordinates()) or any(locate(a, p) >= 0 for p in b.coordinates()):
        return True
    other = _all_segments(b)
    return any(len(_cuts(s, t, other)) > 2 for s, t in _all_segments(a))


def related(a: Shape, b: Shape, relation: str, within: float = 0.0) -> bool:
    """`a` in the relation to `b`, as the column's geometry to the query's."""
    if relation == "equals":  # vertex for vertex
        return a.kind == b.kind and a.points == b.points and a.lines == b.lines and a.polygons == b.polygons
    if relation == "dwithin":
        return distance(a, b) <= within
    if not a.coordinates() or not b.coordinates():
        return relation == "disjoint"
    if relation in ("intersects", "disjoint"):
        return _touch(a, b) == (relation == "intersects")
    if relation in ("within", "covered_by"):
        a, b, relation = b, a, {"within": "contains", "covered_by": "covers"}[relation]
    m = _matrix(a, b)
    if relation == "covers":
        return not m["ei"] and not m["eb"] and _touch(a, b)
    if relation == "contains":
        return m["ii"] and not m["ei"] and not m["eb"]
    if relation == "touches":
        return not m["ii"] and (m["ib"] or m["bi"] or m["bb"])
    da, db = _dim(a), _dim(b)
    if relation == "overlaps":
        if da != db or not (m["ie"] and m["ei"]):
            return False
        return m["ii"] if da == 0 else m["line"] if da == 1 else m["area"] or m["ii"]
    if relation == "crosses":
        if da == db == 1:
            return m["ii"] and not m["line"]
        if da == db:
            return False
        return m["ii"] and (m["ie"] if da < db else m["ei"])
    raise FilterError(f"there is no relation {relation!r}")


@lru_cache(maxsize=64)
def _query(wkb: bytes) -> Shape:
    return read(wkb)


def relation(column: Column, name: str, wkb: bytes, distance_: float = 0.0) -> Column:
    """Exact relation of a WKB column to a constant geometry. Envelopes are compared first, so
    only geometries that could be related are decoded."""
    need = pruning(name, wkb, distance_)
    wkb = bytes(wkb)
    rectangle_ = _as_rectangle(wkb)

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        values, q = [v if v is None or isinstance(v, bytes) else bytes(v) for v in values], _query(wkb)
        e = _boxes(values)
        could = boxes_related(e, *need) if need else np.ones(len(values), bool)
        done, out = np.zeros(len(values), bool), np.zeros(len(values), bool)
        if q.polygons and not q.lines and not q.points and name in POINT_IN:
            point = np.fromiter((v is not None and len(v) == 21 and v[:5] in POINTS for v in values), bool, len(values))
            done = point & could & ~np.isnan(e[:, 0])
            out[done] = POINT_IN[name](_where(e[done, :2], q))
        if rectangle_ and name in ("intersects", "covered_by"):
            # a geometry whose envelope is within the rectangle is covered by it
            with np.errstate(invalid="ignore"):
                sure = ~done & (e[:, 0] >= rectangle_[0]) & (e[:, 2] <= rectangle_[2]) & (e[:, 1] >= rectangle_[1]) & (e[:, 3] <= rectangle_[3])
            out[sure] = done[sure] = True
        for i in np.flatnonzero(could & ~done):
            out[i] = values[i] is not None and related(read(values[i]), q, name, distance_)
        return pd.Series(out)

    return F.coalesce(test(column), F.lit(False))


def _as_rectangle(wkb: bytes) -> tuple[float, float, float, float] | None:
    """The box of a query that is an axis-parallel rectangle with an inside."""
    s = read(wkb)
    if s.points or s.lines or len(s.polygons) != 1 or len(s.polygons[0]) != 1:
        return None
    ring, box = s.polygons[0][0], box_of(wkb)
    corners = {(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])}
    square = len(ring) == 5 and set(ring) == corners and len(corners) == 4 and all((a[0] == b[0]) != (a[1] == b[1]) for a, b in _segments(ring))
    return box if square else None
