"""Embedding near-duplicates: exact threshold pairs by cover trees and dual traversal.

On unit vectors cosine >= t is distance <= sqrt(2 - 2 t). A cover tree halves its radius from level
to level: the children of a node are centres no two of which are within half of its radius, and
every point of the node is with a child that covers it. Two nodes further apart than the threshold
plus both covering radii hold no pair; two nodes whose farthest points are within the threshold hold
only pairs; others are opened, all children of one against all of the other in one matrix product.
Products in single precision only rule out: whatever is within their error bound, which grows with
the dimension, is told in double precision.

The levels over all vectors: centres from a bounded sample (SAMPLE vectors, the smallest by hash)
make cells, whose covering radii are taken over all vectors. Cells are packed into blocks of at most
BLOCK_BYTES, large cells cut into several. Each block's tree is built once and written. Two blocks
meet where cells of theirs survive the radius bound; one task walks the two trees and returns, per
vector, how many vectors of the other block it is linked with, and links that span the task's
components. Results do not depend on sample or blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths; equal vectors are one class, their copies linked with
each other; components may be as large or small as doubles are; a null vec_id takes no part and keeps
null as component; repeated rows of one vec_id count as vectors; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, ship
from .common import components, documents, join_groups, written

SAMPLE = 4_096
MAX_CELLS = 1_024
BLOCK_BYTES = 4 << 20  # an executor holds several trees and messages of two at once; results do not depend on it
LEAST_BLOCKS = 8
LEAST_BLOCK = 1_024
MAX_BROADCAST_BYTES = 64 << 20
LEAF = 32
SLACK = 1e-6
TILE = 1_024  # rows and columns of a product taken at once
GATHERED_BYTES = 8 << 20  # vectors taken in double precision at once
LINKS = "id long, other long, n long"


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T)))


def _net(x: np.ndarray, rows: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """(centre, rows) of a cover of `rows`: `centre` first, no two centres within `radius`, every row
    with one that is. Centres are taken a block at a time."""
    cover = 1 - radius * radius / 2
    at, owner = [centre], np.full(len(rows), -1)
    owner[x[rows] @ x[centre] >= cover] = 0
    owner[rows == centre] = 0
    left = np.flatnonzero(owner < 0)
    while len(left):
        block = left[:256]
        near = x[rows[block]] @ x[rows[block]].T >= cover
        taken, mine = np.zeros(len(block), bool), []
        for i in range(len(block)):
            if not taken[i]:
                mine.append(i)
                taken |= near[i]
        first = len(at)
        at += rows[block[mine]].tolist()
        new, best, held = x[rows[block[mine]]].T, np.empty(len(left), np.int64), np.empty(len(left), bool)
        for s in range(0, len(left), TILE):
            cosine = x[rows[left[s : s + TILE]]] @ new
            best[s : s + TILE] = cosine.argmax(axis=1)
            held[s : s + TILE] = cosine.max(axis=1) >= cover
        held[mine], best[mine] = True, np.arange(len(mine))
        owner[left[held]] = first + best[held]
        left = left[~held]
    order = np.argsort(owner, kind="stable")
    return list(zip(at, np.split(rows[order], np.cumsum(np.bincount(owner, minlength=len(at)))[:-1])))


class CoverTree:
    """Nested levels over unit vectors. Points are put in an order (`order`) in which every node's
    are `lo`..`hi`, nodes so that a node's children are `kid`..`kid + kids`."""

    def __init__(self, x: np.ndarray):
        todo, at = [(0, np.arange(len(x)))], 0
        self.radius, self.kid, self.kids, centres = [], [], [], []
        while at < len(todo):
            centre, rows = todo[at]
            d = distances(x[rows], x[centre]) if len(rows) > 1 else np.zeros(1)
            self.radius.append(float(d.max()))
            centres.append(centre)
            parts = _net(x, rows, centre, self.radius[-1] / 2) if len(rows) > LEAF and self.radius[-1] > SLACK else []
            self.kid.append(len(todo))
            self.kids.append(len(parts))
            todo += parts
            at += 1
        sizes = np.array([len(r) for _, r in todo])
        self.lo = np.zeros(len(todo), np.int64)
        self.order = np.zeros(len(x), np.int64)
        for i, (_, rows) in enumerate(todo):
            if self.kids[i]:
                kids = slice(self.kid[i], self.kid[i] + self.kids[i])
                self.lo[kids] = self.lo[i] + np.cumsum(sizes[kids]) - sizes[kids]
            else:
                self.order[self.lo[i] : self.lo[i] + len(rows)] = rows
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.hi, self.centre = self.lo + sizes, place[centres]
        self.radius, self.kid, self.kids = np.array(self.radius), np.array(self.kid), np.array(self.kids)
        self.set_points(x[self.order])

    def set_points(self, x: np.ndarray | None) -> None:
        """The points, in the tree's order; None leaves the shape alone, to be sent."""
        self.x, self.low = x, None if x is None else x.astype(np.float32)

    def opened(self, node: int) -> np.ndarray:
        return np.arange(self.kid[node], self.kid[node] + self.kids[node]) if self.kids[node] else np.array([node])


def _places(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, several times faster where little is true."""
    return np.divmod(np.flatnonzero(yes), yes.shape[1])


def dual(a: CoverTree, b: CoverTree, cosine: float, all_linked, linked) -> None:
    """Walk both trees, or one against itself if they are the same: `all_linked(node, node)` for
    nodes that hold only pairs, `linked(points, points)` for single pairs. Products are taken in
    tiles, and the pairs of nodes of one tile are walked before the next is taken: what is held at
    once does not grow with the number of children."""
    limit, own = np.sqrt(max(0.0, 2 - 2 * cosine)), a is b
    error = (a.x.shape[1] + 4) * 2.0**-23
    step = max(1, GATHERED_BYTES // (8 * a.x.shape[1]))

    def told(i: np.ndarray, j: np.ndarray):
        """Cosines of points with points, in double precision, a few at a time."""
        for s in range(0, len(i), step):
            u, v = i[s : s + step], j[s : s + step]
            yield u, v, np.einsum("nd,nd->n", a.x[u], b.x[v])

    def points(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """Points against points."""
        for s in range(0, len(p), TILE):
            low = a.low[p[s : s + TILE]]
            for t in range(0, len(q), TILE):
                if same and p[s] > q[t : t + TILE][-1]:
                    continue
                i, j = _places(low @ b.low[q[t : t + TILE]].T >= cosine - error)
                i, j = p[s + i], q[t + j]
                if same:
                    i, j = i[i < j], j[i < j]
                for u, v, c in told(i, j):
                    linked(u[c >= cosine], v[c >= cosine])

    def near(many: np.ndarray, more: np.ndarray, same: bool):
        """Pairs of nodes that may hold linked points, a tile at a time."""
        for s in range(0, len(many), TILE):
            part = many[s : s + TILE]
            low = a.low[a.centre[part]]
            for t in range(0, len(more), TILE):
                rest = more[t : t + TILE]
                if same and part[0] > rest[-1]:
                    continue
                reach = limit + SLACK + a.radius[part][:, None] + b.radius[rest][None, :]
                i, j = _places(low @ b.low[b.centre[rest]].T >= np.where(reach < 2, 1 - reach * reach / 2, -2) - error)
                i, j = part[i], rest[j]
                if same:
                    i, j = i[i <= j], j[i <= j]
                yield i, j

    def walk(p: int, q: int):
        """The pairs of nodes to be opened next."""
        same = own and p == q
        if not a.kids[p] and not b.kids[q]:
            points(np.arange(a.lo[p], a.hi[p]), np.arange(b.lo[q], b.hi[q]), same)
            return
        many, more = a.opened(p), b.opened(q)
        lone, alone = a.hi[many] - a.lo[many] == 1, b.hi[more] - b.lo[more] == 1
        points(a.lo[many[lone]], b.lo[more[alone]], same)
        for left, right in ((many[~lone], more), (many[lone], more[~alone])):
            for i, j in near(left, right, same):
                whole = np.concatenate([np.zeros(0, bool), *(np.sqrt(np.maximum(0.0, 2 - 2 * c)) for _, _, c in told(a.centre[i], b.centre[j]))])
                whole = whole + a.radius[i] + b.radius[j] < limit - SLACK
                for m, n in zip(i[whole].tolist(), j[whole].tolist()):
                    all_linked(m, n)
                yield from zip(i[~whole].tolist(), j[~whole].tolist())

    todo = [walk(0, 0)]
    while todo:
        pair = next(todo[-1], None)
        if pair is None:
            todo.pop()
        else:
            todo.append(walk(*pair))


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    return _units(b"".join(raw), len(raw), width)


def _units(raw: bytes, n: int, width: int) -> np.ndarray:
    """The `n` vectors in `raw`, scaled to length 1 in place, a tile at a time."""
    x = np.frombuffer(raw, np.float32 if width == 4 else np.float64).reshape(n, -1).astype(np.float64)
    for s in range(0, n, TILE):
        y = x[s : s + TILE]
        y /= np.abs(y).max(axis=1, initial=0)[:, None]
        y /= np.sqrt((y * y).sum(axis=1))[:, None]
    return x


def vectors(table: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, raw): raw is null where the vector can link with nothing."""
    ship(table.sparkSession)
    double = isinstance(table.schema[column].dataType.elementType, T.DoubleType)
    v = F.col(column).cast("array<double>" if double else "array<float>")
    kind, width = (np.float64, 8) if double else (np.float32, 4)

    def run(batches):
        for b in batches:
            raw = []
            for x in b.column("v"):
                ok = x.is_valid and len(x) and not x.values.null_count
                y = x.values.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                raw.append(y.tobytes() if ok and np.isfinite(y).all() and y.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).mapInArrow(run, "vec_id long, raw binary"), width


def _cells(sample: np.ndarray) -> np.ndarray:
    """Centres of the cover tree's upper levels: farthest first, so each prefix covers the sample
    with the least radius so far, until all is covered or the bound is reached."""
    centres, near = [0], distances(sample, sample[:1])[:, 0]
    while len(centres) < min(MAX_CELLS, max(1, len(sample) // 4)) and near.max() > 0.05:
        centres.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[centres[-1:]])[:, 0])
    return sample[centres]


def _grow(width: int):
    """Block to one row: its tree's shape, and ids, copies and vectors in the tree's order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable")))
        tree = CoverTree(_unit([r.as_py() for r in table["raw"]], width))
        table = table.take(pa.array(tree.order))
        tree.set_points(None)
        raw = b"".join(r.as_py() for r in table["raw"])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps((tree, table["id"].to_numpy(), table["copies"].to_numpy(), raw))], pa.binary())})

    return run


def _grown(data: pa.Buffer, width: int) -> tuple[CoverTree, np.ndarray, np.ndarray]:
    tree, ids, copies, raw = pickle.loads(data)
    tree.set_points(_units(raw, len(ids), width))
    return tree, ids, copies


def _meet(cosine: float, width: int):
    """Two trees, or one with itself, to the links between their vectors."""

    def walk(mine: pa.Buffer, others: pa.Buffer | None):
        tree, ids, copies = _grown(mine, width)
        other, n = tree, len(ids)
        if others is not None:
            other, more, times = _grown(others, width)
            ids, copies = np.concatenate([ids, more]), np.concatenate([copies, times])
        shift = 0 if others is None else n
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def join(i: np.ndarray, j: np.ndarray) -> None:
            apart = root[i] != root[j]
            for x, y in set(zip(root[i[apart]].tolist(), root[j[apart]].tolist())):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root[:] = root[root]

        def all_linked(p: int, q: int) -> None:
            i, j = np.arange(tree.lo[p], tree.hi[p]), np.arange(other.lo[q], other.hi[q]) + shift
            if i[0] == j[0]:  # a node with itself: every point with all but itself
                count[i] += copies[i].sum() - copies[i]
            else:
                count[i] += copies[j].sum()
                count[j] += copies[i].sum()
            join(i, np.full(len(i), j[0]))
            join(j, np.full(len(j), i[0]))

        def linked(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(count, i, copies[j + shift])
            np.add.at(count, j + shift, copies[i])
            join(i, j + shift)

        dual(tree, other, cosine, all_linked, linked)
        keep = count > 0
        return ids[keep], ids[root[keep]], count[keep]

    def run(batches):
        for b in batches:
            for mine, others in zip(b.column("tree"), b.column("other_tree")):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in walk(mine.as_buffer(), others.as_buffer())], ["id", "other", "n"])

    return run


def near_vectors(table: DataFrame, cosine: float = 0.95, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    rows, width = vectors(table, column)
    rows = written(rows, "vectors")
    n_rows = rows.count()
    classes = rows.where("raw is not null and vec_id is not null").groupBy("raw").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "vector-classes")
    linked = [_one_length(classes.where(F.length("raw") == n.n), cosine, width) for n in classes.select(F.length("raw").alias("n")).distinct().collect()]
    spark = rows.sparkSession
    found = spark.createDataFrame([], LINKS)
    for part in linked:
        found = found.unionByName(part)
    found = written(found, "vector-links")
    roots = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")))
    per = found.groupBy("id").agg(F.sum("n").alias("n"))
    per = classes.join(per, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    per = per.select("raw", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    per = written(per.where("n_links > 0"), "vector-groups")
    out = join_groups(rows.where("raw is not null and vec_id is not null"), per, "raw", "copies", n_rows)
    out = out.unionByName(rows.where("raw is null or vec_id is null"), allowMissingColumns=True)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _one_length(classes: DataFrame, cosine: float, width: int) -> DataFrame:
    """Links among classes of vectors of one length: (id, other, n)."""
    sample = classes.select("raw", F.xxhash64("raw").alias("h")).orderBy("h", "raw").limit(SAMPLE).collect()
    centres = _cells(_unit([r["raw"] for r in sample], width))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = np.sqrt(np.maximum(0, 2 - 2 * (_unit([r.as_py() for r in b.column("raw")], width) @ centres.T)))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), b.column("copies"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], ["id", "raw", "copies", "cell", "d"])

    cells = written(classes.select("id", "raw", "copies").mapInArrow(assign, "id long, raw binary, copies long, cell int, d double"), "cells")
    sizes = sorted(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect())
    # at most MAX_CELLS rows: pack cells into blocks in order, cut large ones
    n_all = sum(r["n"] for r in sizes)
    block = max(1, min(BLOCK_BYTES // len(sample[0]["raw"]), max(LEAST_BLOCK, -(-n_all // LEAST_BLOCKS))))
    radius, begin, parts, at, room = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64), 0, block
    for r in sizes:
        c, n = r["cell"], r["n"]
        radius[c] = r["r"]
        if n > room and room < block:
            at, room = at + 1, block
        begin[c], parts[c] = at, -(-n // block)
        at, room = (at, room - n) if n < room else (at + parts[c], block)
    used = np.flatnonzero(radius >= 0)
    limit = np.sqrt(2 - 2 * cosine) + SLACK

    def place(batches):
        for b in batches:
            ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
            mine = begin[cell] + np.abs(ids * 2654435761 >> 7) % parts[cell]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), b.column("copies"), pa.array(mine, pa.int64())], ["id", "raw", "copies", "block"])

    placed = cells.mapInArrow(place, "id long, raw binary, copies long, block long")
    # one tree a file, so that trees are read by as many tasks and one at a time
    trees = written(placed.groupBy("block").applyInArrow(lambda t: _grow(width)(t), "block long, tree binary"), "trees", file_rows=1)

    def meetings(batches):
        """Blocks to the blocks not below them that hold a cell near enough to one of theirs."""
        gap = distances(centres[used], centres[used]) - radius[used][:, None] - radius[used][None, :]
        near, first, last = gap <= limit, begin[used], begin[used] + parts[used] - 1
        for b in batches:
            for x in b.column("block").to_pylist():
                others = near[(first <= x) & (x <= last)].any(axis=0)
                met = {z for f, t in zip(first[others], last[others]) for z in range(max(f, x), t + 1)} | {x}
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(met), pa.int64()), pa.array(sorted(met), pa.int64())], ["block", "other"])

    pairs = trees.select("block").mapInArrow(meetings, "block long, other long")
    sizes = sorted((r["block"], r["size"]) for r in trees.select("block", F.length("tree").alias("size")).collect())
    second = trees.select(F.col("block").alias("other"), F.col("tree").alias("other_tree"))
    # a block that meets itself brings its tree once
    both = ("tree", F.when(F.col("block") != F.col("other"), F.col("other_tree")).alias("other_tree"))
    if sum(n for _, n in sizes) <= MAX_BROADCAST_BYTES:
        tasks = max(1, min(len(sizes) ** 2 // 2, 100_000))
        met = pairs.repartition(tasks, "block", "other").join(F.broadcast(trees), "block").join(F.broadcast(second), "other").select(*both)
        return met.mapInArrow(_meet(cosine, width), LINKS)
    # more trees than can be broadcast: a few at a time meet all others as these are read, so that no
    # tree is copied to disk or sorted
    pairs = written(pairs, "meetings")
    packs: list[tuple[int, int]] = []
    room = 0
    for at, n in sizes:
        if n > room:
            packs.append((at, at))
            room = MAX_BROADCAST_BYTES
        packs[-1], room = (packs[-1][0], at), room - n
    spark = trees.sparkSession
    path = scratch(spark, "pack-links")
    for first, last in packs:
        few, mine = trees.where(F.col("block").between(first, last)), pairs.where(F.col("block").between(first, last))
        met = second.where(F.col("other") >= first).join(F.broadcast(mine), "other").join(F.broadcast(few), "block").select(*both)
        met.mapInArrow(_meet(cosine, width), LINKS).write.mode("append").parquet(path)
    return spark.read.schema(LINKS).parquet(path)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"))


def brute_vectors(vectors: dict[int, list | None], cosine: float) -> dict[int, tuple[int, int]]:
    """vec_id to (n_links, component) by all pairs; for tests."""
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    good = {i: x / np.abs(x).max() for i, x in good.items()}
    links = {i: set() for i in vectors}
    for i, x in good.items():
        for j, y in good.items():
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(vectors):
        if i not in out:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            for j in group:
                out[j] = (len(links[j]), i)
    return out


OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (
  SELECT vec_id, v FROM e
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM e UNION SELECT l.v, r.root FROM r JOIN l ON r.node = l.u),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT c.node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.node = c.component_id AS kept
FROM c LEFT JOIN n ON n.u = c.node
"""
