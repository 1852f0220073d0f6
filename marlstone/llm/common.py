"""Shared pieces: written intermediate tables, Arrow text access, skew-proof joins, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship

WORD_CLASS = r"[^\x20\x09-\x0D]+"
MAX_BROADCAST_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write `df` in the shared folder, at most `file_rows` rows a file if given, and read it back:
    the lineage ends there and lost executors cost only the tasks they ran. The files go when the
    application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of an Arrow batch; a null text counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def doc_input(docs: DataFrame) -> DataFrame:
    """Only what text operators read, so extra columns never reach a worker."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_texts(docs: DataFrame, kernel, schema: str) -> DataFrame:
    """One Arrow batch in, one out; `kernel(doc_ids, texts)` returns a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = kernel(batch.column("doc_id"), texts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return doc_input(docs).mapInArrow(run, schema)


def hot_limit(rows: int) -> int:
    """Groups above this are hot. At most 20,000 groups can be, whatever the input: the bound
    that allows broadcasting them."""
    return max(500, rows // 20_000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, merge: bool = False) -> DataFrame:
    """Left join of rows with one row per group. Rows of hot groups meet a broadcast of the few
    hot groups and are never dealt by key; the others are joined by key, where each key is small,
    with `merge` by the same plan at every size."""
    limit = hot_limit(n_rows)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    cold = cold.hint("merge") if merge else cold
    return rows.join(hot, key, "inner").unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def join_wide(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, by: str, wide: str) -> DataFrame:
    """`join_groups` for groups with a large column `wide`. Where the hot groups are too many bytes to
    broadcast they are repeated, once for each part of `hot_limit` rows, and rows are dealt to the
    parts by the hash of `by`."""
    limit = hot_limit(n_rows)
    hot = groups.where(F.col(size) > limit)
    if (hot.agg(F.sum(F.length(wide))).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        return join_groups(rows, groups, key, size, n_rows, merge=True)
    parts = F.ceil(F.col(size) / limit).cast("int")
    dealt = rows.join(F.broadcast(hot.select(key, parts.alias("_parts"))), key, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(repeated, [key, "_part"], "left").drop("_part")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have, however it spells its own."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph as (node, root): root is the smallest node
    reachable. Nodes without an edge are absent.

    Each round gives every node its smallest smaller neighbour as parent, shortens parent chains,
    and contracts the edges to parents. A round's mapping and edges are written tables, so rounds
    neither grow the lineage nor repeat work. Roots come out by composing the mappings backwards.
    """
    spark = edges.sparkSession
    a, b = F.least("u", "v"), F.greatest("u", "v")
    edges = written(edges.where("u <> v").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        up = written(up, "parents")
        for _ in range(2):
            over = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            up = up.join(over, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        up = written(up, "parents")
        maps.append(up)
        edges = edges.join(up.withColumnRenamed("node", "a").withColumnRenamed("up", "ra"), "a", "left")
        edges = edges.join(up.withColumnRenamed("node", "b").withColumnRenamed("up", "rb"), "b", "left")
        x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        edges = edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        edges = written(edges, "edges")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    roots = maps[-1].withColumnRenamed("up", "root")
    for up in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("up"), "root")
        roots = roots.unionByName(up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")))
    # every smallest node points to itself
    return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
