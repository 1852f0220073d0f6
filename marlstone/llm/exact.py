"""Exact dedup: immutable snapshots with static binary fuse filters.

A snapshot keeps one row per digest in hash buckets and one fuse filter per bucket. An incoming
batch is grouped by digest on its own; the filters screen its digests; only positives join the
exact buckets. Whatever ends up in a group of two or more rows is compared byte for byte, and
groups whose digests agree though their bytes differ are split by the bytes themselves.

Defined cases: a null text counts as empty and equals other empty texts; a null doc_id is below
every other; rows that repeat a doc_id count as rows, and `deduplicate` returns one of them; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import doc_input, documents, fresh, join_groups, map_texts, written

BUCKET_KEYS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
PARTS = 16


def normalised(text: str = "text"):
    """Lower-case A-Z only."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, key, text_sha256): bytes.lower() changes ASCII letters alone."""

    def kernel(ids, texts):
        full = [hashlib.sha256(t.encode().lower()) for t in texts]
        return {"doc_id": ids, "key": [h.digest()[:digest_bytes] for h in full], "text_sha256": [h.hexdigest() for h in full]}

    return map_texts(docs, kernel, "doc_id long, key binary, text_sha256 string")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))


class Snapshot:
    """Digest groups in `buckets` hash buckets, written once, and one filter per bucket."""

    def __init__(self, rows: DataFrame, n_rows: int):
        self.buckets = max(1, -(-n_rows // BUCKET_KEYS))
        self.groups = written(_grouped(rows).withColumn("bucket", self.bucket()), "snapshot")

        def make(table: pa.Table) -> pa.Table:
            seed, segment, count, prints = fuse.build(_keys(table))
            return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "seed": [seed], "segment": [segment], "count": [count], "prints": pa.array([prints], pa.binary())})

        self.filters = written(self.groups.groupBy("bucket").applyInArrow(make, "bucket int, seed long, segment long, count long, prints binary"), "filters")

    def bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def screen(self, batch: DataFrame) -> DataFrame:
        """The batch's groups with `seen`: false means surely not in the snapshot."""
        batch = batch.withColumn("bucket", self.bucket())

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            seen = np.zeros(left.num_rows, bool)
            if right.num_rows and left.num_rows:
                f = right.to_pylist()[0]
                seen = fuse.probe(_keys(left), f["seed"], f["segment"], f["count"], f["prints"])
            return left.select(["key", "n", "top"]).append_column("seen", pa.array(seen))

        return batch.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInArrow(probe, "key binary, n long, top long, seen boolean")


def _keys(table: pa.Table) -> np.ndarray:
    """64 bits of each digest; shorter digests (tests use one byte) are padded."""
    raw = b"".join(k.as_py()[:8].ljust(8, b"\0") for k in table["key"])
    return np.frombuffer(raw, np.uint64)


def find_copies(docs: DataFrame, digest_bytes: int = 32, snapshot_part=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    `snapshot_part` is a Column over doc_id: true rows form the snapshot, the others the incoming
    batch (by default each gets about half). The split changes the work, never the result.
    """
    if snapshot_part is None:
        snapshot_part = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = written(digests(docs, digest_bytes), "digests")
    n_rows = rows.count()
    old = Snapshot(rows.where(snapshot_part), n_rows)
    new = written(old.screen(_grouped(rows.where(~F.coalesce(snapshot_part, F.lit(False))))), "screened")
    both = new.where("seen").join(old.groups.select("key", F.col("n").alias("old_n"), F.col("top").alias("old_top")), "key", "left")
    met = both.select("key", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.greatest("top", "old_top").alias("top"))
    met = written(met, "met")
    alone = new.where("not seen").select("key", "n", "top").unionByName(old.groups.join(met.select("key"), "key", "left_anti").select("key", "n", "top"))
    groups = written(alone.unionByName(met).where("n > 1"), "copies")

    # byte check: min and max of a group's texts are combined before the shuffle, and again by parts of
    # the key, so no task ever holds a group; they are equal only if all its texts are. Rows outside
    # groups are left where they are read as long as the members are few enough to be sent to them
    members = written(join_groups(rows.select("doc_id", "key"), groups, "key", "n", n_rows).where("n is not null").select("doc_id", "key").distinct(), "members")
    met = F.broadcast(members) if members.count() * (32 + digest_bytes) <= MAX_BROADCAST_BYTES else members.hint("merge")
    texts = doc_input(docs).select(F.col("doc_id").alias("id"), normalised().alias("norm")).join(met, F.col("id").eqNullSafe(F.col("doc_id")))
    parts = texts.groupBy("key", F.spark_partition_id() % PARTS).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    span = parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    differ = written(span.where("lo <> hi").select("key"), "differ")
    if not differ.isEmpty():
        groups, rows = _split(docs, rows, groups, differ, digest_bytes)
    kept = join_groups(rows, groups, "key", "n", n_rows)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return kept.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _split(docs: DataFrame, rows: DataFrame, groups: DataFrame, differ: DataFrame, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Groups whose digests collide: key them by their whole normalised text instead."""
    sha = F.sha2("norm", 256)
    texts = doc_input(docs).select("doc_id", normalised().alias("norm")).select("doc_id", "norm", sha.alias("text_sha256"))
    texts = texts.withColumn("key", F.expr(f"substring(unhex(text_sha256), 1, {digest_bytes})"))
    rekeyed = written(texts.join(differ, "key", "left_semi").select("doc_id", F.encode("norm", "utf-8").alias("key"), "text_sha256"), "rekeyed")
    return (
        groups.join(differ, "key", "left_anti").unionByName(_grouped(rekeyed).where("n > 1")),
        rows.join(differ, "key", "left_anti").unionByName(rekeyed),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, all columns as they came; of repeated doc_ids with equal text, one. Only
    what goes is looked up, so rows that stay are not moved as long as those are few enough."""
    found = written(find_copies(docs), "found")
    per = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    id_, sha, stay, copy = fresh(docs, "gone_id", "gone_sha", "stay", "copy")
    gone = per.where("not kept or rows > 1").select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(sha), F.col("kept").alias(stay))
    gone = written(gone, "gone")
    met = F.broadcast(gone) if gone.count() * 80 <= MAX_BROADCAST_BYTES else gone
    mine = F.col("doc_id").cast("long")
    out = docs.join(met, mine.eqNullSafe(F.col(id_)) & (F.unhex(F.sha2(normalised(), 256)) == F.col(sha)), "left")
    once = out.where(F.col(stay).isNull()).select(*docs.columns)
    if gone.where(stay).isEmpty():
        return once
    several = out.where(stay).withColumn(copy, mine).dropDuplicates([copy, sha])
    return once.unionByName(several.select(*docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir))


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
