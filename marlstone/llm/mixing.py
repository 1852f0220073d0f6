"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words. A target
is clamped at `max_epochs` times its source's size; the excess goes to the others by weight until
no target is above its cap. Sorted by cap per weight, the clamped sources are a prefix, so running
sums give the fixed point without iterating. A source's target is met by whole repetitions of all
its documents and one fractional repetition: documents in a seeded order, up to the remaining
words; the one document on the edge is taken in part, so a source misses its target by less than
one word.

The order of a source's documents is md5(doc_id|seed). Its first three hex digits make 4096 steps
per source whose sums are small, the next three 4096 more in the step that holds the edge; only the
rows of the edge are put in order.

Defined cases: a null text has size 0; null is a source of its own, the last; a null doc_id hashes
as the empty string; repeated rows count as separate documents; all sizes 0 or an empty table give
targets of 0 or no rows; other columns are never read by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, documents, written

SEED = 17
MAX_EPOCHS = 3
MAX_BROADCAST_SOURCES = 20_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target, whole, part): one row per source,
    so the windows over all of them hold as many rows as there are sources."""
    big = "decimal(38,0)"
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("cap", (F.col("source_size") * max_epochs).cast(big))
    level = Window.orderBy((F.col("cap") * (6 / F.col("weight")).cast("int")).cast(big), F.col("source").asc_nulls_last())
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(every).cast(big))
    w = w.withColumn("left", F.col("total") - (F.sum("cap").over(every) - F.sum("cap").over(rest)))
    w = w.withColumn("left_weight", F.sum("weight").over(rest))
    w = w.withColumn("clamped", F.col("cap").cast("decimal(30,0)") * F.col("left_weight") <= F.col("weight") * F.col("left").cast("decimal(30,0)"))
    free_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every)
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0))
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(free.cast("double") * F.col("weight").cast("double") / free_weight.cast("double"))
    w = w.withColumn("target", target).withColumn("words", F.round("target").cast("long"))
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long")
    return w.select("source", "source_size", "target", whole.alias("whole"), (F.col("words") - whole * size).alias("part"))


def _order(seed: int):
    """md5(doc_id|seed), as hex: a source's documents are taken in this order."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(str(seed))))


def _small(df: DataFrame):
    return F.broadcast if df.count() <= MAX_BROADCAST_SOURCES else (lambda x: x)


def _edges(steps: DataFrame, goal: DataFrame, step: str) -> DataFrame:
    """The goal with each source's step that holds the edge, and the words before it. `steps` are
    (source, step, step_size) of what begins after the `before` words of the goal."""
    at = Window.partitionBy("source").orderBy("step")
    run = steps.withColumn("upto", F.sum("step_size").over(at))
    run = run.alias("r").join(_small(goal)(goal).alias("g"), F.expr("r.source <=> g.source"))
    run = run.withColumn("upto", F.col("upto") + F.col("before")).where("upto > part and upto - step_size <= part")
    edge = run.groupBy("g.source").agg(F.min(F.struct("step", (F.col("upto") - F.col("step_size")).alias("upto"))).alias("e"))
    kept = [c for c in goal.columns if c != "before"]
    out = goal.alias("g").join(edge.alias("x"), F.expr("g.source <=> x.source"), "left")
    return written(out.select(*[F.col(f"g.{c}") for c in kept], F.col("e.step").alias(step), F.coalesce("e.upto", "before").alias("before")), "goals")


def goals(sized: DataFrame, max_epochs: int) -> DataFrame:
    """(source, source_size, target, whole, part, edge, before), one row per source: documents whose
    `h` begins with less than `edge` are taken, those with more are not, and of those that begin with
    it as many words as `part` has beyond `before`. The edge is found in two steps of three digits,
    so that a source's edge holds one in 16 million of its documents."""
    prefix = lambda a, n: F.substring("h", a, n)
    steps = written(sized.groupBy("source", prefix(1, 3).alias("step")).agg(F.sum("size").alias("step_size")), "steps")
    goal = targets(steps.groupBy("source").agg(F.sum("step_size").alias("source_size")), max_epochs)
    goal = _edges(steps, written(goal.withColumn("before", F.lit(0).cast("long")), "targets"), "first")
    held = sized.alias("d").join(_small(goal)(goal.select("source", "first")).alias("g"), F.expr("d.source <=> g.source and substring(d.h, 1, 3) = g.first"))
    steps = held.groupBy("d.source", prefix(4, 3).alias("step")).agg(F.sum("size").alias("step_size"))
    return _edges(steps, goal, "second").withColumn("edge", F.concat("first", "second")).drop("first", "second")


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, one row per document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), _order(seed).alias("h"))
    sized = written(sized, "sized")
    goal = goals(sized, max_epochs)
    return _taken(sized, goal, ["doc_id", "source", "size", "source_size", "target"])


def _taken(rows: DataFrame, goal: DataFrame, names: list[str]) -> DataFrame:
    """`names` of the rows (doc_id, source, size, h and more) and how many words are taken. Only the
    rows of a source's edge are moved, to be put in order."""
    rows = rows.alias("d").join(_small(goal)(goal).alias("g"), F.expr("d.source <=> g.source")).drop(F.col("g.source"))
    step = F.substring("h", 1, 6)
    beyond = F.when(F.col("edge").isNull() | (step < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    clear = rows.where(F.col("edge").isNull() | (step != F.col("edge"))).withColumn("more", beyond.cast("long"))
    inside = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("before") + F.sum("size").over(inside) - F.col("size")
    split = rows.where(step == F.col("edge")).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - first)).cast("long"))
    return clear.unionByName(split).select(*names, (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def apply_mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus with the columns of `docs`: each document once per repetition taken; the
    partial repetition of a source's edge document holds its first words, original spacing kept.
    Documents of size 0 are not words of any mix and stay once. Every row's part is told from the
    row and its source's goal, so texts are not moved."""
    source, key = F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id")
    sized = written(docs.select(key, source, word_count().alias("size"), _order(seed).alias("h")), "sized")
    goal = goals(sized, max_epochs)
    rows = docs.select(key, source, word_count().alias("size"), _order(seed).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = _taken(rows, goal, ["size", "row"])
    whole = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(1)
    part = F.when(F.col("size") > 0, F.expr("cast(taken % size as int)")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = out.select("row", F.explode(copies).alias("copy"))
    words = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("copy") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("copy"), F.lit(1))), ""))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|17') AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, 3 * sum(size)::HUGEINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS rest,
         (sum(weight) OVER (ORDER BY cap * (6 // weight), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS rest_weight
  FROM s),
c AS (SELECT *, cap * rest_weight <= weight * rest AS clamped FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE
              ELSE (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0))::DOUBLE * weight::DOUBLE
                   / (sum(CASE WHEN NOT clamped THEN weight END) OVER ())::DOUBLE END AS target
  FROM c),
g AS (
  SELECT *, round(target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN (round(target)::BIGINT // source_size)::BIGINT ELSE 0 END AS whole
  FROM t),
o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, (g.words - g.whole * g.source_size)::BIGINT AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS first_word
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(size, part - first_word)))::BIGINT AS taken
FROM o
"""
