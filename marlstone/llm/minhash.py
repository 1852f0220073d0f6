"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

Signature: every shingle carries a random permutation of the slots; at rank j it offers j plus a
random fraction to its j-th slot, and a slot keeps the least offer. Ranks are taken for all
shingles at once, and a document stops at rank j once all its slots hold less than j, because
later offers cannot win. Bands of ROWS slots are hashed; documents that agree in a band are in one
bucket. With 30 bands of 5, a pair at similarity 0.85 misses all bands with probability 2e-8.

Verification is on full shingle sets (64-bit hashes of all shingles), never on signatures.
Documents with equal sets are one class. In each bucket the least class is the pivot; every other
member is compared with it, which also yields its set as a difference from the pivot's. Members of
one pivot that are still in different components are then compared with each other through these
differences, in blocks; a block emits only links that join two components. So every pair of a
bucket is decided, no pair list is made, and no task holds an unbounded group.

Defined cases: null or empty text, or text without words, has no shingles, links with nothing and
is kept; fewer words than a shingle make one shingle; equal texts are linked; repeated rows get the
same values; where a doc_id has several texts, each row follows its own text; a null doc_id is
never anyone's component, and its row shows the component of its text's class; an empty table
gives an empty result; other columns are never read, whatever their names.

Words and shingles are known by 64-bit hashes in which each eight bytes pass a finaliser. Two of n
shingles of a document share one with probability n^2 / 2^65: 1e-11 at 20,000 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, doc_input, documents, fresh, join_groups, join_wide, texts_of, written
from .fuse import mix

BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
CHUNK_BYTES = 1 << 20
BLOCK = 2_000
MAX_BROADCAST_IDS = 2_000_000
U = np.uint64
ODD = 0x9E3779B97F4A7C15


LONG_WORD = 256


def lanes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each byte string, eight bytes a step, every step through the finaliser, so
    that no algebra of the bytes makes two strings meet."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(U), seed)
        live, at = np.arange(len(begin)), 0
        while len(live):
            left = size[live] - at
            lane = eight[begin[live] + at]
            short = left < 8
            lane[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
            h[live] = mix(h[live] * U(ODD) + lane, seed + at + 1)
            at += 8
            live = live[left > 8]
    return h


def _words(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of the text it is in; `data` ends each text with a space."""
    a = np.frombuffer(data, np.uint8)
    sep = (a == 32) | ((a >= 9) & (a <= 13))
    low = a + np.where((a >= 65) & (a <= 90), np.uint8(32), np.uint8(0))
    edge = np.flatnonzero(np.diff(sep.astype(np.int8), prepend=1, append=1))
    begin, size = edge[0::2], edge[1::2] - edge[0::2]
    h = np.zeros(len(begin), U)
    short = size <= LONG_WORD
    h[short] = lanes(low, begin[short], size[short], 1)
    for i in np.flatnonzero(~short):
        h[i] = int.from_bytes(hashlib.blake2b(low[begin[i] : begin[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(texts: list[str], k: int):
    """Yield (first, sets): sorted distinct 64-bit shingle hashes of each text, chunk by chunk."""
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size < CHUNK_BYTES):
            parts.append(texts[at].encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        starts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        h, owner = _words(b" ".join(parts) + b" ", starts)
        counts = np.bincount(owner, minlength=len(parts))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            grams = np.zeros(max(0, len(h) - k + 1), U)
            for i in range(k if len(grams) else 0):
                grams = mix(grams * U(ODD) + h[i : len(grams) + i], i + 2)
            sets = []
            for n, s in zip(counts, bounds):
                if n >= k:
                    sets.append(np.unique(grams[s : s + n - k + 1]))
                elif n:
                    short = np.zeros(1, U)
                    for x in h[s : s + n]:
                        short = mix(short * U(ODD) + x, 77)
                    sets.append(mix(short, 1000 + int(n)))
                else:
                    sets.append(np.zeros(0, U))
        yield first, sets


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: slots x uint64, rank in the upper half, fraction in the lower."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, U)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat, perm = out.reshape(-1), None
    for j in range(slots):
        if not len(element):
            break
        x = mix(element, (j + 1) * ODD)
        pick = (j + (((x >> U(32)) * U(slots - j)) >> U(32)).astype(np.int64)).astype(np.intp)
        if perm is not None:
            i = np.arange(len(element))
            slot = perm[i, pick].copy()
            perm[i, pick] = perm[:, j]
            perm[:, j] = slot
        else:
            slot, first = pick, pick
        np.minimum.at(flat, owner * slots + slot, (U(j) << U(32)) | (x & U(0xFFFFFFFF)))
        # a document goes on while some slot could still get a lower offer at rank j + 1
        open_docs = (out >= (U(j + 1) << U(32))).any(axis=1)
        live = open_docs[owner]
        if perm is None:
            element, owner, first = element[live], owner[live], first[live]
            if len(element):
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(element), 1))
                i = np.arange(len(element))
                perm[i, first] = 0
                perm[:, 0] = first
        elif not live.all():
            element, owner, perm = element[live], owner[live], perm[live]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band, different bands never sharing keys but by chance."""
    h = np.zeros((len(signature), BANDS), U)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            h = mix(h * U(5) + signature[:, r::ROWS], r + 11)
        h = mix(h + np.arange(BANDS, dtype=U)[None, :] * U(ODD), 5)
    return h.view(np.int64)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_id, n_shingles, set_id (null without shingles), keys."""

    def run(batches):
        for b in batches:
            texts, ids = texts_of(b), b.column("doc_id")
            for first, sets in shingle_sets(texts, k):
                keys = band_keys(signatures(sets))
                full = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sets)), b.column("text_id").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(full, pa.binary()), lists], ["doc_id", "text_id", "n_shingles", "set_id", "keys"])

    texts = doc_input(docs).withColumn("text_id", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, text_id long, n_shingles long, set_id binary, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(set_id, set) of all texts of the given documents: they are read again, others passed by."""
    few = ids.count() <= MAX_BROADCAST_IDS
    texts = doc_input(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            for _, sets in shingle_sets(texts_of(b), k):
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "set"])

    return texts.mapInArrow(run, "set_id binary, set binary")


def named(classes: DataFrame) -> tuple[DataFrame, bool]:
    """Classes with a name `id` each: the smallest doc_id, kept as `doc`, or a number beyond all
    doc_ids where several classes share one, as they do if a doc_id has several texts."""
    shared = written(classes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("own")).where("n > 1"), "shared")
    if shared.isEmpty():
        return classes.withColumn("doc", F.col("id")), False
    other = F.lit(1 << 62) + F.xxhash64("set_id").bitwiseAND(F.lit((1 << 61) - 1))
    out = classes.join(shared.select("id", "own"), "id", "left").withColumn("doc", F.col("id"))
    return written(out.withColumn("id", F.when(F.col("own") != F.col("set_id"), other).otherwise(F.col("id"))).drop("own"), "classes"), True


def _linked(inter, n1, n2, percent: int):
    return 100 * inter >= percent * (n1 + n2 - inter)


def _compare(percent: int):
    """(pivot, id, pset, set) to (pivot, id, linked, n, mask, extra): the member as a bit mask of
    the pivot's set and the shingles outside it."""

    def run(batches):
        for b in batches:
            out = {"linked": [], "n": [], "width": [], "mask": [], "extra": []}
            for p, s in zip(b.column("pset"), b.column("set")):
                p, s = np.frombuffer(p.as_buffer(), U), np.frombuffer(s.as_buffer(), U)
                where = np.searchsorted(p, s)
                inside = p[np.minimum(where, len(p) - 1)] == s
                mask = np.zeros(len(p), bool)
                mask[where[inside]] = True
                inter = int(mask.sum())
                out["linked"].append(_linked(inter, len(p), len(s), percent))
                out["n"].append(len(s))
                out["width"].append(len(p))
                out["mask"].append(np.packbits(mask).tobytes())
                out["extra"].append(s[~inside].tobytes())
            types = {"linked": pa.bool_(), "n": pa.int64(), "width": pa.int64(), "mask": pa.binary(), "extra": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("id"), *[pa.array(out[c], t) for c, t in types.items()]], ["pivot", "id", *types])

    return run


def _blocks(percent: int):
    """Rows of several (pivot, block pair) groups to the links that join two components."""

    def run(table: pa.Table) -> pa.Table:
        pivot, pair = table["pivot"].to_numpy(), table["pair"].to_numpy()
        order = np.lexsort((table["id"].to_numpy(), pair, pivot))
        table = table.take(pa.array(order))
        pivot, pair = pivot[order], pair[order]
        ids, roots, ns, side = (table[c].to_numpy() for c in ("id", "root", "n", "side"))
        cuts = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (pair[1:] != pair[:-1]), [True]]))
        us, vs = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2 or (roots[lo:hi] == roots[lo]).all():
                continue
            width = table["width"][int(lo)].as_py()
            masks = np.frombuffer(b"".join(x.as_py() for x in table["mask"].slice(lo, hi - lo)), np.uint8).reshape(hi - lo, -1)
            bits = np.unpackbits(masks, axis=1, count=width).astype(np.float32)
            extra = [np.frombuffer(x.as_py(), U) for x in table["extra"].slice(lo, hi - lo)]
            more = np.array([len(x) for x in extra])
            n, root, where = ns[lo:hi], roots[lo:hi].copy(), side[lo:hi]
            left, right = np.flatnonzero(where != 1), np.flatnonzero(where != 0)
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                inter = (bits[rows] @ bits[right].T).astype(np.int64)
                most = inter + np.minimum(more[rows][:, None], more[right][None, :])
                total = n[rows][:, None] + n[right][None, :]
                could = (100 * most >= percent * (total - most)) & (root[rows][:, None] != root[right][None, :])
                if (where[rows] == 2).any():
                    could &= rows[:, None] < right[None, :]
                for x, y in zip(*np.nonzero(could)):
                    i, j = rows[x], right[y]
                    if root[i] == root[j]:
                        continue
                    both = int(inter[x, y]) + len(np.intersect1d(extra[i], extra[j], assume_unique=True))
                    if _linked(both, n[i], n[j], percent):
                        us.append(ids[lo + i])
                        vs.append(ids[lo + j])
                        root[root == root[j]] = root[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, with_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row; on request also text_id, the
    row's hash of its text."""
    rows = written(sketch(docs, k), "sketches")
    n_rows = rows.count()
    # classes of equal sets: one representative each, whatever the number of copies
    classes = rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes, several = named(written(classes, "classes"))
    keyed = classes.select("id", F.explode("keys").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("pivot"), F.max("id").alias("other")).where("members > 1"), "buckets")
    two = buckets.where("members = 2").select("pivot", F.col("other").alias("id"))
    many = join_groups(keyed, buckets.where("members > 2").select("key", "members", "pivot"), "key", "members", n_rows * BANDS)
    pairs = written(two.unionByName(many.where("pivot < id").select("pivot", "id")).distinct(), "pairs")

    wanted = classes.select("id", "set_id", "doc").join(pairs.select(F.explode(F.array("pivot", "id")).alias("id")).distinct(), "id", "left_semi")
    wanted = written(wanted, "wanted")
    sets = full_sets(docs, wanted.select(F.col("doc").alias("doc_id")).distinct(), k).join(wanted.select("id", "set_id").hint("merge"), "set_id")
    # only rows that repeat a doc_id give a set twice
    repeated = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    sets = written((sets.dropDuplicates(["id"]) if repeated else sets).select("id", "set"), "sets")
    groups = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("members")).join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("pset")).hint("merge"), "pivot")
    # sets are joined by one plan at every size, so that what they cost grows as they do
    compared = join_wide(pairs.join(sets.hint("merge"), "id"), groups, "pivot", "members", max(n_rows, 1), "id", "pset")
    compared = written(compared.select("pivot", "id", "pset", "set").mapInArrow(_compare(percent), "pivot long, id long, linked boolean, n long, width long, mask binary, extra binary"), "compared")

    links = compared.where("linked").select(F.col("pivot").alias("u"), F.col("id").alias("v"))
    roots = components(links)
    links = links.unionByName(_rest(compared, roots, percent))
    roots = components(links)
    found = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("set_id", "copies", "id", "doc", F.coalesce("root", "id").alias("root"))
    if several:
        found = found.join(found.groupBy("root").agg(F.min("doc").alias("component")), "root")
    else:
        found = found.withColumn("component", F.col("root"))
    found = written(found.where("copies > 1 or component <> id").select("set_id", "copies", "component"), "found")
    out = join_groups(rows.drop("keys").where("set_id is not null"), found, "set_id", "copies", n_rows)
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    made = ["doc_id", "n_shingles", "component_id", *(["text_id"] if with_text else [])]
    out = out.select(*made).unionByName(rows.where("set_id is null").withColumn("component_id", F.col("doc_id")).select(*made))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rest(compared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between members of one pivot that are in different components so far. Pivots with
    more than BLOCK members are cut into blocks, every two of which meet in one group."""
    member = compared.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).drop("linked")
    member = written(member, "members")
    size = member.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    size = written(size.where("members > 1 and r0 <> r1").select("pivot", "members"), "open")
    n_rows = member.count()
    open_rows = join_groups(member, size, "pivot", "members", n_rows).where("members is not null")
    open_rows = open_rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct((F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine"))).cast("long").alias("pair"), F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).cast("int").alias("side")))
    dealt = open_rows.withColumn("m", F.explode(meets)).select("pivot", "id", "root", "n", "width", "mask", "extra", "m.pair", "m.side")
    tasks = max(8, n_rows // 20_000)
    return dealt.withColumn("g", F.pmod(F.xxhash64("pivot", "pair"), F.lit(tasks))).groupBy("g").applyInArrow(lambda t: _blocks(percent)(t.drop_columns(["g"])), "u long, v long")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, columns as they came: of each group the document with the
    smallest doc_id. Rows with a null doc_id belong to no group and stay; where a doc_id has several
    texts, only its rows with a text that goes go."""
    gone = near_groups(docs, k, percent, with_text=True).where("doc_id is not null and not kept").select("doc_id", "text_id").distinct()
    one, two = fresh(docs, "gone_doc", "gone_text")
    gone = written(gone.toDF(one, two), "gone")
    same = (F.col("doc_id").cast("long") == F.col(one)) & (F.xxhash64(F.col("text").cast("string")) == F.col(two))
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone, same, "left_anti").select(*docs.columns)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), k=3, percent=85)


def brute_groups(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component), every pair compared through an inverted index; for tests."""
    import re

    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index: dict = {}
    for d in sorted(texts):
        inter: dict = {}
        for s in sets[d]:
            for o in index.get(s, ()):
                inter[o] = inter.get(o, 0) + 1
            index.setdefault(s, []).append(d)
        for o, i in inter.items():
            if 100 * i >= percent * (len(sets[d]) + len(sets[o]) - i):
                a, b = find(d), find(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in texts}


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.u, p.v FROM p JOIN s a ON a.doc_id = p.u JOIN s b ON b.doc_id = p.v
  WHERE 100 * shared >= 85 * (len(a.s) + len(b.s) - shared)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.v, r.root FROM r JOIN l ON r.node = l.u),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.node = s.doc_id
"""
