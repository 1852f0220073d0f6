"""Removing repeated byte strings with suffix arrays.

A byte goes where it is covered by a LENGTH-byte string that also starts in a document with a
smaller doc_id.

Candidates: every string is named by the least K-byte hash inside it (its anchor), so equal strings
have equal anchors. Consecutive strings with one anchor form a window of at most 84 bytes, named by
128 bits over its bytes (5e12 windows, 100 TB, share a name with probability 4e-14). Windows are
grouped by anchor: one that is, whole, in a smaller document is settled, and an anchor with a single
kind of window needs nothing more. Only anchors with windows of several kinds, which are the edges of
repeated passages, go on: one window of each kind, from its smallest document, is sent to the
anchor's shard.

Shards: the windows of a shard are put together, and the suffixes that begin a string of a window, a
quarter of all, are sorted by their first LENGTH bytes: a sparse suffix array, digit by digit, in which
only suffixes that agree with another so far go on. Those that agree in all LENGTH bytes are one class,
and its smallest document is the one that keeps it. `suffix_array` sorts whole suffixes by induction, and
tests hold the sparse order against it and its permuted common prefixes.

Texts travel in packed batches: a written table that later passes read again. Windows are combined
within a batch before they are dealt out.

Defined cases: a null text counts as empty; texts below LENGTH bytes lose nothing; rows that repeat
a doc_id never remove each other's bytes; a null doc_id counts as larger than all others; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_input, documents, texts_of, written
from .fuse import mix
from .minhash import ODD, lanes

LENGTH = 50
K = 16
SIDE = (LENGTH - K) // 2
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
U = np.uint64
LAST = np.iinfo(np.int64).max
TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


# --- suffix arrays ---------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return (nxt < n - 1) & (t[nxt] < t[np.minimum(nxt + 1, n - 1)])


def _deal(found: np.ndarray, t: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append positions to their characters' lists, order kept."""
    if not len(found):
        return
    c = t[found]
    order = np.argsort(c, kind="stable")
    found, c = found[order], c[order]
    cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(c))):
        into[int(c[lo])].append(found[lo:hi])


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix order that sorted leftmost-smaller positions `seeds` induce."""
    n, none = len(t), np.zeros(0, np.int32)
    seeds = seeds.astype(np.int32)
    seeded: list[list[np.ndarray]] = [[] for _ in range(256)]
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(seeds, t, seeded)
    large[int(t[n - 1])].append(np.array([n - 1], np.int32))
    for c in range(256):
        done, at = [], 0
        while at < len(large[c]):
            # one wave: what this bucket holds so far; its own character makes the next wave
            wave = np.concatenate(large[c][at:])
            at = len(large[c])
            done.append(wave)
            before = wave[wave > 0] - 1
            _deal(before[~small[before]], t, large)
        if seeded[c]:
            _deal(np.concatenate(seeded[c]) - 1, t, large)
        large[c] = done
    out: list[list[np.ndarray]] = [[] for _ in range(256)]
    for c in range(255, -1, -1):
        done, at = [], 0
        while at < len(out[c]):
            wave = np.concatenate(out[c][at:])
            at = len(out[c])
            done.append(wave)
            before = wave[wave > 0] - 1
            _deal(before[small[before]], t, out)
        if large[c]:
            own = np.concatenate(large[c])[::-1]
            before = own[own > 0] - 1
            _deal(before[small[before]], t, out)
        out[c] = done
    parts = []
    for c in range(256):
        parts += large[c]
        parts += [x[::-1] for x in out[c][::-1]]
    return np.concatenate(parts) if parts else none


def _names(t: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of leftmost-smaller substrings, given in sorted order; by position of `starts`."""
    end = np.append(starts[1:], len(t) - 1)
    a, b = order[:-1], order[1:]
    size = end - starts + 1
    same = size[a] == size[b]
    live, i = np.flatnonzero(same), 0
    while len(live):
        x, y = starts[a[live]] + i, starts[b[live]] + i
        equal = t[x] == t[y]
        same[live[~equal]] = False
        i += 1
        live = live[equal & (size[a[live]] > i)]
    # the substring that ends the text is unlike any other: the text's end follows it
    last = len(starts) - 1
    same &= (a != last) & (b != last)
    names = np.empty(len(starts), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _induce_names(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """`_induce` over names: their buckets are too many to sweep one by one, so the sweeps go place by
    place, in Python over plain lists."""
    n = len(t)
    count = np.bincount(t)
    tails = np.cumsum(count)
    heads = tails - count
    # seeds at the ends of their buckets, in their order
    c = t[seeds]
    by = np.argsort(c, kind="stable")
    later = np.append(np.flatnonzero(np.diff(c[by])) + 1, len(c))
    end = later[np.searchsorted(later, np.arange(len(c)), side="right")] if len(c) else later[:0]
    first = np.full(n, -1, np.int64)
    first[tails[c[by]] - (end - np.arange(len(c)))] = seeds[by]
    room = heads.tolist()
    first[heads[t[n - 1]]] = n - 1
    room[int(t[n - 1])] += 1
    sa = first.tolist()
    # the bucket of each place's larger or smaller kind; -1 where it is of the other, and before the text
    large = np.where(small, -1, t).tolist() + [-1, -1]
    for x in sa:
        c = large[x - 1]
        if c >= 0:
            at = room[c]
            sa[at] = x - 1
            room[c] = at + 1
    del large
    room = tails.tolist()
    less = np.where(small, t, -1).tolist() + [-1, -1]
    for x in reversed(sa):
        c = less[x - 1]
        if c >= 0:
            at = room[c] - 1
            sa[at] = x - 1
            room[c] = at
    return np.array(sa)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a string of bytes, or of names from 0 on, in sorted order."""
    if len(t) < 2:
        return np.arange(len(t))
    induce = _induce if t.dtype == np.uint8 else _induce_names
    small = _types(t)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(starts) < 2:
        return induce(t, small, starts)
    first = induce(t, small, starts)
    where = np.full(len(t), -1, np.int32)
    where[starts] = np.arange(len(starts))
    order = where[first]
    del first, where
    names = _names(t, starts, order[order >= 0])
    # the string of names is sorted the same way, unless no two are alike
    ranked = np.argsort(names) if names.max() == len(starts) - 1 else suffix_array(names)
    return induce(t, small, starts[ranked])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in text order, how many bytes it shares with the one before it in the
    suffix array, up to `most`."""
    n = len(t)
    out = np.zeros(n, np.int32)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before >= 0)
    j = before[i]
    room = np.minimum(most, n - np.maximum(i, j))
    padded = np.concatenate([t, np.zeros(8 + most, np.uint8)])
    eight = np.ndarray((n + most + 1,), "<u8", padded, 0, (1,))
    for at in range(0, most, 8):
        differ = eight[i + at] ^ eight[j + at]
        end = np.flatnonzero((differ != 0) | (room <= at + 8))
        # the lowest bit that differs is in the first byte that does
        low = differ[end] & (~differ[end] + U(1))
        same = np.where(low == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int32) // 8)
        out[i[end]] = np.minimum(room[end], at + same)
        go = np.ones(len(i), bool)
        go[end] = False
        i, j, room = i[go], j[go], room[go]
    return out


def sparse_suffixes(t: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the places `at` in the order of their first `size` bytes, which are all there, and
    where in that order a new string begins. Digits are sorted from the front; only suffixes that agree
    with another so far go on, and the number of their run leads the next digit."""
    eight = np.ndarray((len(t) + 1,), ">u8", np.concatenate([t, np.zeros(8, np.uint8)]), 0, (1,))
    step = min(8, size)
    digit = eight[at].astype(U) >> U(64 - 8 * step)
    order = np.argsort(digit)
    new = np.ones(len(at), bool)
    new[1:] = digit[order[1:]] != digit[order[:-1]]
    depth = step
    while depth < size:
        live = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(live):
            break
        run = (np.cumsum(new[live]) - 1).astype(U)
        step = min((64 - int(run[-1]).bit_length()) // 8, size - depth)
        digit = eight[at[order[live]] + depth].astype(U) >> U(64 - 8 * step)
        if step < 8:
            digit |= run << U(8 * step)
        by = np.argsort(digit)
        order[live], digit = order[live][by], digit[by]
        new[live] = np.concatenate([[True], digit[1:] != digit[:-1]])
        depth += step
    return order, new


# --- windows of a packed batch -----------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, U(ODD)), np.full(size, U(pow(ODD, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _alike(kind: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names stand together, and where in it a new name begins. The first
    half of a name decides all but what never happens."""
    order = np.argsort(kind)
    for _ in range(2):
        a, b = kind[order], more[order]
        first, second = a[1:] != a[:-1], b[1:] != b[:-1]
        if not (second & ~first).any():
            break
        order = np.lexsort((more, kind))
    return order, np.concatenate([np.ones(min(1, len(order)), bool), first | second])


class Batch:
    """Windows of the texts of one batch. `owner` is the text of each window, `s0`..`s1` the
    strings in it (positions in the joined bytes), `anchor` and `kind`, `more` its names. `first`
    are windows to deal out: one per name from the smallest doc_id of the batch; `twin` is the
    place of each window's own among them."""

    def __init__(self, data: bytes, lengths: np.ndarray, ids: np.ndarray):
        self.data, self.ids = data, ids
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        a = np.frombuffer(data, np.uint8)
        n, w = len(a), LENGTH - K + 1
        empty = np.zeros(0, np.int64)
        self.s0 = self.s1 = self.owner = self.first = self.twin = self.bucket_order = empty
        self.anchor = self.kind = self.more = np.zeros(0, U)
        self.left = self.right = np.zeros(0, np.uint8)
        if n < LENGTH:
            return
        up, down = _powers(1 << max(20, n.bit_length()))
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, U), np.cumsum(TABLE[a] * up[:n])])
            grams = mix((run[K:] - run[:-K]) * down[: n - K + 1], 3)
        bits = U(max(20, n.bit_length()))
        m = len(grams)
        ranked = ((grams >> bits) << bits) | np.arange(m, dtype=U)
        pad = -m % w
        blocks = np.concatenate([ranked, np.full(pad, np.iinfo(np.uint64).max, U)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = n - LENGTH + 1
        least = (np.minimum(back[:strings], ahead[w - 1 : w - 1 + strings]) & ((U(1) << bits) - U(1))).astype(np.int64)
        # strings must not run over the end of their text
        inside = np.zeros(strings + 1, np.int32)
        for s, e in zip(self.starts[:-1], self.starts[1:]):
            if e - s >= LENGTH:
                inside[s] += 1
                inside[min(e - LENGTH + 1, strings)] -= 1
        inside = np.cumsum(inside)[:strings] > 0
        change = np.ones(strings, bool)
        change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(change & inside)
        nxt = np.flatnonzero(change | ~inside)
        self.s0 = starts
        self.s1 = np.append(nxt, strings)[np.searchsorted(nxt, starts, side="right")] - 1
        self.owner = np.searchsorted(self.starts, starts, side="right") - 1
        p = least[starts]
        with np.errstate(over="ignore"):
            self.anchor = grams[p]
            # both halves cover every byte, the length and the anchor's place
            size = self.s1 - starts + LENGTH
            self.kind = mix(lanes(a, starts, size, 9) + (p - starts).astype(U), 10)
            self.more = mix(lanes(a, starts, size, 1 << 20) + (p - starts).astype(U), 11)
        # what the strings that reach far to one side have there; 0 if there are none
        self.left, self.right = np.zeros(len(p), np.uint8), np.zeros(len(p), np.uint8)
        for out, begin, has in ((self.left, p - SIDE, p - starts >= SIDE), (self.right, p + K, p - self.s1 <= LENGTH - K - SIDE)):
            near = lanes(a, begin[has], np.full(int(has.sum()), SIDE), 5)
            out[has] = (near % U(255)).astype(np.uint8) + np.uint8(1)
        # a kind names the anchor's surroundings, so it names the anchor too
        doc = ids[self.owner]
        order, new = _alike(self.kind, self.more)
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        if len(order):
            least_doc = np.minimum.reduceat(doc[order], heads)
            self.first = np.minimum.reduceat(np.where(doc[order] == least_doc[group], order, len(order)), heads)
        self.twin = np.empty(len(order), np.int64)
        self.twin[order] = group

    def dealt(self, buckets: int):
        """(bucket, places in `first`) for each bucket, in a fixed order."""
        b = (self.anchor[self.first] % U(buckets)).astype(np.int64)
        order = np.lexsort((self.first, b))  # in text order, so that documents repeat and pack well
        cuts = np.flatnonzero(np.concatenate([[True], b[order][1:] != b[order][:-1]])) if len(order) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            yield int(b[order[lo]]), order[lo:hi]

    def flags(self, answers: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
        """Answers of the buckets, put back in the order of `first`."""
        got, out = dict(answers), np.zeros(len(self.first), np.uint8)
        for b, places in self.dealt(buckets):
            if b in got:
                out[places] = np.frombuffer(_open(got[b]), np.uint8)
        return out


def _pack(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def packed(docs: DataFrame) -> DataFrame:
    """Texts in batches of about BATCH_BYTES: batch (a name that retries keep), ids, lengths, texts."""

    def run(batches):
        def made(ids, texts):
            name = hashlib.blake2b(digest_size=8)
            for i, t in zip(ids, texts):
                name.update(b"%d:%d:" % (LAST if i is None else i, len(t)) + hashlib.blake2b(t, digest_size=8).digest())
            joined = b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name.digest(), "little", signed=True)]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([_pack(joined)], pa.binary())], ["batch", "ids", "lengths", "texts"])

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                ids.append(i)
                texts.append(t.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)

    return doc_input(docs).mapInArrow(run, "batch long, ids array<long>, lengths array<int>, texts binary")


def _unpack(row: dict) -> tuple[Batch, list]:
    ids = row["ids"]
    return Batch(_open(row["texts"]), np.array(row["lengths"], np.int64), np.array([LAST if i is None else i for i in ids], np.int64)), ids


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ask(buckets: int):
    """Batch to one row per bucket: names and documents of its windows."""

    def run(batches):
        for row in _rows(batches):
            batch, _ = _unpack(row)
            out = {"bucket": [], "names": []}
            for b, places in batch.dealt(buckets):
                w = batch.first[places]
                out["bucket"].append(b)
                out["names"].append(_pack((batch.anchor[w] >> U(32)).astype(np.uint32).tobytes() + batch.kind[w].tobytes() + batch.more[w].tobytes() + batch.left[w].tobytes() + batch.right[w].tobytes() + batch.ids[batch.owner[w]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array([row["batch"]] * len(out["bucket"]), pa.int64()), pa.array(out["names"], pa.binary())], ["bucket", "batch", "names"])

    return run


def _settle(table: pa.Table) -> pa.Table:
    """All windows of a bucket: flag 1, the same window is in a smaller document; flag 2, it
    represents a kind that may share a string with another kind of its anchor."""
    raw = [_open(x.as_py()) for x in table["names"]]
    sizes = [len(x) // 30 for x in raw]
    anchor = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(raw, sizes)])
    kind = np.concatenate([np.frombuffer(x, U, n, 4 * n) for x, n in zip(raw, sizes)])
    more = np.concatenate([np.frombuffer(x, U, n, 12 * n) for x, n in zip(raw, sizes)])
    sides = [np.concatenate([np.frombuffer(x, np.uint8, n, at * n) for x, n in zip(raw, sizes)]) for at in (20, 21)]
    doc = np.concatenate([np.frombuffer(x, np.int64, n, 22 * n) for x, n in zip(raw, sizes)])
    del raw
    if not len(kind):
        return table.select(["batch", "bucket"]).append_column("answer", pa.array([_pack(b"")] * table.num_rows, pa.binary()))
    order, new = _alike(kind, more)
    d = doc[order]
    del more
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    smallest, largest, of = np.minimum.reduceat(d, heads), np.maximum.reduceat(d, heads), anchor[order][heads]
    compare = np.zeros(len(heads), bool)
    for side in sides:
        # kinds that agree with another kind of their anchor on this side, and not all in one document
        key = (of.astype(U) << U(8)) | side[order][heads].astype(U)
        by = np.argsort(key)
        by = by[(key[by] & U(0xFF)) > 0]
        if len(by):
            new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
            starts, which = np.flatnonzero(new), np.cumsum(new) - 1
            several = (np.bincount(which) > 1) & (np.minimum.reduceat(smallest[by], starts) < np.maximum.reduceat(largest[by], starts))
            compare[by] |= several[which]
    flag = np.empty(len(kind), np.uint8)
    flag[order] = np.where(d > smallest[group], 1, np.where(compare[group], 2, 0))
    cuts = np.cumsum([0, *sizes])
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array([_pack(flag[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:])], pa.binary())})


def _send(buckets: int):
    """Batch with first answers to the windows that shards must compare."""

    def run(batches):
        for row in _rows(batches):
            batch, _ = _unpack(row)
            flag = batch.flags([(x["bucket"], x["answer"]) for x in row["answers"] or []], buckets)
            out = {"bucket": [], "windows": []}
            for b, places in batch.dealt(buckets):
                w = batch.first[places[flag[places] == 2]]
                if len(w):
                    text = b"".join(batch.data[s : e + LENGTH] for s, e in zip(batch.s0[w], batch.s1[w]))
                    head = np.array([len(w)], np.int64).tobytes()
                    out["bucket"].append(b)
                    out["windows"].append(_pack(head + batch.ids[batch.owner[w]].tobytes() + (batch.s1[w] - batch.s0[w] + 1).astype(np.uint32).tobytes() + text))
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array([row["batch"]] * len(out["bucket"]), pa.int64()), pa.array(out["windows"], pa.binary())], ["bucket", "batch", "windows"])

    return run


def _shard(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a shard's windows; per window, bits of the strings that are also in a
    smaller document."""
    docs, counts, texts, cuts = [], [], [], [0]
    for x in table["windows"]:
        raw = _open(x.as_py())
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        docs.append(np.frombuffer(raw, np.int64, n, 8))
        counts.append(np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64))
        texts.append(raw[8 + 12 * n :])
        cuts.append(cuts[-1] + int(counts[-1].sum()))
    t = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    doc, count = np.concatenate(docs), np.concatenate(counts)
    begin = np.concatenate([[0], np.cumsum(count + LENGTH - 1)[:-1]])
    # every string's start, in the order in which windows were sent
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    owner = np.repeat(doc, count)
    order, new = sparse_suffixes(t, at, LENGTH)
    smallest = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    least = np.empty(len(at), np.int64)
    least[order] = smallest[np.cumsum(new) - 1]
    gone = least < owner
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array([_pack(np.packbits(gone[lo:hi]).tobytes()) for lo, hi in zip(cuts, cuts[1:])], pa.binary())})


def _finish(buckets: int):
    """Batch with both answers to rows: doc_id, n_bytes, spans (starts and ends of removed runs), kept bytes."""

    def run(batches):
        for row in _rows(batches):
            batch, ids = _unpack(row)
            flag = batch.flags([(x["bucket"], x["answer"]) for x in row["answers"] or []], buckets)
            shard = {x["bucket"]: _open(x["answer"]) for x in row["shards"] or []}
            doc = batch.ids[batch.owner]
            lead = batch.first[batch.twin] if len(batch.first) else batch.first
            starts_gone = np.zeros(len(batch.data) + 1, np.int32)
            whole = np.flatnonzero((flag[batch.twin] == 1) | (doc > doc[lead])) if len(lead) else lead
            np.add.at(starts_gone, batch.s0[whole], 1)
            np.add.at(starts_gone, batch.s1[whole] + LENGTH, -1)
            bits_of = {}
            for b, places in batch.dealt(buckets):
                sent = places[flag[places] == 2]
                if len(sent):
                    size = batch.s1[batch.first[sent]] - batch.s0[batch.first[sent]] + 1
                    bits = np.unpackbits(np.frombuffer(shard[b], np.uint8), count=int(size.sum()))
                    for place, part in zip(sent, np.split(bits, np.cumsum(size)[:-1])):
                        if part.any():
                            bits_of[int(place)] = np.flatnonzero(part)
            if bits_of:
                part = np.zeros(len(batch.first), bool)
                part[list(bits_of)] = True
                for w in np.flatnonzero(part[batch.twin] & (doc == doc[lead])):
                    s = batch.s0[w] + bits_of[int(batch.twin[w])]
                    np.add.at(starts_gone, s, 1)
                    np.add.at(starts_gone, s + LENGTH, -1)
            removed = np.cumsum(starts_gone)[:-1] > 0
            a = np.frombuffer(batch.data, np.uint8)
            out = {"n_bytes": [], "begins": [], "ends": [], "kept": []}
            for s, e in zip(batch.starts[:-1], batch.starts[1:]):
                r = removed[s:e]
                edge = np.flatnonzero(np.diff(r.astype(np.int8), prepend=0, append=0))
                out["n_bytes"].append(int(e - s))
                out["begins"].append(edge[0::2])
                out["ends"].append(edge[1::2])
                out["kept"].append(a[s:e][~r].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["begins"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64())), pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "begins", "ends", "kept"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, begins and ends of the removed runs, and the remaining bytes."""
    table = written(packed(docs), "packed")
    size = table.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(8, -(-size // BUCKET_BYTES) * 2)
    answer = "batch long, bucket int, answer binary"
    names = table.mapInArrow(_ask(buckets), "bucket int, batch long, names binary")
    # a task per bucket: else Spark joins small partitions to as many tasks as there are cores, and the
    # longest of them is waited for
    first = written(names.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(lambda t: _settle(t), answer), "answers")
    listed = lambda df, name: df.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    asked = table.join(listed(first, "answers"), "batch", "left")
    sent = asked.mapInArrow(_send(buckets), "bucket int, batch long, windows binary")
    second = written(sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(lambda t: _shard(t), answer), "shards")
    replies = listed(first, "answers").join(listed(second, "shards"), "batch", "full")
    return table.join(replies, "batch", "left").mapInArrow(_finish(buckets), "doc_id long, n_bytes long, begins array<long>, ends array<long>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_repeats(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256) with a dictionary of strings; for tests."""
    first: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in texts.items()}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], d)
    out = {}
    for d, x in data.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


OP8_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM b)),
f AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x),
hit AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.x = f.x WHERE s.doc_id > f.least),
j AS (SELECT doc_id, unnest(range(0, n)) AS j FROM b),
y AS (SELECT j.doc_id, j.j, max(hit.i) OVER (PARTITION BY j.doc_id ORDER BY j.j) AS last FROM j LEFT JOIN hit ON hit.doc_id = j.doc_id AND hit.i = j.j),
z AS (SELECT doc_id, j, coalesce(j - last < 50, false) AS gone FROM y),
t AS (SELECT doc_id, j, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM z),
k AS (
  SELECT t.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
         coalesce(string_agg(substring(b.h, 2 * j + 1, 2), '' ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM t JOIN b ON b.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM b LEFT JOIN k ON k.doc_id = b.doc_id
"""
