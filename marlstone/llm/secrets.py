"""Secret scans: fixed formats plus formats learned as probabilistic automata.

Base spans: assignments, access keys and long hex strings. Their values are labelled credentials.
From a bounded sample of them (SAMPLE per kind, the smallest by md5) a prefix tree is built over
character classes, and its states are merged whenever they are statistically compatible: in how often
they stop, in every next symbol, in the lengths that are left to come, and so are their successors.
Labelled values that its automaton cannot make teach another one, and so on until each value of at most
LONGEST characters is made by one; an automaton weighs as many values as it makes of those left to it.
States of one depth are merged first, which pools what the sample tells about a place of the format;
states of different depths only if there is enough evidence to tell them apart, and it does not. So a
format of fixed length or with a fixed beginning keeps its states, and one of any length gets loops.

Ordinary text is a chain of symbols, counted over every run of all documents. Every run of MIN_TOKEN
or more characters outside base spans, and its parts between = / and . , is scored. It is added with
kind `format` if, given the numbers of labelled values and of runs, some automaton is likelier than
ordinary text, and if it is as likely and as varied as all but a twentieth of the automaton's values.

The first pass leaves base values and counts of symbols, a few rows per batch; the second scores.

Defined cases: a null or empty text has no spans; null doc_ids stay; repeated rows give repeated
rows; without base spans in the table no automaton is learned and nothing is added; an empty table
gives an empty result; other columns are never read. Positions count code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_input, documents, map_texts, texts_of, written

KINDS = ("assign", "access", "hex")
SAMPLE = 5_000
LONGEST = 256  # longer values teach no format
ALPHA = 0.01
MIN_TOKEN = 8  # the least length of a labelled value
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PART = re.compile(r"[^=/.]+")
CLASSES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
SYMBOLS = "dhlU+/_.=-"
CACHED = 200_000


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), ordered by start, then kind as listed."""
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs outside base spans."""
    if not base:
        return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e, _ in base)]


def shape(value: str) -> str:
    """Character classes: digits, the letters of hexadecimal numbers, other small letters, capitals;
    signs stand for themselves. The automata are about formats, not values."""
    return value.translate(CLASSES)


class Automaton:
    """A probabilistic deterministic automaton: per state its stop count and, per symbol, the
    count and the next state."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.stop, self.next, self.count = [0], [{}], [{}]
        self._left: list[dict[int, int]] = [{}]
        self.size, self.longest = len(values), max(map(len, values), default=0)
        for v in values:
            at = 0
            for n, s in enumerate(shape(v)):
                self._left[at][len(v) - n] = self._left[at].get(len(v) - n, 0) + 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.stop)
                    self.stop.append(0)
                    self.next.append({})
                    self.count.append({})
                    self._left.append({})
                self.count[at][s] = self.count[at].get(s, 0) + 1
                at = self.next[at][s]
            self.stop[at] += 1
            self._left[at][0] = self._left[at].get(0, 0) + 1
        self._spread = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        own = sorted(self.score(v) for v in values)
        self.floor = own[len(own) // 20] if own else math.inf
        varied = sorted(map(bits, values))
        self.bits = varied[len(varied) // 20] if varied else math.inf

    def _seen(self, q: int) -> int:
        return self.stop[q] + sum(self.count[q].values())

    def _compatible(self, a: int, b: int, same_depth: bool) -> bool:
        """Hoeffding bounds on every frequency; states of different depths need evidence."""
        todo, first = [(a, b)], True
        while todo:
            p, q = todo.pop()
            n, m = self._seen(p), self._seen(q)
            if not n or not m:
                continue
            bound = self._spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:  # nothing could tell them apart
                if first and not same_depth:
                    return False
                continue
            if first and not same_depth and bound > 0.5:
                return False
            first = False
            if abs(self.stop[p] / n - self.stop[q] / m) > bound:
                return False
            x = y = 0.0
            for length in sorted(self._left[p].keys() | self._left[q].keys()):
                x += self._left[p].get(length, 0) / n
                y += self._left[q].get(length, 0) / m
                if abs(x - y) > bound:
                    return False
            for s in self.next[p].keys() | self.next[q].keys():
                if abs(self.count[p].get(s, 0) / n - self.count[q].get(s, 0) / m) > bound:
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below `b` to state `a`."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.stop[p] += self.stop[q]
            for length, n in self._left[q].items():
                self._left[p][length] = self._left[p].get(length, 0) + n
            for s, child in self.next[q].items():
                self.count[p][s] = self.count[p].get(s, 0) + self.count[q][s]
                if s in self.next[p]:
                    todo.append((self.next[p][s], child))
                else:
                    self.next[p][s] = child

    def _merge(self) -> None:
        """Settled states grow from the root, level by level; each frontier state merges into the
        first settled state it is compatible with, those of its depth first, or is settled itself."""
        depth = {0: 0}
        frontier = deque((0, s) for s in sorted(self.next[0]))
        while frontier:
            parent, s = frontier.popleft()
            q = self.next[parent][s]
            if q in depth:
                continue
            d = depth[parent] + 1
            for p in sorted(depth, key=lambda p: (depth[p] != d, p)):
                if self._compatible(p, q, depth[p] == d):
                    self.next[parent][s] = p
                    self._fold(p, q)
                    break
            else:
                p, depth[q] = q, d
            frontier.extend((p, t) for t in sorted(self.next[p]) if self.next[p][t] not in depth)
        keep = {q: i for i, q in enumerate(depth)}
        self.stop = [self.stop[q] for q in depth]
        self.count = [self.count[q] for q in depth]
        self.next = [{s: keep[t] for s, t in self.next[q].items()} for q in depth]
        self._left = []

    def total(self, value: str) -> float:
        """Log-likelihood, the stop included; an unseen symbol makes it impossible."""
        at, total = 0, 0.0
        for s in shape(value):
            n = self.count[at].get(s, 0)
            if not n:
                return -math.inf
            total += math.log(n / self._seen(at))
            at = self.next[at][s]
        if not self.stop[at]:
            return -math.inf
        return total + math.log(self.stop[at] / self._seen(at))

    def score(self, value: str) -> float:
        """Mean log-likelihood per symbol."""
        return self.total(value) / (len(value) + 1)


class Model:
    """Automata by kind, and the chain of ordinary text: `grams` counts pairs of symbols, ^ before
    the first and $ after the last."""

    def __init__(self, automata: dict[str, Automaton], grams: dict[str, int]):
        self.automata = automata
        after = Counter()
        for g, n in grams.items():
            after[g[0]] += n
        kinds = len(SYMBOLS) + 1
        self.chain = {a + b: math.log((grams.get(a + b, 0) + 1) / (after[a] + kinds)) for a in "^" + SYMBOLS for b in SYMBOLS + "$"}
        self.runs = after["^"]
        self.longest = max((a.longest for a in automata.values()), default=0)
        self.cache: dict[str, tuple] = {}

    def ordinary(self, value: str) -> float:
        s = f"^{shape(value)}$"
        return sum(self.chain[s[i : i + 2]] for i in range(len(s) - 1))

    def likely(self, value: str) -> bool:
        for a in self.automata.values():
            total = a.total(value)
            if total > -math.inf and total / (len(value) + 1) >= a.floor and total + math.log(a.size) > self.ordinary(value) + math.log(self.runs + 1) and bits(value) >= a.bits:
                return True
        return False

    def credentials(self, start: int, value: str) -> list[tuple[int, int, str]]:
        """(start, end, value) of the credentials in a run: the run itself, or what stands between any
        two of its signs = / . , the longest first; only the run itself may be longer than every
        labelled value."""
        if not self.automata:
            return []
        if value not in self.cache:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[value] = tuple(self._within(value))
        return [(start + s, start + e, value[s:e]) for s, e in self.cache[value]]

    def _within(self, value: str) -> list[tuple[int, int]]:
        if self.likely(value):
            return [(0, len(value))]
        parts = [m.span() for m in PART.finditer(value)]
        spans = set()
        for i, (s, _) in enumerate(parts):
            for _, e in parts[i:]:
                if e - s > self.longest:
                    break
                if e - s >= MIN_TOKEN and e - s < len(value):
                    spans.add((s, e))
        out: list[tuple[int, int]] = []
        for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x)):
            if not any(x < e and s < y for x, y in out) and self.likely(value[s:e]):
                out.append((s, e))
        return sorted(out)


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
LEARNED = "kind string, value string, n long"


def observed(docs: DataFrame) -> DataFrame:
    """(kind, value, n): base values with their kind, and pairs of symbols of the runs outside base
    spans with kind null, summed per batch."""

    def run(batches):
        for b in batches:
            values: Counter = Counter()
            shapes: Counter = Counter()
            for t in texts_of(b):
                base = base_spans(t)
                values.update((k, v) for k, _, _, v in base)
                shapes.update(shape(v) for _, _, v in candidates(t, base))
            for s, n in shapes.items():
                for x, y in zip(f"^{s}", f"{s}$"):
                    values[None, x + y] += n
            rows = list(values)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array([values[r] for r in rows], pa.int64())], ["kind", "value", "n"])

    return doc_input(docs).mapInArrow(run, LEARNED)


def told_apart(values: DataFrame, automaton: Automaton) -> DataFrame:
    """(value, fits): whether the automaton can make the value."""

    def run(batches):
        for b in batches:
            fits = [automaton.total(v) > -math.inf for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(fits, pa.bool_())], ["value", "fits"])

    return values.select("value").mapInArrow(run, "value string, fits boolean")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Automata by kind and round, each from at most `sample` distinct values: those that no automaton
    of the kind can make teach the next one, until none is left. The chain from all runs."""
    seen = written(observed(docs), "secrets").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    seen = written(seen, "secret-values")
    grams = {r["value"]: r["n"] for r in seen.where("kind is null").collect()}  # at most 121 pairs
    out = {}
    for kind in KINDS:
        rest, turn = seen.where((F.col("kind") == kind) & (F.length("value") <= LONGEST)).select("value"), 0
        # an automaton makes the values it learned from, so every round leaves fewer
        while rows := rest.orderBy(F.md5("value"), "value").limit(sample).collect():
            a = out[f"{kind} {turn}"] = Automaton([r["value"] for r in rows])
            if len(rows) < sample:
                break
            told = written(told_apart(rest, a), "secret-told")
            own = told.where("fits").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("longest")).first()
            a.size, a.longest = own["n"], own["longest"]
            rest, turn = told.where("not fits"), turn + 1
    return Model(out, grams)


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end, value), each ordered by start."""
    model = learn(docs, sample)

    def kernel(ids, texts):
        base = [base_spans(t) for t in texts]
        added = [[("format", *c) for s, _, v in candidates(t, b) for c in model.credentials(s, v)] for t, b in zip(texts, base)]
        told = lambda rows: [[dict(zip(("kind", "start", "end", "value"), x)) for x in r] for r in rows]
        return {"doc_id": ids, "base": told(base), "added": told(added)}

    return map_texts(docs, kernel, f"doc_id long, base {SPAN}, added {SPAN}")


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text) with every span, base or added, replaced by [KIND]."""
    model = learn(docs, sample)

    def kernel(ids, texts):
        out = []
        for t in texts:
            base = base_spans(t)
            spans = [(s, e, k) for k, s, e, _ in base] + [(s, e, "format") for s0, _, v0 in candidates(t, base) for s, e, _ in model.credentials(s0, v0)]
            made, at = [], 0
            for s, e, k in sorted(spans):
                if e > at:
                    made += [t[at : max(s, at)], f"[{k.upper()}]"]
                    at = e
            out.append("".join(made) + t[at:])
        return {"doc_id": ids, "text": out}

    return map_texts(docs, kernel, "doc_id long, text string")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    rank = {k: i for i, k in enumerate((*KINDS, "format"))}
    order = F.create_map(*[F.lit(x) for p in rank.items() for x in p])
    ranked = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(ranked).alias("spans"))


def brute_base(text: str | None) -> tuple[dict[str, int], str]:
    """The contract's patterns taken literally, for tests: counts and digest."""
    plain = {
        "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    spans = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(plain.items()) for m in re.finditer(p, text or "") if ok(m)]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return dict(Counter(k for *_, k in spans)), hashlib.sha256(joined.encode()).hexdigest()
