"""Toxicity scores from a learned lexicon matched with Levenshtein automata.

Learning: a bounded sample of labelled rows (TRAIN_ROWS, the smallest by md5 of doc_id, near
copies left out) gives document counts of terms and word stems per class; terms far likelier under label 1 form a trie.
Matching: a word hits exactly, by stem, or within one edit of a learned word of SHORTEST letters or
more or of a learned stem, found by running the word's Levenshtein automaton along the tries. Context: within a window around each hit, quotation marks
and reporting words speak for quoting, address for abuse; hits count as abuse or as quotation.
Score: logistic regression over the hit counts, its weights drawn to priors in which quoted hits
weigh little. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have no hits and get the score of a text without any; null
labels are ignored, of several labels of one doc_id the largest holds; rows with a null doc_id are
scored, held_out false; repeated rows give repeated rows; without any label 1 or 0 to learn from,
every score is the rate of label 1 (0.0 if there is no label); other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_input, documents, map_texts, texts_of, written
from .fuse import mix
from .minhash import shingle_sets

TRAIN_ROWS = 20_000
MAX_LEXICON = 2_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")
STEMS = range(4, 9)
SHORTEST = 4
CACHED = 100_000
WINDOW = 80
LEET = str.maketrans("013457", "oieast")
QUOTES = "\"“”„«»"
REPORT = re.compile(r"\b(said|says|wrote|writes|quoted?|called|according|reported|sagte|schrieb|dit|dijo|escribi\w+)\b")
ADDRESS = re.compile(r"\b(you|your|you're|du|dich|ihr|tu|toi|vous|usted)\b")


class LevenshteinAutomaton:
    """States are edit distances to each prefix of `word`, capped at one above `edits`; a state
    whose least distance is above `edits` is dead."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...] | None:
        cap = self.edits + 1
        row = [min(state[0] + 1, cap)]
        for i, c in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (c != char), cap))
        return tuple(row) if min(row) <= self.edits else None


class Lexicon:
    """Words and stems with weights, each also as a trie for approximate matching. A stem stands for
    every word that it, or anything within the edit bound of it, begins."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], edits: int = 1):
        self.words, self.stems, self.edits = words, stems, edits
        self.trie = _trie(w for w in words if len(w) >= SHORTEST)
        self.stem_trie = _trie(stems)
        # a term and a word within one edit are equal after at most one letter is taken from each
        self.less = {v for w in words if len(w) >= SHORTEST for v in _shorter(w)}
        self.stem_less = [(n, {v for s in stems if len(s) == n for v in _shorter(s)}) for n in sorted({len(s) for s in stems})]
        # one edit leaves the front or the back half of a term as it is: per length of a word, the
        # places in it to look at and the halves that may stand there
        always: dict[tuple[int, int], set[str]] = {}
        for s in stems:
            h = len(s) // 2
            always.setdefault((0, h), set()).add(s[:h])
            for o in (h - 1, h, h + 1):
                always.setdefault((o, o + len(s) - h), set()).add(s[h:])
        self.always = [(a, b, have) for (a, b), have in always.items()]
        halves: dict[int, dict[tuple[int, int], set[str]]] = {}
        for w in words:
            h = len(w) // 2
            for n in (len(w) - 1, len(w), len(w) + 1) if len(w) >= SHORTEST else (len(w),):
                at = halves.setdefault(n, {k: set(v) for k, v in always.items()})
                at.setdefault((0, h), set()).add(w[:h])
                at.setdefault((n - len(w) + h, n), set()).add(w[h:])
        self.halves = {n: [(a, b, have) for (a, b), have in at.items()] for n, at in halves.items()}
        self.cache: dict[str, tuple[str, float]] = {}
        self.others: set[str] = set()

    def near(self, word: str) -> str | None:
        """The heaviest lexicon word within the edit bound: automaton and trie walked together."""
        return self._walk(self.trie, self.words, word, lambda state: state[-1])

    def near_stem(self, word: str) -> str | None:
        """The heaviest stem within the edit bound of a prefix of the word."""
        return self._walk(self.stem_trie, self.stems, word[: STEMS.stop + self.edits], min)

    def _walk(self, trie: dict, weights: dict[str, float], word: str, distance) -> str | None:
        auto = LevenshteinAutomaton(word, self.edits)
        stack, best = [(trie, auto.start())], None
        while stack:
            node, state = stack.pop()
            if "" in node and distance(state) <= self.edits:
                if best is None or (weights[node[""]], node[""]) > (weights[best], best):
                    best = node[""]
            for c, child in node.items():
                if c and (moved := auto.step(state, c)):
                    stack.append((child, moved))
        return best

    def _possible(self, word: str) -> bool:
        for a, b, have in self.halves.get(len(word), self.always):
            if word[a:b] in have:
                return True
        return False

    def _find(self, word: str) -> tuple[str, float] | None:
        for n in STEMS:
            if word[:n] in self.stems:
                return "stem", self.stems[word[:n]]
        if word in self.words:
            return "exact", self.words[word]
        if not self.less.isdisjoint(_shorter(word)) and (found := self.near(word)):
            return "near" if len(found) > SHORTEST else "loose", self.words[found]
        for n, less in self.stem_less:
            # the prefix that is within one edit of a stem of n letters has n - 1 to n + 1
            if not less.isdisjoint(v for k in (n - 1, n, n + 1) if k <= len(word) for v in _shorter(word[:k])) and (found := self.near_stem(word)):
                return "loose", self.stems[found]
        return None

    def match(self, word: str) -> tuple[str, float] | None:
        """(stem | exact | near | loose, weight) of a lower-case word; loose hits are one edit from a
        stem or from a word of SHORTEST letters, where many ordinary words are."""
        if word in self.others:
            return None
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) + len(self.others) > CACHED:
            self.cache.clear()
            self.others.clear()
        found = self._find(word) if self._possible(word) else None
        if found:
            self.cache[word] = found
        else:
            self.others.add(word)
        return found


def _trie(terms) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term
    return root


def _shorter(word: str) -> list[str]:
    """The word, and the word without each of its letters."""
    return [word, *[word[:i] + word[i + 1 :] for i in range(len(word))]]


def hits(lexicon: Lexicon, text: str) -> tuple[list[tuple[int, int, str, float, bool]], int]:
    """(start, end, how, weight, quoted) of every hit in a text, and its number of words."""
    low = text.lower()
    words = WORD.findall(low)
    found, distinct = {}, set(words)
    for w in distinct - lexicon.others:
        if m := lexicon.match(w):
            found[w] = m
    for w in [w for w in distinct if not w.isalpha()]:
        if w not in found and (m := lexicon.match(w.translate(LEET))):
            found[w] = m
    out = []
    for w, (how, weight) in found.items():
        start = low.find(w)
        while start >= 0:
            end = start + len(w)
            if not low[max(0, start - 1) : start].isalnum() and not low[end : end + 1].isalnum():
                out.append((start, end, how, weight, _quoted(low, start, end)))
            start = low.find(w, start + 1)
    out.sort()
    return out, len(words)


def _quoted(low: str, start: int, end: int) -> bool:
    before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
    before, after = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    marks = sum(before.count(q) for q in QUOTES) % 2 and any(q in after for q in QUOTES)
    score = 2 * bool(marks) + bool(REPORT.search(before)) - bool(ADDRESS.search(before) or ADDRESS.search(after))
    return score >= 2


FEATURES = ("abuse_exact", "abuse_near", "abuse_stem", "abuse_loose", "quoted", "weight", "density", "any")
#: weights the fit is drawn to, in the order of FEATURES
PRIOR = np.array([1.0, 0.5, 0.5, 0.25, 0.1, 0.2, 0.2, 0.5])


def features(lexicon: Lexicon, text: str) -> list[float]:
    found, n = hits(lexicon, text)
    count = Counter((how, quoted) for _, _, how, _, quoted in found)
    # loose hits speak by their own count alone
    close = [h for h in found if h[2] != "loose"]
    abuse = [h for h in close if not h[4]]
    return [
        math.log1p(count["exact", False]),
        math.log1p(count["near", False]),
        math.log1p(count["stem", False]),
        math.log1p(count["loose", False]),
        math.log1p(len(close) - len(abuse)),
        max((h[3] for h in abuse), default=0.0),
        math.sqrt(min(1.0, len(abuse) / max(n, 1))),
        float(bool(abuse)),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    rate: float = 0.0
    trained: bool = field(default=True)

    def score(self, rows: list[list[float]]) -> list[float]:
        if not self.trained:
            return [self.rate] * len(rows)
        z = np.asarray(rows, float).reshape(len(rows), len(FEATURES)) @ self.weights + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised likelihood; the penalty pulls to `prior`, bias free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    mean, pull = np.append(prior, np.log(rate / (1 - rate))), np.append(np.full(x.shape[1] - 1, ridge), 1e-2)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - mean) ** 2).sum() / 2)

    w = mean.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + pull * (w - mean)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        size = 1.0
        while loss(w - size * move) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * move
        if size * np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _distinct(sample: DataFrame) -> DataFrame:
    """Without near copies, whose chance words would look like signs of their label: of rows that
    share one of four min-hashes of five-word shingles, the first by md5 of doc_id stays. The
    sample is bounded, so its hashes go to the driver."""

    def hashes(batches):
        for b in batches:
            got = []
            for _, sets in shingle_sets(texts_of(b), 5):
                got += [[int(mix(s, i).min()) >> 1 if len(s) else 0 for i in (21, 22, 23, 24)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "h"])

    rows = sample.select("doc_id", "text").mapInArrow(hashes, "doc_id long, h array<long>").collect()
    seen: set[tuple[int, int]] = set()
    keep = set()
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
        keys = set(enumerate(r["h"]))
        if not keys & seen:
            keep.add(r["doc_id"])
        seen |= keys
    ids = sample.sparkSession.createDataFrame([(i,) for i in sorted(keep)], "doc_id long")
    return written(sample.join(F.broadcast(ids), "doc_id", "left_semi"), "toxic-distinct")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _terms(batches):
    """Document counts by class of words and stems, combined per task."""
    counts: dict[tuple[str, bool], list[int]] = {}

    def flush():
        keys = list(counts)
        table = pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], ["term", "stem", "neg", "pos"])
        counts.clear()
        return table

    for b in batches:
        for text, toxic in zip(texts_of(b), b.column("toxic").to_pylist()):
            words = set(WORD.findall(text.lower()))
            terms = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}
            for key in terms:
                counts.setdefault(key, [0, 0])[toxic] += 1
        if len(counts) > 100_000:
            yield flush()
    yield flush()


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most `train_rows` labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    sample = _distinct(written(doc_input(docs).join(F.broadcast(known), "doc_id"), "toxic-sample"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    neg, pos = size.get(0, 0), size.get(1, 0)
    rate = pos / max(1, neg + pos)
    if not neg or not pos:
        return Model(Lexicon({}, {}), np.zeros(len(FEATURES)), 0.0, rate, False)

    terms = sample.select("text", "toxic").mapInArrow(_terms, "term string, stem boolean, neg long, pos long")
    terms = terms.groupBy("term", "stem").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    # twice the log-likelihood ratio against the overall rate
    ratio = 2 * (F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0))
    strong = terms.withColumn("odds", odds).withColumn("ratio", ratio).where((F.col("odds") > 1.8) & (F.col("ratio") > 30) & (F.col("pos") >= max(4, pos // 100)))
    top = strong.orderBy(F.desc("ratio"), "term").limit(MAX_LEXICON).collect()
    stems: dict[str, float] = {}
    whole = {r["term"]: r["odds"] for r in top if not r["stem"]}
    for r in sorted((r for r in top if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        if not any(r["term"][:k] in stems for k in STEMS if k < len(r["term"])):
            stems[r["term"]] = r["odds"]
    # a stem that one strong word makes up alone adds nothing to it; other stems stand for theirs
    alone = {s for s in stems for x in whole if x.startswith(s) and sum(y.startswith(s) for y in whole) == 1}
    stems = {s: w for s, w in stems.items() if s not in alone}
    lexicon = Lexicon(whole, stems)

    def measure(batches):
        for b in batches:
            rows = [features(lexicon, t) for t in texts_of(b)]
            yield pa.record_batch([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    got = sample.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    weights, bias = fit_logistic(x, y, PRIOR)
    # approximate hits never speak against abuse
    close, against = np.isin(FEATURES, ("abuse_near", "abuse_loose")), np.zeros(len(weights), bool)
    while (more := (weights < 0) & ~against & close).any():
        against |= more
        x[:, against] = 0
        weights, bias = fit_logistic(x, y, PRIOR)
    weights[against] = 0
    return Model(lexicon, weights, bias, rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def kernel(ids, texts):
        rows = [features(model.lexicon, t) for t in texts]
        return {"doc_id": ids, "score": model.score(rows)}

    return map_texts(docs, kernel, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` scored below the threshold, columns as they came. The model reads each
    row's text beside its other columns, so no join is needed."""
    model = train(docs, labels)
    names = docs.columns
    at = names.index("text")

    def keep(batches):
        for b in batches:
            s = model.score([features(model.lexicon, t) for t in [x or "" for x in b.column(at).to_pylist()]])
            yield b.filter(pa.array([x < THRESHOLD for x in s], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
