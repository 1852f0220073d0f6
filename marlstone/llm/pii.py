"""Personal data: fixed formats, and terms that disclose them, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Information-
theoretic sanitisation then asks how much a term in a document with a protected entity tells about
it. Over the whole corpus of N documents, n(e) counts those with entity e (a base span's text), n(t)
those with term t, and n(t, e) those with both. A term is a word of four letters or more. Its
information about the entity, with PRIOR documents added that have the term and not the entity, so
that few documents prove little, is held against the entity's own:

    log(n(t, e) N / ((n(t) + PRIOR) n(e))) >= log(N / n(e)) / ALPHA

Disclosing terms are added with kind `term` wherever they stand, in documents without the entity too,
and generalised to [TERM] in the sanitised text. A term that all but stands with one entity alone
discloses it once the corpus is large enough to make that remarkable (2,048 documents for a single
one); a term seen as often elsewhere never does.

Positions come from pieces: `split` gives the text between matches, `regexp_extract_all` the
matches, and running lengths their places, in code points. The patterns are written so that they
match where the plain ones do and run in linear time: a run of characters that cannot start a
match at its first place cannot start one later in it.

Defined cases: a null or empty text has no spans; null doc_ids stay; repeated rows give repeated
rows; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_input, documents, join_groups, written

KINDS = ("email", "ip", "card", "phone")
ALPHA = 1.1
PRIOR = 1
MAX_BROADCAST_TERMS = 50_000
MAX_BROADCAST_BYTES = 32 << 20
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}]{4,}+"


def places(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>> of the matches, or of those that `keep` holds for, left to
    right."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(h.alias("value"), F.length(g).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        end = start + F.length(x.value)
        more = F.concat(acc.out, F.array(F.struct(start.alias("start"), end.alias("end"), x.value.alias("value"))))
        return F.struct(end.alias("at"), (more if keep is None else F.when(keep(x.value), more).otherwise(acc.out)).alias("out"))

    return F.aggregate(F.filter(pairs, lambda p: p.value.isNotNull()), begin, step, lambda acc: acc.out)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right doubled, the digit sums adding to a multiple of ten."""
    ds = F.split(F.reverse(digits(value)), "(?<=.)(?=.)")
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    n = F.length(digits(s.value))
    if kind == "ip":
        parts = F.split(s.value, r"\.")
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 9).cast("int") <= 255)
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(s.value)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _kept(text: Column, rank: int, kind: str) -> Column:
    good = F.filter(places(text, PATTERN[kind]), lambda s: valid(kind, s))
    return F.transform(good, lambda s: F.struct(F.lit(rank).alias("rank"), s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind"), s.value.alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<rank, start, end, kind, value>> ordered by kind as listed, then start."""
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string,value:string>>")
    may = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(PATTERN["ip"])), "card": F.rlike(text, F.lit(PATTERN["card"])), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(F.when(may[kind], _kept(text, rank, kind)).otherwise(none))
    return F.concat(*parts)


def row_id() -> list[Column]:
    """128 bits over a row's doc_id and text: rows that share them are the same."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("2"), "text", "doc_id").alias("r2")]


def _texts(docs: DataFrame) -> DataFrame:
    return doc_input(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (identity of a row), base, and for rows with base spans the terms of their
    text: one pass over the texts."""
    found = _texts(docs).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return found.select("doc_id", *row_id(), "base", F.when(F.size("base") > 0, _terms(F.col("text"))).alias("terms"))


def _terms(text: Column) -> Column:
    """Distinct words outside e-mail addresses, which alone of base spans hold letters."""
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, PATTERN["email"], " "), F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def disclosing(docs: DataFrame, found: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """(entity, term, outside) above the disclosure threshold; outside: the term also stands in
    documents without any base span. All counts cover all documents."""
    total = found.count()
    held = found.where(F.size("base") > 0).select("terms", F.array_distinct(F.transform("base", lambda s: s.value)).alias("entities"))
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    entities = written(entities, "entities")
    # each document once per term: with the first of its entities
    pairs = held.select("terms", F.posexplode("entities").alias("nth", "entity")).select("entity", (F.col("nth") == 0).cast("long").alias("one"), F.explode("terms").alias("term"))
    pairs = written(pairs.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te"), F.sum("one").alias("one")), "term-pairs")
    n_pairs = pairs.count()
    near = written(pairs.groupBy("term").agg(F.sum("one").alias("n_near"), F.count(F.lit(1)).alias("rows")), "near")
    entities = written(entities.join(pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("with_terms")), "entity"), "entities")

    def told(n_t: str) -> Column:
        return F.log(F.col("n_te") * F.lit(float(total)) / ((F.col(n_t) + prior) * F.col("n_e")))

    # a term stands in all documents at least as often as in those with entities, and with an entity
    # at most as often as the entity: pairs that miss the threshold even so are settled first
    most = entities.agg(F.max("n_e")).first()[0] or 0
    least = F.lit(float(most)) / (F.col("n_near") + prior) >= F.pow(F.lit(1 / max(total, 1)), F.lit(1 - 1 / alpha)) - 1e-9
    own = F.log(F.lit(float(total)) / F.col("n_e"))
    # frequent terms and entities have many pairs: those never meet in one task
    pairs = join_groups(pairs.drop("one"), near, "term", "rows", n_pairs).where(least).drop("rows")
    pairs = join_groups(pairs, entities, "entity", "with_terms", n_pairs)
    pairs = written(pairs.where(told("n_near") >= own / alpha - 1e-9), "near-pairs")
    terms = written(pairs.select("term").distinct(), "near-terms")
    every = doc_input(docs).select(F.explode(_terms(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    if terms.count() <= MAX_BROADCAST_TERMS:
        counts = every.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:
        counts = every.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term", "left_semi")
    pairs = pairs.join(counts, "term").where((told("n_t") >= own / alpha) & (told("n_t") > 0))
    return pairs.select("entity", "term", (F.col("n_t") > F.col("n_near")).alias("outside"))


def marked(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """r1, r2, added: every place of a term outside base spans, in whatever document. Terms that
    stand in documents with base spans alone are looked up in those."""
    inside = found.where(F.size("base") > 0).select("r1", "r2", F.explode("terms").alias("term"))
    held = inside.join(terms.select("term"), "term", "left_semi")
    others = written(terms.where("outside").select("term"), "outside")
    n_others = others.count()
    if n_others:
        words = _texts(docs).select(*row_id(), F.explode(_terms(F.col("text"))).alias("term"))
        held = held.unionByName(words.join(F.broadcast(others) if n_others <= MAX_BROADCAST_TERMS else others, "term", "left_semi"))
    held = held.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("term")).alias("held"))
    # base spans are read, not found again: in the test of every place they would be found for each
    held = written(held.join(found.select("r1", "r2", "base").dropDuplicates(["r1", "r2"]), ["r1", "r2"]), "held")
    size = held.agg(F.sum(F.length(F.array_join("held", "|")) + 64 * (1 + F.size("base")))).first()[0] or 0
    rows = _texts(docs).select("text", *row_id()).join(F.broadcast(held) if size <= MAX_BROADCAST_BYTES else held, ["r1", "r2"])
    places_of = places(F.col("text"), WORD, lambda w: F.array_contains("held", F.lower(w)))
    made = rows.select("r1", "r2", "base", places_of.alias("places"))
    free = F.filter("places", lambda w: ~F.exists("base", lambda b: (w.start < b.end) & (b.start < w.end)))
    spans = F.transform(free, lambda w: F.struct(F.lit(len(KINDS)).alias("rank"), w.start.alias("start"), w.end.alias("end"), F.lit("term").alias("kind")))
    return made.select("r1", "r2", spans.alias("added")).groupBy("r1", "r2").agg(F.first("added").alias("added"))


def find(docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """doc_id, r1, r2, base, spans: array<struct<rank, start, end, kind>> by kind as listed, then
    start; added spans have kind `term`, the last."""
    found = written(scan(docs), "pii")
    pairs = written(disclosing(docs, found, alpha, prior), "disclosing")
    terms = written(pairs.groupBy("term").agg(F.max("outside").alias("outside")), "terms")
    added = marked(docs, found, terms)
    base = F.transform("base", lambda s: F.struct(s["rank"].alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    rows = found.select("doc_id", "r1", "r2", base.alias("base")).join(added, ["r1", "r2"], "left")
    return rows.select("doc_id", "r1", "r2", "base", F.concat("base", F.coalesce("added", none)).alias("spans"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """(doc_id, text): every span replaced by its kind, overlapping spans by the first's."""
    spans = find(docs, alpha, prior).groupBy("r1", "r2").agg(F.first("spans").alias("spans"))
    texts = _texts(docs).select("doc_id", "text", *row_id())
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, new).otherwise(acc.out).alias("out"))

    done = F.aggregate(ordered, begin, step)
    out = texts.join(spans, ["r1", "r2"]).withColumn("done", done)
    return out.select("doc_id", F.concat("done.out", F.expr("substring(text, done.at + 1)")).alias("text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def brute_terms(texts: list[str | None], alpha: float = ALPHA, prior: float = PRIOR) -> list[list[tuple[int, int]]]:
    """Added spans of each text, every count taken by hand; for tests."""
    import math
    import re

    def spans(t: str) -> list[tuple[int, int, str]]:
        def good(kind: str, v: str) -> bool:
            ds = [int(c) for c in v if c in "0123456789"]
            if kind == "ip":
                return all(int(p) <= 255 for p in v.split("."))
            if kind == "card":
                return 16 <= len(ds) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(ds[::-1])) % 10 == 0
            return kind == "email" or 8 <= len(ds) <= 15

        plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
        return [(m.start(), m.end(), m[0]) for k, p in plain.items() for m in re.finditer(p, t) if good(k, m[0])]

    rows = [(t or "", spans(t or "")) for t in texts]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{4,}", t) if not any(s < m.end() and m.start() < e for s, e, _ in base)] for t, base in rows]
    n, n_t, n_e, n_te = len(rows), {}, {}, {}
    for (_, base), found in zip(rows, words):
        entities, terms = {v for _, _, v in base}, {w for _, _, w in found}
        for x in terms:
            n_t[x] = n_t.get(x, 0) + 1
        for e in entities:
            n_e[e] = n_e.get(e, 0) + 1
            for x in terms:
                n_te[x, e] = n_te.get((x, e), 0) + 1
    told = {x for (x, e), k in n_te.items() if math.log(k * n / ((n_t[x] + prior) * n_e[e])) >= math.log(n / n_e[e]) / alpha and k * n > (n_t[x] + prior) * n_e[e]}
    return [[(s, e) for s, e, w in found if w in told] for found in words]
