"""Held-out accuracy, SQL oracles, and the pipeline against a brute-force version."""

import hashlib

import numpy as np

import corpus_pipeline
from marlstone.llm import bpe, licenses, minhash, pii, queries, toxicity

from ..oracle import same_rows
from .test_operators import brute_mix, lower

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    for name, sql in queries.SQL.items():
        same_rows(queries.QUERIES[name](spark, SF), sql, SF)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_disclosing_terms_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], pii.brute_terms([r.text for r in rows])))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.find(docs).collect()}
    assert got == want


def test_licenses_of_a_table(spark):
    """Every notice in its usual wording is found, and nothing where no such notice stands."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    plain = [(name, " ".join(words)) for (name, _, _), words in zip(licenses.TEMPLATES, licenses.WANT)]
    want = {}
    for r in docs.collect():
        text = f" {' '.join(licenses.WORD.findall(r.text.lower()))} " if r.text else ""
        want[r.doc_id] = {name for name, words in plain if f" {words} " in text}
    got = {r.doc_id: {h.license for h in r.hits} for r in licenses.scan(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.predicted == 1).sum() > 0.9 and hit.sum() / (got.toxic == 1).sum() > 0.8


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    rows = [r for r in rows if model.score([toxicity.features(model.lexicon, r[1] or "")])[0] < 0.3]
    last = {}
    for r in rows:
        last[lower(r[1])] = max(last.get(lower(r[1]), -1), r[0])
    rows = [r for r in rows if last[lower(r[1])] == r[0]]
    near = minhash.brute_groups({r[0]: r[1] for r in rows}, 5, 80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    texts, theirs, want = {r[0]: r[1] for r in rows}, Tokenizer.from_file(bpe.vocabulary_path()), []
    import re

    for d, _, size, _, _, taken in brute_mix(rows):
        pieces = re.split(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", texts[d])
        copies = [texts[d]] * (taken // size if size else 1) + (["".join(pieces[: taken % size])] if size and taken % size else [])
        for t in copies:
            ids = theirs.encode(t, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
