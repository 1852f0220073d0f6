"""BPE encoding and decoding with a given byte-level vocabulary, by tree concatenation.

A text longer than a leaf is cut into leaves wherever their ends fall; the leaves are encoded in
parallel, and neighbours are joined as a tree. At each join the text around the cut is encoded again
in a window that grows until both sides agree:

- In text that splits, the window's ends are places where any text splits, whatever stands around
  them (a word before a space, a letter before a digit). The tokens of both sides outside the window
  stay as they are.
- Inside a piece that the pre-tokenizer leaves whole, the window is made of tokens on both sides and
  doubles on the side that disagrees, until its first token is the left side's and its last the right
  side's. Adjacent tokens that each occur in some encoding make the whole an encoding.

Either way the result is that of the undivided text. The leaves' encoder leaves Python's lock, so a
worker with idle cores encodes one long text on several.

The special token's text is the special token, as the vocabulary file asks for.

Defined cases: a null text counts as empty and has no tokens; a null doc_id stays null; repeated
rows give repeated rows; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts

LEAF = 4096
THREADS = 4
SPECIAL = "<|endoftext|>"
#: places at which every text splits: what stands before and after them cannot be in one piece
SPLITS = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")
#: enough of one class on both sides of a cut to be inside one piece
INSIDE = 8
SAME = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+")


@functools.lru_cache(maxsize=4)
def codec(path: str):
    """The encoder of a byte-level `*.json` vocabulary, read through the same vocabulary as ranks."""
    import json

    import public_tokenizers as P
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    # the format writes bytes as printable characters: those that are printable stand for themselves
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=1)
def _pool(threads: int) -> ThreadPoolExecutor:
    return ThreadPoolExecutor(threads)


@functools.lru_cache(maxsize=1)
def _pieces(pattern: str):
    return regex.compile(pattern)


def _join(enc, a: list[int], b: list[int]) -> list[int]:
    """Tokens of a piece of which `a` and `b` are the tokens of its halves."""
    i = j = 1
    token = enc.decode_single_token_bytes
    while True:
        i, j = min(i, len(a)), min(j, len(b))
        window = enc._encode_single_piece(b"".join(map(token, a[len(a) - i :])) + b"".join(map(token, b[:j])))
        left = i == len(a) or window[0] == a[-i]
        right = j == len(b) or window[-1] == b[j - 1]
        if left and right:
            return a[: len(a) - i] + window + b[j:]
        i, j = i if left else 2 * i, j if right else 2 * j


def _until(enc, ids, size: int) -> int | None:
    """How many of the tokens make up `size` bytes; None if a token runs over them."""
    n = 0
    for i in ids:
        if size <= 0:
            break
        size -= len(enc.decode_single_token_bytes(i))
        n += 1
    return n if size == 0 else None


def _last_split(text: str, start: int, end: int) -> int | None:
    """The last certain split in text[start + 1 : end + 1], looked for ever further back."""
    reach = 64
    while True:
        lo = max(start + 1, end - reach)
        found = None
        for m in SPLITS.finditer(text, max(start, lo - 1), min(len(text), end + 1)):
            if lo <= m.start() <= end:
                found = m.start()
        if found is not None or lo == start + 1:
            return found
        reach *= 8


def _first_split(text: str, start: int, end: int) -> int | None:
    """The first certain split in text[start : end]."""
    for m in SPLITS.finditer(text, max(0, start - 1), end):
        if start <= m.start() < end:
            return m.start()
    return None


def _concatenated(enc, text: str, left: tuple, right: tuple) -> tuple:
    """(start, end, tokens) of two neighbours to that of both."""
    (start, cut, a), (_, end, b) = left, right
    lo, hi = cut - INSIDE, cut + INSIDE
    if lo >= start and hi <= end and SAME.fullmatch(text, lo, hi):
        # inside one piece: from its first token on the left to its last on the right
        from_ = _last_split(text, start, lo)
        from_ = start if from_ is None else from_
        pieces = _pieces(enc._pat_str)
        for m in pieces.finditer(text, from_, cut):
            from_ = m.start()
        to = pieces.match(text, cut, end).end()
        n = _until(enc, reversed(a), len(text[from_:cut].encode()))
        k = _until(enc, b, len(text[cut:to].encode()))
        if n is not None and k is not None:
            return start, end, a[: len(a) - n] + _join(enc, a[len(a) - n :], b[:k]) + b[k:]
    x, y = _last_split(text, start, cut), _first_split(text, cut, end)
    x, y = start if x is None else x, end if y is None else y
    n = _until(enc, reversed(a), len(text[x:cut].encode()))
    k = _until(enc, b, len(text[cut:y].encode()))
    if n is None or k is None:
        raise AssertionError("a token runs over a split")
    return start, end, a[: len(a) - n] + enc.encode_ordinary(text[x:y]) + b[k:]


def encode_plain(enc, text: str, leaf: int = LEAF, threads: int = THREADS) -> list[int]:
    """Tokens of a text without special tokens."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    cuts = [*range(0, len(text), leaf), len(text)]
    parts = [text[x:y] for x, y in zip(cuts, cuts[1:])]
    # a few leaves are encoded sooner than handed out
    encoded = _pool(threads).map(enc.encode_ordinary, parts) if threads > 1 and len(parts) > 16 else map(enc.encode_ordinary, parts)
    level = list(zip(cuts, cuts[1:], encoded))
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [_concatenated(enc, text, *p) if len(p) == 2 else p[0] for p in pairs]
    return level[0][2]


def encode_text(enc, text: str, leaf: int = LEAF, threads: int = THREADS) -> list[int]:
    ids: list[int] = []
    for n, plain in enumerate(text.split(SPECIAL)):
        if n:
            ids.append(enc.eot_token)
        ids += encode_plain(enc, plain, leaf, threads)
    return ids


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers, packed), decoded."""

    def kernel(ids, texts):
        enc = codec(path)
        tokens = [encode_text(enc, t) for t in texts]
        packed = [np.asarray(t, "<u4").tobytes() for t in tokens]
        return {"doc_id": ids, "n_tokens": [len(t) for t in tokens], "token_ids": packed, "decoded": [decode_ids(enc, t) for t in tokens]}

    return map_texts(docs, kernel, "doc_id long, n_tokens long, token_ids binary, decoded string")


def decode_ids(enc, ids: list[int]) -> str:
    return enc.decode_bytes(ids).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text); null ids decode to the empty text."""
    import pyarrow as pa

    def run(batches):
        enc = codec(path)
        for b in batches:
            texts = [decode_ids(enc, np.frombuffer(x or b"", "<u4").tolist()) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digested(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(encode(documents(spark, sf_dir), vocabulary_path()))
