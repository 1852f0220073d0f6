"""Deletion vectors: positions of deleted rows as a portable 64-bit Roaring bitmap.

A blob is its length (big-endian), a magic number, the bitmap and a CRC-32 of magic and bitmap
(big-endian). The bitmap is a count of 32-bit bitmaps (64-bit little-endian), each after its key.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import FormatError

# fixed values of the format
MAGIC = 1681511377
COOKIE_PLAIN = 12346
COOKIE_RUNS = 12347
OFFSETS_FROM = 4
ARRAY_MAX = 4096


def positions(blob: bytes, cardinality: int | None = None) -> np.ndarray:
    """Sorted positions; a wrong length, magic, checksum or cardinality is an error."""
    if len(blob) < 12 or struct.unpack_from(">I", blob)[0] != len(blob) - 8:
        raise FormatError("the length of a deletion vector is wrong")
    if struct.unpack_from("<I", blob, 4)[0] != MAGIC:
        raise FormatError("this is not a deletion vector")
    if zlib.crc32(blob[4:-4]) != struct.unpack_from(">I", blob, len(blob) - 4)[0]:
        raise FormatError("the checksum of a deletion vector is wrong")
    out, at = [], 16
    try:
        for _ in range(struct.unpack_from("<Q", blob, 8)[0]):
            key = struct.unpack_from("<I", blob, at)[0]
            low, at = _bitmap(blob, at + 4)
            out.append(low + (np.int64(key) << np.int64(32)))
    except (struct.error, ValueError) as e:
        raise FormatError("a deletion vector ends early") from e
    got = np.concatenate(out) if out else np.zeros(0, np.int64)
    if cardinality is not None and len(got) != cardinality:
        raise FormatError(f"a deletion vector holds {len(got)} positions, not {cardinality}")
    return got


def _bitmap(b: bytes, at: int) -> tuple[np.ndarray, int]:
    cookie = struct.unpack_from("<I", b, at)[0]
    at += 4
    runs = np.zeros(0, bool)
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        marks = np.frombuffer(b, np.uint8, (n + 7) // 8, at)
        runs = np.unpackbits(marks, bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == COOKIE_PLAIN:
        n = struct.unpack_from("<I", b, at)[0]
        at += 4
        runs = np.zeros(n, bool)
    else:
        raise FormatError("the cookie of a bitmap is unknown")
    heads = np.frombuffer(b, "<u2", 2 * n, at).astype(np.int64).reshape(n, 2)
    at += 4 * n
    if cookie == COOKIE_PLAIN or n >= OFFSETS_FROM:
        at += 4 * n
    out = []
    for (key, less_one), is_run in zip(heads, runs):
        if is_run:
            m = struct.unpack_from("<H", b, at)[0]
            pairs = np.frombuffer(b, "<u2", 2 * m, at + 2).astype(np.int64).reshape(m, 2)
            at += 2 + 4 * m
            low = np.concatenate([np.arange(s, s + k + 1) for s, k in pairs]) if m else np.zeros(0, np.int64)
        elif less_one + 1 > ARRAY_MAX:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        else:
            low = np.frombuffer(b, "<u2", less_one + 1, at).astype(np.int64)
            at += 2 * (less_one + 1)
        out.append(low.astype(np.int64) + (key << 16))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def blob(deleted) -> bytes:
    """A deletion vector of the positions, in array and bit containers."""
    values = np.unique(np.asarray(deleted, np.int64))
    body = bytearray()
    highs = np.unique(values >> 32)
    body += struct.pack("<Q", len(highs))
    for high in highs:
        low = values[values >> 32 == high] & 0xFFFFFFFF
        keys = np.unique(low >> 16)
        parts = [(int(k), (low[low >> 16 == k] & 0xFFFF)) for k in keys]
        body += struct.pack("<III", int(high), COOKIE_PLAIN, len(parts))
        for k, vs in parts:
            body += struct.pack("<HH", k, len(vs) - 1)
        packed = []
        for _, vs in parts:
            if len(vs) > ARRAY_MAX:
                bits = np.zeros(65536, np.uint8)
                bits[vs] = 1
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            else:
                packed.append(vs.astype("<u2").tobytes())
        at = 8 + 8 * len(parts)
        for p in packed:
            body += struct.pack("<I", at)
            at += len(p)
        body += b"".join(packed)
    inner = struct.pack("<I", MAGIC) + bytes(body)
    return struct.pack(">I", len(inner)) + inner + struct.pack(">I", zlib.crc32(inner))
