"""Variants as JSON text: dates, times and timestamps as the numbers they are stored as, UUIDs in
their usual spelling, binary as Base64. Spark's own text spells dates and timestamps instead.

A value is a header byte and a body; see the public encoding of the type.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from decimal import Decimal
from uuid import UUID

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError

# fixed values of the format: primitive types by number, as (struct code, size)
NUMBERS = {3: ("<b", 1), 4: ("<h", 2), 5: ("<i", 4), 6: ("<q", 8), 7: ("<d", 8), 11: ("<i", 4), 12: ("<q", 8), 13: ("<q", 8), 14: ("<f", 4), 17: ("<q", 8), 18: ("<q", 8), 19: ("<q", 8)}
DECIMALS = {8: 4, 9: 8, 10: 16}


def keys(metadata: bytes) -> list[str]:
    """The field names that values refer to by number."""
    if not metadata or metadata[0] & 15 != 1:
        raise FormatError("the metadata of a variant is of an unknown version")
    size = (metadata[0] >> 6) + 1
    at = lambda i: int.from_bytes(metadata[1 + i * size : 1 + (i + 1) * size], "little")
    n = at(0)
    begin = 1 + (n + 2) * size
    return [metadata[begin + at(1 + i) : begin + at(2 + i)].decode() for i in range(n)]


def text(value: bytes, metadata: bytes) -> str:
    """JSON of a variant."""
    names = keys(metadata)

    def whole(at: int, size: int) -> int:
        return int.from_bytes(value[at : at + size], "little")

    def number(x) -> str:
        if isinstance(x, float) and not math.isfinite(x):
            return json.dumps(str(x).replace("inf", "Infinity").replace("nan", "NaN"))
        return repr(x)

    def primitive(kind: int, at: int) -> str:
        if kind < 3:
            return ("null", "true", "false")[kind]
        if kind in NUMBERS:
            code, size = NUMBERS[kind]
            x = struct.unpack_from(code, value, at)[0]
            return str(np.float32(x)) if kind == 14 and math.isfinite(x) else number(x)
        if kind in DECIMALS:
            unscaled = int.from_bytes(value[at + 1 : at + 1 + DECIMALS[kind]], "little", signed=True)
            return format(Decimal(unscaled).scaleb(-value[at]), "f")
        if kind in (15, 16):
            data = value[at + 4 : at + 4 + whole(at, 4)]
            return json.dumps(base64.b64encode(data).decode() if kind == 15 else data.decode(), ensure_ascii=False)
        if kind == 20:
            return json.dumps(str(UUID(bytes=bytes(value[at : at + 16]))))
        raise FormatError(f"variant type {kind} is unknown")

    def walk(at: int) -> str:
        head = value[at]
        basic, more = head & 3, head >> 2
        if basic == 0:
            return primitive(more, at + 1)
        if basic == 1:
            return json.dumps(value[at + 1 : at + 1 + more].decode(), ensure_ascii=False)
        offset = (more & 3) + 1
        large = (more >> 4 if basic == 2 else more >> 2) & 1
        count = 4 if large else 1
        n = whole(at + 1, count)
        at += 1 + count
        if basic == 3:
            begin = at + (n + 1) * offset
            return "[" + ",".join(walk(begin + whole(at + i * offset, offset)) for i in range(n)) + "]"
        field = (more >> 2 & 3) + 1
        table = at + n * field
        begin = table + (n + 1) * offset
        return "{" + ",".join(json.dumps(names[whole(at + i * field, field)], ensure_ascii=False) + ":" + walk(begin + whole(table + i * offset, offset)) for i in range(n)) + "}"

    try:
        return walk(0)
    except (struct.error, IndexError) as e:
        raise FormatError("a variant ends early") from e


def variant_json(v: Column) -> Column:
    """JSON text of a variant column; null stays null."""

    @F.arrow_udf(T.StringType())
    def spell(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else text(x["value"], x["metadata"]) for x in a.to_pylist()], pa.string())

    return spell(v)
