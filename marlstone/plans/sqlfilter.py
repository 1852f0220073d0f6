"""WHERE texts to predicates: a column on the left, literals on the right.

    = != <> < <= > >=   AND OR NOT ( )   [NOT] IN (…)   [NOT] BETWEEN … AND …   IS [NOT] NULL
    ST_Intersects(col, geometry), and the other relations; ST_DWithin(col, geometry, distance)

Order comparisons are for numbers, dates and timestamps only. A repeated column gets ANY.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import types as T

from ..errors import FilterError
from ..functions import geometry
from ..functions.compiling import resolve
from ..functions.predicate import And, Box, BoxTest, Compare, GeometryTest, In, IsNotNull, IsNull, Not, Or, Predicate, Quantified

TOKEN = re.compile(r"""\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|[A-Za-z_][\w.]*)|(?P<op><=|>=|<>|!=|[=<>(),+-]))""")
OP = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
RELATIONS = {"st_intersects": "intersects", "st_touches": "touches", "st_crosses": "crosses", "st_overlaps": "overlaps", "st_disjoint": "disjoint", "st_equals": "equals", "st_contains": "contains", "st_within": "within", "st_covers": "covers", "st_coveredby": "covered_by", "st_dwithin": "dwithin"}
SWAPPED = {"contains": "within", "within": "contains", "covers": "covered_by", "covered_by": "covers"}
BOXES = {"intersects": "intersects", "equals": "equals", "covers": "contains", "covered_by": "covered_by"}


def parse(text: str, schema: T.StructType) -> Predicate:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read the filter at {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    parser = _Parser(tokens, schema)
    out = parser.either()
    if parser.at != len(tokens):
        raise FilterError(f"the filter goes on after its end: {tokens[parser.at][1]!r}")
    return out


class _Parser:
    def __init__(self, tokens, schema):
        self.tokens, self.schema, self.at = tokens, schema, 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise FilterError(f"expected {word} but found {found!r}")

    def next(self, kind: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise FilterError(f"expected a {kind}")

    def either(self) -> Predicate:
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self) -> Predicate:
        parts = [self.single()]
        while self.take("AND"):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def single(self) -> Predicate:
        if self.take("NOT"):
            return Not(self.single())
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        name = self.next("name")
        if name.lower() in RELATIONS and self.peek("("):
            return self.spatial(name.lower())
        if self.peek("("):
            raise FilterError(f"functions are not supported in filters: {name}")
        path = name[1:-1].replace('""', '"') if name[0] == '"' else name
        leaf = resolve(self.schema, path)
        wrap = (lambda p: Quantified("any", p)) if leaf.repeated else (lambda p: p)
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return wrap(IsNotNull(path) if negated else IsNull(path))
        negated = self.take("NOT")
        if self.take("IN"):
            self.need("(")
            values = [self.literal(leaf)]
            while self.take(","):
                values.append(self.literal(leaf))
            self.need(")")
            out = wrap(In(path, tuple(values)))
        elif self.take("BETWEEN"):
            self.ordered(leaf, "BETWEEN")
            lo = self.literal(leaf)
            self.need("AND")
            out = wrap(And((Compare(path, "ge", lo), Compare(path, "le", self.literal(leaf)))))
        elif not negated and self.at < len(self.tokens) and self.tokens[self.at][1] in OP:
            op = OP[self.next("op")]
            if op not in ("eq", "ne"):
                self.ordered(leaf, op)
            return wrap(Compare(path, op, self.literal(leaf)))
        else:
            raise FilterError(f"expected a comparison after {name!r}")
        return Not(out) if negated else out

    def ordered(self, leaf, op: str) -> None:
        if isinstance(leaf.type, (T.StringType, T.BinaryType, T.BooleanType)):
            raise FilterError(f"{op}: {leaf.path!r} of type {leaf.type.simpleString()} has no order in filters")

    def literal(self, leaf):
        sign = -1 if self.take("-") else 1
        if sign == 1:
            self.take("+")
        if self.at >= len(self.tokens):
            raise FilterError("a literal is missing")
        kind, raw = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            if isinstance(leaf.type, T.DecimalType):
                return sign * Decimal(raw)
            if re.fullmatch(r"\d+", raw):
                n = sign * int(raw)
                if not -(1 << 63) <= n < 1 << 63:
                    raise FilterError(f"{n} is beyond 64 bits")
                return n
            return sign * float(raw)
        if kind == "text":
            t = raw[1:-1].replace("''", "'")
            if isinstance(leaf.type, T.BooleanType) and t.lower() in ("true", "false"):
                return t.lower() == "true"
            try:
                if isinstance(leaf.type, T.DateType):
                    return date.fromisoformat(t)
                if isinstance(leaf.type, (T.TimestampType, T.TimestampNTZType)):
                    return datetime.fromisoformat(t)
            except ValueError as e:
                raise FilterError(f"{t!r} is no {leaf.type.simpleString()}") from e
            return t
        if kind == "name" and raw.upper() in ("TRUE", "FALSE"):
            return raw.upper() == "TRUE"
        if kind == "name" and raw.upper() in ("DATE", "TIMESTAMP"):
            return self.literal(leaf)
        raise FilterError(f"{raw!r} is no literal; strings are quoted")

    def shape(self):
        """("column", name), ("extent", name) or ("wkb", bytes)."""
        name = self.next("name")
        low = name.lower()
        if not self.take("("):
            resolve(self.schema, name)
            return "column", name
        if low in ("st_extent", "st_envelope"):
            out = "extent", self.next("name")
        elif low == "st_geomfromtext":
            out = "wkb", geometry.from_wkt(self.next("text")[1:-1])
        elif low == "st_makeenvelope":
            xs = [self.number()]
            for _ in range(3):
                self.need(",")
                xs.append(self.number())
            out = "wkb", geometry.rectangle(*xs)
        else:
            raise FilterError(f"unknown geometry function {name}")
        self.need(")")
        return out

    def number(self) -> float:
        sign = -1 if self.take("-") else 1
        return sign * float(self.next("number"))

    def spatial(self, name: str) -> Predicate:
        relation, distance = RELATIONS[name], 0.0
        self.need("(")
        a = self.shape()
        self.need(",")
        b = self.shape()
        if relation == "dwithin":
            self.need(",")
            distance = self.number()
        self.need(")")
        if a[0] == "wkb":
            a, b, relation = b, a, SWAPPED.get(relation, relation)
        if b[0] != "wkb" or a[0] == "wkb":
            raise FilterError(f"{name} needs a column and a constant geometry")
        if a[0] == "extent":
            negated = relation == "disjoint"
            kind = "intersects" if negated else relation
            if kind not in BOXES:
                raise FilterError(f"{name} has no meaning for an extent")
            box = geometry.box_of(b[1])
            if box is None or (b[1] != geometry.rectangle(*box)):
                raise FilterError("an extent is compared with a rectangle")
            test = BoxTest(a[1], BOXES[kind], Box(*box))
            return Not(test) if negated else test
        if geometry.box_of(b[1]) is None:
            raise FilterError("the query geometry is empty")
        return GeometryTest(a[1], relation, b[1], distance)
