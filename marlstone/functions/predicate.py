"""The predicate language: immutable values that say which rows match, never how to find them.

A comparison never matches null. On floating columns NaN equals NaN only, is unlike every number,
and is in no order with anything; the two zeros are equal. Conditions on a list or map leaf are
quantified: they speak of the elements, where null elements are members that match IS NULL only.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Always(Predicate):
    value: bool


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str  # eq ne lt le gt ge
    value: Any


@dataclass(frozen=True)
class In(Predicate):
    column: str
    values: tuple


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str


@dataclass(frozen=True)
class IsNotNull(Predicate):
    column: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Quantified(Predicate):
    """`kind` is any, all or one; `part` a comparison, IN, null test or their conjunction, all on
    one repeated leaf."""

    kind: str
    part: Predicate


@dataclass(frozen=True)
class Box:
    xmin: float
    ymin: float
    xmax: float
    ymax: float


@dataclass(frozen=True)
class BoxTest(Predicate):
    """A geometry column's envelope against a box: intersects, contains (it encloses the box),
    covered_by (the box encloses it) or equals. Edges count as inside."""

    column: str
    relation: str
    box: Box


@dataclass(frozen=True)
class GeometryTest(Predicate):
    """An exact relation of a geometry column to a geometry given as WKB."""

    column: str
    relation: str
    wkb: bytes
    distance: float = 0.0


@dataclass(frozen=True)
class GeometryFiltered(Predicate):
    """A caller's own exact test of a geometry column (see hooks.GeometryFilter)."""

    filter: Any

    @property
    def column(self) -> str:
        return self.filter.column


@dataclass(frozen=True)
class RowsExcluded(Predicate):
    """All rows but those at the given positions of their file."""

    positions: frozenset[int]


FLIPPED = {"eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}


class col:  # noqa: N801
    """col("x").gt(5), col("x").isin(1, 2), col("tags").any().eq("a") and so on."""

    def __init__(self, name: str, kind: str | None = None):
        self._name, self._kind = name, kind

    def _made(self, p: Predicate) -> Predicate:
        return Quantified(self._kind, p) if self._kind else p

    def any(self) -> col:
        return col(self._name, "any")

    def all(self) -> col:
        return col(self._name, "all")

    def one(self) -> col:
        return col(self._name, "one")

    def eq(self, v) -> Predicate:
        return self._made(Compare(self._name, "eq", v))

    def ne(self, v) -> Predicate:
        return self._made(Compare(self._name, "ne", v))

    def lt(self, v) -> Predicate:
        return self._made(Compare(self._name, "lt", v))

    def le(self, v) -> Predicate:
        return self._made(Compare(self._name, "le", v))

    def gt(self, v) -> Predicate:
        return self._made(Compare(self._name, "gt", v))

    def ge(self, v) -> Predicate:
        return self._made(Compare(self._name, "ge", v))

    def between(self, lo, hi) -> Predicate:
        return self._made(And((Compare(self._name, "ge", lo), Compare(self._name, "le", hi))))

    def isin(self, *values) -> Predicate:
        return self._made(In(self._name, tuple(values)))

    def is_null(self) -> Predicate:
        return self._made(IsNull(self._name))

    def is_not_null(self) -> Predicate:
        return self._made(IsNotNull(self._name))

    def bbox(self, relation: str, *box: float) -> Predicate:
        return BoxTest(self._name, relation, Box(*box))


def columns(p: Predicate) -> set[str]:
    """Every column a predicate reads."""
    match p:
        case And(parts) | Or(parts):
            return set().union(*map(columns, parts))
        case Not(part) | Quantified(_, part):
            return columns(part)
        case Always() | RowsExcluded():
            return set()
        case _:
            return {p.column}


def renamed(p: Predicate, names: dict[str, str]) -> Predicate:
    """The predicate on other column names."""
    from dataclasses import replace

    match p:
        case And(parts):
            return And(tuple(renamed(x, names) for x in parts))
        case Or(parts):
            return Or(tuple(renamed(x, names) for x in parts))
        case Not(part):
            return Not(renamed(part, names))
        case Quantified(kind, part):
            return Quantified(kind, renamed(part, names))
        case Always() | RowsExcluded() | GeometryFiltered():
            return p
        case _:
            head, dot, rest = p.column.partition(".")
            return replace(p, column=names.get(p.column, names.get(head, head) + dot + rest))


def normal(p: Predicate, negate: bool = False) -> Predicate:
    """Negations pushed to the leaves by turning operators, so `NOT x > 5` is `x <= 5` and NaN
    stays out of both; constants folded, nested AND and OR flattened."""
    match p:
        case Always(v):
            return Always(v != negate)
        case Not(part):
            return normal(part, not negate)
        case Compare(c, op, v):
            return Compare(c, FLIPPED[op], v) if negate else p
        case IsNull(c):
            return IsNotNull(c) if negate else p
        case IsNotNull(c):
            return IsNull(c) if negate else p
        case In(c, values):
            if negate:
                return normal(And(tuple(Compare(c, "ne", v) for v in values)))
            return p if values else Always(False)
        case And(parts) | Or(parts):
            conj = isinstance(p, And) != negate
            flat: list[Predicate] = []
            for x in (normal(x, negate) for x in parts):
                if isinstance(x, Always):
                    if x.value != conj:
                        return Always(not conj)
                    continue
                flat += x.parts if isinstance(x, And if conj else Or) else [x]
            if len(flat) < 2:
                return flat[0] if flat else Always(conj)
            return (And if conj else Or)(tuple(flat))
        case Quantified(kind, part):
            if negate and kind != "one":
                return Quantified("all" if kind == "any" else "any", normal(part, True))
            inner = Quantified(kind, normal(part))
            return Not(inner) if negate else inner
        case _:
            return Not(p) if negate else p
