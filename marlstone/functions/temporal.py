"""Stored numbers of temporal values, and relations between instants and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FilterError
from .predicate import Always, Predicate, col


def ntz_micros(c: Column) -> Column:
    """Microseconds of a timestamp without zone since 1970-01-01 on its own clock."""
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


#: What a relation is called with its sides exchanged; the rest are their own mirrors or never hold.
MIRRORED = {"after": "before", "during": "contains", "begins": "begun_by", "ends": "ended_by"}
MIRRORED |= {b: a for a, b in MIRRORED.items()}
NEVER_OF_INSTANTS = {"meets", "met_by", "overlaps", "overlapped_by", "contains", "begun_by", "ended_by"}


def related(column: str, relation: str, start, end=None, literal_first: bool = False) -> Predicate:
    """A temporal relation between a timestamp column and an instant, or a period where `end` is
    given, as comparisons that reach the scan. An instant has no inside and no overlap, so
    relations that need them match no row."""
    if literal_first:
        relation = MIRRORED.get(relation, relation)
    at = col(column)
    last = start if end is None else end
    match relation:
        case "after":
            return at.gt(last)
        case "before":
            return at.lt(start)
        case "any_interacts":
            return at.eq(start) if end is None else at.ge(start) & at.le(end)
        case "equals":
            return at.eq(start) if end is None else Always(False)
        case "during":
            return Always(False) if end is None else at.gt(start) & at.lt(end)
        case "begins" | "ends":
            return Always(False) if end is None else at.eq(start if relation == "begins" else end)
    if relation in NEVER_OF_INSTANTS:
        return Always(False)
    raise FilterError(f"temporal relation {relation!r} is unknown")
