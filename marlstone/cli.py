"""python -m marlstone.cli COMMAND PATH [options]: schema, meta, cat, head, cp, explain, row-groups,
row-count, stats.

Errors leave with the exit code of their class: usage 2, schema 3, format 4, filter 5, other 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MarlstoneError, SchemaError
from .functions.compiling import compiled
from .functions.predicate import Always
from .plans.explain import entries, explain, file_stats, row_groups
from .plans.query import Query, of_leaves
from .plans.sqlfilter import parse
from .session import ship
from .sources import geo
from .sources.fileset import listed, open_fileset
from .sources.sinks import delimited_rows, header, json_rows, text_rows


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("command", choices=["schema", "meta", "cat", "head", "cp", "explain", "row-groups", "row-count", "stats"])
    p.add_argument("path")
    p.add_argument("target", nargs="?", help="where cp writes")
    p.add_argument("--filter")
    p.add_argument("--columns", help="names, comma between; the file's order holds")
    p.add_argument("--limit", type=int)
    p.add_argument("--geometry", help="cp: write GeoParquet with this column of WKB")
    p.add_argument("--compression", default="zstd", help="cp: codec")
    p.add_argument("--format", choices=["text", "json", "csv", "tsv"], default="text")
    return p


def lines(df: DataFrame, kind: str):
    """Output lines in the order of the partitions they are made in. All are made at once, and pulled from
    the few partitions of a shuffle: a local iterator runs the partitions that it pulls in turn."""
    made = {"json": json_rows, "csv": delimited_rows, "tsv": lambda d: delimited_rows(d, "\t"), "text": text_rows}[kind](df)
    if kind in ("csv", "tsv"):
        yield header(df, "," if kind == "csv" else "\t")
    line = made.columns[0]
    for row in made.select(F.col(line), F.monotonically_increasing_id().alias("at")).orderBy("at").select(line).toLocalIterator():
        yield row[0]


def run(spark: SparkSession, args: argparse.Namespace):
    ship(spark)
    if args.command in ("stats", "row-groups", "meta"):
        made = {"stats": file_stats, "row-groups": row_groups, "meta": entries}[args.command]
        yield from lines(made(spark, listed(spark, args.path)), args.format)
        return
    df = open_fileset(spark, args.path).frame()
    predicate = parse(args.filter, df.schema) if args.filter else Always(True)
    compiled(predicate, df.schema)
    if args.command == "schema":
        yield from (f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)
    elif args.command == "row-count":
        yield str(Query(predicate).count(df).first()[0])
    elif args.command == "explain":
        yield from lines(explain(spark, listed(spark, args.path), predicate), args.format)
    else:
        limit = args.limit if args.limit is not None else 10 if args.command == "head" else None
        rows = Query(predicate, limit=limit).rows(df)
        if args.columns:
            names = [c.strip() for c in args.columns.split(",")]
            if not all(names):
                raise SchemaError("a column name is empty")
            rows = rows.select(*of_leaves(rows.schema, names))
        if args.command != "cp":
            yield from lines(rows, args.format)
        elif args.geometry:
            yield from geo.write(rows, args.target, args.geometry, compression=args.compression)
        else:
            rows.write.mode("errorifexists").option("compression", args.compression).parquet(args.target)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if (args.command == "cp") != (args.target is not None):
        print("cp, and only cp, takes a target", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("marlstone").getOrCreate()
    try:
        for line in run(spark, args):
            print(line)
    except MarlstoneError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
