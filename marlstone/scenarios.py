"""Registered queries over files that are written from the driver's tables first: directories, Hive
partitions, GeoParquet, Iceberg tables, catalogs, containers, footers. Each scenario is written once
per session and folder of tables, in the folder that executors share, and read back by the engine.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cli
from .errors import MarlstoneError
from .functions import hooks
from .functions.compiling import compiled
from .functions.folding import folded
from .functions.predicate import Box, BoxTest, GeometryFiltered, Quantified, RowsExcluded, col, columns, renamed
from .functions.variantjson import variant_json
from .operators.reconcile import Field, reconciled
from .plans import counting, explain
from .plans.query import Coalesce, Constant, Physical, Promoted, Query, RowPosition, of_leaves
from .plans.reading import native_geometries
from .plans.sqlfilter import parse
from .session import scratch, ship
from .sources import deletion, geo, items, sinks
from .sources.fileset import by_file, listed, open_fileset, open_per_file
from .sources.tables import Table, warehouse
from .sources.tablewriter import TableWriter, write_bytes
from .sources.writer import Bloom, RowBuilder, WriteOptions, write
from .suite import ORDER, POINTS, points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_made: dict[tuple[str, str, str], str] = {}


def query(sql: str):
    """Register a function (spark, sf_dir) under its name with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def once(make: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], str]:
    """The folder that `make(spark, sf_dir, folder)` has written, written at the first call."""

    def folder(spark: SparkSession, sf_dir: str) -> str:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        if key not in _made:
            path = scratch(ship(spark), make.__name__)
            make(spark, sf_dir, path)
            _made[key] = path
        return _made[key]

    return folder


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def one_file(df: DataFrame, path: str) -> None:
    """Rows as one file of a given name."""
    spark = df.sparkSession
    work = f"{path}.d"
    df.coalesce(1).write.parquet(work)
    jvm, (made,) = spark._jvm, listed(spark, work)
    p = jvm.org.apache.hadoop.fs.Path(made)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path).getParent())
    fs.rename(p, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(jvm.org.apache.hadoop.fs.Path(work), True)


FILE_ROWS = 500_000


def file_number(df: DataFrame, least: int, rows: int = FILE_ROWS) -> int:
    """How many files to write, so that no task writes much more than `rows`."""
    return max(least, -(-df.count() // rows))


# --- directories and partitions -------------------------------------------------------------------

STEP = 1000


@once
def ranges(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Orders in files of STEP keys each, sorted."""
    df = orders(spark, sf_dir).withColumn("r", (F.col("o_orderkey") / STEP).cast("int"))
    tasks = max(1, df.select("r").distinct().count() // explain.FILES_A_TASK)
    df.repartition(tasks, "r").sortWithinPartitions("r", "o_orderkey").write.partitionBy("r").parquet(f"{path}/hive")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(of(f"{path}/flat"))
    for f in listed(spark, f"{path}/hive"):
        r = f.split("/r=")[1].split("/")[0]
        fs.rename(of(f), of(f"{path}/flat/range{r}.parquet"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def fileset_directory(spark, sf_dir):
    return open_fileset(spark, f"{ranges(spark, sf_dir)}/flat").frame().select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT 'range' || (o_orderkey // 1000) AS name, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def fileset_per_file(spark, sf_dir):
    rows = by_file(open_per_file(spark, f"{ranges(spark, sf_dir)}/flat"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT 'range' || r || '.parquet' AS name FROM (SELECT DISTINCT o_orderkey // 1000 AS r FROM orders)")
def file_listing(spark, sf_dir):
    return spark.createDataFrame([(f.split("/")[-1],) for f in listed(spark, f"{ranges(spark, sf_dir)}/flat")], "name string")


@query("SELECT o_orderkey // 1000 AS r, o_orderkey FROM orders WHERE o_orderkey // 1000 IN (1, 3)")
def file_listing_glob(spark, sf_dir):
    files = listed(spark, f"{ranges(spark, sf_dir)}/flat", r"range[13]\.parquet$")
    rows = spark.read.parquet(*files) if files else orders(spark, sf_dir).where("false")
    return rows.select((F.col("o_orderkey") / STEP).cast("int").cast("long").alias("r"), "o_orderkey")


@once
def hive(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Keys of every type a path can spell; `status` stays a column of the files too."""
    df = orders(spark, sf_dir)
    keys = {"year": F.year("o_orderdate").cast("string"), "code": F.lpad((F.col("o_custkey") % 3).cast("string"), 2, "0"), "half": F.when(F.col("o_custkey") % 2 == 0, "0.5").otherwise("1.5"), "day": F.when(F.col("o_custkey") % 2 == 0, "2024-01-31").otherwise("2024-02-29"), "mixed": F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("2.5")}
    for name, c in keys.items():
        df = df.withColumn(name, c)
    df = df.withColumn("status", F.col("o_orderstatus"))
    # large keys are dealt to several tasks
    df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path)


HIVE = "(SELECT *, year(o_orderdate) AS year, lpad((o_custkey % 3)::VARCHAR, 2, '0') AS code, CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS half, CASE WHEN o_custkey % 2 = 0 THEN DATE '2024-01-31' ELSE DATE '2024-02-29' END AS day, CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE '2.5' END AS mixed FROM orders)"


@query(f"SELECT o_orderkey, year, code, half, day, mixed FROM {HIVE} WHERE year = 1996 AND code <> '01' AND half < 1 AND day < DATE '2024-02-01'")
def hive_typed_partitions(spark, sf_dir):
    p = col("year").eq(1996) & col("code").ne("01") & col("half").lt(1.0) & col("day").lt(date(2024, 2, 1))
    return open_fileset(spark, hive(spark, sf_dir)).frame(p).select("o_orderkey", "year", "code", "half", "day", "mixed")


@query(f"SELECT count(DISTINCT (year, code, half, day, mixed)) AS left_files, (SELECT count(DISTINCT (year, code, half, day, mixed)) FROM {HIVE}) AS files FROM {HIVE} WHERE year = 1996 AND mixed = '1'")
def hive_pruned_files(spark, sf_dir):
    fs = open_fileset(spark, hive(spark, sf_dir))
    folder = lambda f: f.rsplit("/", 1)[0]
    left = {folder(f) for f, _ in fs.surviving(col("year").eq(1996) & col("mixed").eq("1"))}
    return spark.createDataFrame([(len(left), len({folder(f) for f in fs.files}))], "left_files long, files long")


@query(f"SELECT count(*) AS n FROM {HIVE} WHERE year = 1997 OR half > 1")
def hive_count_from_paths(spark, sf_dir):
    return open_fileset(spark, hive(spark, sf_dir)).count(col("year").eq(1997) | col("half").gt(1.0))


@once
def hive_own(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The key is a column of the files too, where it has its own value."""
    df = orders(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for s in ("F", "O", "P"):
        one_file(df.where(F.col("status") == s).withColumn("status", F.when(F.col("o_orderkey") % 5 == 0, F.lit(s)).otherwise(F.lower("status"))), f"{path}/status={s}/part.parquet")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0")
def hive_own_column(spark, sf_dir):
    return open_fileset(spark, hive_own(spark, sf_dir)).frame(col("status").eq("F"))


# --- footers, explain, counts ---------------------------------------------------------------------


@query("SELECT o_orderkey // 1000 AS r, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high, count(*) AS n, 0::BIGINT AS nulls FROM orders GROUP BY 1")
def footer_statistics(spark, sf_dir):
    stats = explain.file_stats(spark, listed(spark, f"{ranges(spark, sf_dir)}/flat")).where("column = 'o_orderkey'")
    r = F.regexp_extract("file", r"range(\d+)\.parquet$", 1).cast("long").alias("r")
    return stats.groupBy(r).agg(F.min(F.col("min").cast("long")).cast("string").alias("low"), F.max(F.col("max").cast("long")).cast("string").alias("high"), F.sum("num_values").alias("n"), F.sum("nulls").alias("nulls"))


@query("SELECT o_orderkey // 1000 AS r, count(*) AS n, 6 AS n_columns FROM orders GROUP BY 1")
def footer_row_groups(spark, sf_dir):
    groups = explain.row_groups(spark, listed(spark, f"{ranges(spark, sf_dir)}/flat"))
    return groups.groupBy(F.regexp_extract("file", r"range(\d+)\.parquet$", 1).cast("long").alias("r")).agg(F.sum("rows").alias("n"), F.max("columns").alias("n_columns"))


@query("SELECT o_orderkey // 1000 AS r, count(*)::VARCHAR AS value FROM orders GROUP BY 1")
def footer_entries(spark, sf_dir):
    told = explain.entries(spark, listed(spark, f"{ranges(spark, sf_dir)}/flat")).where("key = 'rows'")
    return told.select(F.regexp_extract("file", r"range(\d+)\.parquet$", 1).cast("long").alias("r"), "value")


@query("SELECT name, type FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t(name, type)")
def footer_schema(spark, sf_dir):
    df = open_fileset(spark, f"{ranges(spark, sf_dir)}/flat").frame()
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def _explained(spark: SparkSession, sf_dir: str, p) -> DataFrame:
    told = explain.explain(spark, listed(spark, f"{ranges(spark, sf_dir)}/flat"), p)
    return told.select(F.regexp_extract("file", r"range(\d+)\.parquet$", 1).cast("long").alias("r"), "rows", "verdict", "reason")


RANGES = "(SELECT o_orderkey // 1000 AS r, min(o_orderkey) AS a, max(o_orderkey) AS z, min(o_custkey) AS c, max(o_custkey) AS d, count(*) AS rows FROM orders GROUP BY 1)"


@query(f"SELECT r, rows, CASE WHEN z < 150 OR a > 2600 THEN 'none' WHEN a >= 150 AND z <= 2600 THEN 'all' ELSE 'some' END AS verdict FROM {RANGES}")
def explain_range(spark, sf_dir):
    return _explained(spark, sf_dir, col("o_orderkey").between(150, 2600)).drop("reason")


@query(f"SELECT r, rows, 'all' AS verdict FROM {RANGES}")
def explain_nulls_and_not(spark, sf_dir):
    return _explained(spark, sf_dir, ~col("o_orderkey").is_null() & ~(col("o_orderkey").lt(0))).drop("reason")


@query(f"SELECT r, CASE WHEN a <= 5 AND z >= 5 OR a <= 2500 AND z >= 2500 THEN 'some' ELSE 'none' END AS verdict, CASE WHEN a <= 5 AND z >= 5 OR a <= 2500 AND z >= 2500 THEN 'o_orderkey: value within [min, max]' ELSE 'o_orderkey: value outside [min, max]' END AS reason FROM {RANGES}")
def explain_in(spark, sf_dir):
    return _explained(spark, sf_dir, col("o_orderkey").isin(5, 2500)).drop("rows")


@query(f"SELECT r, 'unknown' AS verdict, 'not decided by statistics' AS reason FROM {RANGES}")
def explain_undecided(spark, sf_dir):
    return _explained(spark, sf_dir, ~BoxTest("o_orderkey", "intersects", Box(0, 0, 1, 1))).drop("rows")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 150 AND 2600")
def count_from_footers(spark, sf_dir):
    return counting.count(spark, listed(spark, f"{ranges(spark, sf_dir)}/flat"), col("o_orderkey").between(150, 2600))


@query("SELECT count(*) AS n, 0 AS opened FROM orders WHERE o_orderkey >= 0")
def count_without_rows(spark, sf_dir):
    """Every file is decided by its footer: none is opened for rows."""
    files, p = listed(spark, f"{ranges(spark, sf_dir)}/flat"), col("o_orderkey").ge(0)
    opened = counting.decided(spark, files, p).where("open").count()
    return counting.count(spark, files, p).withColumn("opened", F.lit(opened))


# --- projections and predicates that had no query -------------------------------------------------


def nested(df: DataFrame) -> DataFrame:
    inner = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust")).alias("more"))
    return df.select("o_orderkey", inner.alias("s"), F.array("o_orderkey", "o_custkey").alias("l"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders")
def projection_of_leaves(spark, sf_dir):
    df = nested(orders(spark, sf_dir))
    rows = df.select(*of_leaves(df.schema, ["o_orderkey", "s.more.price", "s.status"]))
    if rows.schema["s"].dataType.simpleString() != "struct<status:string,more:struct<price:double>>":
        raise AssertionError(rows.schema.simpleString())
    return rows.select("o_orderkey", "s.status", "s.more.price")


@query("SELECT o_totalprice AS price, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def output_of_members(spark, sf_dir):
    q = Query(predicate=col("s.status").eq("F"), columns=(Physical("o_orderkey"), Physical("s")), output=("s.more.price", "o_orderkey"))
    return q.rows(nested(orders(spark, sf_dir)))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def window_in_file_order(spark, sf_dir):
    df = spark.read.parquet(*listed(spark, f"{ranges(spark, sf_dir)}/flat")[:1])
    return Query(offset=40, limit=20).rows(df, in_order=True).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders) WHERE pos % 3 <> 0")
def many_rows_excluded(spark, sf_dir):
    df = orders(spark, sf_dir)
    gone = RowsExcluded(frozenset(range(0, df.count(), 3)))
    return df.where(compiled(gone, df.schema)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.05")
def predicate_of_other_names(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    p = renamed(col("tax").gt(0.05), {"tax": "l_tax"})
    if columns(p) != {"l_tax"}:
        raise AssertionError(columns(p))
    return df.where(compiled(p, df.schema)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 500")
def folded_constants(spark, sf_dir):
    df = orders(spark, sf_dir)
    p = folded((col("year").eq(1996) & col("o_custkey").gt(500)) | col("gone").is_not_null(), {"year": 1996, "gone": None})
    return df.where(compiled(p, df.schema)).select("o_orderkey")


ERRORS = [
    ("unknown column", "SchemaError"), ("another type", "SchemaError"), ("a group", "SchemaError"), ("a bare list", "SchemaError"), ("decimal elements", "SchemaError"), ("no elements", "SchemaError"),
    ("no produced column", "ValueError"), ("a column twice", "ValueError"), ("a widening that is none", "SchemaError"), ("a filter text", "FilterError"), ("a constant of another type", "SchemaError"),
    ("a reserved entry", "WriteError"), ("an unset field", "WriteError"), ("a missing capability", "CapabilityError"), ("another reference system", "SchemaError"),
]


@query("SELECT name, error FROM (VALUES " + ", ".join(f"('{n}', '{e}')" for n, e in ERRORS) + ") t(name, error)")
def errors_before_reading(spark, sf_dir):
    """What is refused, and by which class, on a table without rows."""
    df = nested(orders(spark, sf_dir)).withColumn("d", F.array(F.lit(Decimal("1.5")))).where("false")
    need = T.StructType([T.StructField("a", T.LongType(), False)])
    doc = {"primary_column": "g", "columns": {"g": {"crs": {"id": {"authority": "EPSG", "code": 3857}}}}}
    tries = {
        "unknown column": lambda: compiled(col("nothing").eq(1), df.schema),
        "another type": lambda: compiled(col("o_orderkey").eq("x"), df.schema),
        "a group": lambda: compiled(col("s").eq("x"), df.schema),
        "a bare list": lambda: compiled(col("l").eq(1), df.schema),
        "decimal elements": lambda: compiled(col("d").any().eq(Decimal("1.5")), df.schema),
        "no elements": lambda: compiled(col("o_orderkey").any().eq(1), df.schema),
        "no produced column": lambda: Query(columns=()).rows(df),
        "a column twice": lambda: Query(columns=(Physical("o_orderkey"), Physical("o_orderkey"))).rows(df),
        "a widening that is none": lambda: Query(columns=(Promoted("x", "o_orderkey", "int"),)).rows(df),
        "a filter text": lambda: parse("upper(o_orderkey) = 'X'", df.schema),
        "a constant of another type": lambda: folded(col("k").eq("x"), {"k": 1}),
        "a reserved entry": lambda: WriteOptions(entries={"geo": "{}"}),
        "an unset field": lambda: RowBuilder(need).end(),
        "a missing capability": lambda: open_fileset(spark, f"{ranges(spark, sf_dir)}/flat").capabilities.require(merge_on_read=True),
        "another reference system": lambda: geo.check_crs(doc, "g", "EPSG:4326"),
    }
    out = []
    for name, _ in ERRORS:
        try:
            tries[name]()
            out.append((name, "none"))
        except (MarlstoneError, ValueError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "name string, error string")


@query("SELECT o_orderkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def quantified_conjunction_on_struct_list(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("items", F.array(F.struct(F.col("o_totalprice").alias("price"))))
    p = Quantified("any", col("items.price").gt(100000.0) & col("items.price").is_not_null())
    return df.where(compiled(p, df.schema)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


# --- materializers and sinks ----------------------------------------------------------------------


@query("SELECT o_orderkey AS key, upper(o_orderpriority) AS label FROM orders WHERE o_orderstatus = 'P'")
def materialized_rows(spark, sf_dir):
    rows = orders(spark, sf_dir).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority")
    return hooks.mapped(rows, lambda r: (r.o_orderkey, r.o_orderpriority.upper()), "key long, label string")


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def materialized_batches(spark, sf_dir):
    def add(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([sum(b.column(0).to_pylist())], pa.int64())})

    return hooks.mapped_batches(orders(spark, sf_dir).select("o_custkey"), add, "part long").agg(F.sum("part").alias("total"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_stream(spark, sf_dir):
    """Through an Arrow stream and back."""
    sink = io.BytesIO()
    sinks.write_arrow(table(spark, sf_dir, "nation"), sink)
    return spark.createDataFrame(pa.ipc.open_stream(sink.getvalue()).read_all())


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def arrow_c_stream(spark, sf_dir):
    """Handed over by Arrow's C interface."""
    reader = sinks.arrow_batches(table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name"))
    return spark.createDataFrame(pa.RecordBatchReader.from_stream(reader).read_all())


@query("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation")
def json_array(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return spark.createDataFrame([("".join(sinks.json_lines(rows, array=True)),)], "json string")


@query("SELECT '{\"n\":' || n_nationkey || ',\"u\":\"00000000-0000-0000-0000-0000000000' || lpad(lower(to_hex(n_nationkey)), 2, '0') || '\"}' AS json FROM nation")
def json_uuid(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex("n_nationkey"), 32, "0"))
    return sinks.json_rows(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), raw.alias("u", metadata={"logical": "uuid"})))


@query("SELECT o_orderkey, '{\"at\":' || epoch_us(o_orderdate) || ',\"d\":' || (CAST(o_orderdate AS DATE) - DATE '1970-01-01') || ',\"l\":[' || o_custkey || ',null],\"p\":' || CAST(o_custkey AS DECIMAL(12,2)) || ',\"s\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def variant_to_json(spark, sf_dir):
    value = F.struct(F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("d"), F.array("o_custkey", F.lit(None)).alias("l"), (F.col("o_custkey") + F.lit(Decimal("0.00"))).cast("decimal(12,2)").alias("p"), F.col("o_orderstatus").alias("s"))
    return orders(spark, sf_dir).select("o_orderkey", variant_json(F.to_variant_object(value)).alias("json"))


@query("SELECT '{\"k\":' || n_nationkey || ',\"v\":{\"d\":19723,\"n\":\"' || n_name || '\"}}' AS json FROM nation")
def json_of_variants(spark, sf_dir):
    v = F.to_variant_object(F.struct(F.lit(date(2024, 1, 1)).alias("d"), F.col("n_name").alias("n")))
    return sinks.json_rows(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), v.alias("v")))


@query("SELECT l_orderkey || ',' || CAST(l_quantity AS VARCHAR) || ',' || CAST(l_tax AS VARCHAR) AS line FROM lineitem")
def csv_floats(spark, sf_dir):
    return sinks.delimited_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax"))


@query("SELECT n_nationkey || chr(9) || '{\"name\":\"' || n_name || '\",\"day\":19723}' AS line FROM nation")
def tsv_groups(spark, sf_dir):
    return sinks.delimited_rows(table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.lit(date(2024, 1, 1)).alias("day")).alias("g")), "\t")


@once
def optioned(spark: SparkSession, sf_dir: str, path: str) -> None:
    options = WriteOptions(codec="gzip", page_version=2, row_group_bytes=1 << 20, dictionary={"l_tax": False}, bloom={"l_orderkey": Bloom(60_000, 0.01)})
    write(table(spark, sf_dir, "lineitem"), path, options)


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_orderkey IN (1, 77, 130)")
def written_with_options(spark, sf_dir):
    df = spark.read.parquet(optioned(spark, sf_dir))
    return df.where(compiled(col("l_orderkey").isin(1, 77, 130), df.schema)).select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT 'GZIP' AS codec, false AS tax_has_dictionary, true AS flag_has_dictionary, count(*) AS rows FROM lineitem")
def write_options_in_footer(spark, sf_dir):
    def told(path, meta):
        for g in range(meta.num_row_groups):
            by = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            yield by["l_tax"].compression, by["l_tax"].has_dictionary_page, by["l_returnflag"].has_dictionary_page, meta.row_group(g).num_rows

    rows = explain.footer_rows(spark, listed(spark, optioned(spark, sf_dir)), told, "codec string, tax_has_dictionary boolean, flag_has_dictionary boolean, rows long")
    return rows.groupBy("codec", "tax_has_dictionary", "flag_has_dictionary").agg(F.sum("rows").alias("rows"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END AS n_tags, CASE WHEN n_nationkey % 3 = 0 THEN 1.5::DOUBLE END AS x FROM nation")
def built_rows(spark, sf_dir):
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("g", T.StructType([T.StructField("name", T.StringType(), False), T.StructField("region", T.IntegerType())])), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("x", T.DoubleType())])
    b = RowBuilder(schema)
    for r in table(spark, sf_dir, "nation").collect():
        b.set("id", r.n_nationkey)
        with b.group("g"):
            b.set("name", r.n_name).set("region", r.n_regionkey)
        if r.n_nationkey % 2 == 0:
            b.add("tags", "a").add("tags", r.n_name)
        if r.n_nationkey % 3 == 0:
            b.set("x", 1.5)
        b.end()
    return b.frame(spark).select("id", "g.name", "g.region", F.coalesce(F.size(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(0)).alias("n_tags"), "x")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END, 100 + row_number() OVER () - 1) AS id FROM orders")
def coalesce_to_position(spark, sf_dir):
    df = orders(spark, sf_dir)
    made = df.withColumn("c", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")))
    return Query(columns=(Physical("o_orderkey"), Coalesce("id", "c", RowPosition("_", 100)))).rows(made)


@query("SELECT CAST(o_custkey AS DECIMAL(20,2)) AS wide, o_orderkey, CAST(7 AS BIGINT) AS n FROM orders")
def promoted_decimals(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("d", F.col("o_custkey").cast("decimal(12,2)"))
    return Query(columns=(Promoted("wide", "d", "decimal(20,2)"), Physical("o_orderkey"), Constant("n", 7))).rows(df).withColumn("n", F.col("n").cast("long"))


# --- geometry -------------------------------------------------------------------------------------


def _double(c):
    """Big-endian bytes, as hex, of a small number with few binary digits."""
    a = F.abs(c)
    e = F.when(a > 0, F.floor(F.log2(F.when(a > 0, a)))).otherwise(0).cast("long")
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("long")
    bits = F.shiftleft(e + 1023, 52).bitwiseOR(mantissa)
    bits = F.when(c < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
    return F.when(a == 0, F.lit("0" * 16)).otherwise(F.lpad(F.hex(bits), 16, "0"))


def shapes(df: DataFrame) -> DataFrame:
    """A rectangle per order, one to four wide, as a polygon of one ring; the other diagonal's line for
    every third."""
    df = points(df)
    w = (F.col("o_orderkey") % 4 + 1).cast("double")
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + w, F.col("y") + 1
    # columns of their own, which Spark works out once: inside the cases below it would do so for each byte
    df = df.withColumns({"x1": x1, "y1": y1, "_x0": _double(x0), "_y0": _double(y0), "_x1": _double(x1), "_y1": _double(y1)})
    # little-endian: the digits from the end, and those of each byte in their order again
    df = df.withColumns({n: F.regexp_replace(F.reverse(n), "(.)(.)", "$2$1") for n in ("_x0", "_y0", "_x1", "_y1")})
    ring = F.concat(F.lit("010300000001000000" + "05000000"), "_x0", "_y0", "_x1", "_y0", "_x1", "_y1", "_x0", "_y1", "_x0", "_y0")
    line = F.concat(F.lit("0102000000" + "02000000"), "_x0", "_y0", "_x1", "_y1")
    return df.withColumn("geom", F.when(F.col("o_orderkey") % 11 != 0, F.unhex(F.when(F.col("o_orderkey") % 3 == 0, line).otherwise(ring)))).drop("_x0", "_y0", "_x1", "_y1")


SHAPES = f"(SELECT *, x + o_orderkey % 4 + 1 AS x1, y + 1 AS y1, o_orderkey % 3 = 0 AS is_line FROM {POINTS})"


def shaped(name: str, p, sql: str) -> None:
    def rows(spark, sf_dir):
        df = shapes(orders(spark, sf_dir))
        return df.where(compiled(parse(p, df.schema) if isinstance(p, str) else p, df.schema)).select(*ORDER)

    QUERIES[name], SQL[name] = rows, f"SELECT o_orderkey FROM {SHAPES} WHERE has AND ({sql})"


TOUCH = "x <= 30 AND x1 >= -10 AND y <= 40 AND y1 >= -20"
INSIDE = "x >= -10 AND x1 <= 30 AND y >= -20 AND y1 <= 40"
shaped("bbox_intersects_shapes", BoxTest("geom", "intersects", Box(-10, -20, 30, 40)), TOUCH)
shaped("bbox_covered_by_shapes", BoxTest("geom", "covered_by", Box(-10, -20, 30, 40)), INSIDE)
shaped("bbox_contains_shapes", BoxTest("geom", "contains", Box(5.5, 5.25, 5.75, 5.5)), "x <= 5.5 AND x1 >= 5.75 AND y <= 5.25 AND y1 >= 5.5")
shaped("bbox_equals_shapes", BoxTest("geom", "equals", Box(7, -3, 9, -2)), "x = 7 AND y = -3 AND x1 = 9")
shaped("st_coveredby_shapes", "ST_CoveredBy(geom, ST_MakeEnvelope(-10, -20, 30, 40))", INSIDE)
shaped("st_within_shapes", "ST_Within(geom, ST_MakeEnvelope(-10, -20, 30, 40))", INSIDE)
shaped("st_intersects_shapes", "ST_Intersects(geom, ST_MakeEnvelope(-100, -95, 200, 95))", "x <= 200 AND x1 >= -100 AND NOT (is_line AND x < -100 AND y < -95)")
shaped("st_covers_point", "ST_Covers(geom, ST_GeomFromText('POINT (6 -2)'))", "CASE WHEN is_line THEN x <= 6 AND x1 >= 6 AND y <= -2 AND y1 >= -2 AND (6 - x) * 1.0 = (-2 - y) * (x1 - x) ELSE x <= 6 AND x1 >= 6 AND y <= -2 AND y1 >= -2 END")
shaped("st_contains_point", "ST_Contains(geom, ST_GeomFromText('POINT (6.5 -2.5)'))", "CASE WHEN is_line THEN x < 6.5 AND x1 > 6.5 AND y < -2.5 AND y1 > -2.5 AND (6.5 - x) = (-2.5 - y) * (x1 - x) ELSE x < 6.5 AND x1 > 6.5 AND y < -2.5 AND y1 > -2.5 END")
shaped("st_overlaps_shapes", "ST_Overlaps(geom, ST_MakeEnvelope(-10.5, -20.5, 30.5, 40.5))", f"NOT is_line AND x < 30.5 AND x1 > -10.5 AND y < 40.5 AND y1 > -20.5 AND NOT (x >= -10.5 AND x1 <= 30.5 AND y >= -20.5 AND y1 <= 40.5)")
shaped("st_touches_shapes", "ST_Touches(geom, ST_MakeEnvelope(-10, -200, 300, 200))", "x1 = -10")
shaped("st_crosses_shapes", "ST_Crosses(geom, ST_MakeEnvelope(-10.5, -200, 300, 200))", "is_line AND x < -10.5 AND x1 > -10.5")
shaped("st_equals_shape", "ST_Equals(geom, ST_GeomFromText('POLYGON ((7 -3, 9 -3, 9 -2, 7 -2, 7 -3))'))", "x = 7 AND y = -3 AND x1 = 9 AND NOT is_line")


class Larger:
    """A caller's own filter: geometries whose box is wider than a bound, near a box."""

    column = "geom"

    def __init__(self, width: float, near: Box):
        self.width, self.near = width, near

    def box(self):
        return "intersects", self.near

    def matches(self, shape) -> bool:
        xs = [p[0] for p in shape.coordinates()]
        return max(xs) - min(xs) > self.width


shaped("geometry_filter_hook", GeometryFiltered(Larger(2.5, Box(-10, -20, 30, 40))), f"{TOUCH} AND x1 - x > 2.5")


@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {SHAPES} WHERE has AND o_totalprice > 300000")
def bounds_shapes(spark, sf_dir):
    return Query(predicate=col("o_totalprice").gt(300000.0)).bounds(shapes(orders(spark, sf_dir)), "geom")


#: Files with small row groups have long footers, which every task of a file reads.
GEO_FILE_ROWS = 50_000


@once
def geoparquet(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Shapes in vertical strips, each strip's files with their own box and a double covering."""
    rows = orders(spark, sf_dir)
    files = file_number(rows, 8, GEO_FILE_ROWS)
    df = shapes(rows.select("o_orderkey", "o_custkey").repartition(files)).select("o_orderkey", "x", "geom")
    for i in range(4):
        # coalesced: the other strips' rows are left out, so four tasks make one file
        geo.write(df.where((F.col("x") >= -180 + 90 * i) & (F.col("x") < -90 + 90 * i)).coalesce(files // 4), f"{path}/strip={i}", "geom", covering="double", row_group_rows=500)


@query(f"SELECT o_orderkey, CAST(floor((x + 180) / 90) AS BIGINT) AS strip FROM {SHAPES} WHERE has AND ({TOUCH})")
def geoparquet_filtered(spark, sf_dir):
    df = open_fileset(spark, geoparquet(spark, sf_dir)).frame()
    return df.where(compiled(BoxTest("geom", "intersects", Box(-10, -20, 30, 40)), df.schema, {"geom": "bbox"})).select("o_orderkey", "strip")


@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {SHAPES} WHERE has")
def geoparquet_estimated_bounds(spark, sf_dir):
    return spark.createDataFrame([tuple(geo.estimated_bounds(spark, listed(spark, geoparquet(spark, sf_dir))))], "xmin double, ymin double, xmax double, ymax double")


@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM {SHAPES} WHERE has AND x >= 0")
def geoparquet_bounds_of_strips(spark, sf_dir):
    """Whole strips: paths and declared boxes decide."""
    return open_fileset(spark, geoparquet(spark, sf_dir)).bounds("geom", col("strip").ge(2), {"geom": "bbox"})


@query("SELECT 'geom' AS name, 'LineString,Polygon' AS types, 'WKB' AS encoding, 'bbox' AS covering")
def geoparquet_metadata(spark, sf_dir):
    docs = {f: geo.metadata(spark, f) for f in listed(spark, geoparquet(spark, sf_dir))}
    doc = geo.joined(docs)
    (name,) = geo.geometry_columns(doc)
    c = doc["columns"][name]
    geo.check_crs(doc, name, "EPSG:4326")
    return spark.createDataFrame([(name, ",".join(c["geometry_types"]), c["encoding"], c["covering"]["bbox"]["xmin"][0])], "name string, types string, encoding string, covering string")


@once
def native(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Shapes as the native type, without a covering: row groups have box statistics."""
    df = shapes(orders(spark, sf_dir)).where("geom is not null").select("o_orderkey", "x", "geom")
    geo.write(df.repartitionByRange(file_number(df.select("x"), 4, GEO_FILE_ROWS), "x"), path, "geom", covering=None, metadata="2.0", row_group_rows=200)


@query(f"SELECT o_orderkey FROM {SHAPES} WHERE has AND ({TOUCH})")
def native_geometry_filtered(spark, sf_dir):
    df = open_fileset(spark, native(spark, sf_dir)).frame()
    return df.where(compiled(BoxTest("geom", "intersects", Box(-10, -20, 30, 40)), df.schema)).select("o_orderkey")


@query("SELECT true AS some_ruled_out, 'geom' AS native, '2.0.0' AS version")
def native_geometry_statistics(spark, sf_dir):
    files = listed(spark, native(spark, sf_dir))
    told = explain.explain(spark, files, BoxTest("geom", "intersects", Box(-10, -200, 30, 200)))
    gone = told.where("verdict = 'none'").count() > 0
    meta = explain._footer(spark, files[0])
    return spark.createDataFrame([(gone, ",".join(native_geometries(meta)), geo.metadata(spark, files[0])["version"])], "some_ruled_out boolean, native string, version string")


@query(f"SELECT count(*) AS n FROM {SHAPES} WHERE has AND x <= 91 AND x1 >= -95")
def count_by_boxes(spark, sf_dir):
    """Row groups whose box is within the query are counted from their footers."""
    return counting.count(spark, listed(spark, geoparquet(spark, sf_dir)), BoxTest("geom", "intersects", Box(-95, -200, 91, 200)))


@query("SELECT strip, 'none' AS verdict FROM (VALUES (0), (3)) t(strip)")
def explain_boxes(spark, sf_dir):
    """Strips apart from the query are ruled out by their row groups' boxes."""
    told = explain.explain(spark, listed(spark, geoparquet(spark, sf_dir)), BoxTest("geom", "intersects", Box(-80, -200, 80, 200)))
    strip = F.regexp_extract("file", r"strip=(\d)", 1).cast("int").alias("strip")
    return told.groupBy(strip).agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("v")).where("verdict = v and verdict = 'none'").drop("v")


# --- tables ---------------------------------------------------------------------------------------

ORDER_FIELDS = [(1, "key", "long"), (2, "cust", "long"), (3, "status", "string"), (4, "price", "double"), (5, "at", "timestamp")]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))


KEYED = "SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS at FROM orders"
FIRST, SECOND = "o_orderkey % 10 < 7", "o_orderkey % 10 >= 7"


@once
def plain_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Two snapshots; the files of a snapshot hold one range of keys each."""
    rows = order_rows(spark, sf_dir)
    w = TableWriter(spark, f"{path}/sales/orders", ORDER_FIELDS)
    for cond in ("key % 10 < 7", "key % 10 >= 7"):
        w.append(rows.where(cond).repartitionByRange(4, "key"))
        w.commit()
    other = TableWriter(spark, f"{path}/geo/nations", [(1, "id", "int"), (2, "name", "string")])
    other.append(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    other.commit()


def plain(spark: SparkSession, sf_dir: str) -> str:
    return f"{plain_table(spark, sf_dir)}/sales/orders"


@query(KEYED)
def iceberg_scan(spark, sf_dir):
    return Table(spark, plain(spark, sf_dir)).frame()


@query(f"{KEYED} WHERE {FIRST}")
def iceberg_snapshot(spark, sf_dir):
    return Table(spark, plain(spark, sf_dir), snapshot_id=1001).frame()


@query(f"SELECT o_orderkey AS key FROM orders WHERE {FIRST}")
def iceberg_pinned_metadata(spark, sf_dir):
    root = plain(spark, sf_dir)
    return Table(spark, root, metadata=f"{root}/metadata/v1.metadata.json").frame(columns=["key"])


@query("SELECT 'geo.nations' AS name, 25::BIGINT AS n UNION ALL SELECT 'sales.orders', count(*) FROM orders")
def iceberg_warehouse(spark, sf_dir):
    parts = [t.frame().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in sorted(warehouse(spark, plain_table(spark, sf_dir)).items())]
    return parts[0].unionByName(parts[1])


@query(f"{KEYED} WHERE o_orderkey BETWEEN 20 AND 60 AND o_orderdate >= TIMESTAMP '1996-01-01'")
def iceberg_filtered(spark, sf_dir):
    return Table(spark, plain(spark, sf_dir)).frame(col("key").between(20, 60) & col("at").ge(datetime(1996, 1, 1)))


@query("SELECT 8 AS files, 2 AS left_files")
def iceberg_pruned_files(spark, sf_dir):
    t = Table(spark, plain(spark, sf_dir))
    return t.files().agg(F.count(F.lit(1)).cast("int").alias("files")).select("files", F.lit(t.files(col("key").lt(20)).count()).alias("left_files"))


@query("SELECT count(*) AS n FROM orders")
def iceberg_count(spark, sf_dir):
    return Table(spark, plain(spark, sf_dir)).count()


@query("SELECT true AS merge_on_read, 'none' AS partitions, 'manifests' AS statistics")
def dataset_capabilities(spark, sf_dir):
    c = Table(spark, plain(spark, sf_dir)).capabilities.require(merge_on_read=True)
    return spark.createDataFrame([(c.merge_on_read, c.partitions, c.statistics)], "merge_on_read boolean, partitions string, statistics string")


@once
def evolved_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Renamed, reordered, widened, dropped and added fields; a name that belongs to another field now."""
    rows = orders(spark, sf_dir)
    w = TableWriter(spark, path, [(1, "id", "int"), (2, "status", "string"), (3, "old", "double")])
    w.append(rows.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("int").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("old")))
    w.commit()
    w.evolve([(4, "status", "string", "new"), (2, "state", "string"), (1, "id", "long"), (5, "note", "string")])
    w.append(rows.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("status"), F.lit(None).cast("string").alias("note")))
    w.commit()


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderpriority END AS status, o_orderstatus AS state, o_orderkey AS id, CAST(NULL AS VARCHAR) AS note FROM orders")
def iceberg_evolution(spark, sf_dir):
    return Table(spark, evolved_table(spark, sf_dir)).frame()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority = 'new'")
def iceberg_filter_on_default(spark, sf_dir):
    return Table(spark, evolved_table(spark, sf_dir)).frame(col("status").eq("new"), columns=["id"])


@once
def parted_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Identity partitions whose column the files leave out."""
    w = TableWriter(spark, path, [(1, "key", "long"), (2, "status", "string")], partition="status")
    for s in ("F", "O", "P"):
        w.append(orders(spark, sf_dir).where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("key")).coalesce(2), constant=s)
    w.commit()


@query("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'")
def iceberg_partition_constants(spark, sf_dir):
    return Table(spark, parted_table(spark, sf_dir)).frame(col("status").ne("O"))


@query("SELECT 'F' AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def iceberg_count_of_partition(spark, sf_dir):
    """Counted by manifest entries: the partition value decides every file."""
    return Table(spark, parted_table(spark, sf_dir)).count(col("status").eq("F")).select(F.lit("F").alias("status"), "n")


def deleting(spark: SparkSession, sf_dir: str, path: str, version: int) -> tuple[TableWriter, list[str]]:
    w = TableWriter(spark, path, ORDER_FIELDS[:3], version)
    rows = order_rows(spark, sf_dir).select("key", "cust", "status")
    files = w.append(rows.repartitionByRange(file_number(rows, 3), "key"))
    w.commit()
    return w, files


@once
def position_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    w, files = deleting(spark, sf_dir, path, 2)
    w.delete_positions(w.positions_of(files, F.col("key") % 4 == 1, "key long"))
    w.commit()


@query("SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 <> 1")
def iceberg_position_deletes(spark, sf_dir):
    return Table(spark, position_table(spark, sf_dir)).frame()


@once
def equality_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Deleted rows come before, rows that would be deleted after the deletes."""
    rows = order_rows(spark, sf_dir).select("key", "cust", F.nullif("status", F.lit("P")).alias("status"))
    w = TableWriter(spark, path, ORDER_FIELDS[:3])
    w.append(rows.where("key % 2 = 0"))
    w.commit()
    w.delete_equal(rows.where("cust % 5 = 0").select("cust", "status").distinct(), ["cust", "status"])
    w.commit()
    w.append(rows.where("key % 2 = 1"))
    w.commit()


@query("WITH t AS (SELECT o_orderkey AS key, o_custkey AS cust, nullif(o_orderstatus, 'P') AS status FROM orders) SELECT key, cust, status FROM t WHERE key % 2 = 1 OR cust % 5 <> 0")
def iceberg_equality_deletes(spark, sf_dir):
    return Table(spark, equality_table(spark, sf_dir)).frame()


@once
def vectors(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Files in the order of keys, each with position deletes that a vector supersedes."""
    w = TableWriter(spark, path, ORDER_FIELDS[:3], 3)
    rows = order_rows(spark, sf_dir).select("key", "cust", "status")
    files = w.append(rows.repartitionByRange(file_number(rows, 2), "key").sortWithinPartitions("key"))
    w.commit()
    w.delete_positions(w.positions_of(files, F.col("key") % 4 == 1, "key long"))
    w.commit()
    w.delete_vectors(w.positions_of(files, F.col("key") % 3 == 0, "key long"))
    w.commit()


@query("SELECT o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0")
def iceberg_deletion_vectors(spark, sf_dir):
    return Table(spark, vectors(spark, sf_dir)).frame()


@query("SELECT o_orderkey AS key, 1::BIGINT AS _last_updated_sequence_number, o_orderkey AS _row_id FROM orders WHERE o_orderkey % 3 <> 0")
def iceberg_row_lineage(spark, sf_dir):
    return Table(spark, vectors(spark, sf_dir)).frame(columns=["key"], lineage=True)


@once
def mapped_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Files without ids, read by the table's names."""
    names = json.dumps([{"field-id": 1, "names": ["key", "o_orderkey"]}, {"field-id": 3, "names": ["status", "o_orderstatus"]}])
    w = TableWriter(spark, path, [(1, "key", "long"), (3, "state", "string"), (9, "more", "int", 5)], properties={"schema.name-mapping.default": names})
    w.append(orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_custkey"), ids=False, known={"o_orderkey": (1, "long")})
    w.commit()


@query("SELECT o_orderkey AS key, o_orderstatus AS state, 5 AS more FROM orders WHERE o_orderkey < 300")
def iceberg_name_mapping(spark, sf_dir):
    return Table(spark, mapped_table(spark, sf_dir)).frame(col("key").lt(300))


@once
def typed_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    kinds = [(1, "k", "long"), (2, "i", "int"), (3, "f", "float"), (4, "b", "boolean"), (5, "d", "date"), (6, "p", "decimal(12, 2)"), (7, "z", "timestamptz"), (8, "n", "timestamp"), (9, "raw", "binary"), (10, "l", {"type": "list", "element-id": 11, "element": "long", "element-required": False}), (12, "s", {"type": "struct", "fields": [{"id": 13, "name": "a", "type": "string", "required": False}, {"id": 14, "name": "c", "type": "long", "required": False}]})]
    o = orders(spark, sf_dir)
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("int").alias("i"), (F.col("o_custkey") / 4).cast("float").alias("f"), (F.col("o_custkey") % 2 == 0).alias("b"), F.to_date("o_orderdate").alias("d"), F.col("o_custkey").cast("decimal(12,2)").alias("p"), F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone()).alias("z"), F.col("o_orderdate").alias("n"), F.encode("o_orderstatus", "utf-8").alias("raw"), F.array("o_orderkey", "o_custkey").alias("l"), F.struct(F.col("o_orderstatus").alias("a"), F.col("o_custkey").alias("c")).alias("s"))
    w = TableWriter(spark, path, kinds)
    w.append(rows.repartitionByRange(3, "d"))
    w.commit()


@query("SELECT o_orderkey AS k, CAST(o_custkey AS INT) AS i, CAST(o_custkey / 4 AS FLOAT) AS f, o_custkey % 2 = 0 AS b, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DECIMAL(12,2)) AS p, o_orderdate AS n, o_orderstatus AS raw, o_custkey AS second, o_orderstatus AS a FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01' AND o_custkey > 10 AND o_custkey % 2 = 0")
def iceberg_types(spark, sf_dir):
    p = col("d").ge(date(1997, 6, 1)) & col("p").gt(Decimal("10.00")) & col("b").eq(True)
    rows = Table(spark, typed_table(spark, sf_dir)).frame(p)
    return rows.select("k", "i", "f", "b", "d", "p", "n", F.decode("raw", "utf-8").alias("raw"), F.col("l")[1].alias("second"), "s.a")


@once
def monthly_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Two files per year, west and east, told by partition values alone: bounds of the time are left out."""
    w = TableWriter(spark, path, [(1, "key", "long"), (2, "at", "timestamp"), (3, "geom", "geometry")], version=3, partition="at", transform="year")
    rows = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate")
    rows = rows.repartition(file_number(rows, 1, GEO_FILE_ROWS))
    rows = shapes(rows).select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"), "geom")
    halves = rows.select("*", F.year("at").alias("year"), (F.col("key") % 360 < 180).cast("int").alias("west")).where("year between 1995 and 2001")
    # a task for each file, all at once; shapes are made before, by more tasks
    w.append_split(halves.repartitionById(14, (F.col("year") - 1995) * 2 + F.col("west")), ["year", "west"], lambda told: int(told["year"]) - 1970)
    for e in w.entries:
        for side in ("lower_bounds", "upper_bounds"):
            e["data_file"][side] = [b for b in e["data_file"][side] if b["key"] != 2]
    w.commit()


@query("SELECT o_orderkey AS key, 4 AS left_files FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1998-03-01'")
def iceberg_partition_transform(spark, sf_dir):
    t, p = Table(spark, monthly_table(spark, sf_dir)), col("at").ge(datetime(1997, 3, 1)) & col("at").lt(datetime(1998, 3, 1))
    return t.frame(p, columns=["key"]).withColumn("left_files", F.lit(t.files(p).count()))


@query(f"SELECT o_orderkey AS key, 7 AS left_files FROM {SHAPES} WHERE has AND x <= -20 AND x1 >= -100")
def iceberg_geometry_bounds(spark, sf_dir):
    t, p = Table(spark, monthly_table(spark, sf_dir)), BoxTest("geom", "intersects", Box(-100, -200, -20, 200))
    return t.frame(p, columns=["key"]).withColumn("left_files", F.lit(t.files(p).count()))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 7 IN (1, 2) AND o_orderkey < 140000")
def deletion_vector_positions(spark, sf_dir):
    """Positions through a vector's bytes and back, over several containers and 32-bit parts."""
    keys = [r[0] for r in orders(spark, sf_dir).where("o_orderkey % 7 in (1, 2) and o_orderkey < 140000").select("o_orderkey").collect()]
    shift = (1 << 33) + 5
    back = deletion.positions(deletion.blob([k + shift for k in keys]), len(keys))
    return spark.createDataFrame([(int(k) - shift,) for k in back], "key long")


@query("SELECT o_orderkey AS k, 'old' AS a, CAST(o_custkey AS BIGINT) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 9 FROM orders WHERE o_orderkey % 2 = 1")
def reconciled_by_field_id(spark, sf_dir):
    o = orders(spark, sf_dir)
    table_fields = [Field(1, "k", "bigint"), Field(2, "a", "string", "old"), Field(3, "n", "bigint", 9)]
    return reconciled(table_fields, [(o.where("o_orderkey % 2 = 0").withColumn("i", F.col("o_custkey").cast("int")), {1: ("o_orderkey", "bigint"), 3: ("i", "int")}), (o.where("o_orderkey % 2 = 1"), {1: ("o_orderkey", "bigint"), 2: ("o_orderstatus", "string")})])


# --- catalogs -------------------------------------------------------------------------------------


@once
def stac(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A catalog with one collection whose items are the strips, and the same as an item table."""
    files = {i: listed(spark, f"{geoparquet(spark, sf_dir)}/strip={i}") for i in range(4)}
    rows, links = [], []
    for i, names in files.items():
        box = [-180.0 + 90 * i, -90.0, -90.0 + 90 * i + 4, 91.0]
        assets = {f"part{n}": {"href": f, "type": "application/vnd.apache.parquet"} for n, f in enumerate(names)}
        item = {"type": "Feature", "id": f"strip{i}", "bbox": box, "assets": assets, "collection": "shapes"}
        write_bytes(spark, f"{path}/shapes/strip{i}.json", json.dumps(item).encode())
        links.append({"rel": "item", "href": f"./strip{i}.json"})
        rows.append((f"strip{i}", tuple(box), {k: (a["href"], a["type"]) for k, a in assets.items()}, "shapes"))
    collection = {"type": "Collection", "id": "shapes", "extent": {"spatial": {"bbox": [[-180, -90, 184, 91]]}}, "links": links}
    write_bytes(spark, f"{path}/shapes/collection.json", json.dumps(collection).encode())
    root = {"type": "Catalog", "id": "root", "links": [{"rel": "child", "href": "./shapes/collection.json"}]}
    write_bytes(spark, f"{path}/catalog.json", json.dumps(root).encode())
    schema = "id string, bbox struct<xmin double, ymin double, xmax double, ymax double>, assets map<string, struct<href string, type string>>, collection string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/items")


NEAR = Box(-10, -20, 30, 40)


@query(f"SELECT o_orderkey FROM {SHAPES} WHERE has AND ({TOUCH})")
def stac_catalog(spark, sf_dir):
    df = items.catalog(spark, f"{stac(spark, sf_dir)}/catalog.json")["shapes"].frame(NEAR)
    return df.where(compiled(BoxTest("geom", "intersects", NEAR), df.schema, {"geom": "bbox"})).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {SHAPES} WHERE has AND ({TOUCH}) AND o_orderkey % 2 = 0")
def stac_item_table(spark, sf_dir):
    df = items.item_table(spark, f"{stac(spark, sf_dir)}/items", NEAR)["shapes"].frame(NEAR)
    return df.where(compiled(BoxTest("geom", "intersects", NEAR), df.schema, {"geom": "bbox"})).where("o_orderkey % 2 = 0").select("o_orderkey")


@query("SELECT id FROM (VALUES ('strip1'), ('strip2')) t(id)")
def stac_items_chosen(spark, sf_dir):
    found = items.catalog(spark, f"{stac(spark, sf_dir)}/catalog.json")["shapes"]
    return spark.createDataFrame([(i.id,) for i in found.items if items.touches(i.box, NEAR)], "id string")


@query("SELECT -180.0::DOUBLE AS xmin, -90.0::DOUBLE AS ymin, 184.0::DOUBLE AS xmax, 91.0::DOUBLE AS ymax")
def stac_extent(spark, sf_dir):
    box = items.catalog(spark, f"{stac(spark, sf_dir)}/catalog.json")["shapes"].extent
    return spark.createDataFrame([tuple(map(float, box))], "xmin double, ymin double, xmax double, ymax double")


# --- command line ---------------------------------------------------------------------------------


def said(spark: SparkSession, *words: str) -> list[str]:
    return list(cli.run(ship(spark), cli.arguments().parse_args(list(words))))


@query("SELECT o_orderkey || ',' || o_orderstatus AS line FROM orders WHERE o_orderkey < 700 AND o_orderstatus IN ('F', 'P') UNION ALL SELECT 'o_orderkey,o_orderstatus'")
def cli_cat_columns(spark, sf_dir):
    """The file's order of columns holds, whatever order is asked for."""
    lines = said(spark, "cat", f"{ranges(spark, sf_dir)}/flat", "--columns", "o_orderstatus,o_orderkey", "--filter", "o_orderkey < 700 AND o_orderstatus IN ('F', 'P')", "--format", "csv")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT 10 AS head, 3 AS limited, count(*)::VARCHAR AS rows FROM orders WHERE o_orderkey < 900")
def cli_head_and_count(spark, sf_dir):
    path = f"{ranges(spark, sf_dir)}/flat"
    return spark.createDataFrame([(len(said(spark, "head", path)), len(said(spark, "cat", path, "--limit", "3")), said(spark, "row-count", path, "--filter", "o_orderkey < 900")[0])], "head int, limited int, rows string")


@query("SELECT name, code FROM (VALUES ('usage', 2), ('schema', 3), ('format', 4), ('filter', 5), ('fine', 0)) t(name, code)")
def cli_exit_codes(spark, sf_dir):
    path = f"{ranges(spark, sf_dir)}/flat"
    broken = scratch(spark, "broken") + "/x.parquet"
    write_bytes(spark, broken, b"not a file of this format")
    tries = {"usage": ["cp", path], "schema": ["cat", path, "--columns", "nothing"], "format": ["stats", broken], "filter": ["cat", path, "--filter", "upper(o_orderstatus) = 'F'"], "fine": ["row-count", path]}
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        return spark.createDataFrame([(name, cli.main(words, spark)) for name, words in tries.items()], "name string, code int")
