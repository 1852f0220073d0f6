"""Registered queries over the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, temporal, variant
from .functions.compiling import compiled
from .functions.predicate import Box, BoxTest, GeometryTest, In, Not, Predicate, Quantified, RowsExcluded, col
from .operators.decimation import decimated
from .operators.deletes import without_equal
from .operators.reconcile import Field, reconciled
from .plans.query import Coalesce, Constant, Null, Physical, Promoted, Query, RowPosition
from .plans.sqlfilter import parse
from .session import ship
from .sources import avro
from .sources.sinks import delimited_rows, json_rows, text_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, source: str, rows: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rows(table(spark, sf_dir, source))
    SQL[name] = sql


def select(p: Predicate | str, *names: str, derive: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Rows of a predicate, given as a value or as a WHERE text."""

    def rows(df: DataFrame) -> DataFrame:
        df = derive(df) if derive else df
        q = parse(p, df.schema) if isinstance(p, str) else p
        return df.where(compiled(q, df.schema)).select(*names)

    return rows


LINE = ("l_orderkey", "l_linenumber")
KEYS = ", ".join(LINE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


FLAGSHIP = Query(
    predicate=col("l_quantity").ge(45) & ~col("l_returnflag").isin("A", "N"),
    columns=(Physical("order_key", "l_orderkey"), Physical("l_linenumber"), Physical("l_quantity"), Constant("origin", "lineitem"), RowPosition("row")),
    output=("order_key", "l_linenumber", "l_quantity", "origin"),
)
register("flagship", "lineitem", FLAGSHIP.rows, "SELECT l_orderkey AS order_key, l_linenumber, l_quantity, 'lineitem' AS origin FROM lineitem WHERE l_quantity >= 45 AND l_returnflag NOT IN ('A', 'N')")

# --- scalar predicates ------------------------------------------------------------------------


def where(name: str, p: Predicate | str, sql: str, source: str = "lineitem", names: tuple[str, ...] = LINE, derive=None, derived: str | None = None) -> None:
    register(name, source, select(p, *names, derive=derive), f"SELECT {', '.join(names)} FROM {derived or source} WHERE {sql}")


where("filter_eq_ne_range", (col("l_linenumber").eq(1) & col("l_quantity").gt(10)) | (col("l_shipdate").lt(datetime(1995, 1, 1)) & col("l_returnflag").ne("R")), "(l_linenumber = 1 AND l_quantity > 10) OR (l_shipdate < TIMESTAMP '1995-01-01' AND l_returnflag <> 'R')")
where("filter_always_true", ~In("l_orderkey", ()), "true")
where("filter_always_false", In("l_orderkey", ()), "false")
where("filter_not_flip", ~(col("l_quantity").gt(25) | col("l_tax").le(0.03)), "l_quantity <= 25 AND l_tax > 0.03")
where("filter_not_between", ~col("l_quantity").between(5, 45), "l_quantity < 5 OR l_quantity > 45")

NULLABLE = "(SELECT *, nullif(l_returnflag, 'A') AS flag, CASE WHEN l_linenumber > 3 THEN l_tax END AS tax FROM lineitem)"


def nullable(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.nullif("l_returnflag", F.lit("A"))).withColumn("tax", F.when(F.col("l_linenumber") > 3, F.col("l_tax")))


where("filter_in_null", In("flag", ("A", "R")), "flag IN ('A', 'R')", derive=nullable, derived=NULLABLE)
where("filter_not_in_null", Not(In("flag", ("R", "X"))), "flag IS NOT NULL AND flag <> 'R' AND flag <> 'X'", derive=nullable, derived=NULLABLE)
where("filter_is_null", col("flag").is_null() & col("tax").is_not_null(), "flag IS NULL AND tax IS NOT NULL", derive=nullable, derived=NULLABLE)
where("filter_not_null_and", ~(col("flag").eq("N") & col("tax").lt(0.05)), "flag <> 'N' OR tax >= 0.05", derive=nullable, derived=NULLABLE)

NAN = "(SELECT *, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN NULL ELSE l_discount - 0.05 END AS x FROM lineitem)"


def with_nan(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_linenumber") == 6, None).otherwise(F.col("l_discount") - 0.05))


nan = float("nan")
for key, p, sql in (
    ("eq_nan", col("x").eq(nan), "isnan(x)"),
    ("ne_nan", col("x").ne(nan), "x IS NOT NULL AND NOT isnan(x)"),
    ("gt", col("x").gt(0.01), "x > 0.01 AND NOT isnan(x)"),
    ("not_le", ~col("x").le(0.01), "x > 0.01 AND NOT isnan(x)"),
    ("ne_number", col("x").ne(0.03), "x <> 0.03"),
    ("in", col("x").isin(nan, 0.03), "isnan(x) OR x = 0.03"),
    ("order_nan", col("x").lt(nan), "false"),
):
    where(f"filter_nan_{key}", p, sql, derive=with_nan, derived=NAN)

ZERO = "(SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN '-0.0'::DOUBLE ELSE l_tax END AS z FROM lineitem)"


def with_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.when(F.col("l_linenumber") % 3 == 0, F.lit(0.0)).when(F.col("l_linenumber") % 3 == 1, F.lit(-0.0)).otherwise(F.col("l_tax")))


for key, p, sql in (("eq", col("z").eq(0.0), "z = 0"), ("ne", col("z").ne(-0.0), "z <> 0"), ("ge", col("z").ge(0), "z >= 0"), ("gt", col("z").gt(-0.0), "z > 0"), ("le", col("z").le(-0.0), "z <= 0")):
    where(f"filter_zero_{key}", p, sql, derive=with_zero, derived=ZERO)

where("filter_date", col("d").between(date(1994, 3, 1), date(1995, 2, 28)), "CAST(l_shipdate AS DATE) BETWEEN DATE '1994-03-01' AND DATE '1995-02-28'", derive=lambda df: df.withColumn("d", F.to_date("l_shipdate")))
where("filter_date_as_days", col("d").ge(9000), "CAST(l_shipdate AS DATE) - DATE '1970-01-01' >= 9000", derive=lambda df: df.withColumn("d", F.to_date("l_shipdate")))
where("filter_timestamp", col("ts").ge(datetime(2024, 1, 3, 12, 0, 0)), "ts >= TIMESTAMP '2024-01-03 12:00:00'", "events", ("event_id", "event_type"))
where("filter_timestamp_as_micros", col("ts").lt(1704300000000000), "epoch_us(ts) < 1704300000000000", "events", ("event_id",))
where("filter_decimal", col("price").gt(Decimal("12345.67")) & col("price").ne(Decimal("20000.00")), "CAST(l_extendedprice AS DECIMAL(12,2)) > 12345.67 AND CAST(l_extendedprice AS DECIMAL(12,2)) <> 20000.00", derive=lambda df: df.withColumn("price", F.col("l_extendedprice").cast("decimal(12,2)")))
where("filter_string_bytes", col("text").gt("é"), "text > 'é'", "documents", ("doc_id",))
where("filter_binary", col("raw").ge(b"R"), "l_returnflag >= 'R'", derive=lambda df: df.withColumn("raw", F.encode("l_returnflag", "utf-8")))
where("filter_float_literal", col("f").eq(0.05), "CAST(l_discount AS FLOAT) = CAST(0.05 AS FLOAT)", derive=lambda df: df.withColumn("f", F.col("l_discount").cast("float")))
where("filter_long_literal", col("l_linenumber").lt(3_000_000_000), "true")
where("filter_struct_leaf", col("s.flag").eq("R") & col("s.inner.tax").lt(0.02), "l_returnflag = 'R' AND l_tax < 0.02", derive=lambda df: df.withColumn("s", F.struct(F.col("l_returnflag").alias("flag"), F.struct(F.col("l_tax").alias("tax")).alias("inner"))))

for key, p, sql in (
    ("during", temporal.related("ts", "during", datetime(2024, 1, 2), datetime(2024, 1, 4)), "ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04'"),
    ("after_period", temporal.related("ts", "after", datetime(2024, 1, 2), datetime(2024, 1, 4)), "ts > TIMESTAMP '2024-01-04'"),
    ("period_after", temporal.related("ts", "after", datetime(2024, 1, 2), datetime(2024, 1, 4), literal_first=True), "ts < TIMESTAMP '2024-01-02'"),
    ("any_interacts", temporal.related("ts", "any_interacts", datetime(2024, 1, 2), datetime(2024, 1, 4)), "ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04'"),
    ("meets", temporal.related("ts", "meets", datetime(2024, 1, 2), datetime(2024, 1, 4)), "false"),
):
    where(f"temporal_{key}", p, sql, "events", ("event_id",))

# --- quantified predicates --------------------------------------------------------------------

LISTS = "(SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 7 = 1 THEN [] ELSE list_transform(embedding, lambda e: CASE WHEN e > 0.28::FLOAT THEN NULL ELSE e END) END AS v FROM embeddings)"


def lists(df: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda e: F.when(e > F.lit(0.28).cast("float"), None).otherwise(e))
    return df.withColumn("v", F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 7 == 1, F.array().cast("array<float>")).otherwise(v))


HIT = "len(list_filter(coalesce(v, []), lambda e: {}))"
SIZE = "len(coalesce(v, []))"
for key, p, sql in (
    ("any", col("v").any().gt(0.25), HIT.format("coalesce(e > 0.25::FLOAT, false)") + " > 0"),
    ("all", col("v").all().gt(-0.25), HIT.format("coalesce(e > -0.25::FLOAT, false)") + f" = {SIZE}"),
    ("one", col("v").one().gt(0.25), HIT.format("coalesce(e > 0.25::FLOAT, false)") + " = 1"),
    ("not_any", ~col("v").any().gt(0.25), HIT.format("coalesce(e <= 0.25::FLOAT, false)") + f" = {SIZE}"),
    ("not_all", ~col("v").all().gt(-0.25), HIT.format("coalesce(e <= -0.25::FLOAT, false)") + " > 0"),
    ("not_one", ~col("v").one().gt(0.25), HIT.format("coalesce(e > 0.25::FLOAT, false)") + " <> 1"),
    ("between", col("v").any().between(0.2, 0.21), HIT.format("coalesce(e >= 0.2::FLOAT AND e <= 0.21::FLOAT, false)") + " > 0"),
    ("any_null", col("v").any().is_null(), HIT.format("e IS NULL") + " > 0"),
    ("all_not_null", col("v.list.element").all().is_not_null(), HIT.format("e IS NOT NULL") + f" = {SIZE}"),
):
    where(f"quant_{key}", p, sql, "embeddings", ("vec_id",), lists, LISTS)

WORDS = "(SELECT doc_id, string_split(source, '1') AS parts FROM documents)"
where("quant_in", Quantified("any", In("parts", ("src", "2"))), "list_has_any(parts, ['src', '2'])", "documents", ("doc_id",), lambda df: df.withColumn("parts", F.split("source", "1")), WORDS)
MAPS = "(SELECT *, MAP {l_returnflag: l_tax, 'q': l_quantity} AS m FROM lineitem)"
where("map_value", col("m.value").any().gt(49.5), "l_quantity > 49.5 OR l_tax > 49.5", derive=lambda df: df.withColumn("m", F.create_map("l_returnflag", "l_tax", F.lit("q"), "l_quantity")), derived=MAPS)
where("map_key", col("m.key_value.key").any().eq("R"), "l_returnflag = 'R'", derive=lambda df: df.withColumn("m", F.create_map("l_returnflag", "l_tax", F.lit("q"), "l_quantity")), derived=MAPS)
where("list_of_struct_leaf", col("items.tax").any().lt(0.01) & col("items.list.element.flag").all().ne("A"), "l_tax < 0.01 AND l_returnflag <> 'A'", derive=lambda df: df.withColumn("items", F.array(F.struct(F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag")))))

# --- WHERE texts ------------------------------------------------------------------------------

for key, text in {
    "compare": "l_quantity >= 45 AND NOT (l_returnflag IN ('A', 'N'))",
    "between": "l_quantity BETWEEN 10 AND 12 OR l_tax NOT BETWEEN 0.01 AND 0.07",
    "not_in": "l_returnflag NOT IN ('A', 'R') AND l_linestatus <> 'F'",
    "nested": "NOT (l_linenumber = 1 OR (l_quantity < 30 AND l_discount != 0.05))",
    "null": "l_tax IS NOT NULL AND NOT (l_orderkey IS NULL)",
    "signed": "l_tax > -1 AND l_linenumber < 3000000000 AND l_orderkey IN (1, 2, 3, 7)",
}.items():
    where(f"sql_where_{key}", text, text)
where("sql_where_timestamp", "ts >= '2024-01-02 00:00:00' AND event_type = 'click'", "ts >= TIMESTAMP '2024-01-02 00:00:00' AND event_type = 'click'", "events", ("event_id",))

# --- produced columns, windows, aggregates ------------------------------------------------------


def shaped(q: Query, derive=None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: q.rows(derive(df) if derive else df)


PRODUCED = Query(predicate=col("flag").ne("N"), columns=(Physical("flag", "l_returnflag"), Promoted("number", "l_linenumber", "bigint"), Physical("l_orderkey"), Constant("origin", "x"), Constant("seven", 7), Null("nothing", "int")))
register("proj_rename_const_null_promote", "lineitem", shaped(PRODUCED), "SELECT l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS number, l_orderkey, 'x' AS origin, 7 AS seven, CAST(NULL AS INT) AS nothing FROM lineitem WHERE l_returnflag <> 'N'")
register("proj_output_order", "orders", shaped(Query(columns=(Physical("a", "o_orderkey"), Physical("b", "o_totalprice"), Physical("c", "o_orderstatus")), output=("c", "a"))), "SELECT o_orderstatus AS c, o_orderkey AS a FROM orders")
register("proj_row_position", "orders", shaped(Query(columns=(Physical("o_orderkey"), RowPosition("pos", 100)))), "SELECT o_orderkey, row_number() OVER () - 1 + 100 AS pos FROM orders")
register("proj_coalesce", "lineitem", lambda df: Query(columns=(Physical("l_orderkey"), Physical("l_linenumber"), Coalesce("flag2", "flag", Constant("_", "none")))).rows(nullable(df)), f"SELECT {KEYS}, coalesce(nullif(l_returnflag, 'A'), 'none') AS flag2 FROM lineitem")
register("window_offset_limit", "orders", lambda df: Query(predicate=col("o_totalprice").gt(1000.0), offset=100, limit=50).rows(df.orderBy("o_orderkey")).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 100")
register("count_filter", "lineitem", Query(predicate=col("l_quantity").gt(30) & col("l_returnflag").eq("R")).count, "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
register("count_always", "lineitem", Query(limit=3, offset=1).count, "SELECT count(*) AS n FROM lineitem")
register("batch_fold", "lineitem", lambda df: FLAGSHIP.filtered(df).agg(F.sum(F.col("l_linenumber").cast("long")).alias("total")), "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_quantity >= 45 AND l_returnflag NOT IN ('A', 'N')")

# --- geometry ---------------------------------------------------------------------------------

X, Y = "CAST(o_orderkey % 360 AS DOUBLE) - 180", "CAST(o_custkey % 180 AS DOUBLE) - 90"


def points(df: DataFrame) -> DataFrame:
    """A point per order in WKB; every eleventh is null. Its bytes are put together from the
    big-endian bits of the coordinates, without leaving the JVM."""

    def double(c):
        # small whole numbers: sign, exponent and mantissa follow from the binary logarithm
        a = F.abs(c)
        e = F.when(a >= 1, F.floor(F.log2(F.greatest(a, F.lit(1.0))))).otherwise(0).cast("long")
        mantissa = ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("long")
        bits = F.shiftleft(e + 1023, 52).bitwiseOR(mantissa)
        bits = F.when(c < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
        return F.when(a == 0, F.lit("0" * 16)).otherwise(F.lpad(F.hex(bits), 16, "0"))

    x, y = F.expr(X), F.expr(Y)
    hexed = F.concat(F.lit("0000000001"), double(x), double(y))
    return df.withColumn("x", x).withColumn("y", y).withColumn("geom", F.when(F.col("o_orderkey") % 11 != 0, F.unhex(hexed)))


POINTS = f"(SELECT *, {X} AS x, {Y} AS y, o_orderkey % 11 <> 0 AS has FROM orders)"
ORDER = ("o_orderkey",)


def near(name: str, p: Predicate | str, sql: str) -> None:
    where(name, p, f"has AND ({sql})", "orders", ORDER, points, POINTS)


near("bbox_intersects", BoxTest("geom", "intersects", Box(-10, -20, 30, 40)), "x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40")
near("bbox_covered_by", BoxTest("geom", "covered_by", Box(-10, -20, 30, 40)), "x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40")
near("bbox_contains", BoxTest("geom", "contains", Box(5, 5, 5, 5)), "x = 5 AND y = 5")
near("bbox_equals", BoxTest("geom", "equals", Box(7, -3, 7, -3)), "x = 7 AND y = -3")
near("bbox_not", Not(BoxTest("geom", "intersects", Box(-10, -20, 30, 40))), "NOT (x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40)")
near("st_intersects_rectangle", "ST_Intersects(geom, ST_MakeEnvelope(-10, -20, 30, 40))", "x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40")
near("st_within_rectangle", "ST_Within(geom, ST_MakeEnvelope(-10, -20, 30, 40))", "x > -10 AND x < 30 AND y > -20 AND y < 40")
near("st_covered_by", "ST_CoveredBy(geom, ST_MakeEnvelope(-10, -20, 30, 40))", "x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40")
near("st_touches", "ST_Touches(geom, ST_MakeEnvelope(-10, -20, 30, 40))", "x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40 AND (x IN (-10, 30) OR y IN (-20, 40))")
near("st_disjoint", "ST_Disjoint(geom, ST_MakeEnvelope(-10, -20, 30, 40))", "NOT (x BETWEEN -10 AND 30 AND y BETWEEN -20 AND 40)")
near("st_triangle", "ST_Intersects(geom, ST_GeomFromText('POLYGON ((0 0, 40 0, 0 40, 0 0))'))", "x >= 0 AND y >= 0 AND x + y <= 40")
near("st_dwithin", "ST_DWithin(geom, ST_GeomFromText('POINT (10 10)'), 13)", "(x - 10) * (x - 10) + (y - 10) * (y - 10) <= 169")
near("st_equals", "ST_Equals(geom, ST_GeomFromText('POINT (7 -3)'))", "x = 7 AND y = -3")
near("st_extent", "ST_Intersects(ST_Extent(geom), ST_MakeEnvelope(0, 0, 20, 20)) AND NOT ST_Covers(ST_Extent(geom), ST_MakeEnvelope(3, 3, 3, 3))", "x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20 AND NOT (x = 3 AND y = 3)")
near("geometry_line", GeometryTest("geom", "covered_by", geometry.from_wkt("LINESTRING (-50 -50, 50 50)")), "x = y AND x BETWEEN -50 AND 50")
register("bounds_points", "orders", lambda df: Query(predicate=col("o_totalprice").gt(400000.0)).bounds(points(df), "geom"), f"SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM {POINTS} WHERE has AND o_totalprice > 400000")


def covered(df: DataFrame) -> DataFrame:
    df = points(df)
    box = F.struct(*[F.col(c).alias(n) for n, c in (("xmin", "x"), ("ymin", "y"), ("xmax", "x"), ("ymax", "y"))])
    return df.withColumn("bbox", box).where(compiled(BoxTest("geom", "intersects", Box(0, 0, 50, 50)), points(df).withColumn("bbox", box).schema, {"geom": "bbox"})).select("o_orderkey")


register("bbox_with_covering", "orders", covered, f"SELECT o_orderkey FROM {POINTS} WHERE has AND x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50")

register("decimate_points", "orders", lambda df: decimated(points(df), "geom", Box(-100, -50, 100, 50), 50, 25, "o_orderkey").select("o_orderkey"), f"SELECT min(o_orderkey) AS o_orderkey FROM {POINTS} WHERE has AND x BETWEEN -100 AND 100 AND y BETWEEN -50 AND 50 GROUP BY floor((x + 100) / 4), floor((y + 50) / 4)")

# --- deletes and reconciliation -----------------------------------------------------------------

register("row_index_excluded", "orders", lambda df: df.where(compiled(RowsExcluded(frozenset(range(0, 1000, 3))), df.schema)).select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders) WHERE NOT (pos < 1000 AND pos % 3 = 0)")


def equality(df: DataFrame) -> DataFrame:
    df = nullable(df)
    deletes = df.where("l_quantity > 49").select("flag", "l_linenumber").distinct()
    return without_equal(df, deletes, ["flag", "l_linenumber"]).select(*LINE)


register("equality_deletes", "lineitem", equality, f"WITH t AS (SELECT * FROM {NULLABLE}), d AS (SELECT DISTINCT flag, l_linenumber FROM t WHERE l_quantity > 49) SELECT {KEYS} FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.flag IS NOT DISTINCT FROM t.flag AND d.l_linenumber IS NOT DISTINCT FROM t.l_linenumber)")


def evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = [Field(1, "id", "bigint"), Field(2, "amount", "double"), Field(3, "label", "string", "none"), Field(4, "note", "string")]
    old, cur = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return reconciled(new, [(old, {1: ("l_linenumber", "int"), 2: ("l_quantity", "double")}), (cur, {1: ("o_orderkey", "bigint"), 2: ("o_totalprice", "double"), 3: ("o_orderstatus", "string"), 4: ("o_orderpriority", "string")})])


QUERIES["evolved_union"] = evolved
SQL["evolved_union"] = "SELECT CAST(l_linenumber AS BIGINT) AS id, l_quantity AS amount, 'none' AS label, CAST(NULL AS VARCHAR) AS note FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders"

# --- sinks ------------------------------------------------------------------------------------

register("json_rows", "lineitem", lambda df: json_rows(nullable(df).select("l_orderkey", "flag", F.to_date("l_shipdate").alias("day"), F.col("l_shipdate").alias("at"))), f"SELECT '{{\"l_orderkey\":' || l_orderkey || CASE WHEN flag IS NULL THEN '' ELSE ',\"flag\":\"' || flag || '\"' END || ',\"day\":' || (CAST(l_shipdate AS DATE) - DATE '1970-01-01') || ',\"at\":' || epoch_us(l_shipdate) || '}}' AS json FROM {NULLABLE}")
register("csv_rows", "lineitem", lambda df: delimited_rows(nullable(df).select("l_orderkey", "flag", "l_linestatus")), f"SELECT l_orderkey || ',' || coalesce(flag, '') || ',' || l_linestatus AS line FROM {NULLABLE}")
register("tsv_rows", "orders", lambda df: delimited_rows(df.select("o_orderkey", "o_orderstatus"), "\t"), "SELECT o_orderkey || chr(9) || o_orderstatus AS line FROM orders")
register("text_rows", "nation", lambda df: text_rows(df.select("n_nationkey", "n_name")), "SELECT 'n_nationkey=' || n_nationkey || ', n_name=' || n_name AS line FROM nation")

# --- variants and row containers ------------------------------------------------------------------


def variants(df: DataFrame) -> DataFrame:
    v = F.parse_json(F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.array("l_linenumber", "l_suppkey").alias("numbers"), F.struct(F.col("l_partkey").alias("part")).alias("inner"))))
    df = df.withColumn("v", v)
    numbers = variant.get(F.col("v"), "$.numbers")
    return df.select(*LINE, variant.get(F.col("v"), "$.flag", "string").alias("flag"), variant.get(F.col("v"), "$.inner.part", "bigint").alias("part"), variant.get(F.col("v"), "$.flag", "int").alias("none"), F.array_join(variant.field_names(F.col("v")), ",").alias("names"), variant.field_count(F.col("v")).alias("n_fields"), variant.element_count(numbers).alias("n_elements"), variant.get(variant.element(numbers, 1), "$", "bigint").alias("second"), variant.field_count(numbers).alias("not_an_object"))


register("variant_navigation", "lineitem", variants, f"SELECT {KEYS}, l_returnflag AS flag, CAST(l_partkey AS BIGINT) AS part, CAST(NULL AS INT) AS none, 'flag,inner,numbers' AS names, 3 AS n_fields, 2 AS n_elements, CAST(l_suppkey AS BIGINT) AS second, CAST(NULL AS INT) AS not_an_object FROM lineitem")

AVRO_ROW = {"type": "record", "name": "row", "fields": [{"name": "l_orderkey", "type": "long"}, {"name": "l_linenumber", "type": "int"}, {"name": "flag", "type": ["null", "string"]}, {"name": "l_tax", "type": "double"}]}
AVRO_READER = {"type": "record", "name": "row", "fields": [{"name": "l_orderkey", "type": "long"}, {"name": "number", "aliases": ["l_linenumber"], "type": "long"}, {"name": "flag", "type": ["null", "string"]}, {"name": "added", "type": "string", "default": "d"}]}


def containers(df: DataFrame) -> DataFrame:
    rows = nullable(df).select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), "flag", "l_tax")
    return avro.decoded(avro.encoded(rows, AVRO_ROW), AVRO_READER)


register("avro_resolution", "lineitem", containers, f"SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS number, flag, 'd' AS added FROM {NULLABLE}")
