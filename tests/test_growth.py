"""What must not grow faster than the input: plans, jobs, tasks, files."""

import uuid

import pytest

from marlstone import cli, scenarios
from marlstone.errors import SchemaError
from marlstone.functions.predicate import col
from marlstone.plans import counting, explain
from marlstone.sources import items, tables
from marlstone.sources.fileset import by_file, listed, open_fileset, open_per_file

SF = "/root/testdata/sf0.001"


def jobs(spark, run) -> int:
    """Spark jobs of a call."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """40 files of 25 rows."""
    path = str(tmp_path_factory.mktemp("many") / "t")
    spark.range(0, 1000, 1, 40).write.parquet(path)
    return path


def test_one_scan_for_all_files(spark, many, tmp_path):
    plan = scenarios.fileset_per_file(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    got = by_file(open_per_file(spark, many)).groupBy("name").count().collect()
    assert sorted(r["name"] + ".parquet" for r in got) == sorted(f.split("/")[-1] for f in listed(spark, many)) and {r["count"] for r in got} == {25}
    spark.range(3).write.parquet(f"{tmp_path}/x")
    spark.range(3).selectExpr("cast(id as int) id").write.parquet(f"{tmp_path}/y")
    with pytest.raises(SchemaError):
        by_file(open_per_file(spark, str(tmp_path)))


def test_listing(spark, tmp_path):
    base = tmp_path / "a [b]*"
    for name in ("x y.parquet", "k=%41/é+.parquet", "_hidden/z.parquet", "k=1/.z.parquet", "k=1/#?.parquet", "other.txt", "_k=1/z.parquet"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x")
    assert listed(spark, str(base)) == sorted(f"file:{base}/{n}" for n in ("x y.parquet", "k=%41/é+.parquet", "k=1/#?.parquet"))
    assert listed(spark, str(base / "other.txt")) == [str(base / "other.txt")]
    (tmp_path / "empty").mkdir()
    assert listed(spark, str(tmp_path / "empty")) == []
    # named files are not listed by a task for each
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) < 1000


def test_schemas_are_compared_by_tasks(spark, many, monkeypatch):
    def driver(*_):
        raise AssertionError("footers are read by the driver")

    monkeypatch.setattr("marlstone.sources.fileset.footers", driver)
    assert open_fileset(spark, many).frame().count() == 1000


def test_jobs_do_not_grow_with_files(spark, many, monkeypatch):
    monkeypatch.setattr(explain, "FILES_A_TASK", 1)
    odd = (col("id").lt(5)) | ~col("id").isin(7, 8)  # leaves files open
    assert jobs(spark, lambda: counting.count(spark, listed(spark, many), odd).collect()) < 12
    monkeypatch.undo()
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        args = cli.arguments().parse_args(["cat", many, "--format", "csv"])
        out = []
        assert jobs(spark, lambda: out.extend(cli.run(spark, args))) < 20
        assert out[0] == "id" and out[1:] == [str(r[0]) for r in open_fileset(spark, many).frame().collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_deletes_are_not_broadcast(spark, monkeypatch):
    want = scenarios.iceberg_position_deletes(spark, SF).count()
    monkeypatch.setattr(tables, "BROADCAST_DELETES", 10)
    for query in (scenarios.iceberg_position_deletes, scenarios.iceberg_equality_deletes, scenarios.iceberg_deletion_vectors):
        plan = query(spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan
    assert scenarios.iceberg_position_deletes(spark, SF).count() == want
    # one row per file is what is broadcast, not the rows of the files
    plan = scenarios.iceberg_position_deletes(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "Inner, BuildLeft" not in plan


def test_written_by_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(scenarios, "_made", {})
    monkeypatch.setattr(scenarios, "GEO_FILE_ROWS", 100)
    assert len(listed(spark, scenarios.geoparquet(spark, SF))) == 12  # 1,500 orders, four strips
    entries = tables.Table(spark, scenarios.vectors(spark, SF)).entries()
    assert len([e for e in entries if e.format == "puffin"]) == len([e for e in entries if not e.content]) == 2
    # shapes: each coordinate is worked out once, not once for each byte of each corner
    plan = scenarios.shapes(scenarios.orders(spark, SF)).select("geom")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2") < 30


def test_links_with_a_scheme_are_not_relative():
    assert items._at("file:///a/b/c.json", "file:/x/y.parquet") == "file:/x/y.parquet"
    assert items._at("file:///a/b/c.json", "./y.parquet") == "file:///a/b/y.parquet"
