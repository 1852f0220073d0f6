"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once per application. Spark's own file server
    carries them, so no shared folder or installation is needed."""
    sc = spark.sparkContext
    # whole texts travel in Arrow batches: with Spark's default of 10,000 rows a batch of long
    # documents would be the largest thing in a worker's memory
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64m"):
        spark.conf.set(BATCH_BYTES, "8m")
    # Spark lists named files by a task for each, up to 10,000
    if spark.conf.get(LISTING_TASKS) == "10000":
        spark.conf.set(LISTING_TASKS, str(max(32, 4 * sc.defaultParallelism)))
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "marlstone")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names, or in local mode, where it
    names none, a folder of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the application's files there are deleted when it ends."""
    base = f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"
