"""Session settings the jobs rely on, and the one place that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "heliograde", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own settings instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call-site capture costs about a millisecond per column expression built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own, removed when the process ends; on a cluster every executor
    would write to its own disk and reads would miss files, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL_SCRATCH
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH, ignore_errors=True)
    return _LOCAL_SCRATCH


_LOCAL_SCRATCH: str | None = None
_WRITTEN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What the jobs of the block shuffle is removed when they end: for jobs that write a table, which is there then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Cuts the lineage, outlives any executor, lets later readers prune columns, and gives the
    optimizer the real size, so that joins with small results broadcast and large ones do not. ``release`` removes the table.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    _WRITTEN.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Removes one table that ``durable`` returned; nothing that reads it may run afterwards."""
    if table._scratch_path in _WRITTEN:
        _WRITTEN.remove(table._scratch_path)
        _delete(table.sparkSession, table._scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what ``durable`` wrote inside the block when the block ends; results built in it must have been written or collected."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Removes the tables that ``durable`` wrote after the first ``keep``; nothing that reads them may run afterwards."""
    while len(_WRITTEN) > keep:
        _delete(spark, _WRITTEN.pop())
