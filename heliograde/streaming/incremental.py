"""Incremental behaviour of the workflow: append logs, resume by key, replace by key.

The workflow has no streams. What it does over time is append metric and stage rows, skip
work already done and replace the row of a key, each a batch job over a growing table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograde.session import discard, durable

# Fixed column order of the results log.
RESULT_COLUMNS = [
    "experiment", "method", "scheme", "scope", "metric", "value", "n_pos", "n_neg",
    "model_path", "scores_path", "figure_path", "aef_year", "timestamp", "notes",
]
_RESULT_TYPES = {"value": "double", "n_pos": "bigint", "n_neg": "bigint", "aef_year": "int", "timestamp": "timestamp"}


def result_rows(df: DataFrame) -> DataFrame:
    """Shape metric rows like the log: all columns, value rounded to five places."""
    cols = []
    for c in RESULT_COLUMNS:
        t = _RESULT_TYPES.get(c, "string")
        v = F.col(c).cast(t) if c in df.columns else (F.current_timestamp() if c == "timestamp" else F.lit(None).cast(t))
        cols.append((F.round(v, 5) if c == "value" else v).alias(c))
    return df.select(*cols)


def append_results(df: DataFrame, path: str) -> None:
    """Append to the log, one folder per experiment; the commit is atomic per job."""
    result_rows(df).write.mode("append").partitionBy("experiment").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append one batch of metric rows so that a repeated batch changes nothing.

    Every (experiment, batch) is a folder of its own and only folders of this batch are replaced: files are staged and moved
    into place when all tasks are done, so a job that dies halfway leaves no rows, and running it again leaves them once.
    """
    rows = result_rows(df).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "batch").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The log with its fixed columns and the batch of each row."""
    types = [f"{c} {_RESULT_TYPES.get(c, 'string')}" for c in RESULT_COLUMNS]
    return spark.read.schema(", ".join([*types, "batch string"])).parquet(path)


def relative_path(path: Column, root: str) -> Column:
    """Paths below ``root`` relative to it, so that the log can move; others and NULL as they are."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def append_stage(spark: SparkSession, path: str, stage: str, cmd: str, status: str, **extra: str) -> None:
    """One stage event as a JSON line."""
    row = {"stage": stage, "cmd": cmd, "status": status, **extra}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()], F.current_timestamp().alias("ts"))
    df.coalesce(1).write.mode("append").json(path)


def append_stages(events: DataFrame, path: str) -> None:
    """Many stage events as JSON lines."""
    events.write.mode("append").json(path)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose key has no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def replace_by_key(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Table with the rows of new keys replaced."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_stored(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Replace the rows of new keys in a stored table partitioned by ``partition``, which must be one of ``keys``.

    Only partitions that new keys name are read and rewritten. The merged rows are staged as a table of their own first,
    so nothing is read while it is overwritten, and a repeat after a failure gives the same table. NULL is a key like any
    other; several new rows of one key all stay. A table that is not there yet is started.
    """
    if partition not in keys:
        raise ValueError("an old row of a key could lie in another partition")
    new = durable(new)
    staged = new
    if _exists(spark, path):
        current = spark.read.schema(new.schema).parquet(path)
        touched, named = new.select(F.col(partition).alias("__p")).distinct(), new.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
        same = None
        for i, k in enumerate(keys):
            one = F.col(k).eqNullSafe(F.col(f"__{i}"))
            same = one if same is None else same & one
        old = current.join(touched, F.col(partition).eqNullSafe(F.col("__p")), "left_semi").join(named, same, "left_anti")
        staged = durable(old.unionByName(new))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for table in {id(t): t for t in (staged, new)}.values():
        discard(table)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def latest_non_null(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Per key and column, the latest value that is not NULL (columns may come from different rows).

    ``max`` over (order, value) structs combines on the map side, unlike an ordered window.
    """
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c)))).getField(c).alias(c)
    return df.groupBy(key).agg(*[last(c) for c in values])
