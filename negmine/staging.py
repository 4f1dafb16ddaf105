"""Stage tables: results written once to the cluster's shared folder.

A stage cuts lineage and is read many times.  Losing an executor costs nothing
that was staged, and a staged table never changes between two jobs over it.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_scope: ContextVar[str] = ContextVar("stage_scope", default="")


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on a single machine without that setting gets a folder of
    its own; on a cluster an unset folder is an error, because a machine-local
    path would not be visible to the other executors.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="negmine-stages-")
        root = _local_root
    return f"{root.rstrip('/')}/negmine/{spark.sparkContext.applicationId}"


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{_scope.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def stage_scope(spark: SparkSession):
    """Delete what is staged inside the block when it ends; results must be written by then."""
    folder = f"scope-{uuid.uuid4().hex}/"
    token = _scope.set(_scope.get() + folder)
    path = f"{stage_root(spark)}/{_scope.get()}"
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, path)


# Bytes a task is worth: inputs that cannot give every core this much are small.
_TASK_BYTES = 128 << 20
# Estimated bytes, compressed as they are, that a task of a spread input gets at most.
_SPREAD_BYTES = 16 << 20


def spread(df: DataFrame, unique_key: str | None = None) -> DataFrame:
    """Give a small input to all cores before heavy work per row.

    A file with few row groups is read by few tasks.  Large inputs have splits
    for every core already and are left where they are, without a shuffle.
    Without a unique key rows are dealt out one by one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * _TASK_BYTES:
        return df
    n = max(cores, -(-size // _SPREAD_BYTES))
    return df.repartition(n, unique_key) if unique_key else df.repartition(n)


def small_model_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's limit of rows in a batch that goes to Python, and leave it so: the texts of a batch stand there several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = new_stage_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return read_stage(df, path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what is no staged table itself is left alone."""
    for df in tables:
        path = df.__dict__.get("_stage_path")
        if path:
            _delete(df.sparkSession, path)


def stage_in_parts(parts, name: str) -> DataFrame:
    """Write several results of one schema, one after the other, as one table."""
    path, first = None, None
    for df in parts:
        if path is None:
            path, first = new_stage_path(df.sparkSession, name), df
        df.write.mode("append").parquet(path)
    return read_stage(first, path)


def read_stage(like: DataFrame, path: str) -> DataFrame:
    table = like.sparkSession.read.schema(like.schema).parquet(path)
    table.__dict__["_stage_path"] = path
    return table


def drop_stages(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    _delete(spark, stage_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
