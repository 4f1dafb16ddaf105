"""Bounds on what an operator holds while its jobs run: rows of a batch, and stages that are needed no more."""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from negmine.staging import new_stage_path, read_stage, stage_scope

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """At most ``rows`` rows a batch, so that whole texts of a batch stay small; the session's own smaller limit stands."""
    before = spark.conf.get(_KEY, None)
    spark.conf.set(_KEY, str(min(rows, int(before or 10_000)) if int(before or 10_000) > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_KEY)
        else:
            spark.conf.set(_KEY, before)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For results that are computed after the call returns: lower the session's limit of rows a batch, and leave it so."""
    now = int(spark.conf.get(_KEY, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(_KEY, str(rows))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so when the driver's garbage is collected, which a driver with little to do puts off; the files of a chain of staged
    steps would pile up on the executors meanwhile.  What a step needs is in its staged table.  The thread that tells listeners of
    the end of an execution holds that execution, and so its shuffles, until it has another one to tell of.
    """
    spark.sql("SELECT 1").collect()  # no job
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage_result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns and delete what it staged on the way."""
    path = new_stage_path(spark, name)
    with stage_scope(spark):
        df = make()
        df.write.parquet(path)
    return read_stage(df, path)
