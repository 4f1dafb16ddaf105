"""Dense 0-based positions over data of any size.

No step orders the whole data in one task: rows are range partitioned, and only
one total per partition (a number fixed by the configuration) is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from negmine.staging import stage

# Bytes of input per range when rows are numbered by key.
RANGE_BYTES = 256 << 20

_POSITION_BITS = 33  # monotonically_increasing_id: partition number, then 33 bits of position


def _in_ranges(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Range partitioned, sorted and written, with ``_range`` and ``_at`` inside it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 100_000))
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    return stage(
        ranged.withColumn("_row", row)
        .withColumn("_range", F.shiftright("_row", _POSITION_BITS).cast("int"))
        .withColumn("_at", F.col("_row").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("_row"),
        "ranges",
    )


def _range_offsets(ranged: DataFrame, amount: Column) -> DataFrame:
    """One row per range: the total of all ranges before it."""
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    return totals.select("_range", offset)


def number_rows(df: DataFrame, order_by: list[str], name: str = "doc_idx") -> DataFrame:
    """Position of each row in the order of ``order_by``; equal keys keep scan order.

    The scan position breaks ties, so a key held by very many rows still
    spreads over several ranges.
    """
    tied = df.withColumn("_scan", F.monotonically_increasing_id())
    ranged = _in_ranges(tied, [*order_by, "_scan"])
    offsets = F.broadcast(_range_offsets(ranged, F.lit(1)))  # one row per shuffle partition
    return (
        ranged.join(offsets, "_range")
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_range", "_at", "_scan", "_offset")
    )


def number_in_place(df: DataFrame, name: str = "doc_idx") -> DataFrame:
    """Position of each row in scan order; rows are written once and never shuffled."""
    staged = stage(with_scan_counter(df), "scanned").withColumn("_range", F.shiftright("_scan", _POSITION_BITS))
    offsets = F.broadcast(_range_offsets(staged, F.lit(1)))  # two numbers per task
    at = F.col("_scan").bitwiseAND((1 << _POSITION_BITS) - 1)
    return staged.join(offsets, "_range").withColumn(name, F.col("_offset") + at).drop("_range", "_scan", "_offset")


def running_total(df: DataFrame, order_by: list[str], amount: str, name: str) -> DataFrame:
    """Add the total of ``amount`` over all earlier rows."""
    ranged = _in_ranges(df, order_by)
    offsets = F.broadcast(_range_offsets(ranged, F.col(amount)))
    earlier = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, "_range")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long"))
        .drop("_range", "_at", "_offset", "_inside")
    )


def scan_position(df: DataFrame) -> DataFrame:
    """Add where each row was read: file, start of the split, scan counter.

    Must be applied directly to a file scan.  Rows of one split lie next to each
    other in one task, so the counter differs from the position inside the
    split by a constant.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def with_scan_counter(df: DataFrame) -> DataFrame:
    return df.withColumn("_scan", F.monotonically_increasing_id())


def split_offsets(staged: DataFrame) -> DataFrame:
    """Per split: its first counter and the number of rows in all earlier splits."""
    splits = staged.groupBy("_file", "_start").agg(
        F.min("_scan").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    return running_total(splits, ["_file", "_start"], "_rows", "_before")


def number_staged(staged: DataFrame, name: str = "doc_idx") -> DataFrame:
    """Position in file order (path, split, line) for a staged scan.

    ``staged`` was written once with its scan counters, so the counting pass
    and the numbering pass cannot see different splits.
    """
    # three numbers per split: some tens of megabytes for a million splits, so text never moves for its number
    split = F.xxhash64("_file", "_start").alias("_split")
    offsets = F.broadcast(split_offsets(staged).select(split, (F.col("_before") - F.col("_first")).alias("_shift")))
    return (
        staged.withColumn("_split", split).join(offsets, "_split")
        .withColumn(name, F.col("_shift") + F.col("_scan"))
        .drop("_file", "_start", "_scan", "_split", "_shift")
    )
