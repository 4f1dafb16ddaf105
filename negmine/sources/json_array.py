"""Elements of files that are one JSON array of objects, read in many tasks.

The text reader cuts files at every closing brace, so a file of any size, on one line or many, gives as many
splits as its bytes ask for.  Whether a brace stands in a text, and at which depth, depends on everything before
it; it is found by running sums: inside each split for both possible states at its start, then over the
few numbers that each split leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from negmine.functions.text import is_blank, strip_ws
from negmine.operators.numbering import running_total, scan_position, with_scan_counter
from negmine.staging import stage

_SPLIT = ["_file", "_start"]


def pieces(spark: SparkSession, path) -> DataFrame:
    """``value``: what stands before each closing brace, and after the last one."""
    return spark.read.option("lineSep", "}").text(path)


def is_array(spark: SparkSession, path) -> bool:
    """Whether the first character that is no blank opens an array; no more than a piece is read for it."""
    head = pieces(spark, path).filter(~is_blank(F.col("value"))).select(F.substring(strip_ws(F.col("value")), 1, 1).alias("c")).first()
    return head is not None and head.c == "["


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _depth_change(bare: Column) -> Column:
    """Brackets opened less those closed outside texts, the brace that ends the piece included."""
    outside = F.regexp_replace(bare, r'"[^"]*("|$)', "")
    brace = 1 - _count(bare, '"') % 2
    return (_count(outside, "{[") - _count(outside, "]") - brace).cast("long")


def _since_file_start(splits: DataFrame, amount: str, name: str) -> DataFrame:
    """The total of ``amount`` over earlier splits of the same file."""
    placed = running_total(splits, _SPLIT, amount, "_all")
    first = F.first("_all").over(Window.partitionBy("_file").orderBy("_start"))
    return placed.withColumn(name, F.col("_all") - first).drop("_all")


def array_elements(spark: SparkSession, path) -> DataFrame:
    """``value``: the text of every object of the arrays, each file being one array of objects.

    Anything else between or around the objects, and an array that does not end, stops the job.  One closing
    brace after the end of the array is not told.  The text is written once and shuffled twice: by split, whose
    size Spark bounds, and by element.
    """
    # without escaped characters every quotation mark opens or closes a text
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    read = with_scan_counter(scan_position(pieces(spark, path))).withColumn("_bare", bare).select(
        "value", "_file", "_start", "_scan", _count(F.col("_bare"), '"').cast("long").alias("_marks"),
        _depth_change(F.col("_bare")).alias("_out"),
        _depth_change(F.concat(F.lit('"'), "_bare")).alias("_in"))
    in_split = Window.partitionBy(*_SPLIT).orderBy("_scan")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_split.rowsBetween(Window.unboundedPreceding, 0)
    odd = F.coalesce(F.sum("_marks").over(before), F.lit(0)) % 2 == 1
    marked = stage(read.withColumn("_odd", odd)
                   .withColumn("_depth0", F.sum(F.when(F.col("_odd"), F.col("_in")).otherwise(F.col("_out"))).over(upto))
                   .withColumn("_depth1", F.sum(F.when(F.col("_odd"), F.col("_out")).otherwise(F.col("_in"))).over(upto))
                   .drop("_in", "_out"), "array-pieces")

    last = F.max_by(F.struct("_depth0", "_depth1"), "_scan")
    splits = stage(marked.groupBy(*_SPLIT).agg(F.sum("_marks").alias("_marks"), last.alias("_last")), "array-splits")
    parity = _since_file_start(splits, "_marks", "_marks_before").withColumn("_in_text", F.col("_marks_before") % 2 == 1)
    change = F.when(F.col("_in_text"), F.col("_last._depth1")).otherwise(F.col("_last._depth0"))
    placed = stage(_since_file_start(parity.withColumn("_change", change), "_change", "_depth_before"), "array-depths")

    # after the bracket that ends the array the depth is 0, less one for the brace that the last piece lacks
    ends = placed.groupBy("_file").agg(F.sum("_change").alias("depth"), F.sum("_marks").alias("marks"))
    broken = ends.filter((F.col("depth") != -1) | (F.col("marks") % 2 != 0)).select("_file").first()
    if broken is not None:
        raise ValueError(f"malformed array: {broken._file}")

    known = F.broadcast(placed.select(*_SPLIT, "_in_text", "_depth_before"))  # one row for each split
    depth = F.col("_depth_before") + F.when(F.col("_in_text"), F.col("_depth1")).otherwise(F.col("_depth0"))
    text_after = (F.col("_odd").cast("int") + F.col("_in_text").cast("int") + F.col("_marks")) % 2 == 1
    closed = marked.join(known, _SPLIT).withColumn("_end", (~text_after & (depth == 1)).cast("int"))
    counted = closed.select("value", "_file", "_start", "_scan", "_end",
                            F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_at"))
    ended = stage(counted.groupBy(*_SPLIT).agg(F.sum("_end").alias("_ends")), "array-ends")
    earlier = F.broadcast(_since_file_start(ended, "_ends", "_ends_before").select(*_SPLIT, "_ends_before"))
    element = counted.join(earlier, _SPLIT).withColumn("_element", F.col("_ends_before") + F.col("_at"))
    whole = element.groupBy("_file", "_element").agg(
        F.max("_end").alias("_whole"), F.sort_array(F.collect_list(F.struct("_start", "_scan", "value"))).alias("_pieces"))
    joined = whole.select("_element", "_whole", F.array_join(F.col("_pieces.value"), "}").alias("_text"))
    bracket = F.when(F.col("_element") == 0, "[").otherwise(",")
    opened = strip_ws(F.col("_text"))
    inner = F.when(F.col("_whole") == 1, F.when(opened.startswith(bracket), F.concat(F.expr("substring(_opened, 2)"), F.lit("}"))))
    tail = F.when(F.col("_element") == 0, F.regexp_replace("_opened", r"^\[\s*\]$", "]")).otherwise(F.col("_opened"))
    told = F.raise_error(F.concat(F.lit("malformed array: "), F.substring("_opened", 1, 200))).cast("string")
    checked = joined.withColumn("_opened", opened).select(
        "_whole", F.when(F.col("_whole") == 0, F.when(tail != "]", told)).otherwise(F.coalesce(inner, told)).alias("value"))
    return checked.filter((F.col("_whole") == 1) | F.col("value").isNotNull()).select("value")
