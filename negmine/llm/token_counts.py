"""Token totals for every context limit, from one exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from negmine.llm.bpe import DEFAULT, Remembered, load_codec, vocabulary
from negmine.llm.batches import bound_batches
from negmine.staging import stage

# Lengths per block of the two-level sums; blocks are few, so their totals fit one task.
_BLOCK = 1024


_known: dict[str, Remembered] = {}


def _lengths(path: str, pattern: str) -> Remembered:
    """Number of ids of a pre-token, by its text."""
    if path not in _known:
        codec = load_codec(path, pattern)
        _known[path] = Remembered(lambda word: len(codec.pre_token(word)))
    return _known[path]


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocab: Callable[[], tuple[str, str]] | None = None) -> DataFrame:
    """Encoded length of every text, of any length; null counts 0. One row per row."""
    bound_batches(docs.sparkSession)
    find = vocab or vocabulary(DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = find()
        known, split = _lengths(*place), load_codec(*place).split
        for batch in batches:
            lengths = [sum(map(known.__getitem__, split(t))) if t else 0 for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())],
                                             names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col))


def length_table(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Per occurring length: what a context limit of that many tokens keeps and cuts.

    Columns: ``n_tokens`` (the length, taken as limit), ``n_docs`` of that length, ``docs_ge`` and
    ``tokens_ge`` (documents at least as long and their tokens), ``truncated_total`` (tokens left when every
    document is cut to the limit), ``total_tokens``, ``n_all`` and ``quantile`` (share of documents no longer).
    Null lengths are not counted; an empty table gives an empty one.  Only the histogram is shuffled, summed
    in the tasks first; running sums go by blocks of lengths, so no task sees all of them.
    """
    # written once: both levels of the sums read the histogram, the texts are encoded once
    counts = stage(lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens"))
              .agg(F.count(F.lit(1)).alias("n_docs"))
              .withColumn("block", F.floor(F.col("n_tokens") / _BLOCK)), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("n_all"), F.sum("t").over(every).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.join(blocks, "block")
            .withColumn("docs_ge", F.sum("n_docs").over(own) + F.col("docs_above"))
            .withColumn("tokens_ge", F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("tokens_above"))
            .select("n_tokens", "n_docs", "docs_ge", "tokens_ge",
                    (F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"),
                    "total_tokens", "n_all",
                    ((F.col("n_all") - F.col("docs_ge") + F.col("n_docs")) / F.col("n_all")).alias("quantile")))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, from ``length_table``: per limit ``truncated_total`` and ``docs_cut``.

    Between two occurring lengths the answer is linear, so the next longer length is enough.
    """
    wanted = table.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "lim long")
    longer = (table.join(F.broadcast(wanted), F.col("n_tokens") > F.col("lim"))
              .groupBy("lim").agg(F.min_by(F.struct("docs_ge", "tokens_ge"), "n_tokens").alias("x")))
    total = table.agg(F.max("total_tokens").alias("total_tokens"))
    return (wanted.join(longer, "lim", "left").join(F.broadcast(total))
            .select("lim", F.coalesce(F.col("x.docs_ge"), F.lit(0)).alias("docs_cut"),
                    (F.col("total_tokens") - F.coalesce(F.col("x.tokens_ge"), F.lit(0))
                     + F.col("lim") * F.coalesce(F.col("x.docs_ge"), F.lit(0))).alias("truncated_total")))


def quantile_lengths(table: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least the given share of documents does not exceed."""
    wanted = table.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    return (table.join(F.broadcast(wanted), F.col("quantile") >= F.col("share"))
            .groupBy("share").agg(F.min("n_tokens").alias("n_tokens")))
