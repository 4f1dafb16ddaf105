"""Joins against a table with one row per key, when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key on more than one row in HOT_SHARE is hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 500
# Tasks that the rows of one hot key are dealt to.
SALTS = 64
# Fewer rows than this are no load for one task, whatever their keys.
MIN_ROWS = 1_000_000


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``lookup``, which holds each key once.

    Hot keys would send a large share of ``rows`` to one task.  Their rows are dealt
    over ``SALTS`` tasks, each with a copy of the few lookup rows; all other rows take
    the ordinary join.  ``rows`` is read more than once and should be staged.
    """
    total = rows.count()
    if total < MIN_ROWS:
        return rows.join(lookup, key, how)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = [r[key] for r in counted.filter(F.col("_n") * HOT_SHARE > total).collect()]
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    usual = rows.filter(~is_hot).join(lookup.filter(~is_hot), key, how)
    dealt = rows.filter(is_hot).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = lookup.filter(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return usual.unionByName(dealt.join(copies, [key, "_salt"], how).drop("_salt"))
