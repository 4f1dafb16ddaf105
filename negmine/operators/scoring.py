"""Training samples to scored samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from negmine.constants import SCORE_BATCH, SCORED_NEGATIVES
from negmine.operators.inference import score_lists
from negmine.staging import spread, stage


def assemble_docs(positive: Column, negatives: Column, max_negatives: int = SCORED_NEGATIVES) -> Column:
    """The positive, then the first negatives."""
    return F.concat(F.array(positive), F.slice(negatives, 1, max_negatives))


def sample_pairs(samples: DataFrame, max_negatives: int = SCORED_NEGATIVES) -> DataFrame:
    """``sample_id, query, pos, doc``: one row per document to score."""
    docs = samples.select("sample_id", F.col("anchor").alias("query"),
                          assemble_docs(F.col("positive"), F.col("negatives"), max_negatives).alias("docs"))
    return docs.select("sample_id", "query", F.posexplode("docs").alias("pos", "doc"))


def attach_scores(scored_pairs: DataFrame) -> DataFrame:
    """``sample_id, query, docs, scores`` with documents back in their order.

    Every pair carries its sample and place; groups hold a handful of rows.
    """
    listed = F.sort_array(F.collect_list(F.struct("pos", "doc", "score")))
    grouped = scored_pairs.groupBy("sample_id").agg(F.first("query").alias("query"), listed.alias("_l"))
    return grouped.select("sample_id", "query", F.transform("_l", lambda x: x.doc).alias("docs"),
                          F.transform("_l", lambda x: x.score).alias("scores"))


def score_samples(samples: DataFrame, make_scorer, max_negatives: int = SCORED_NEGATIVES,
                  batch_size: int = SCORE_BATCH) -> DataFrame:
    """Scored samples.  Scores are staged: a model need not answer twice alike.

    A sample stays one row; its documents are scored in place, so no text is shuffled to find its sample again.
    """
    docs = spread(samples, "sample_id").select(
        "sample_id", F.col("anchor").alias("query"),
        assemble_docs(F.col("positive"), F.col("negatives"), max_negatives).alias("docs"))
    return stage(score_lists(docs, make_scorer, batch_size), "scored-samples")


def restore_order(scored: DataFrame) -> DataFrame:
    """Input order, for an export; a range-partitioned sort."""
    return scored.orderBy("sample_id")
