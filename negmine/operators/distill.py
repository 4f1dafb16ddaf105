"""Scored samples to distillation rows, inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from negmine.constants import NEGATIVES_PER_ROW, TEACHER_SCALE, TEMPERATURE
from negmine.functions.vectors import cosine, inner_product, log_softmax, scale_scores


def usable(k: int = NEGATIVES_PER_ROW) -> Column:
    """Documents and scores pair up, all scores are numbers, and 1 + k documents exist."""
    known = F.forall("scores", lambda s: s.isNotNull() & ~F.isnan(s))
    return F.coalesce(
        (F.size("docs") == F.size("scores")) & (F.size("docs") >= 1 + k) & known, F.lit(False))


def filter_scored(scored: DataFrame, k: int = NEGATIVES_PER_ROW) -> DataFrame:
    return scored.filter(usable(k))


def skipped_count(scored: DataFrame, k: int = NEGATIVES_PER_ROW) -> DataFrame:
    """One row: ``kept, skipped``."""
    return scored.agg(F.count_if(usable(k)).alias("kept"), F.count_if(~usable(k)).alias("skipped"))


def best_position(scores: Column) -> Column:
    """0-based place of the highest score; the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def with_best(scored: DataFrame) -> DataFrame:
    """Add ``best`` (place), ``positive`` and its ``score``: the teacher's choice."""
    placed = scored.withColumn("best", best_position(F.col("scores")))
    return placed.withColumn("positive", F.get("docs", "best")).withColumn("positive_score", F.get("scores", "best"))


def rank_rest(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """Add ``rest``: the other documents by falling score, ties in their order."""
    # ascending order of (-score, place) is falling score, then place; no comparator needed
    entries = F.transform(F.arrays_zip("docs", "scores"), lambda x, i: F.struct(
        (-x.scores + F.lit(0.0)).alias("neg"), i.alias("pos"), x.docs.alias("doc"), x.scores.alias("score")))
    rest = F.sort_array(F.filter(entries, lambda x: x.pos != F.col("best")))
    return with_best(scored).withColumn("rest", rest if top_n is None else F.slice(rest, 1, top_n))


def chunk_rest(ranked: DataFrame, k: int = NEGATIVES_PER_ROW) -> DataFrame:
    """One row per full group of ``k`` of the rest: ``chunk_no, chunk``; a remainder is dropped."""
    full = F.floor(F.size("rest") / F.lit(k)).cast("int")
    numbers = F.when(full > 0, F.sequence(F.lit(0), full - 1))  # sequence(0, -1) would count down
    chunks = F.transform(numbers, lambda c: F.slice("rest", c * k + 1, F.lit(k)))
    return ranked.select("*", F.posexplode(chunks).alias("chunk_no", "chunk"))


def distillation_rows(scored: DataFrame, k: int = NEGATIVES_PER_ROW, scale: float = TEACHER_SCALE,
                      top_n: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``query, positive, negative1..k, label``; ``keep`` names columns to carry along."""
    chunks = chunk_rest(rank_rest(filter_scored(scored, k), top_n), k)
    raw = F.concat(F.array("positive_score"), F.transform("chunk", lambda x: x.score))
    negatives = [F.get("chunk", F.lit(i)).getField("doc").alias(f"negative{i + 1}") for i in range(k)]
    return chunks.select(*keep, "query", "positive", *negatives, scale_scores(raw, scale).alias("label"))


def distill_loss(rows: DataFrame, temperature: float = TEMPERATURE, similarity: str = "cos") -> DataFrame:
    """One row ``n, loss``: divergence of the student from the teacher.

    ``rows`` holds ``query_vec``, ``doc_vecs`` (positive first) and ``label``.  The
    student is the similarity of the query with each document; both sides are
    softened by the temperature and the mean is scaled by its square.
    """
    compare = {"cos": cosine, "dot": inner_product}[similarity]
    student = F.transform("doc_vecs", lambda d: compare(F.col("query_vec"), d) / temperature)
    teacher = F.transform("label", lambda x: x.cast("double") / temperature)
    logs = rows.select(log_softmax(student).alias("s"), log_softmax(teacher).alias("t"))
    terms = F.zip_with("t", "s", lambda t, s: F.exp(t) * (t - s))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return logs.agg(F.count(F.lit(1)).alias("n"), (F.avg(divergence) * temperature ** 2).alias("loss"))
