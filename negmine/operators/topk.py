"""Best k per query, shared by lexical and vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from negmine.constants import SCORE_DECIMALS

# Large searches score one document in SEED_SLICES first, for floors.
SEED_SLICES = 64
SEED_CANDIDATES = 20_000_000
# Unrounded scores are compared with rounded floors with this much to spare.
_SLACK = 10.0 ** -SCORE_DECIMALS
_CELLS = 400_000  # cells of one dense score matrix inside a task: a few MB, close to the core


def rank_candidates(scored: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Top ``k`` per query with ``rank`` from 1.

    Written as a row-number filter so that Spark keeps k rows per query and
    task before the shuffle.
    """
    rounded = scored.withColumn("score", F.round("score", SCORE_DECIMALS))
    best = Window.partitionBy(query).orderBy(F.col("score").desc(), "doc_idx")
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def chunk_size(columns: int) -> int:
    """Queries scored at a time against ``columns`` documents."""
    return max(1, _CELLS // max(1, columns))


@dataclass(frozen=True)
class Floors:
    """Per query of a batch: a score and a document that k documents reach."""

    scores: np.ndarray
    docs: np.ndarray

    @staticmethod
    def none(n_queries: int) -> Floors:
        return Floors(np.full(n_queries, -np.inf), np.full(n_queries, np.iinfo(np.int64).max))


def in_slice() -> Column:
    """One document in SEED_SLICES, by hash."""
    return F.pmod(F.xxhash64("doc_idx"), F.lit(SEED_SLICES)) == 0


def pays_to_seed(n_tasks: int, n_queries: int, k: int) -> bool:
    """A slice must hold more than one task does, and spare many candidate rows."""
    return n_tasks > SEED_SLICES and n_tasks * n_queries * k > SEED_CANDIDATES


def slice_floors(found: DataFrame, k: int) -> DataFrame:
    """``qi, floor, floor_doc``: the k-th best per query (``qi, doc_idx, score``) over some of the documents.

    The k-th best of some never ranks before the k-th best of all, so dropping
    what ranks behind it loses nothing.
    """
    kth = rank_candidates(found, k, "qi").filter(F.col("rank") == k)
    return kth.select("qi", F.col("score").alias("floor"), F.col("doc_idx").alias("floor_doc"))


def with_floors(queries: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Queries with ``floor`` and ``floor_doc``; null where nothing is known."""
    if floors is None:
        return queries.withColumn("floor", F.lit(None).cast("double")).withColumn("floor_doc", F.lit(None).cast("long"))
    return queries.join(floors, "qi", "left")


def block_floors(block: pa.RecordBatch) -> Floors:
    return Floors(block.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(float),
                  block.column("floor_doc").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64))


class BestSoFar:
    """Running top k of one task: a (queries x k) table for a bounded batch.

    ``floors`` gives per query a score and a document that k documents are known
    to reach.  What ranks behind is dropped at once, among equal scores too, so
    many copies of one document do not pass as many candidates.
    """

    def __init__(self, n_queries: int, k: int, floors: Floors | None):
        self.k = k
        known = floors or Floors.none(n_queries)
        self.floors, self.floor_docs = known.scores.copy(), known.docs.copy()
        self._scores = np.full((n_queries, k), -np.inf)
        self._docs = np.zeros((n_queries, k), np.int64)

    def can_reach(self, bounds: np.ndarray) -> np.ndarray:
        """Queries whose score bound still reaches their floor."""
        return np.flatnonzero((bounds > 0) & (bounds >= self.floors - _SLACK))

    def least(self) -> np.ndarray:
        """Per query the unrounded score below which nothing is kept."""
        return self.floors - _SLACK

    def offer(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Offer single matches: query, document, score that is not rounded."""
        values, floor = np.round(scores, SCORE_DECIMALS), self.floors[queries]
        ahead = (scores > 0) & ((values > floor) | ((values == floor) & (docs <= self.floor_docs[queries])))
        self.add_found(queries[ahead], docs[ahead], values[ahead])

    def add(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray, matches_only: bool) -> None:
        """Offer a (queries x docs) matrix; with ``matches_only`` a cell of 0 is no match."""
        least = self.floors[queries] - _SLACK
        if matches_only:
            least = np.maximum(least, np.finfo(float).tiny)
        passing = scores >= least[:, None]
        crowded = np.flatnonzero(passing.sum(axis=1) > 4 * self.k)
        if len(crowded):
            kth = np.partition(scores[crowded], -self.k, axis=1)[:, -self.k]
            passing[crowded] = scores[crowded] >= np.maximum(kth - _SLACK, least[crowded])[:, None]
        rows, columns = np.nonzero(passing)
        values, ids, asked = np.round(scores[rows, columns], SCORE_DECIMALS), docs[columns], queries[rows]
        floor = self.floors[asked]
        ahead = (values > floor) | ((values == floor) & (ids <= self.floor_docs[asked]))
        if ahead.any():
            self._merge(queries, rows[ahead], ids[ahead], values[ahead])

    def add_found(self, rows: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Offer single results (query, document, rounded score), many at a time."""
        queries, at = np.unique(rows, return_inverse=True)
        if len(queries):
            self._merge(queries, at, docs, scores)

    def _merge(self, queries: np.ndarray, rows, docs, scores) -> None:
        """Best k of what these queries hold and what is offered."""
        held = self._scores[queries]
        old_rows, old_places = np.nonzero(held > -np.inf)
        rows = np.concatenate([old_rows, rows])
        docs = np.concatenate([self._docs[queries[old_rows], old_places], docs])
        scores = np.concatenate([held[old_rows, old_places], scores])
        order = np.lexsort((docs, -scores, rows))
        rows, docs, scores = rows[order], docs[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        asked, place, docs, scores = queries[rows[kept]], place[kept], docs[kept], scores[kept]
        self._scores[asked, place] = scores
        self._docs[asked, place] = docs
        # the last of a full list is a new floor; it never ranks behind the old one
        full = place == self.k - 1
        self.floors[asked[full]] = scores[full]
        self.floor_docs[asked[full]] = docs[full]

    def result(self) -> dict[str, np.ndarray]:
        queries, places = np.nonzero(self._scores > -np.inf)
        return {"qi": queries, "doc_idx": self._docs[queries, places], "score": self._scores[queries, places]}


def named_topk(found: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_idx, score, rank`` from the ``qi, doc_idx, score`` of all tasks.

    ``names`` (``qi, query_id``) puts the ids back after ranking, on k rows per query.
    """
    return rank_candidates(found, k, "qi").join(names, "qi").select("query_id", "doc_idx", "score", "rank")


def over_blocks(chunks: Iterator, blocks, n_results: int, most_results: int, k: int, offer) -> Iterator[pd.DataFrame]:
    """Run every chunk of documents of a task past every block of queries.

    ``blocks()`` gives (numbers of the queries, what they ask, floors); ``offer(best, asked, chunk)`` scores.  If all
    results fit into ``most_results`` each block keeps its best of the whole task; else it gives them up after each chunk.
    """
    kept: dict[int, tuple[np.ndarray, BestSoFar]] = {}
    for chunk in chunks:
        for i, (numbers, asked, floors) in enumerate(blocks()):
            best = kept[i][1] if i in kept else BestSoFar(len(numbers), k, floors)
            offer(best, asked, chunk)
            if n_results <= most_results:
                kept[i] = numbers, best
            else:
                yield _numbered(numbers, best)
    for numbers, best in kept.values():
        yield _numbered(numbers, best)


def _numbered(numbers: np.ndarray, best: BestSoFar) -> pd.DataFrame:
    found = best.result()
    return pd.DataFrame({**found, "qi": numbers[found["qi"]]})


def query_batches(df: DataFrame, n_batches: int) -> Iterator[DataFrame]:
    """Disjoint parts of the queries, by hash, that together hold all of them."""
    for i in range(n_batches):
        part = F.pmod(F.xxhash64("query_id"), F.lit(n_batches)) == i
        yield df if n_batches == 1 else df.filter(part)
