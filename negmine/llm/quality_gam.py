"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature after the other; what a
feature's trees add up to is a lookup table over its bins.  Pairs of features
get tables of their own from what the single ones leave over.  A score is the
sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.bytehash import SPACED, Chunk, byte_class, chunks, span_hash

_UPPER, _LOWER = byte_class("[A-Z]"), byte_class("[a-z]")
_SYMBOL, _SHOUT, _DIGIT = byte_class(r"[#*$%&|<>]"), byte_class("[!?]"), byte_class("[0-9]")
_ALNUM = byte_class("[0-9A-Za-z]")

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "symbols", "shouts", "digits", "wide", "lines_per_word",
    "different_words", "same_as_before", "repeated_threes", "repeated_lines", "bare_words", "stops", "short_words",
    "shouted_words", "symbol_words", "top_word",
)


def _per_row(chunk: Chunk, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[chunk.offsets]).astype(float)


def _repeats(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many keys equal an earlier one, and the size of the largest group."""
    if not len(keys):
        return np.zeros(n_rows), np.zeros(n_rows)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    largest = np.zeros(n_rows)
    np.maximum.at(largest, r[at], size)
    return np.bincount(r, weights=~new, minlength=n_rows), largest


def text_features(chunk: Chunk) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has all zeros."""
    n, data = len(chunk), chunk.data
    starts, ends, rows = chunk.words(SPACED)
    prefix = chunk.prefix_hash()
    words = span_hash(prefix, starts, ends)
    n_bytes = np.diff(chunk.offsets).astype(float)
    n_words = np.bincount(rows, minlength=n).astype(float)
    of_bytes, of_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)

    def share(table):
        return _per_row(chunk, table[data]) / of_bytes

    def words_with(flags):
        return np.bincount(rows, weights=flags, minlength=n) / of_words

    def inside(table):
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return total[ends] - total[starts]

    letters = _per_row(chunk, (_UPPER | _LOWER)[data])
    breaks = _per_row(chunk, data == 10)
    again, top = _repeats(rows, words, n)
    same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    whole = rows[2:] == rows[:-2]
    threes = (words[:-2] * np.uint64(3) ^ words[1:-1] * np.uint64(5) ^ words[2:] * np.uint64(7))[whole] if len(words) > 2 else words[:0]
    three_rows = rows[:-2][whole] if len(words) > 2 else rows[:0]
    threes_again, _ = _repeats(three_rows, threes, n)
    line_starts, line_ends, line_rows = chunk.words(np.arange(256) != 10)
    lines_again, _ = _repeats(line_rows, span_hash(prefix, line_starts, line_ends), n)
    length = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    upper = inside(_UPPER)
    out = [
        np.log1p(n_bytes), np.log1p(n_words), np.bincount(rows, weights=length, minlength=n) / of_words,
        _per_row(chunk, _UPPER[data]) / np.maximum(letters, 1), share(_SYMBOL), share(_SHOUT), share(_DIGIT),
        share(np.arange(256) > 127), breaks / of_words,
        (n_words - again) / of_words, np.bincount(rows[1:], weights=same, minlength=n) / of_words,
        threes_again / np.maximum(n_words - 2, 1), lines_again / np.maximum(np.bincount(line_rows, minlength=n), 1),
        words_with(inside(_ALNUM | (np.arange(256) > 127)) == 0), words_with((last == 46) | (last == 44)),
        words_with(length == 1), words_with((upper >= 2) & (inside(_LOWER) == 0)), words_with(inside(_SYMBOL) > 0),
        top / of_words,
    ]
    return np.stack(out, axis=1)


@dataclass
class Gam:
    """Bin edges and tables; ``pairs`` holds (first, second, table) over coarser bins."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[bins[j]]
        for a, b, table in self.pairs:
            out += table[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """The step of a shallow tree over ordered bins: its leaf value for every bin."""
    out = np.zeros(len(gradient))
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in parts:
            g, h = np.cumsum(gradient[lo:hi]), np.cumsum(weight[lo:hi])
            gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
            if len(gl):
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g[-1]**2 / (h[-1] + penalty)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (lo, hi), lo + at + 1)
        if best[1] is None:
            break
        lo, hi = best[1]
        parts.remove(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    for lo, hi in parts:
        out[lo:hi] = gradient[lo:hi].sum() / (weight[lo:hi].sum() + penalty)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 60, rate: float = 0.2, leaves: int = 3,
            n_pairs: int = 6, pair_bins: int = 6, penalty: float = 2.0) -> Gam:
    """Boost single features in cycles, then the pairs that the gradients interact on most."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    n_features = len(FEATURES) if not len(y) else x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0)
             for j in range(n_features)]
    coarse = [(np.arange(len(e) + 1) * pair_bins // (len(e) + 1)) for e in edges]
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], coarse)
    if not len(y) or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(binned):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(b, g, size), np.bincount(b, h, size), leaves, penalty)
            model.tables[j] += step
            margin += step[b]
    cells = {}
    g, h = slopes()
    gains = []
    for a, b in combinations(range(n_features), 2):
        cell = coarse[a][binned[a]] * pair_bins + coarse[b][binned[b]]
        sums, weights = np.bincount(cell, g, pair_bins**2), np.bincount(cell, h, pair_bins**2)
        gains.append(((sums**2 / (weights + penalty)).sum(), a, b))
        cells[a, b] = cell
    for _, a, b in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((a, b, np.zeros((pair_bins, pair_bins))))
    for _ in range(rounds // 3):
        for a, b, table in model.pairs:
            g, h = slopes()
            cell = cells[a, b]
            sums, weights = np.bincount(cell, g, pair_bins**2), np.bincount(cell, h, pair_bins**2)
            # a tree with a split on the first feature and one on the second within each side
            grad, hess = sums.reshape(pair_bins, pair_bins), weights.reshape(pair_bins, pair_bins)
            rows = _tree(grad.sum(1), hess.sum(1), 2, penalty)
            step = np.zeros_like(table)
            for value in np.unique(rows):
                side = rows == value
                step[side] = _tree(grad[side].sum(0), hess[side].sum(0), 2, penalty)
            table += rate * step
            margin += (rate * step).ravel()[cell]
    return model


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def features_of(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and an array of ``FEATURES`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(c) for c in chunks(batch.column(len(keep)))]
            values = pa.array(np.concatenate(x).ravel() if x else np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.FixedSizeListArray.from_arrays(values, len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=[*keep, "features"])

    schema = ", ".join(f"`{k}` {_kind(docs, k)}" for k in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{schema}, features array<double>")


def training_side(id_col: str) -> F.Column:
    """Rows whose label may be learned from; the rest is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Gam:
    """Fit on about ``max_rows`` labelled rows, chosen evenly by a hash of the id; null labels do not count."""
    known = (labels.where(training_side(id_col) & F.col(label_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = features_of(texts.join(F.broadcast(known), "_id"), ["_y"], "_text").toPandas()
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    y = rows["_y"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; the sums of the fit should not
    return fit_gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` in 0..1 and ``predicted``.

    Null and empty texts have all features zero and are scored like any other; rows with a null id are not held
    out; repeated rows are scored alike.  A model from no labels gives 0.5 to all.  No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(text_features(c)) for c in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["_id", "score"])

    out = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
           .mapInArrow(run, f"_id {_kind(docs, id_col)}, score double"))
    return out.select(F.col("_id").alias(id_col), F.coalesce(~training_side("_id"), F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
