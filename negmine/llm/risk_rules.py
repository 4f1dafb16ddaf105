"""Quality rules whose cutoffs are certified to reject few good documents.

A rule rejects what lies beyond its cutoff.  For every stratum and rule the cutoffs
are tested from the loosest on: a cutoff passes while the exact binomial probability
of seeing so few false rejections, were their true share ``risk``, stays below the
corrected level.  Testing stops at the first that fails, so only the number of
(stratum, rule) sequences needs correction.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.bytehash import SPACED, Chunk, byte_class, chunks, span_hash

_SYMBOL = byte_class(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")

#: Rule name: (numerator, denominator, +1 to reject above the cutoff or -1 below, cutoffs from loose to tight).
RULES = {
    "symbols": ("n_symbols", "n_words", 1, [3, 2.5, 2, 1.75, 1.5, 1.25, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "repeats": ("n_repeat_words", "n_words", 1, [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "dup_lines": ("n_dup_lines", "n_lines", 1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "shouted": ("n_shouted", "n_words", 1, [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "long_words": ("word_chars", "n_words", 1, [60, 40, 30, 25, 20, 17, 15, 13, 12]),
    "short_words": ("word_chars", "n_words", -1, [1, 1.25, 1.5, 1.75, 2, 2.25, 2.5, 2.75, 3]),
}


def _sum(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def base_counts(chunk: Chunk) -> np.ndarray:
    """The counts of ``BASE`` per text."""
    n, data = len(chunk), chunk.data
    starts, ends, rows = chunk.words(SPACED)
    prefix = chunk.prefix_hash()
    words = span_hash(prefix, starts, ends)

    def inside(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    def again(row, key):
        """Which entries have an equal one in their row, and which of those come after another."""
        order = np.lexsort((key, row))  # stable, so equal keys stay in text order
        r, k = row[order], key[order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return twice, later

    covered = np.zeros(len(words), dtype=bool)
    if len(words) > 2:
        at = np.flatnonzero(rows[2:] == rows[:-2])
        three = span_mix(words[at], words[at + 1], words[at + 2])
        hit = at[again(rows[at], three)[0]]
        for k in range(3):
            covered[hit + k] = True
    line_start, line_end, line_row = chunk.words(np.arange(256) != 10)
    word_at = np.concatenate([[0], np.cumsum(SPACED[data], dtype=np.int64)])
    real = word_at[line_end] > word_at[line_start]
    line_start, line_end, line_row = line_start[real], line_end[real], line_row[real]
    _, later = again(line_row, span_hash(prefix, line_start, line_end))
    upper, lower = inside((data >= 65) & (data <= 90)), inside((data >= 97) & (data <= 122))
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    out = [
        np.bincount(rows, minlength=n), _sum(rows, inside((data & 0xC0) != 0x80), n), np.diff(symbols[chunk.offsets]),
        _sum(line_row, later, n), _sum(rows, covered, n), np.bincount(line_row, minlength=n),
        _sum(rows, (upper >= 2) & (lower == 0), n),
    ]
    return np.stack(out, axis=1).astype(np.int64)


def span_mix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the counts of ``BASE`` per row; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [base_counts(c) for c in chunks(batch.column(len(keep)))]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(BASE)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array(counts[:, k]) for k in range(len(BASE)))], names=[*keep, *BASE])

    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"{b} long" for b in BASE]
    return (docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, ", ".join(fields)))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(n: int, k: int, p: float) -> float:
    """P(at most k of n) when each happens with probability p, exactly summed."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
           for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def _beyond(rule: str, cutoff: float) -> F.Column:
    top, bottom, sign, _ = RULES[rule]
    above = F.col(top) > F.lit(cutoff) * F.col(bottom)
    below = F.col(top) < F.lit(cutoff) * F.col(bottom)
    return (above if sign > 0 else below) & (F.col(bottom) > 0)


def holdout_counts(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Per stratum and label: documents, and how many lie beyond every cutoff. Base failures are left out."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label")))
    passed = measured.where(~base_failed()).withColumnRenamed(id_col, "_id")
    columns = [F.sum(_beyond(rule, c).cast("long")).alias(f"{rule}:{i}")
               for rule in RULES for i, c in enumerate(RULES[rule][3])]
    return passed.join(known, "_id").groupBy("stratum", "_label").agg(F.count(F.lit(1)).alias("n"), *columns)


def certify(counts: list[dict], risk: float = 0.02, level: float = 0.05, cost: float = 20.0) -> dict[str, dict[str, float]]:
    """Cutoff per stratum and rule from the counts of ``holdout_counts``.

    ``risk`` bounds the share of good documents that all rules of a stratum reject together, with confidence
    1 - ``level`` over all strata and rules at once.  Of the certified cutoffs the one is taken that rejects most
    bad documents, a good one costing as much as ``cost`` bad ones; a rule that gains nothing is not used.
    """
    strata = defaultdict(dict)
    for row in counts:
        strata[row["stratum"]][row["_label"]] = row
    each, corrected = risk / len(RULES), level / max(1, len(strata) * len(RULES))
    chosen: dict[str, dict[str, float]] = {}
    for stratum, rows in strata.items():
        good, bad = rows.get(1), rows.get(0)
        for rule, (_, _, _, cutoffs) in RULES.items():
            best = (0.0, None)
            for i, cutoff in enumerate(cutoffs):
                if good is None or tail(good["n"], good[f"{rule}:{i}"], each) > corrected:
                    break
                gain = (bad[f"{rule}:{i}"] if bad else 0) - cost * good[f"{rule}:{i}"]
                if gain > best[0]:
                    best = (gain, cutoff)
            if best[1] is not None:
                chosen.setdefault(stratum, {})[rule] = best[1]
    return chosen


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stratum_col: str = "lang", risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """Per row: id, the counts of ``BASE``, ``base_failed``, ``kept`` and ``rejected_by``.

    A null text has no words and so fails; a null stratum is one of its own; a stratum without enough labels to
    certify a cutoff has no rule and keeps what passes the base.  Rows are judged one by one, so repeated rows get
    the same answer; an id that is labelled twice counts with its lower label.  An empty table gives an empty one.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), stratum.alias("stratum"), F.col(text_col).alias("_text"))
    labelled = labels.select(F.col(id_col).alias("_id"), F.col("quality"))
    measured = measure(rows, ["_id", "stratum"], "_text")
    counts = holdout_counts(measured, labelled, "_id").collect()
    cutoffs = certify([r.asDict() for r in counts], risk, level)
    failed = [F.when((F.col("stratum") == s) & _beyond(rule, c), F.lit(rule))
              for s, rules in cutoffs.items() for rule, c in rules.items()]
    by = F.coalesce(F.when(base_failed(), F.lit("base")), *failed)
    return measured.select(F.col("_id").alias(id_col), *BASE, base_failed().alias("base_failed"),
                           by.isNull().alias("kept"), by.alias("rejected_by"))
