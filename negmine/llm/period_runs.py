"""Periodic runs of words in texts, by recompression.

The words of a batch of documents, with a symbol of its own between any two, are parsed level by
level: blocks of one symbol become one symbol, then neighbours become pairs wherever a symbol of one
random half of the alphabet stands before one of the other.  Equal parts of the texts are parsed alike
but for their rims, so the levels are a run-length grammar in which the common extension of two places
is read off with one or two steps per level: up while the symbols agree, down from the first that do not.

A run of period q is a stretch in which words q apart are equal.  It has that many such places in a row
that one of them lies on a grid whose step is the least number asked for, about n/q places for each q and
n ln n in all.  Where words on the grid agree, their extensions to both sides are the ends of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import bound_batches
from negmine.llm.bytehash import mix

_U = np.uint64
LEAST = 12
# Words that are parsed together, but for a longer document, and places of the grid that are looked at together.
_WORDS = 1 << 17
_PLACES = 1 << 20


class _Level:
    """Symbols of one level, and how they are put together to those of the next."""

    def __init__(self, sym: np.ndarray, heads: np.ndarray, block: bool, right: np.ndarray | None):
        self.sym, self.block, self.right = sym, block, right
        self.first = np.append(np.flatnonzero(heads), len(sym))  # of every symbol above its first here
        self.parent = np.cumsum(heads) - 1


class Grammar:
    """The levels of a sequence that begins and ends with a symbol found nowhere else in it."""

    def __init__(self, sym: np.ndarray):
        self.levels: list[_Level] = []
        kinds = int(sym.max()) + 1
        turn = 0
        while kinds < len(sym):
            heads = np.ones(len(sym), dtype=bool)
            heads[1:] = sym[1:] != sym[:-1]
            if not heads.all():
                level = _Level(sym, heads, True, None)
                lengths = np.diff(level.first)
                sym, kinds = self._named(sym[level.first[:-1]], lengths)
                self.levels.append(level)
                if kinds == len(sym):
                    break
            side = (mix(np.arange(kinds, dtype=_U) + (_U(turn + 1) << _U(40))) & _U(1)).astype(bool)
            turn += 1
            right = side[sym]
            rising, falling = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
            if np.count_nonzero(falling) > np.count_nonzero(rising):
                right, rising = ~right, falling
            if not rising.any():
                continue
            heads = np.ones(len(sym), dtype=bool)
            heads[1:] = ~rising
            level = _Level(sym, heads, False, right)
            second = np.zeros(len(level.first) - 1, dtype=np.int64)
            two = np.diff(level.first) == 2
            second[two] = sym[level.first[:-1][two] + 1] + 1
            sym, kinds = self._named(sym[level.first[:-1]], second)
            self.levels.append(level)
        self.top = sym

    @staticmethod
    def _named(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, int]:
        codes, kinds = pd.factorize(one * (int(two.max()) + 1) + two)
        return codes.astype(np.int64, copy=False), len(kinds)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from places i and j on (back: up to them) are equal; i and j differ everywhere."""
        x, y = i.copy(), j.copy()
        sign = -1 if back else 1
        at = np.full(len(x), len(self.levels))  # level on which the symbols at x and y are found to differ
        live = np.arange(len(x))
        for k, level in enumerate(self.levels):
            a, b = x[live], y[live]
            same = level.sym[a] == level.sym[b]
            at[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            if not len(live):
                break
            pa_, pb = level.parent[a], level.parent[b]
            if level.block:
                left_a, left_b = (a - level.first[pa_] + 1, b - level.first[pb] + 1) if back else (level.first[pa_ + 1] - a, level.first[pb + 1] - b)
                step = np.minimum(left_a, left_b)
                x[live], y[live] = a + sign * step, b + sign * step
                at[live[left_a != left_b]] = k
                live = live[left_a == left_b]
            else:
                # the second half of the alphabet ends its symbol above, the first half begins it
                step = (level.right[a] != back).astype(np.int64)
                x[live], y[live] = a + sign * step, b + sign * step
            x[live], y[live] = level.parent[x[live]], level.parent[y[live]]
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            down = np.flatnonzero(at > k)
            if not len(down):
                continue
            up_x, up_y = x[down], y[down]
            a, b = (level.first[up_x + 1] - 1, level.first[up_y + 1] - 1) if back else (level.first[up_x], level.first[up_y])
            step = (level.sym[a] == level.sym[b]).astype(np.int64)
            if level.block:
                step *= np.minimum(level.first[up_x + 1] - level.first[up_x], level.first[up_y + 1] - level.first[up_y])
            x[down], y[down] = a + sign * step, b + sign * step
        return sign * (x - i)


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ``words`` are the numbers of the words, document after document.  A run has its smallest period q, at least
    ``max(least, 2 * q)`` words, and no neighbouring word goes on with it.
    """
    empty = np.zeros(0, np.int64)
    if not len(words) or lengths.max() < least:
        return empty, empty, empty, empty
    n_docs = len(lengths)
    begin = np.cumsum(lengths + 1) - lengths  # places of the first words, after one separator each
    sym = np.empty(len(words) + n_docs + 1, dtype=np.int64)
    sym[begin - 1] = np.arange(n_docs)
    sym[-1] = n_docs
    inside = np.ones(len(sym), dtype=bool)
    inside[begin - 1] = inside[-1] = False
    sym[inside] = words + n_docs + 1
    sym = pd.factorize(sym)[0].astype(np.int64, copy=False)
    grammar = Grammar(sym)
    found = []
    # every document with every period, and how many places its grid has
    halves = np.where(lengths >= least, lengths // 2, 0)
    done = np.cumsum(halves) - halves
    for lo, hi in _slices(halves, _PLACES):
        doc = np.repeat(np.arange(lo, hi), halves[lo:hi])
        period = np.arange(len(doc)) - np.repeat(done[lo:hi] - done[lo], halves[lo:hi]) + 1
        step = np.maximum(least, 2 * period) - period
        places = (lengths[doc] - period + step - 1) // step
        for first, last in _slices(places, _PLACES):
            count = places[first:last]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            i = np.repeat(begin[doc[first:last]], count) + at * np.repeat(step[first:last], count)
            q = np.repeat(period[first:last], count)
            hit = np.flatnonzero(sym[i] == sym[i + q])
            i, q = i[hit], q[hit]
            ahead, behind = grammar.extend(i, i + q), grammar.extend(i - 1, i - 1 + q, back=True)
            whole = ahead + behind + q >= np.maximum(least, 2 * q)
            i, q, ahead, behind = i[whole], q[whole], ahead[whole], behind[whole]
            if len(i):
                found.append(_smallest(i - behind, i + ahead + q, q))
    if not found:
        return empty, empty, empty, empty
    start, end, period = _smallest(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    doc = np.searchsorted(begin, start, side="right") - 1
    return doc, start - begin[doc], end - start, period


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most``, or of one that is larger."""
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period: it was found with the multiples too."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Find the periodic runs of every text and leave one period of each.

    Per row: id, ``n_words`` (words lie between blanks of ASCII), ``runs`` (start, length and period in words, by start, then
    period) and ``text``: the words that are left, joined by one space; a word goes if any run holds it after that run's first
    period.  Null and empty texts and texts without words have no runs and become ''.  Rows are taken one by one, so
    repeated rows and ids give equal rows and a null id stays null; an empty table gives an empty one, and other columns are
    not read.  A text of any length is parsed whole, in its own task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        words = pa.array([w for x in texts for w in x], pa.binary()).dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        doc, start, length, period = find_runs(codes, lengths, least)
        begin = np.cumsum(lengths) - lengths
        change = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(change, begin[doc] + start + period, 1)
        np.add.at(change, begin[doc] + start + length, -1)
        stays = np.cumsum(change[:-1]) == 0
        left = []
        has = np.zeros(len(texts), dtype=bool)
        has[doc] = True
        for k, x in enumerate(texts):
            if has[k]:
                x = [w for w, s in zip(x, stays[begin[k]:begin[k] + lengths[k]].tolist()) if s]
            left.append(b" ".join(x))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                        pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(struct)))
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths), runs, pa.array(left, pa.binary()).cast(pa.string())],
                                          names=["_id", "n_words", "runs", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, lo = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                words = (text.as_py() or b"").split()
                if texts and size + len(words) > _WORDS:
                    yield answer(batch.column(0).slice(lo, row - lo), texts)
                    texts, size, lo = [], 0, row
                texts.append(words)
                size += len(words)
            if texts:
                yield answer(batch.column(0).slice(lo), texts)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    out = rows.mapInArrow(run, f"_id {kind}, n_words long, runs {RUNS}, _text string")
    return out.select(F.col("_id").alias(id_col), "n_words", "runs", F.col("_text").alias("text"))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with runs put into one text in ten, told by the id: a known share of texts with one period and its copies."""
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_words")
    # a: first word of the periodic part; p: its period
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int")
    periodic = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    wanted = (h % 10 == 0) & F.col(text_col).isNotNull()
    split = docs.select(F.col(id_col), F.col(text_col), F.when(wanted, words).alias("_words"))
    marked = split.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return marked.select(id_col, F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col(text_col)).alias(text_col))


def digests(collapsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``collapse_runs``: number of runs, the longest one (ties: smallest start, then period) and digests."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = collapsed.select(id_col, "runs", "text", top.alias("_top"))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"), F.expr("(1000 * _top.length) div (-_top.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
