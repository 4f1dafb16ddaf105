"""Passages of benchmark items in documents, by a prefix-filtered join on rare shingles.

A window is a run of item words that must occur whole.  Every shingle of a
window is necessary for that, so one is enough as its prefix: the rarest one over
all documents.  Documents are searched for prefixes; where one stands, the window
can only start at one place and needs room on both sides, and there its words
are compared.  Windows are sent to the tasks in blocks of bounded size, so neither
documents nor windows are shuffled, and a passage in many documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.bytehash import ALNUM, Chunk, chunks, lowered, mix, randoms, span_hash

WINDOW = 10
SHINGLE = 3
# Different windows that are held by a task at once; more of them make more blocks.
BLOCK_WINDOWS = 200_000
_STEP = randoms(SHINGLE, 21) | np.uint64(1)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, rows not regarded."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out += words[k:k + count] * _STEP[k]
    return mix(out)


def _words(chunk: Chunk):
    starts, ends, rows = chunk.words(ALNUM)
    return starts, ends, rows, span_hash(chunk.prefix_hash(), starts, ends)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Different windows of every item: ``item`` as text, ``words`` of the window joined by a space, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(lowered(batch.column(1))):
                starts, ends, rows = chunk.words(ALNUM)
                cut = np.searchsorted(rows, np.arange(len(chunk) + 1))
                ids, windows, sizes = [], [], []
                for r in range(len(chunk)):
                    words = [chunk.data[s:e].tobytes().decode() for s, e in zip(starts[cut[r]:cut[r + 1]], ends[cut[r]:cut[r + 1]])]
                    n = min(size, len(words))
                    for w in sorted({" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else ()):
                        ids.append(batch.column(0)[chunk.first + r].as_py())
                        windows.append(w)
                        sizes.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string()), pa.array(sizes, pa.int32())],
                                                 names=["item", "words", "n"])

    return (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "item string, words string, n int"))


class Windows:
    """One block of windows as arrays, ready to be searched for."""

    def __init__(self, words: list[str], items: list[list[str]]):
        self.items = items
        text = pa.array(words, pa.large_string())
        per_window = [w for c in chunks(text, 1 << 30) for w in self._split(c)] if words else []
        self.words = per_window
        self.shingle: list[np.ndarray] = [_shingles(w, min(SHINGLE, len(w))) for w in per_window]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in per_window})

    @staticmethod
    def _split(chunk: Chunk) -> list[np.ndarray]:
        _, _, rows, words = _words(chunk)
        cut = np.searchsorted(rows, np.arange(len(chunk) + 1))
        return [words[cut[r]:cut[r + 1]] for r in range(len(chunk))]

    def all_shingles(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shingle)) if self.shingle else np.zeros(0, np.uint64)

    def order_by(self, shingles: np.ndarray, frequency: np.ndarray) -> None:
        """Choose every window's rarest shingle as prefix; ties go to the first by hash."""
        prefix, offset = [], []
        for own in self.shingle:
            f = frequency[np.searchsorted(shingles, own)]
            at = int(np.lexsort((own, f))[0])
            prefix.append(own[at])
            offset.append(at)
        order = np.argsort(np.array(prefix, dtype=np.uint64), kind="stable")
        self.prefix = np.array(prefix, dtype=np.uint64)[order]
        self.window = order
        self.offset = np.array(offset, dtype=np.int64)[order]
        self.distinct = np.unique(self.prefix)
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)

    def find(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur: (window, place of its first word)."""
        found, places = [], []
        for n in self.sizes:
            hashes = _shingles(words, n)
            if not len(hashes):
                continue
            near = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
            at = np.flatnonzero(self.distinct[near] == hashes)
            lo, hi = np.searchsorted(self.prefix, hashes[at]), np.searchsorted(self.prefix, hashes[at], side="right")
            count = hi - lo
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            window = self.window[entry]
            start = np.repeat(at, count) - self.offset[entry]
            last = start + self.length[window] - 1
            room = (start >= 0) & (last < len(words))
            window, start, last = window[room], start[room], last[room]
            room = rows[start] == rows[last]
            window, start = window[room], start[room]
            same = np.array([np.array_equal(words[s:s + self.length[w]], self.words[w]) for w, s in zip(window, start)], dtype=bool)
            found.append(window[same] if len(window) else window)
            places.append(start[same] if len(window) else start)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(places)


def _frequency(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """In how many documents each shingle stands, summed in the tasks before it is shuffled."""
    def run(batches):
        total = np.zeros(len(shingles), dtype=np.int64)
        for batch in batches:
            for chunk in chunks(lowered(batch.column(0))):
                _, _, rows, words = _words(chunk)
                for n in sizes:
                    hashes = _shingles(words, n)
                    near = np.minimum(np.searchsorted(shingles, hashes), len(shingles) - 1)
                    hit = np.flatnonzero((shingles[near] == hashes) & (rows[:len(hashes)] == rows[n - 1:n - 1 + len(hashes)]))
                    pair = np.unique(rows[hit].astype(np.int64) * len(shingles) + near[hit])
                    total += np.bincount(pair % len(shingles), minlength=len(shingles))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(len(shingles), dtype=np.int64)
    if len(shingles):
        for r in docs.select("_text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]
    return out


def _blocks(windows: DataFrame, size: int) -> Iterator[Windows]:
    """Windows with the items they stand in, at most about ``size`` at a time."""
    grouped = windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    n = max(1, -(-windows.count() // size))
    for b in range(n):
        rows = grouped.where(F.pmod(F.xxhash64("words"), F.lit(n)) == b).collect()
        rows.sort(key=lambda r: r["words"])
        if rows:
            yield Windows([r["words"] for r in rows], [r["items"] for r in rows])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A word is hit if it lies in any occurrence of any window.  Null and empty texts have no words; items without
    words have no window; an item without id is called ``null``, and items that share an id count once.  Without
    items nothing is contaminated.  Repeated rows give repeated results.  Columns of ``keep`` are carried along after the
    id, but for those with the name of a result; no other column is read.
    """
    results = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    keep = [k for k in keep or [] if k != id_col and k not in results]
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                        F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
                        F.struct(*keep, F.lit(0).alias("_none")).alias("_rest"))
    kind, rest = (found.schema[c].dataType.simpleString() for c in ("_id", "_rest"))
    schema = f"_id {kind}, _text string, spans array<long>, items array<string>, _rest {rest}"
    for block in _blocks(item_windows(items, item_id_col, item_text_col, window), block_windows):
        shingles = block.all_shingles()
        block.order_by(shingles, _frequency(found, shingles, block.sizes))
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = found.mapInArrow(_searcher(shared), schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lowered(batch.column(1))
            n_words = []
            for chunk in chunks(column):
                _, _, rows = chunk.words(ALNUM)
                n_words.append(np.bincount(rows, minlength=len(chunk)))
            hits, counts, digests = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                names = sorted(set(items))
                hits.append(_covered(spans))
                counts.append(len(names))
                digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64()),
                 pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), batch.column(4)],
                names=["_id", "n_words", "n_hit", "n_items", "items_sha256", "_rest"])

    return (found.mapInArrow(finish, f"_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, _rest {rest}")
            .select(F.col("_id").alias(id_col), *(F.col("_rest")[k].alias(k) for k in keep), "n_words", "n_hit", "n_items", "items_sha256",
                    (F.col("n_hit") > 0).alias("contaminated")))


def _covered(spans: list[int]) -> int:
    """Words inside the spans, given as begin, end, begin, end, ..."""
    total, reach = 0, -1
    for begin, end in sorted(zip(spans[::2], spans[1::2])):
        total += max(0, end - max(begin, reach))
        reach = max(reach, end)
    return total


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for chunk in chunks(lowered(batch.column(1))):
                _, _, rows, words = _words(chunk)
                first = np.searchsorted(rows, np.arange(len(chunk)))
                for w, at in zip(*block.find(words, rows)):
                    r = int(rows[at])
                    begin = int(at - first[r])
                    spans[chunk.first + r] += [begin, begin + int(block.length[w])]
                    items[chunk.first + r] += block.items[w]
            spans = [_merged(s) for s in spans]
            items = [sorted(set(i)) for i in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), batch.column(4)],
                names=["_id", "_text", "spans", "items", "_rest"])

    return run


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2])):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out
