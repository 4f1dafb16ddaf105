"""Removal of long repeated byte strings, by window hashes over sampled positions.

A suffix array of every byte position is not needed to know which strings of
``LENGTH`` bytes occur twice.  Positions are sampled so that every such string holds
one at a place that depends on its bytes alone: the least q-gram of all its q-grams.
Sampled positions fall into buckets by their q-gram.  Around a position lie SPAN
strings that hold it; a bucket's members are split by the bytes of all those strings
together.  Members that agree are repeated there as a whole.  Where a bucket has
members that do not, the range of strings is cut into parts, each part's common bytes
are hashed anew and name its bucket, and the same step is repeated on these smaller
buckets, down to single strings.  This replaces bucket-pointer refinement: no bucket
name of another offset enters a key, so none has to be joined.  Only buckets with members that
differ are refined, so each level handles little more than the ends of matches.
Buckets are named by 64-bit hashes and their parts by others of a second kind; no text is
shuffled for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import small_batches, stage_result
from negmine.llm.bitset import bitset, may_hold
from negmine.llm.bytehash import Chunk, chunks, mix, span_hash
from negmine.staging import stage

_U = np.uint64
LENGTH = 200
# Widths of the ranges of strings at each level of refinement, as shares of the first.
_CUTS = (1, 8, 128)
# From so many different members of a bucket in one batch on, the rest goes to the next level unasked.
_MANY = 8
# Rows compared among themselves at once before they are shuffled.
_TOGETHER = 100_000
_ROWS = "bucket long, part long, text long, lo long, hi long, kind int"
_PLAIN, _RANGE, _DEEPER, _COVERED = 0, 1, 2, 3


def span_of(length: int) -> int:
    """Strings around a sampled position: the largest power of two below two thirds of the length."""
    return 1 << max(0, (2 * length // 3).bit_length() - 1)


def sampled(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions with their row and q-gram hash."""
    span = span_of(length)
    gram, n = length - span + 1, len(chunk.data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.arange(n - gram + 1)
    grams = span_hash(chunk.prefix_hash(1), at, at + gram)
    least = (grams & _U(0xFFFFFFFF00000000)) | at.astype(_U)  # ties go to the first
    step = 1
    while step < span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    inside = np.zeros(n + 1, dtype=np.int64)  # strings that lie in one row
    size = np.diff(chunk.offsets)
    fits = size >= length
    np.add.at(inside, chunk.offsets[:-1][fits], 1)
    np.add.at(inside, (chunk.offsets[1:] - length + 1)[fits], -1)
    valid = np.cumsum(inside)[:len(least)] > 0
    places = (least[valid] & _U(0xFFFFFFFF)).astype(np.int64)
    if not len(places):
        return places, places, np.zeros(0, _U)
    new = np.ones(len(places), dtype=bool)
    new[1:] = places[1:] != places[:-1]
    places = np.unique(places[new])
    return places, np.searchsorted(chunk.offsets, places, side="right") - 1, grams[places]


class Parts:
    """The ranges of strings around sampled positions at one level: string l starts l bytes before the position."""

    def __init__(self, chunk: Chunk, place: np.ndarray, row: np.ndarray, first: np.ndarray, width: int, length: int):
        begin, end = chunk.offsets[row], chunk.offsets[row + 1]
        last = first + width - 1
        lo, hi = np.maximum(first, place - (end - length)), np.minimum(last, place - begin)
        some = lo <= hi  # at least one string lies in the row
        self.place, self.row, self.first = place[some], row[some], first[some]
        first, last, lo, hi, begin = first[some], last[some], lo[some], hi[some], begin[some]
        common = span_hash(chunk.prefix_hash(1), self.place - first, self.place - last + length)
        self.bucket = common if width > 1 else mix(common)
        self.start, self.stop = self.place - hi, self.place - lo + length
        whole = span_hash(chunk.prefix_hash(2), self.start, self.stop)
        self.part = mix(whole + (lo - first).astype(_U) * _U(0x9E3779B1) + (last - hi).astype(_U) * _U(0x85EBCA77))
        self.lo, self.hi = self.start - begin, self.stop - begin


def level_parts(chunk: Chunk, level: int, deeper: list[np.ndarray], length: int) -> Parts:
    """What a level compares: ranges whose bucket was found to need it at every level before."""
    span = span_of(length)
    place, row, _ = sampled(chunk, length)
    first = np.zeros(len(place), dtype=np.int64)
    parts = Parts(chunk, place, row, first, span, length)
    width = span
    for at in range(1, level + 1):
        wanted = may_hold(deeper[at - 1], parts.bucket)
        smaller = max(1, span // _CUTS[at])
        n = width // smaller
        place, row = np.repeat(parts.place[wanted], n), np.repeat(parts.row[wanted], n)
        first = np.repeat(parts.first[wanted], n) + np.tile(np.arange(n) * smaller, wanted.sum())
        parts, width = Parts(chunk, place, row, first, smaller, length), smaller
    return parts


def _merged(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the same text that touch or overlap, as one."""
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order]
    out = []
    for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist()):
        if out and out[-1][0] == t and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([t, a, b])
    x = np.array(out, dtype=np.int64).reshape(-1, 3)
    return x[:, 0], x[:, 1], x[:, 2]


def _record(bucket, part, text, lo, hi, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (bucket, part, text, lo, hi)] + [pa.array(kind, pa.int32())],
        names=["bucket", "part", "text", "lo", "hi", "kind"])


def _level_rows(docs: DataFrame, level: int, deeper: list[np.ndarray], length: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(deeper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            got: list[tuple] = []
            held = 0
            for chunk in chunks(batch.column(0)):
                names = np.zeros(len(chunk), dtype=np.int64)
                fresh = np.zeros(len(chunk), dtype=bool)
                for i in range(len(chunk)):
                    if chunk.offsets[i + 1] - chunk.offsets[i] >= length:
                        names[i] = _name(chunk.data[chunk.offsets[i]:chunk.offsets[i + 1]])[0]
                        fresh[i] = names[i] not in seen
                        seen.add(int(names[i]))
                if not fresh.any():
                    continue
                p = level_parts(chunk, level, shared.value, length)
                keep = fresh[p.row]
                got.append((p.bucket[keep].view(np.int64), p.part[keep].view(np.int64), names[p.row[keep]], p.lo[keep], p.hi[keep]))
                held += int(keep.sum())
                if held >= _TOGETHER:
                    yield _combined(*(np.concatenate(x) for x in zip(*got)))
                    got, held = [], 0
            if got:
                yield _combined(*(np.concatenate(x) for x in zip(*got)))

    return docs.mapInArrow(run, _ROWS)


def _combined(bucket, part, text, lo, hi) -> pa.RecordBatch:
    """Compare the members of one batch among themselves, so that few rows of a hot bucket are shuffled."""
    order = np.lexsort((lo, text, part, bucket))
    bucket, part, text, lo, hi = (x[order] for x in (bucket, part, text, lo, hi))
    keep = np.ones(len(bucket), dtype=bool)
    keep[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (text[1:] != text[:-1]) | (lo[1:] != lo[:-1])
    bucket, part, text, lo, hi = (x[keep] for x in (bucket, part, text, lo, hi))
    new_bucket, new_part = np.ones(len(bucket), dtype=bool), np.ones(len(bucket), dtype=bool)
    new_bucket[1:] = bucket[1:] != bucket[:-1]
    new_part[1:] = new_bucket[1:] | (part[1:] != part[:-1])
    at = np.flatnonzero(new_part)
    size = np.diff(np.append(at, len(bucket)))
    covered = np.repeat(size, size) >= 2
    texts, starts, stops = _merged(text[covered], lo[covered], hi[covered])
    heads = new_part.copy()
    number = np.cumsum(new_part) - 1  # of the part, then of the part within its bucket
    first = np.flatnonzero(new_bucket)
    within = number - np.repeat(number[first], np.diff(np.append(first, len(bucket)))) if len(first) else number
    heads &= within < _MANY
    kind = np.where(covered[heads], _COVERED, _PLAIN)
    return _record(
        np.concatenate([bucket[heads], mix(texts.view(_U)).view(np.int64)]), np.concatenate([part[heads], texts]),
        np.concatenate([text[heads], texts]), np.concatenate([lo[heads], starts]), np.concatenate([hi[heads], stops]),
        np.concatenate([kind, np.full(len(texts), _RANGE)]))


def _refined(rows: DataFrame, name: str) -> DataFrame:
    """Ranges that are repeated and buckets that need the next level, from sorted rows read in a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, inside = None, False  # the row before, not judged yet, and whether its part has an earlier one
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(6)]
            done = columns[5] == _RANGE
            if done.any():
                yield _record(*(x[done] for x in columns))
            columns = [x[~done] for x in columns]
            if last is not None:
                columns = [np.append(a, b) for a, b in zip(last, columns)]
            new = np.ones(len(columns[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns[:4]])
            bucket, part, text, lo, hi, kind = columns = [x[new] for x in columns]  # copies of a text count once
            n = len(bucket)
            if not n:
                continue
            like, near = np.zeros(n + 1, dtype=bool), np.zeros(n, dtype=bool)
            near[1:] = bucket[1:] == bucket[:-1]
            like[1:n] = near[1:] & (part[1:] == part[:-1])
            deep = near & ~like[:n]
            like[0] = inside
            hit = (like[:n] | like[1:]) & (kind != _COVERED)
            last, inside = [x[-1:] for x in columns], bool(like[n - 1])
            hit[-1] = False
            yield _record(*(np.concatenate([x[hit], x[deep]]) for x in columns[:5]),
                          np.concatenate([np.full(hit.sum(), _RANGE), np.full(deep.sum(), _DEEPER)]))
        if last is not None and inside and last[5][0] != _COVERED:
            yield _record(*last[:5], np.full(1, _RANGE))

    return stage(rows.repartition("bucket").sortWithinPartitions("bucket", "part", "text", "lo").mapInArrow(run, _ROWS), name)


def _name(data: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a text."""
    x = xxhash.xxh3_128_intdigest(data.tobytes())
    return (x >> 64) - (1 << 63), (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _named_rows(docs: DataFrame) -> DataFrame:
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, marks, sizes, digests = [], [], [], []
            for chunk in chunks(batch.column(1)):
                for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:]):
                    data = chunk.data[a:b]
                    name, mark = _name(data)
                    names.append(name)
                    marks.append(mark)
                    sizes.append(int(b - a))
                    digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=["_id", "text", "mark", "n_bytes", "sha256"])

    return docs.mapInArrow(run, f"_id {kind}, text long, mark long, n_bytes long, sha256 string")


def repeated_ranges(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(text, lo, hi): byte ranges of differing texts, by their names, that are covered by repeated strings.

    A text that stands in several rows counts once here.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    deeper: list[np.ndarray] = []
    ranges = None
    for level in range(len(_CUTS)):
        found = _refined(_level_rows(texts, level, deeper, length), f"level{level}")
        own = found.where(F.col("kind") == _RANGE).select("text", "lo", "hi")
        ranges = own if ranges is None else ranges.union(own)
        if level + 1 < len(_CUTS):
            deeper.append(bitset(found.where(F.col("kind") == _DEEPER).select("bucket").distinct(), "bucket"))
    return ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts at another place too.

    Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of what is left and the
    ``spans`` themselves as (lo, hi) byte offsets.  Null texts are empty.  Texts shorter than ``length`` keep all;
    rows with equal texts of that length or more, repeated rows included, lose all.  An empty table gives an empty one;
    other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs, id_col, text_col, length)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = stage(_named_rows(base), "texts")
    classes = stage(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high"),
                                             F.max("n_bytes").alias("n_bytes")), "classes")
    if not classes.where("low <> high").isEmpty():
        raise RuntimeError("two different texts have the same 64-bit name")
    copied = classes.where((F.col("n") > 1) & (F.col("n_bytes") >= length)).select("text", "n_bytes")
    spans = stage_result(docs.sparkSession, "spans", lambda: (
        repeated_ranges(base, "_text", length).join(copied, "text", "left_anti")
        .groupBy("text").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))))
    wanted = docs.sparkSession.sparkContext.broadcast(bitset(spans, "text"))

    def affected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for chunk in chunks(batch.column(0)):
                for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:]):
                    if b - a >= length:
                        name = _name(chunk.data[a:b])[0]
                        if may_hold(wanted.value, np.array([name]))[0]:
                            names.append(name)
                            texts.append(chunk.data[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.binary())], names=["text", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests = [], [], []
            for data, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
                data, whole = data.as_py(), []
                for r in ranges:
                    if whole and r["lo"] <= whole[-1]["hi"]:
                        whole[-1]["hi"] = max(whole[-1]["hi"], r["hi"])
                    else:
                        whole.append(r)
                kept, at = hashlib.sha256(), 0
                for r in whole:
                    kept.update(data[at:r["lo"]])
                    at = r["hi"]
                kept.update(data[at:])
                removed.append(sum(r["hi"] - r["lo"] for r in whole))
                runs.append(whole)
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                 pa.array(digests, pa.string())], names=["text", "n_removed", "spans", "kept_sha256"])

    some = (base.select("_text").mapInArrow(affected, "text long, data binary").join(spans, "text").select("text", "data", "ranges")
            .mapInArrow(cut, "text long, n_removed long, spans array<struct<lo:long,hi:long>>, kept_sha256 string"))
    nothing = hashlib.sha256(b"").hexdigest()
    all_ = copied.select("text", F.col("n_bytes").alias("n_removed"),
                         F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))).alias("spans"),
                         F.lit(nothing).alias("kept_sha256"))
    cuts = stage(some.unionByName(all_), "cuts")
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    return (rows.join(cuts, "text", "left")
            .select(F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                    F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", none).alias("spans")))
