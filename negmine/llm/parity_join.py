"""Near-duplicate documents by a parity-sketch join over five-word shingles.

The shingles of a document are dealt by hash into as many blocks as its size band
has; a block is sketched by the exclusive or of its shingles.  Every shingle that
two documents do not share spoils at most one block, so the number of blocks that
differ never exceeds the symmetric difference of the sets.  Sets of Jaccard
similarity 0.8 differ in at most a quarter of either set's size; more occupied
blocks than that must be given, and one of them agrees.  Blocks are taken in one
common order: those with the most shingles that are rare in the corpus first, so blocks that hold
nothing but a widespread passage come last.  What meets in a block is compared by bit sketches, whose
Hamming distance is a lower bound too, and then by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import small_batches, stage_result
from negmine.llm.bitset import bitset, may_hold
from negmine.llm.bytehash import SPACED, chunks, lowered, mix, shingle_hashes
from negmine.llm.groups import ROWS, bucket_batch, linked_groups, shared_buckets
from negmine.staging import stage

_U = np.uint64
SHINGLE = 5
# Similar: 100 * intersection >= 80 * union.
PERCENT = 80
# 64-bit words of the folded sketch by which pairs of a bucket are told apart before anything is read again.
FEW = 16


def blocks_of(band: np.ndarray) -> np.ndarray:
    """Blocks of a size band 2**band .. 2**(band+1)-1.

    Small sets get so many that every shingle has one of its own; in larger bands there are as many as the
    smallest set of the band has shingles, which leaves far more of them occupied than a quarter of any set.
    """
    return np.where(band < 6, 1 << 20, 1 << band).astype(np.int64)


def sketch_bits(n: int) -> int:
    """Length of a set's bit sketch: a power of two, so that longer ones fold onto shorter ones."""
    return max(64 * FEW, 2 << max(0, int(n - 1).bit_length()))


def node_of(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set, from its sorted shingles."""
    a = int(mix(hashes * _U(0x9E3779B97F4A7C15) + _U(1)).sum(dtype=_U)) ^ len(hashes)
    b = int(np.bitwise_xor.reduce(mix(hashes + _U(0xD1B54A32D192ED03)))) if len(hashes) else 0
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def parity(hashes: np.ndarray, bits: int) -> bytes:
    place = (mix(hashes ^ _U(0xA5A5A5A5)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes) -> list[int]:
    """FEW words of the sketch, folded by exclusive or."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) > FEW:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x.view(np.int64).tolist()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bit sketches, the longer one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.unpackbits(x ^ y).sum())


def may_differ(a: int, b: int) -> int:
    """The largest symmetric difference with which sets of these sizes are similar."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def block_tokens(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, band: np.ndarray,
                 frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(token, owner) of the blocks that each set must give in the layout of ``band``.

    ``hashes`` are the shingles of all sets, set after set; ``sizes`` and ``band`` are per set.  ``frequent`` says
    which shingles count less.  Any order of blocks will do as long as it depends on a block's shingles alone.
    """
    n_blocks = blocks_of(band)
    block = ((mix(hashes + _U(77)) >> _U(20)) % n_blocks[owner].astype(_U)).astype(np.int64)
    order = np.lexsort((block, owner))
    owner, block, hashes = owner[order], block[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    word = np.bitwise_xor.reduceat(hashes, at)
    full = np.diff(np.append(at, len(owner)))
    rare = full if frequent is None else np.add.reduceat(~frequent[order], at, dtype=np.int64)
    own = owner[at]
    token = mix(word + mix((block[at].astype(_U) << _U(24)) + (band[own].astype(_U) << _U(16)) + np.minimum(full, 65535).astype(_U)))
    rank = np.lexsort((token, -full, -rare, own))
    token, own = token[rank], own[rank]
    first = np.searchsorted(own, np.arange(len(sizes)))
    place = np.arange(len(own)) - first[own]
    need = sizes[own] // 4 + 1  # a set differs from a similar one in at most a quarter of its size
    return token[place < need], own[place < need]


# Cells that shingles are counted in, and parts in which the counts are shuffled.
CELLS = 1 << 24
_SLICES = 64
# A cell is frequent with this many times the mean count, and at least LEAST_FREQUENT documents.
_TIMES = 8
LEAST_FREQUENT = 64


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - 24)).astype(np.int64)


def frequent_cells(docs: DataFrame, text_col: str) -> np.ndarray:
    """Bits of the cells whose shingles stand in many documents, from counts over all of them.

    A rare shingle may share a cell with a frequent one; that costs some selectivity and no result.  A task sums its
    counts before they are shuffled, a reducer holds a few slices of them, the driver gets one bit per cell.
    """
    width = CELLS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.uint8)
        for batch in batches:
            for _, hashes, _ in _sets(batch.column(0)):
                cells, n = np.unique(_cell(hashes), return_counts=True)
                total[cells] += np.minimum(n, 255 - total[cells]).astype(np.uint8)  # full cells stay full
        blobs = [pa.compress(total[i * width:(i + 1) * width].tobytes(), codec="zstd", asbytes=True) for i in range(_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(pa.decompress(blob.as_buffer(), decompressed_size=width, codec="zstd", asbytes=True), np.uint8)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint32)
        blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())],
            names=["slice", "counts", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(count, "slice int, counts binary")
    summed = stage(counts.repartition("slice").mapInArrow(add, "slice int, counts binary, n long"), "cells")
    total = summed.agg(F.sum("n").alias("n")).first().n or 0
    least = max(LEAST_FREQUENT, _TIMES * total // CELLS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column(1):
                raw = pa.decompress(blob.as_buffer(), decompressed_size=4 * width, codec="zstd", asbytes=True)
                blobs.append(np.packbits(np.frombuffer(raw, np.uint32) > least).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["slice", "bits"])

    out = np.zeros(CELLS // 8, dtype=np.uint8)
    for r in summed.select("slice", "counts").mapInArrow(judge, "slice int, bits binary").collect():
        out[r["slice"] * width // 8:(r["slice"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _is_frequent(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = _cell(hashes)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for chunk in chunks(lowered(column)):
        hashes, bounds = shingle_hashes(chunk, SPACED, SHINGLE)
        yield chunk.first, hashes, bounds


def set_rows(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` with the node, its check value, number of shingles and sketches of every row; no node for an empty set.

    ``few`` is the bit sketch folded to FEW words, ``sketch`` all of it, ``whole`` the same as words where it is longer than ``few``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, checks, sizes, few, whole, sketches = [], [], [], [], [], []
            for _, hashes, bounds in _sets(batch.column(len(keep))):
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    a, b = node_of(hashes[lo:hi])
                    nodes.append(a if hi > lo else None)
                    checks.append(b)
                    sizes.append(int(hi - lo))
                    sketch = parity(hashes[lo:hi], sketch_bits(hi - lo))
                    sketches.append(sketch)
                    few.append(folded(sketch))
                    whole.append(np.frombuffer(sketch, np.int64).tolist() if len(sketch) > 8 * FEW else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(few, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=[*keep, "node", "mark", "n_shingles", "few", "whole", "sketch"])

    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [
        "node long", "mark long", "n_shingles long", "few array<long>", "whole array<long>", "sketch binary"]
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, ", ".join(fields))


def _token_rows(docs: DataFrame, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, nodes, seen = [], [], set()
            for _, hashes, bounds in _sets(batch.column(0)):
                fresh, names = [], []
                for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if hi > lo:
                        name = node_of(hashes[lo:hi])[0]
                        if name not in seen:
                            seen.add(name)
                            fresh.append(i)
                            names.append(name)
                if not fresh:
                    continue
                fresh = np.array(fresh)
                sizes = np.diff(bounds)[fresh]
                at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in fresh])
                owner = np.repeat(np.arange(len(fresh)), sizes)
                band = np.frexp(sizes)[1] - 1
                names = np.array(names, dtype=np.int64)
                frequent = _is_frequent(shared.value, hashes[at])
                token, own = block_tokens(hashes[at], owner, sizes, band, frequent)
                buckets.append(token)
                nodes.append(names[own])
                # a set near the lower end of its band may be similar to one of the band below
                low = (sizes * PERCENT < (1 << band) * 100) & (band > 0)
                if low.any():
                    some = low[owner]
                    place = np.cumsum(low) - 1
                    token, own = block_tokens(hashes[at][some], place[owner[some]], sizes[low], band[low] - 1, frequent[some])
                    buckets.append(token)
                    nodes.append(names[low][own])
            if buckets:
                yield bucket_batch(np.concatenate(buckets).view(np.int64), np.concatenate(nodes))

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, ROWS)


def _sets_of(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """Size and shingles of every wanted node, once."""
    shared = docs.sparkSession.sparkContext.broadcast(bitset(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            seen, names, sizes, data = set(), [], [], []
            for _, hashes, bounds in _sets(batch.column(0)):
                own = [node_of(hashes[lo:hi])[0] if hi > lo else 0 for lo, hi in zip(bounds[:-1], bounds[1:])]
                hit = may_hold(wanted, np.array(own, dtype=np.int64)) & (np.diff(bounds) > 0)
                for i in np.flatnonzero(hit):
                    if own[i] not in seen:
                        seen.add(own[i])
                        names.append(own[i])
                        sizes.append(int(bounds[i + 1] - bounds[i]))
                        data.append(hashes[bounds[i]:bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
                                             names=["node", "n", "data"])

    found = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "node long, n long, data binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _judge(pairs: DataFrame, details: DataFrame, similar) -> DataFrame:
    """Pairs (a, b) whose details ``similar`` accepts."""
    left = details.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("data").alias("data_a"))
    right = details.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("data").alias("data_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = [similar(x.as_py(), y.as_py(), n, m) for x, y, (n, m) in zip(batch.column(4), batch.column(5), sizes)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "n_a", "n_b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def _close(x: bytes, y: bytes, n: int, m: int) -> bool:
    return distance(x, y) <= may_differ(n, m)


def _similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    both = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
    return 100 * both >= PERCENT * (n + m - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links of similar sets reach.

    Texts with fewer than five words, but not none, have one shingle of all of them.  Null and empty texts and
    texts without words have none and are linked with nothing: their component is their own id.  Equal sets are
    similar, so copies and rows that repeat an id share a component; a null id is passed over where a component
    has another.  An empty table gives an empty one; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col)


def _near(a: str, b: str) -> Column:
    """Sizes that allow similarity, and sketches that do not rule it out: first folded ones, then those of large sets as a whole.

    A folded sketch of a large set is full, so it tells nothing; the whole one grows with the set.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")

    def close(odd: Column) -> Column:
        return odd * (100 + PERCENT) <= (n + m) * (100 - PERCENT)

    def half(x: Column) -> Column:
        part = F.floor(F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), part), F.slice(x, part + 1, part), lambda u, v: u.bitwiseXOR(v))

    def odd(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, u: s + u)

    few = sum((F.bit_count(F.col(f"{a}.few")[i].bitwiseXOR(F.col(f"{b}.few")[i])) for i in range(FEW)), F.lit(0))
    x, y = F.col(f"{a}.whole"), F.col(f"{b}.whole")
    # sizes that allow similarity have sketches of the same length, or of twice the other's
    whole = F.when(F.size(x) == F.size(y), odd(x, y)).when(F.size(x) > F.size(y), odd(half(x), y)).otherwise(odd(x, half(y)))
    few_only = (F.size(x) == 0) | (F.size(y) == 0)
    return (F.greatest(n, m) * PERCENT <= F.least(n, m) * 100) & close(few) & (few_only | close(whole))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = stage(set_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), ["_id"], "_t"), "sets")
    # rows of a node are alike but for the id
    classes = stage(rows.where("node is not null").groupBy("node").agg(
        F.min("_id").alias("first"), F.min("mark").alias("low"), F.max("mark").alias("high"),
        F.first("n_shingles").alias("n_shingles"), F.first("few").alias("few"), F.first("whole").alias("whole"), F.first("sketch").alias("sketch")), "classes")
    if not classes.where("low <> high").isEmpty():
        raise RuntimeError("two different shingle sets have the same 64-bit name; change the constants in node_of")
    sketches = classes.select("node", F.col("n_shingles").alias("n"), F.col("sketch").alias("data"))

    def links(pairs: DataFrame) -> DataFrame:
        close = stage(_judge(pairs, sketches, _close), "close")
        if close.isEmpty():
            return close
        wanted = stage(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
        return _judge(close, stage(_sets_of(docs, text_col, wanted), "members"), _similar)

    labels = stage_result(docs.sparkSession, "labels", lambda: linked_groups(
        shared_buckets(_token_rows(docs, text_col), "blocks"), links, "near",
        classes.select("node", F.struct("n_shingles", "few", "whole").alias("traits")), _near))
    named = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first")
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stage(named.join(stage(smallest, "smallest"), "label").select("node", "component_id"), "named")
    known = rows.where("node is not null").join(named, "node").select("_id", "n_shingles", "component_id")
    none = rows.where("node is null").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return known.unionByName(none).withColumnRenamed("_id", id_col)
