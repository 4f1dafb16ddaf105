"""How far the sources of a language differ in their words: quadtrees over the matrix of groups and terms.

The counts of a language's groups (its sources) by terms are cut into tiles of bounded size: columns by a hash of
the term, rows by blocks of groups.  A tile is a K-squared tree with K = 2: level by level one bit for every
quadrant of a nonzero quadrant says whether it holds a count, and the last level's ones have their counts.  Within
a tile the columns are ordered by the group that uses the term most, so zeros lie together.

For all pairs of groups two tiles of the same columns are walked through together.  Where both have an empty
quadrant all its terms have the price of a count of zero in either group, so they are only counted, for the whole
quadrant of pairs at once; only what is nonzero in one of them is followed down to its leaves and priced there.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from negmine.llm.batches import small_batches
from negmine.staging import stage

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, SMOOTH = 1_000_000_000, 5
# Groups in a block of rows and, on the average, terms in a block of columns.
SIDE = 256
COLUMNS = 200
# Different terms a task counts before it gives them away, and pairs of quadrants walked at once.
_MOST_TERMS = 200_000
_FRONT = 1 << 17
# A lookup table of at most so many bytes is broadcast.
_SMALL_BYTES = 8 << 20

_TO_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Stretches of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TO_TERM).split()


def price(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * n_terms)), exactly."""
    den = np.asarray(total) + SMOOTH * n_terms
    num = np.asarray(count) + SMOOTH
    if den.size and int(den.max()) >= (1 << 63) // 1000:
        return (1 + SCALE * num.astype(object) // den.astype(object)).astype(np.int64)
    out, rest = num // den, num % den
    for _ in range(3):  # three decimal digits at a time stay inside 64 bits
        rest = rest * 1000
        out, rest = out * 1000 + rest // den, rest % den
    return out + 1


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of all documents, and a row without a term for every group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def given() -> pa.RecordBatch:
            rows = [(lang, source, term, n, df[term]) for (lang, source), (all_, df) in counts.items() for term, n in all_.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in counts]
            counts.clear()
            lang, source, term, n, df = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
                                               pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = counts.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text.as_py())
                own[0].update(words)
                own[1].update(set(words))
            if sum(len(x[0]) for x in counts.values()) > _MOST_TERMS:
                yield given()
        if counts:
            yield given()

    with small_batches(docs.sparkSession):
        found = docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
        return stage(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")


def _with(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a table that has one row per key, broadcast if it is measured to be small."""
    size = lookup.agg(F.sum(sum((F.length(F.col(k).cast("string").cast("binary")) + 16 for k in lookup.columns), F.lit(0)))).first()[0] or 0
    return rows.join(F.broadcast(lookup) if size <= _SMALL_BYTES else lookup, keys)


class Quadtree:
    """Bits of the quadrants, level by level, of a matrix of ``size`` rows and columns; counts of its leaves."""

    def __init__(self, levels: list[np.ndarray], counts: np.ndarray):
        self.levels, self.counts = levels, counts
        self.size = 1 << len(levels)
        self.child = [np.where(bits, np.cumsum(bits) - 1, -1) for bits in levels]

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, count: np.ndarray, depth: int) -> Quadtree:
        place = np.zeros(len(row), dtype=np.int64)
        for k in range(depth):
            place |= ((row >> k & 1) << 1 | (column >> k & 1)) << 2 * k
        order = np.argsort(place, kind="stable")
        place = place[order]
        levels, parents = [], np.zeros(1 if len(place) else 0, dtype=np.int64)
        for k in range(depth - 1, -1, -1):
            nodes = np.unique(place >> 2 * k)
            bits = np.zeros(4 * len(parents), dtype=bool)
            bits[4 * np.searchsorted(parents, nodes >> 2) + (nodes & 3)] = True
            levels.append(bits)
            parents = nodes
        return cls(levels, count[order])

    def to_bytes(self) -> tuple[bytes, bytes]:
        return np.packbits(np.concatenate([*self.levels, np.zeros(0, bool)])).tobytes(), self.counts.astype(np.int64).tobytes()

    @classmethod
    def from_bytes(cls, bits: bytes, counts: bytes, depth: int) -> Quadtree:
        values = np.frombuffer(counts, np.int64)
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        levels, at, nodes = [], 0, 1 if len(values) else 0
        for _ in range(depth):
            levels.append(flat[at:at + 4 * nodes])
            at += 4 * nodes
            nodes = int(np.count_nonzero(levels[-1]))
        return cls(levels, values)

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count) of every nonzero cell."""
        row = column = np.zeros(1 if len(self.counts) else 0, dtype=np.int64)
        for bits in self.levels:
            at = np.flatnonzero(bits)
            row, column = row[at >> 2] * 2 + (at >> 1 & 1), column[at >> 2] * 2 + (at & 1)
        return row, column, self.counts

    def below(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Nodes of the next level, -1 for empty quadrants and for those of empty ones."""
        child = self.child[level]
        if not len(child):
            return np.full(len(node), -1)
        return np.where(node >= 0, child[np.maximum(node, 0) * 4 + quadrant], -1)


def tile_distances(one: Quadtree, two: Quadtree, total_1: np.ndarray, total_2: np.ndarray, n_columns: int, n_terms: int, same: bool) -> np.ndarray:
    """Sum over the tile's columns of the differences in price, for all pairs of a row of one and a row of two.

    ``same`` says that both are the same tile; then only pairs of an earlier and a later row are priced.
    """
    n1, n2, depth = len(total_1), len(total_2), len(one.levels)
    out = np.zeros((n1, n2), dtype=np.int64)
    zero = [np.zeros((1 << k, 1 << k), dtype=np.int64) for k in range(depth + 1)]

    def walk(level: int, r1, r2, c, a, b) -> None:
        if len(r1) > _FRONT:
            for part in np.array_split(np.arange(len(r1)), 2):
                walk(level, r1[part], r2[part], c[part], a[part], b[part])
            return
        size = one.size >> level
        empty = (a < 0) & (b < 0)
        if empty.any():
            at = np.flatnonzero(empty)
            np.add.at(zero[level], (r1[at], r2[at]), np.minimum(size, n_columns - c[at] * size))
            at = np.flatnonzero(~empty)
            r1, r2, c, a, b = r1[at], r2[at], c[at], a[at], b[at]
        if not len(r1):
            return
        if level == depth:
            x = np.where(a >= 0, one.counts[np.maximum(a, 0)] if len(one.counts) else 0, 0)
            y = np.where(b >= 0, two.counts[np.maximum(b, 0)] if len(two.counts) else 0, 0)
            np.add.at(out, (r1, r2), np.abs(price(x, total_1[r1], n_terms) - price(y, total_2[r2], n_terms)))
            return
        down = np.repeat(np.arange(len(r1)), 8)
        part = np.tile(np.arange(8), len(r1))
        half = size >> 1
        r1, r2, c = r1[down] * 2 + (part >> 2), r2[down] * 2 + (part >> 1 & 1), c[down] * 2 + (part & 1)
        inside = (r1 * half < n1) & (r2 * half < n2) & (c * half < n_columns)
        if same:
            inside &= r1 <= r2
        down, part, r1, r2, c = down[inside], part[inside], r1[inside], r2[inside], c[inside]
        walk(level + 1, r1, r2, c, one.below(level, a[down], (part >> 2) * 2 + (part & 1)), two.below(level, b[down], (part >> 1 & 1) * 2 + (part & 1)))

    if n_columns and n1 and n2:
        root = np.zeros(1, dtype=np.int64)
        walk(0, root, root, root, root if len(one.counts) else root - 1, root if len(two.counts) else root - 1)
        both = sum(np.kron(z, np.ones((one.size >> k, one.size >> k), dtype=np.int64))[:n1, :n2] for k, z in enumerate(zero) if z.any())
        if not isinstance(both, int):
            none_1, none_2 = price(np.zeros(n1, np.int64), total_1, n_terms), price(np.zeros(n2, np.int64), total_2, n_terms)
            out += both * np.abs(none_1[:, None] - none_2[None])
    return out


_TILE = ("lang string, cb long, rb int, n_terms long, lang_total long, depth int, n_columns int, totals binary, tree binary, counts binary, "
         "terms array<string>, all binary")


def _tiles(terms: DataFrame, langs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per language, block of groups and block of terms: the tree of its counts and what prices need."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / COLUMNS)).cast("long")
    heavy = F.array_max(F.transform("cells", lambda x: F.struct(x["n"].alias("n"), (-x["g"]).alias("g"))))["g"]
    placed = (_with(terms, langs, ["lang"]).withColumn("cb", F.pmod(F.xxhash64("term"), blocks))
              .withColumn("col", F.row_number().over(Window.partitionBy("lang", "cb").orderBy(heavy.desc(), "term")) - 1)
              .select("lang", "cb", "col", "term", "n", "cells", F.explode(F.expr(f"sequence(0, cast((n_groups - 1) div {SIDE} as int))")).alias("rb"))
              .withColumn("cells", F.expr(f"filter(cells, x -> x.g div {SIDE} = rb)")))
    cells = F.transform("cells", lambda x: F.struct((x["g"] % SIDE).cast("int").alias("g"), x["n"].alias("n")))
    tiles = placed.groupBy("lang", "cb", "rb").agg(F.collect_list(F.struct("col", "term", "n", cells.alias("cells"))).alias("columns"))
    # a language without kept terms has tiles without columns, so that its pairs come out too
    bare = langs.where("n_terms = 0").select("lang", F.lit(0).cast("long").alias("cb"), F.explode(F.expr(f"sequence(0, cast((n_groups - 1) div {SIDE} as int))")).alias("rb"))
    tiles = tiles.unionByName(bare, allowMissingColumns=True)
    rows = groups.withColumn("rb", F.expr(f"cast(g div {SIDE} as int)")).groupBy("lang", "rb", "n_terms", "lang_total").agg(
        F.array_sort(F.collect_list(F.struct("g", "total"))).alias("totals"))
    rows = rows.withColumn("totals", F.col("totals.total"))
    full = tiles.join(F.broadcast(rows) if groups.count() <= _SMALL_BYTES // 64 else rows, ["lang", "rb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = sorted(r["columns"] or [], key=lambda x: x["col"])
                row = np.array([c["g"] for x in columns for c in x["cells"]], dtype=np.int64)
                count = np.array([c["n"] for x in columns for c in x["cells"]], dtype=np.int64)
                column = np.repeat(np.arange(len(columns)), [len(x["cells"]) for x in columns])
                depth = max(SIDE, len(columns), 1).bit_length() if len(columns) > SIDE else SIDE.bit_length() - 1
                tree, counts = Quadtree.of(row, column, count, depth).to_bytes()
                yield pa.RecordBatch.from_pylist([{
                    **{k: r[k] for k in ("lang", "cb", "rb", "n_terms", "lang_total")}, "depth": depth, "n_columns": len(columns),
                    "totals": np.array(r["totals"], dtype=np.int64).tobytes(), "tree": tree, "counts": counts,
                    "terms": [x["term"] for x in columns], "all": np.array([x["n"] for x in columns], dtype=np.int64).tobytes()}], schema=schema)

    schema = pa.schema([("lang", pa.string()), ("cb", pa.int64()), ("rb", pa.int32()), ("n_terms", pa.int64()), ("lang_total", pa.int64()),
                        ("depth", pa.int32()), ("n_columns", pa.int32()), ("totals", pa.binary()), ("tree", pa.binary()), ("counts", pa.binary()),
                        ("terms", pa.list_(pa.string())), ("all", pa.binary())])
    with small_batches(terms.sparkSession, 20):
        return stage(full.select("lang", "cb", "rb", "n_terms", "lang_total", "totals", "columns").mapInArrow(run, _TILE), "tiles")


def _tree(r: dict, end: str = "") -> Quadtree:
    return Quadtree.from_bytes(r[f"tree{end}"], r[f"counts{end}"], r["depth"])


def _pairs(tiles: DataFrame) -> DataFrame:
    """(lang, g, h, value) with g < h of all pairs of groups."""
    one = tiles.select("lang", "cb", "rb", "n_terms", "depth", "n_columns", "totals", "tree", "counts")
    two = tiles.select("lang", "cb", *(F.col(k).alias(f"{k}_2") for k in ("rb", "totals", "tree", "counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, rb, rb_2), value in sums.items():
                g, h = np.divmod(np.arange(value.size), value.shape[1])
                keep = g < h if rb == rb_2 else np.ones(len(g), dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(g[keep] + rb * SIDE), pa.array(h[keep] + rb_2 * SIDE), pa.array(value.ravel()[keep])],
                    names=["lang", "g", "h", "value"])
            sums.clear()

        for batch in batches:
            for r in batch.to_pylist():
                t1, t2 = np.frombuffer(r["totals"], np.int64), np.frombuffer(r["totals_2"], np.int64)
                value = tile_distances(_tree(r), _tree(r, "_2"), t1, t2, r["n_columns"], r["n_terms"], r["rb"] == r["rb_2"])
                key = (r["lang"], r["rb"], r["rb_2"])
                sums[key] = sums[key] + value if key in sums else value
                if len(sums) > 64:
                    yield from given()
        yield from given()

    with small_batches(tiles.sparkSession, 20):
        both = one.join(two, ["lang", "cb"]).where("rb <= rb_2")
        parts = both.select(*one.columns, "rb_2", "totals_2", "tree_2", "counts_2").mapInArrow(run, "lang string, g long, h long, value long")
        return stage(parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value")), "pairs")


def _terms_above(tiles: DataFrame, top: int) -> DataFrame:
    """(lang, g, item, value): a task's ``top`` terms of each group that are priced above their language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}

        def cut(key: tuple) -> None:
            best[key] = heapq.nsmallest(top, best[key])

        for batch in batches:
            for r in batch.to_pylist():
                row, column, count = _tree(r).leaves()
                totals, all_ = np.frombuffer(r["totals"], np.int64), np.frombuffer(r["all"], np.int64)
                if not len(row):
                    continue
                over = price(count, totals[row], r["n_terms"]) - price(all_[column], np.full(len(column), r["lang_total"]), r["n_terms"])
                up = np.flatnonzero(over > 0)
                for g, c, v in zip(row[up].tolist(), column[up].tolist(), over[up].tolist()):
                    key = (r["lang"], g + r["rb"] * SIDE)
                    own = best.setdefault(key, [])
                    own.append((-v, r["terms"][c]))
                    if len(own) >= 8 * top:
                        cut(key)
        for key in list(best):
            cut(key)
        rows = [(lang, g, item, -v) for (lang, g), own in best.items() for v, item in own]
        lang, g, item, value = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(g, pa.int64()), pa.array(item, pa.string()), pa.array(value, pa.int64())],
                                         names=["lang", "g", "item", "value"])

    with small_batches(tiles.sparkSession, 20):
        return stage(tiles.select("lang", "rb", "n_terms", "lang_total", "depth", "totals", "tree", "counts", "terms", "all").mapInArrow(
            run, "lang string, g long, item string, value long"), "above")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """How far each (lang, source) group is from the other sources of its language, and by which terms.

    A language keeps the terms that stand in ``least_docs`` of its documents at least.  Rows: lang, source, part, item, value,
    rank.  Part ``pair`` has every other source of the language with the sum over all kept terms of the difference in price;
    part ``term`` the ``top_terms`` terms of the group that are priced above the language, with the difference.  Ranks run by
    falling value, then by the item's bytes.  Null texts, languages and sources are empty ones; a group without
    terms, or in a language that keeps none, still has its pairs (0 where nothing is kept), and a language of one source has no
    pairs.  Every repeated row counts.  An empty table gives an empty one; other columns are not read.
    """
    def plain(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    base = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    counted = count_terms(base)
    named = stage(counted.where("term IS NULL").select("lang", "source")
                  .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "named")
    cells = _with(counted.where("term IS NOT NULL"), named, ["lang", "source"])
    terms = stage(cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("g", "n")).alias("cells"))
                  .where(F.col("df") >= least_docs).drop("df"), "terms")
    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("lang_total"))
    langs = stage(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(per_lang, "lang", "left").na.fill(0), "langs")
    totals = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.g").alias("g")).agg(F.sum("c.n").alias("total"))
    groups = stage(named.join(totals, ["lang", "g"], "left").na.fill(0, ["total"]).join(langs, "lang"), "groups")
    tiles = _tiles(terms, langs.select("lang", "n_groups", "n_terms"), groups)
    source = groups.select("lang", "g", "source")
    both = _pairs(tiles).select("lang", F.explode(F.array(F.struct("g", "h", "value"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), "value"))).alias("p"))
    other = source.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    pairs = _with(both.select("lang", "p.*"), other, ["lang", "h"]).select("lang", "g", F.lit("pair").alias("part"), "item", "value")
    above = _terms_above(tiles, top_terms).select("lang", "g", F.lit("term").alias("part"), "item", "value")
    ranked = pairs.unionByName(above).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "g", "part").orderBy(F.desc("value"), "item")))
    return _with(ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms)), source, ["lang", "g"]).select(
        "lang", "source", "part", "item", "value", "rank")
