"""Shards of equal numbers of documents that keep linked ones together, by balanced label propagation.

Documents are linked if they have the same value in a link column; without such columns, if their texts are
equal.  All shards have the same number of rows, one more or less.  Documents with the same links are alike to the
search, so its rows are cells: how many documents of a class stand in a shard.  In each round the weights of a link's
shards are summed and joined to its cells, and every cell wants to go where most of its neighbours are (ties by a
hash all of them share).  The totals of these wishes by shard, target, gain and slice are a small matrix whatever
the number of documents; from it follows what share of each may move without overfilling a shard.  A full shard
takes no part as a target, so a class larger than a shard fills one after the other.

Documents without links have no wish.  They fill what the linked ones leave of every shard.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import stage_result
from negmine.operators.hotkeys import join_unique
from negmine.operators.numbering import number_in_place, number_rows, running_total
from negmine.staging import stage

LAW = "rows"
N_SHARDS = 16
ROUNDS = 16
# Wishes of one gain are moved in so many slices, whole but for the last.
_SLICES = 16


def capacities(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def quotas(wishes: dict[tuple, int], linked: list[int], room: list[int]) -> dict[tuple, int]:
    """How many of each (from, to, gain, slice) may move, so that no shard holds more than its room.

    Higher gains go first.  Only slices that move whole count as leaving, so the bound holds however parts of slices are rounded.
    """
    lists: dict[tuple, list] = defaultdict(list)
    for (i, j, gain, part), n in sorted(wishes.items(), key=lambda x: (-x[0][2], x[0][3])):
        lists[i, j].append((gain, part, n))
    moved = {ij: sum(n for *_, n in parts) for ij, parts in lists.items()}

    def whole(ij: tuple) -> int:
        total = 0
        for *_, n in lists[ij]:
            if total + n > moved[ij]:
                break
            total += n
        return total

    changed = True
    while changed:
        changed = False
        leaving = defaultdict(int)
        for ij in lists:
            leaving[ij[0]] += whole(ij)
        for j in range(len(room)):
            coming = [ij for ij in lists if ij[1] == j and moved[ij]]
            total = sum(moved[ij] for ij in coming)
            over = linked[j] + total - leaving[j] - room[j]
            if over > 0 and total:
                before = {ij: moved[ij] for ij in coming}
                for ij in coming:
                    moved[ij] = moved[ij] * max(0, total - over) // total
                spare = max(0, total - over) - sum(moved[ij] for ij in coming)
                for ij in sorted(coming, key=lambda x: -before[x]):
                    more = min(spare, before[ij] - moved[ij])
                    moved[ij] += more
                    spare -= more
                changed = True
    allowed = {}
    for ij, parts in lists.items():
        left = moved[ij]
        for gain, part, n in parts:
            if left <= 0:
                break
            allowed[*ij, gain, part] = min(left, n)
            left -= n
    return allowed


def _weights(cells: DataFrame, link: str, n_shards: int) -> DataFrame:
    """Per value of a link: how many documents it has in each shard."""
    sums = [F.sum(F.when(F.col("at") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(n_shards)]
    grouped = cells.where(F.col(link).isNotNull()).groupBy(link).agg(*sums)
    return grouped.select(link, F.array(*(f"s{s}" for s in range(n_shards))).alias(f"w_{link}"))


def _wishes(cells: DataFrame, links: list[str], full: list[int], n_shards: int) -> DataFrame:
    """``cells`` with the shard they want to be in, the gain (a power of two) and their slice."""
    for k in links:
        weights = _weights(cells, k, n_shards)
        # a class has a cell per shard at most; only a link of many classes can be a hot key
        cells = cells.join(weights, k) if len(links) == 1 else join_unique(cells, weights, k, "left")

    def score(s: Column) -> Column:
        return sum((F.coalesce(F.get(f"w_{k}", s), F.lit(0)) for k in links), F.lit(0))

    shards = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: ~s.isin(full) | (s == F.col("at"))) if full else F.sequence(F.lit(0), F.lit(n_shards - 1))
    first = F.coalesce(*links)
    best = F.array_max(F.transform(shards, lambda s: F.struct(score(s).alias("score"), F.xxhash64(first, s).alias("turn"), s.alias("s"))))
    found = cells.withColumn("_best", best).withColumn("to", F.col("_best.s"))
    gain = F.floor(F.log2(F.col("_best.score") - score(F.col("at")) + 1)).cast("int")
    return found.select("class", *links, "at", "n", "to", gain.alias("gain"), F.pmod(F.xxhash64("class"), F.lit(_SLICES)).cast("int").alias("part"))


def propagate(cells: DataFrame, links: list[str], room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move cells (class, links, at, n) towards their neighbours; no shard gets more than its room.

    The driver sees the sums of wishes by two shards, gain and slice, and nothing that grows with the documents.
    """
    spark, n_shards = cells.sparkSession, len(room)
    closed: set[int] = set()
    for _ in range(rounds):
        held = {r["at"]: r["n"] for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect()}
        linked = [held.get(s, 0) for s in range(n_shards)]
        closed = {s for s in closed if linked[s] >= room[s]}
        wanted = stage(_wishes(cells, links, sorted(closed), n_shards), "wishes")
        keys = ["at", "to", "gain", "part"]
        wishes = {tuple(r[k] for k in keys): r["n"] for r in wanted.where("at <> to").groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
        chosen = quotas(wishes, linked, room)
        # a full shard that lets few in is no target until rows leave it
        asked, let_in = ({j: sum(v for k, v in x.items() if k[1] == j) for j in range(n_shards)} for x in (wishes, chosen))
        stuck = {j for j in range(n_shards) if 2 * let_in[j] < asked[j]}
        if not chosen and stuck <= closed:
            break
        closed |= stuck
        if not chosen:
            continue
        # one row per two shards, gain and slice
        allowed = F.broadcast(spark.createDataFrame([(*k, v, wishes[k]) for k, v in chosen.items()], "at INT, to INT, gain INT, part INT, may LONG, all LONG"))
        moved = F.coalesce(F.expr("cast(n AS decimal(19, 0)) * cast(may AS decimal(18, 0)) div all"), F.lit(0).cast("long"))
        parted = wanted.join(allowed, keys, "left").select("class", *links, F.explode(F.array(
            F.struct("at", (F.col("n") - moved).alias("n")), F.struct(F.col("to").alias("at"), moved.alias("n")))).alias("x"))
        cells = stage(parted.select("class", *links, "x.at", "x.n").where("n > 0").groupBy("class", *links, "at").agg(F.sum("n").alias("n")), "cells")
    return cells


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, links: list[str] | None = None,
                    rounds: int = ROUNDS) -> DataFrame:
    """Give every row a shard and a place in it.

    Per row: id, ``size`` (UTF-8 bytes of the text and one), ``text_crc32``, ``law`` (always ``rows``: the numbers of rows of two
    shards differ by one at most), ``shard``, ``slot`` (0, 1, 2 … in every shard) and ``grown_shard`` (null under this law).
    Rows with the same value in one of ``links`` are linked, a null links nothing; without ``links`` rows with equal
    texts are.  A null text is an empty one.  Repeated rows and ids, and null ids, are rows like any other.  Which of
    several alike rows stands where follows the order of the scan.  An empty table gives an empty one; other columns are not read.
    """
    names = [f"k{i}" for i in range(len(links or [1]))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    values = [F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in links] if links is not None else [F.xxhash64(text)]
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       *(v.alias(k) for v, k in zip(values, names)))
    one_class = F.col("k0") if len(names) == 1 else F.when(F.coalesce(*names).isNotNull(), F.xxhash64(*names))
    # written first: sorting by ranges reads its input twice, and this is all that is needed of the texts
    numbered = stage(number_rows(stage(rows.withColumn("class", one_class), "rows"), ["class"], "pos"), "numbered")
    placed = stage_result(docs.sparkSession, "placed", lambda: _places(numbered, names, n_shards, rounds))
    total = numbered.count()
    room = capacities(total, n_shards)
    joined = stage(join_unique(numbered.drop(*names), placed, "class", "left"), "joined")
    # of a class the first rows go to its first shard, and so on
    chosen = F.filter("places", lambda x: x["upto"] > F.col("pos") - F.col("first"))[0]["shard"]
    linked = joined.where("places IS NOT NULL").select("_id", "size", "text_crc32", chosen.alias("shard"))
    held = {r["shard"]: r["n"] for r in placed.select(F.explode("places").alias("x")).groupBy("x.shard").agg(F.sum("x.n").alias("n")).collect()}
    ends = np.cumsum([room[s] - held.get(s, 0) for s in range(n_shards)]).tolist()
    fill = F.lit(n_shards - 1)
    for s in range(n_shards - 2, -1, -1):
        fill = F.when(F.col("at") < ends[s], s).otherwise(fill)
    others = number_in_place(joined.where("places IS NULL").select("_id", "size", "text_crc32"), "at").select("_id", "size", "text_crc32", fill.alias("shard"))
    both = number_rows(stage(linked.unionByName(others), "sharded"), ["shard"], "pos")
    starts = F.array(*(F.lit(sum(room[:s])).cast("long") for s in range(n_shards)))
    return both.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                       (F.col("pos") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _places(numbered: DataFrame, links: list[str], n_shards: int, rounds: int) -> DataFrame:
    """Per class of linked rows: its first position, and its shards with their numbers of rows, added up."""
    classes = stage(numbered.where("class IS NOT NULL").groupBy("class", *links).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    room = capacities(numbered.count(), n_shards)
    linked = classes.where("n > 1")
    if len(links) > 1:
        linked = classes.select("*", F.lit(False).alias("shared"))
        for k in links:
            several = classes.where(F.col(k).isNotNull()).groupBy(k).agg((F.sum("n") > 1).alias("_more"))
            linked = stage(join_unique(linked, several, k, "left").withColumn("shared", F.col("shared") | F.coalesce("_more", F.lit(False))).drop("_more"), "linked")
        linked = linked.where("shared").drop("shared")
    # dealt out evenly at first: of the linked rows, in their order, every n-th goes to the same shard
    order = stage(running_total(linked.select("class", *links, "first", "n"), ["class"], "n", "before"), "order")
    count = f"(before + n + {n_shards - 1} - s) div {n_shards} - (before + {n_shards - 1} - s) div {n_shards}"
    cells = (order.select("class", *links, "n", "before", F.explode(F.expr(f"sequence(0, {n_shards - 1})")).alias("s"))
             .select("class", *links, F.col("s").alias("at"), F.expr(count).alias("n")).where("n > 0"))
    final = propagate(stage(cells, "cells"), links, room, rounds)
    listed = final.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("shard"), "n"))).alias("x"))
    places = F.transform("x", lambda a, i: F.struct(a["shard"].alias("shard"), a["n"].alias("n"), F.aggregate(
        F.slice("x", 1, i + 1), F.lit(0).cast("long"), lambda t, b: t + b["n"]).alias("upto")))
    return listed.select("class", places.alias("places")).join(order.select("class", "first"), "class")

