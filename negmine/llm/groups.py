"""From rows (bucket, node) to connected groups of nodes, without listing all pairs of a bucket.

Two nodes may be linked only if they share a bucket.  Every bucket first links its
members to one of them; what is connected by then needs no further comparison.
Only between members that are still in different groups are all pairs compared,
so nothing that a bucket could link is left out, and a large group of alike nodes
costs as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from negmine.llm.batches import free_shuffles, stage_result
from negmine.llm.bytehash import mix
from negmine.staging import discard, stage, stage_in_parts

# From so many rows of a bucket in one batch on, only the first goes to the bucket's partition.
LOCALLY_HOT = 8
ROWS = "bucket long, slot long, lead long, node long"
# A pair of a bucket is left out if both also stand in one of the so many buckets before it, which has the pair already.
BUCKETS_BEFORE = 8
# The pairs of the buckets are joined in so many parts, one after the other, each with its share of the buckets.
JOIN_PARTS = 4


def bucket_batch(bucket: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch for ``shared_buckets``; equal rows once.

    Where many nodes of the batch stand in a bucket, the first leads them here already: ``slot`` sends the others
    elsewhere than to the bucket's own partition, so no partition gets all rows of a hot bucket.
    """
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    keep = np.ones(len(bucket), dtype=bool)
    keep[1:] = (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])
    bucket, node = bucket[keep], node[keep]
    new = np.ones(len(bucket), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(bucket)))
    size = np.repeat(count, count)
    hot = size >= LOCALLY_HOT
    first = np.repeat(node[at], count) if len(at) else node
    # the same batch gets the same place again if its task is repeated
    elsewhere = int(mix(np.bitwise_xor.reduce(mix(node.view(np.uint64)), keepdims=True))[0] >> np.uint64(2)) + 1 if len(node) else 1
    slot = np.where(hot & ~new, elsewhere, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(slot), pa.array(first, mask=~hot), pa.array(node)], names=["bucket", "slot", "lead", "node"])


def shared_buckets(rows: DataFrame, name: str) -> DataFrame:
    """Of rows made by ``bucket_batch`` those in buckets of two nodes or more, as (bucket, lead, node, many), written once.

    One shuffle; a task reads its sorted rows in a stream and holds one batch of them.  ``many`` is false in buckets
    that were seen to have two nodes at most; it may be true in a few more of them, where a batch ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, slot, lead and whether the last row is still to be given
        for batch in batches:
            bucket, slot, node = (batch.column(k).to_numpy() for k in (0, 1, 3))
            known = batch.column(2)
            led = ~np.asarray(known.is_null())
            lead = known.fill_null(0).to_numpy()
            n = len(bucket)
            if not n:
                continue
            if last is not None:
                bucket, slot = np.append(last[0], bucket), np.append(last[1], slot)
                node, lead, led = np.append(last[2], node), np.append(last[3], lead), np.append(last[4], led)
                n += 1
            new = np.ones(n, dtype=bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (slot[1:] != slot[:-1])
            if last is not None and last[5]:
                new[0] = False  # the row before this one was of the same bucket
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1 + (0 if new[0] else 1)
            heads = node[at] if new[0] else np.append(last[6], node[at])
            head = heads[group]
            runs = at if new[0] else np.append(0, at)
            many = (np.diff(np.append(runs, n)) > 2) | np.logical_or.reduceat(led, runs)
            many[-1] = True  # may go on
            many[0] |= not new[0]
            many = many[group]
            more = np.zeros(n, dtype=bool)
            more[:-1] = ~new[1:]
            same = np.zeros(n, dtype=bool)
            same[1:] = (node[1:] == node[:-1]) & ~new[1:]
            # the last row waits for the next batch, which may go on with its bucket
            give = ((~new | more | led) & (~same | led))[:-1]
            out = np.where((slot != 0) & led, lead, head)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[:-1][give]), pa.array(out[give]), pa.array(node[:-1][give]),
                                              pa.array(many[:-1][give])], names=["bucket", "lead", "node", "many"])
            if last is None or n > 1:
                inside = not new[-1]
            else:
                inside = last[5]
            last = (bucket[-1:], slot[-1:], node[-1:], lead[-1:], led[-1:], inside, head[-1:])
        if last is not None and (last[5] or last[4][0]):
            out = last[3] if last[1][0] and last[4][0] else last[6]
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(out), pa.array(last[2]), pa.array([True])],
                                             names=["bucket", "lead", "node", "many"])

    return stage(rows.repartition("bucket", "slot").sortWithinPartitions("bucket", "slot", "node")
                 .mapInArrow(run, "bucket long, lead long, node long, many boolean"), name)


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected to, for all ends of edges (a, b) but those smallest ones.

    Every node with smaller neighbours points to the smallest; pointers are followed to their ends, edges are
    drawn between the ends, and so on until none is left.  Only minima are aggregated, so a node with very many
    neighbours is no large group; every round is written, so losing an executor costs one round.
    """
    left = stage(_pairs(edges), f"{name}-edges")
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).limit(0)
    while not left.isEmpty():
        points = stage(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), f"{name}-points")
        going = True
        while going:
            one, two = (points.select(F.col("node").alias(f"at{i}"), F.col("to").alias(f"to{i}")) for i in (1, 2))
            points = stage(points.join(one, F.col("to") == F.col("at1"), "left").select("node", F.coalesce("to1", "to").alias("mid"))
                           .join(two, F.col("mid") == F.col("at2"), "left")
                           .select("node", F.coalesce("to2", "mid").alias("to"), F.col("to2").isNotNull().alias("moved")), f"{name}-points")
            going = not points.where("moved").isEmpty()
            points = points.drop("moved")
        labels = stage(_relabelled(labels, points).union(points), f"{name}-labels")
        left = stage(_pairs(_between(left, points, "to")), f"{name}-edges")
    free_shuffles(edges.sparkSession)
    return labels


def _pairs(edges: DataFrame) -> DataFrame:
    """Different pairs (a, b) with a < b."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(edges: DataFrame, points: DataFrame, to: str) -> DataFrame:
    """The edges between what their ends point to."""
    for end in ("a", "b"):
        ends = points.select(F.col("node").alias(end), F.col(to).alias("_to"))
        edges = edges.join(ends, end, "left").select(*[c for c in ("a", "b") if c != end], F.coalesce("_to", end).alias(end))
    return edges.select("a", "b")


def _relabelled(labels: DataFrame, points: DataFrame) -> DataFrame:
    step = points.select(F.col("node").alias("label"), F.col("to").alias("_to"))
    return labels.join(step, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))


def joined_labels(labels: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The labels after the edges ``found``, which are staged, have linked some of their groups."""
    added = stage_result(labels.sparkSession, f"{name}-more", lambda: components(_between(found, labels, "label"), name))
    more = added.select("node", F.col("label").alias("to"))
    # labels that moved on, and nodes that had no label of their own so far
    fresh = more.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
    return _relabelled(labels, more).union(fresh)


def _across(known: DataFrame, near: Callable[[str, str], Column]) -> Iterator[DataFrame]:
    """Pairs (a, b) of members of a bucket with different labels, in parts; the rows of a part are shuffled once, and given up after it."""
    for part in range(JOIN_PARTS):
        free_shuffles(known.sparkSession)
        rows = known.where(F.pmod(F.xxhash64("bucket"), F.lit(JOIN_PARTS)) == part)
        # both sides are the same but for names, so one exchange serves both
        one, two = (rows.select(F.col("bucket").alias(f"bucket_{end}"), F.col("node").alias(end), F.col("label").alias(f"label_{end}"),
                                F.col("traits").alias(f"_{end}"), F.col("before").alias(f"before_{end}")) for end in ("a", "b"))
        # alike nodes share many buckets; the smallest one that a pair shares never falls to the last condition
        yield one.join(two, (F.col("bucket_a") == F.col("bucket_b")) & F.expr("a < b and label_a <> label_b")
                       & near("_a", "_b") & ~F.arrays_overlap("before_a", "before_b")).select("a", "b").distinct()


def linked_groups(shared: DataFrame, links: Callable[[DataFrame], DataFrame], name: str, traits: DataFrame,
                  near: Callable[[str, str], Column], star_rounds: int = 1) -> DataFrame:
    """``node`` and ``label`` for all nodes that are linked to a smaller one, directly or not.

    ``shared`` comes from ``shared_buckets``; without ``many`` all its buckets are taken to have many nodes.  ``traits`` holds a struct ``traits`` for every node; ``near`` names a
    condition on two such structs that all linked pairs fulfil.  ``links`` takes different pairs (a, b) with a < b
    that fulfil it and returns those that are linked.  What is staged on the way goes as soon as it was read for the
    last time, ``shared`` too.
    """
    spark = shared.sparkSession

    def linked(pairs: DataFrame) -> DataFrame:
        return stage_result(spark, f"{name}-links", lambda: links(pairs))

    def may_link(x: DataFrame) -> DataFrame:
        left, right = (traits.select(F.col("node").alias(end), F.col("traits").alias(f"_{end}")) for end in ("a", "b"))
        full = x.join(left, "a").join(right.withColumnRenamed("b", "_node"), (F.col("b") == F.col("_node")) & near("_a", "_b"))
        return full.select("a", "b")

    asked = stage(_pairs(shared.select(F.col("lead").alias("a"), F.col("node").alias("b"))), f"{name}-pairs")
    free_shuffles(spark)
    # written: the components read them more than once
    found = linked(may_link(asked))
    labels = stage_result(spark, f"{name}-labels", lambda: components(found, name))
    discard(found)
    read = shared
    # a bucket of two has had its one pair compared; most are such, and they are shuffled no more
    many = shared.where("many") if "many" in shared.columns else shared
    members = many.select("bucket", "node").union(many.select("bucket", F.col("lead").alias("node"))).distinct()
    for round_ in range(star_rounds + 1):
        labelled = (members.join(labels, "node", "left")
                    .select("bucket", "node", F.coalesce("label", "node").alias("label")))
        mixed = (labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"),
                                                F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
                 .where("low <> high and n > 2"))
        # buckets of the same members, as a shared passage makes many, ask for the same pairs
        mixed = mixed.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("low").alias("low")).select("bucket", "low")
        mixed = stage(mixed, f"{name}-mixed")
        free_shuffles(spark)
        if mixed.isEmpty():
            break
        members = stage(labelled.join(mixed, "bucket"), f"{name}-members")
        discard(read, mixed)
        read = members
        free_shuffles(spark)
        if round_ < star_rounds:
            # another leader for everyone: of the members outside the lowest label one, chosen by hash
            best = stage(members.where("label <> low").groupBy("bucket")
                         .agg(F.min_by("node", F.xxhash64("bucket", "node", F.lit(round_))).alias("lead")), f"{name}-leads")
            new = members.join(best, "bucket").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        else:
            before = Window.partitionBy("node").orderBy("bucket").rowsBetween(-BUCKETS_BEFORE, -1)
            known = stage(members.drop("low").withColumn("before", F.collect_list("bucket").over(before)).join(traits, "node"), f"{name}-known")
            discard(members)
            free_shuffles(spark)
            new = stage_in_parts(_across(known, near), f"{name}-across")
        new = _pairs(new).join(asked, ["a", "b"], "left_anti")
        new = stage(may_link(new) if round_ < star_rounds else new, f"{name}-pairs")
        discard(best if round_ < star_rounds else known)
        free_shuffles(spark)
        members = members.select("bucket", "node")
        if new.isEmpty():
            continue
        found = linked(new)
        labels = stage(joined_labels(labels, found, name), f"{name}-labels")
        discard(found)
        asked = asked.union(new)  # pairs that were compared; others need not be looked up again
    return labels
