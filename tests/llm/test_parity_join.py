import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from negmine.llm import groups, parity_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def brute(texts):
    sets, label = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if similar(sets[a], sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in texts}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_table(documents, texts):
    assert got(parity_join.near_duplicates(documents)) == brute(texts)


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_chains_hot_passages_and_sizes(spark, monkeypatch, frequent):
    monkeypatch.setattr(groups, "LOCALLY_HOT", 3)
    monkeypatch.setattr(parity_join, "LEAST_FREQUENT", frequent)
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    passage = " ".join(rng.choice(word, size=30))
    for size in (1, 3, 5, 8, 12, 20, 40, 63, 64, 70, 80, 120, 130, 160, 300):
        base = list(rng.choice(word, size=size))
        for step in range(6):  # each differs a little from the one before, so far ends are linked by the chain only
            texts[n] = " ".join(base) + (" " + passage if size > 100 and step % 2 else "")
            n += 1
            at = int(rng.integers(len(base)))
            base[at] = f"new{n}"
            if step % 2:
                base = base + list(rng.choice(word, size=max(1, size // 30)))
    for _ in range(40):
        texts[n] = " ".join(rng.choice(word, size=int(rng.integers(40, 90)))) + " " + passage
        n += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").repartition(5)
    assert got(parity_join.near_duplicates(frame)) == brute(texts)


def test_enough_occupied_blocks():
    rng = np.random.default_rng(3)
    for n in [*range(1, 70), 100, 127, 128, 160, 500, 1024, 1279, 5000]:
        hashes = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        sizes = np.array([len(hashes)])
        band = np.frexp(sizes)[1] - 1
        for b in (band, band - 1):
            if b[0] >= 0 and (b[0] == band[0] or sizes[0] * 80 < (1 << band[0]) * 100):
                token, _ = parity_join.block_tokens(hashes, np.zeros(len(hashes), np.int64), sizes, b)
                assert len(token) == n // 4 + 1


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (100, 90), (500, 520)):
        a = np.unique(rng.integers(0, 1 << 60, size=n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:n // 2], rng.integers(0, 1 << 60, size=m, dtype=np.uint64)]))
        x, y = parity_join.parity(a, parity_join.sketch_bits(len(a))), parity_join.parity(b, parity_join.sketch_bits(len(b)))
        assert parity_join.distance(x, y) <= len(np.setxor1d(a, b)) and parity_join.distance(x, x) == 0


def test_messy(messy, nothing):
    out = parity_join.near_duplicates(messy).collect()
    assert len(out) == messy.count()
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id))
    assert by[1] == {(False, 1)} and by[2] == {(False, 2)} and by[3] == {(False, 3)}
    assert by[5] == by[6] == {(True, 5)} and by[7] == {(True, 7)} and by[4] == {(True, 4)}
    assert by[None] == {(False, None), (True, 7)}
    assert parity_join.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, size=(60, 2))]
    edges += [(5, 5), (1, 0)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a LONG, b LONG")
    assert {r.node: r.label for r in groups.components(frame).collect()} == {x: root(x) for x in label if root(x) != x}
    assert groups.components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [2, 3, 1000])
def test_shared_buckets_stream(spark, setting, monkeypatch, batch):
    monkeypatch.setattr(groups, "LOCALLY_HOT", 4)
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = np.random.default_rng(8)
    pairs = [(int(b), int(x)) for b, x in zip(rng.integers(0, 30, 200) ** 2, rng.integers(0, 50, 200))] + [(5000, 1), (5001, 2), (5001, 2)]
    import pyarrow as pa

    def rows(batches):
        for part in batches:
            yield groups.bucket_batch(part.column(0).to_numpy(), part.column(1).to_numpy())

    frame = spark.createDataFrame(pairs, "b LONG, x LONG").repartition(3).mapInArrow(rows, groups.ROWS)
    shared = groups.shared_buckets(frame, "t").collect()
    members = defaultdict(set)
    for b, x in pairs:
        members[b].add(x)
    found = defaultdict(set)
    for r in shared:
        found[r.bucket] |= {r.lead, r.node}
    assert {b: x for b, x in found.items() if len(x) > 1} == {b: x for b, x in members.items() if len(x) > 1}
    label = {}
    for r in shared:  # all members of a bucket hang together through their leaders
        label.setdefault(r.bucket, []).append({r.lead, r.node})
    for b, links in label.items():
        whole = links[0]
        for _ in links:
            for x in links:
                if whole & x:
                    whole = whole | x
        assert len(members[b]) < 2 or whole == members[b] or batch < 1000


@pytest.mark.parametrize("batch", [2, 3, 1000])
def test_buckets_of_two_are_told_apart(spark, setting, monkeypatch, batch):
    """Every row of a larger bucket is marked; rows of buckets of two are not, but where a batch ends."""
    import pyarrow as pa

    monkeypatch.setattr(groups, "LOCALLY_HOT", 4)
    rng = np.random.default_rng(3)
    pairs = [(b, int(x)) for b in range(300) for x in rng.choice(50, 1 + b % 7 % 3 + 5 * (b % 10 == 0), replace=False)]

    def rows(batches):
        for part in batches:
            yield groups.bucket_batch(part.column(0).to_numpy(), part.column(1).to_numpy())

    frame = spark.createDataFrame(pairs, "b LONG, x LONG").repartition(3).mapInArrow(rows, groups.ROWS)
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    size = Counter(b for b, _ in pairs)
    marked = defaultdict(set)
    for r in groups.shared_buckets(frame, "t").collect():
        marked[r.bucket].add(r.many)
    assert set(marked) >= {b for b, n in size.items() if n > 1}
    assert all(marked[b] == {True} for b, n in size.items() if n > 2)
    if batch == 1000:
        assert sum(True in marked[b] for b, n in size.items() if n == 2) <= 10


def test_linked_groups_compares_across_groups(spark):
    """A link that only two members of a mixed bucket have is found."""
    near = {(1, 2), (3, 4), (2, 9), (7, 8)}
    shared = spark.createDataFrame([(1, 1, x) for x in range(1, 10)], "bucket LONG, lead LONG, node LONG")

    def links(pairs):
        return pairs.where(F.concat_ws(":", "a", "b").isin([f"{a}:{b}" for a, b in near]))

    traits = spark.range(1, 10).select(F.col("id").alias("node"), F.struct(F.lit(1).alias("n")).alias("traits"))
    found = groups.linked_groups(shared, links, "t", traits, lambda a, b: F.col(f"{a}.n") == F.col(f"{b}.n"))
    got_labels = {r.node: r.label for r in found.collect()}
    assert got_labels == {2: 1, 9: 1, 4: 3, 8: 7}


def test_rows_of_buckets_are_shuffled_once_in_parts(spark, setting):
    """Each part has its own buckets, all pairs across labels come, and a join shuffles its rows once."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(b, x, x % 3, x) for b in range(40) for x in range(b % 7)]
    known = spark.createDataFrame(rows, "bucket LONG, node LONG, label LONG, x LONG").select(
        "bucket", "node", "label", F.struct("x").alias("traits"), F.array().cast("array<long>").alias("before"))
    known = groups.stage(known, "known")
    parts = list(groups._across(known, lambda a, b: F.col(f"{a}.x") + F.col(f"{b}.x") >= 0))
    assert len(parts) == groups.JOIN_PARTS > 1
    found = [{(r.a, r.b) for r in part.collect()} for part in parts]
    assert set().union(*found) == {(a, b) for a in range(6) for b in range(a + 1, 6) if a % 3 != b % 3}
    parts[0].collect()
    plan = parts[0]._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_sketches_of_large_sets_tell_them_apart(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)

    def traits(hashes):
        sketch = parity_join.parity(hashes, parity_join.sketch_bits(len(hashes)))
        whole = np.frombuffer(sketch, np.int64).tolist() if len(sketch) > 8 * parity_join.FEW else []
        return (len(hashes), parity_join.folded(sketch), whole)

    def other(size, shared):
        return np.concatenate([base[:shared], rng.integers(0, 2**63, size - shared, dtype=np.uint64)])

    rows = []
    for size, kept in ((3000, 2700), (2500, 2480), (300, 280), (1100, 1000), (3000, 900), (2450, 600)):
        first = base[:300] if size == 300 else base[:1000] if size == 1100 else base
        rows.append((traits(first), traits(other(size, min(kept, len(first))))))
    # 2,048 is where the sketch doubles
    rows.append((traits(base[:2100]), traits(base[:1900])))
    kind = "struct<n_shingles: long, few: array<long>, whole: array<long>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}").select(parity_join._near("a", "b").alias("near"))
    assert [r.near for r in df.collect()] == [True, True, True, True, False, False, True]


def test_a_pair_of_many_buckets_is_compared_in_few(spark, monkeypatch):
    """Alike nodes share nearly all of their buckets; the join over buckets gives such a pair in few of them, and loses none."""
    rng = random.Random(5)
    rows = [(bucket, 0, node) for bucket in range(1, 201) for node in range(1, 13) if rng.random() < 0.9]
    shared = spark.createDataFrame(rows, "bucket long, lead long, node long").where("lead <> node")
    traits = spark.range(13).select(F.col("id").alias("node"), F.struct(F.col("id").alias("x")).alias("traits"))
    real, given = groups._pairs, []

    def counted(edges):
        given.append(edges.count())
        return real(edges)

    monkeypatch.setattr(groups, "_pairs", counted)
    asked = []

    def links(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("a = 5 and b = 9")

    got = {r.node: r.label for r in groups.linked_groups(shared, links, "few", traits, lambda a, b: F.col(f"{a}.x") >= 0).collect()}
    assert got == {9: 5}
    assert sorted(asked) == [(a, b) for a in range(13) for b in range(a + 1, 13)]
    # 66 pairs share about 160 buckets each
    assert max(given) <= len(rows)
