import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from negmine.llm import sharding
from negmine.llm.queries import op12_sharding


def check(rows, texts, n_shards):
    """What the law asks of every result; returns the shards of every text."""
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    count = Counter(r.shard for r in rows)
    assert set(count) <= set(range(n_shards)) and all(count[s] in (len(rows) // n_shards, len(rows) // n_shards + 1) for s in range(n_shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    shards = defaultdict(Counter)
    for r in rows:
        shards[r.size, r.text_crc32][r.shard] += 1
    return shards


def test_query(spark, small, texts):
    for folder in (small, "/root/testdata/sf0.01"):
        given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        got = op12_sharding(spark, folder)
        assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        shards = check(got.collect(), given, 16)
        assert all(len(x) == 1 for x in shards.values())  # every group of copies fits, and none is cut


def test_group_larger_than_a_shard(spark):
    """A third of all rows is one text; many groups beside it."""
    rng = np.random.default_rng(1)
    texts = ["hot"] * 700 + [f"g{i % 150}" for i in rng.integers(0, 1000, 900)] + [f"alone {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(7).cache()
    shards = check(sharding.balanced_shards(docs).collect(), list(enumerate(texts)), 16)
    hot = shards[4, zlib.crc32(b"hot")]
    # 125 rows a shard: six shards at least; dealt out evenly a sixteenth of its pairs would be together
    assert sum(hot.values()) == 700 and sum((n / 700) ** 2 for n in hot.values()) > 0.1
    cut = [x for x in shards.values() if len(x) > 1 and sum(x.values()) < 100]
    assert len(cut) <= 5


def test_only_linked_rows(spark):
    """Without rows that fill up, moves have to balance by themselves."""
    texts = [f"g{i // 5}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    shards = check(sharding.balanced_shards(docs, n_shards=4).collect(), list(enumerate(texts)), 4)
    before = sum(sum(x.values()) * 3 // 4 for x in shards.values())
    assert sum(sum(x.values()) - max(x.values()) for x in shards.values()) < before / 3


def test_links_by_columns(spark):
    """Rows are drawn together by either of two columns; a null links nothing."""
    rows = [(i, f"t{i}", f"site{i // 12}" if i % 3 else None, f"author{i // 24}" if i % 2 else None) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING, site STRING, author STRING").repartition(5)
    got = {r.doc_id: r.shard for r in sharding.balanced_shards(docs, n_shards=4, links=["site", "author"]).collect()}
    assert sorted(Counter(got.values()).values()) == [120] * 4
    spread = defaultdict(set)
    for i, _, site, author in rows:
        if site:
            spread[site].add(got[i])
        if author:
            spread[author].add(got[i])
    assert sum(len(x) == 1 for x in spread.values()) > len(spread) / 2  # none when dealt out evenly


@pytest.mark.parametrize("seed", range(20))
def test_quotas_keep_the_room(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 6))
    linked = rng.integers(0, 100, n)
    room = (linked + rng.integers(0, 30, n)).tolist()
    wishes = {}
    for i in range(n):
        left = int(linked[i])
        for j in range(n):
            for part in range(3):
                m = int(rng.integers(0, left + 1)) if i != j else 0
                if m:
                    wishes[i, j, int(rng.integers(0, 3)), part] = m
                    left -= m
    allowed = sharding.quotas(wishes, linked.tolist(), room)
    # the worst case: slices that move in part leave nothing behind them and arrive in full
    for j in range(n):
        coming = sum(v for k, v in allowed.items() if k[1] == j)
        leaving = sum(v for k, v in allowed.items() if k[0] == j and v == wishes[k])
        assert linked[j] + coming - leaving <= room[j]
    assert sharding.quotas(wishes, linked.tolist(), [10**6] * n) == wishes


def test_messy_rows(spark, messy, nothing):
    texts = [(r.doc_id, r.text) for r in messy.collect()]
    for n_shards in (2, 16, 40):
        check(sharding.balanced_shards(messy, n_shards=n_shards).collect(), texts, n_shards)
    assert sharding.balanced_shards(nothing).count() == 0
    assert sharding.balanced_shards(nothing).columns[0] == "doc_id"
