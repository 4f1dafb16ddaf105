import hashlib
import re

import pytest

from negmine.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("null" if name is None else str(name))
    return (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))


def check(docs, items, **options):
    got = decontaminate.contamination(docs, items, **options).collect()
    listed = [(r.item_id, r.text) for r in items.collect()]
    want = [(r.doc_id, *brute(r.text, listed)) for r in docs.select("doc_id", "text").collect()]
    have = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    return sum(x[5] for x in have)


@pytest.mark.parametrize("block", [200_000, 50])
def test_table(spark, documents, small, block):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert check(documents, items, block_windows=block) > 0


def test_short_and_repeated_items(spark, messy):
    items = spark.createDataFrame([
        (1, "ONE"), (2, ""), (3, None), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (4, "Ünï çödé"),
        (5, "xi omicron"), (5, "rho end"), (6, "word1 goes1 word2 goes2 word3 goes3 word4 goes4 word5 goes5"),
        (7, "a b a b a b a b a b a b"), (8, "...")], "item_id INT, text STRING")
    assert check(messy, items) >= 6
    again = messy.selectExpr("doc_id", "concat('a b ', repeat('a b ', 9)) AS text")
    assert check(again, items) == messy.count()


def test_nothing(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id INT, text STRING")
    assert check(messy, none) == 0
    some = spark.createDataFrame([(1, "one")], "item_id INT, text STRING")
    assert check(nothing, some) == 0
    kept = decontaminate.contamination(messy, some, keep=["text", "node", "n_words"])
    assert kept.columns[:3] == ["doc_id", "text", "node"] and kept.where("contaminated").first().text == "one"
