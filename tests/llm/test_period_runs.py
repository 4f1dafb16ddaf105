import hashlib
import re
import zlib

import numpy as np
import pytest

from negmine.llm import period_runs
from negmine.llm.queries import op13_period_runs


def brute(words, least=12):
    """(start, length, period) of all runs, by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t + q < n:
            s = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            if t - s + q >= max(least, 2 * q) and t > s:
                found.setdefault((s, t + q), q)
            t += t == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def row_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(60):
        n = int(rng.integers(0, 90))
        x = rng.integers(0, rng.integers(1, 6), n)
        if n > 4 and rng.random() < 0.5:  # a period of its own in a part of it
            a, b = sorted(rng.integers(0, n, 2))
            x[a:b] = np.resize(x[a:a + 1 + (b - a) // 4], b - a)
        docs.append(x)
    doc, *runs = period_runs.find_runs(np.concatenate(docs).astype(np.int64), np.array([len(x) for x in docs]))
    for i, x in enumerate(docs):
        assert list(zip(*(r[doc == i].tolist() for r in runs))) == brute(x.tolist())


def test_extensions_against_counting():
    rng = np.random.default_rng(5)
    x = np.concatenate([[9], np.resize(rng.integers(0, 2, 37), 300), [8]]).astype(np.int64)
    grammar = period_runs.Grammar(x)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(1, 301), np.arange(1, 301)))
    i, j = i[i < j], j[i < j]

    def count(a, b, step):
        k = 0
        while x[a + step * k] == x[b + step * k]:
            k += 1
        return k

    for back, step in ((False, 1), (True, -1)):
        assert grammar.extend(i, j, back).tolist() == [count(a, b, step) for a, b in zip(i, j)]


def test_known_runs(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "d"), (2, "go " * 12), (3, "go " * 11), (4, "a b " * 6 + "b a " * 6)], "doc_id INT, text STRING")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.text) for r in period_runs.collapse_runs(docs).collect()}
    assert got[1] == ([(1, 15, 3)], "x a b c d")
    assert got[2] == ([(0, 12, 1)], "go")
    assert got[3] == ([], " ".join(["go"] * 11))
    assert got[4][0] == [(0, 12, 2), (12, 12, 2)] or got[4][0] == brute(("a b " * 6 + "b a " * 6).split())


def test_query_against_brute_force(spark, small, texts):
    got = {r.doc_id: r for r in op13_period_runs(spark, small).collect()}
    assert len(got) == len(texts)
    some = [k for k in texts if zlib.crc32(str(k).encode()) % 10 == 0 or k % 3 == 0]
    for k in some:
        if len(texts[k]) < 30_000:
            assert tuple(got[k]) == row_of(k, texts[k])
    assert sum(r.n_runs > 0 for r in got.values()) > len(texts) // 20


def test_messy_rows(spark, messy, nothing):
    docs = period_runs.with_periods(messy)
    got = sorted((tuple(r) for r in period_runs.digests(period_runs.collapse_runs(docs)).collect()), key=repr)
    source = [r for r in messy.collect() if len(r.text or "") < 50_000]
    want = [row_of(r.doc_id, r.text) for r in source]
    assert len(got) == messy.count()
    assert all(w in got for w in want)
    assert period_runs.collapse_runs(nothing).count() == 0


def test_very_long_periodic_text(spark):
    text = " ".join(f"w{i % 7919}" for i in range(200_000))
    docs = spark.createDataFrame([("a", text), ("b", "z " * 100_000)], "doc_id STRING, text STRING")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in period_runs.collapse_runs(docs).collect()}
    assert got == {"a": [(0, 200_000, 7919)], "b": [(0, 100_000, 1)]}
