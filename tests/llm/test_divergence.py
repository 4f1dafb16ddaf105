import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from checks.compare import open_oracle, rows_of

from negmine.llm import divergence
from negmine.llm.oracle import ORACLE
from negmine.llm.queries import op11_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top=50):
    """All rows from dense counts of (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(low))
        df[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def prices(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in groups.items()}, prices(sum(groups.values(), Counter()))
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_trees_hold_their_cells_and_price_pairs(seed):
    rng = np.random.default_rng(seed)
    n, m, depth = int(rng.integers(1, 16)), int(rng.integers(1, 16)), 4
    dense = [np.where(rng.random((k, m)) < 0.3, rng.integers(1, 50, (k, m)), 0) for k in (n, int(rng.integers(1, 16)))]
    if seed == 5:
        dense[1][:] = 0
    trees, totals = [], []
    for x in dense:
        tree = divergence.Quadtree.of(*np.nonzero(x), x[np.nonzero(x)], depth)
        back = divergence.Quadtree.from_bytes(*tree.to_bytes(), depth)
        again = np.zeros_like(x)
        row, column, count = back.leaves()
        again[row, column] = count
        assert (again == x).all()
        trees.append(back)
        totals.append(x.sum(1) + 7)
    p = [divergence.price(x, np.repeat(t[:, None], m, 1), 40) for x, t in zip(dense, totals)]
    want = np.abs(p[0][:, None] - p[1][None]).sum(2)
    assert (divergence.tile_distances(*trees, *totals, m, 40, False) == want).all()
    want = np.triu(np.abs(p[0][:, None] - p[0][None]).sum(2))
    assert (np.triu(divergence.tile_distances(trees[0], trees[0], totals[0], totals[0], m, 40, True)) == want).all()


def test_prices_are_exact():
    for count, total, n in ((0, 0, 1), (5, 10, 3), (10**12, 3 * 10**12, 10**6), (10**15, 9 * 10**15, 10**5), (7, 7, 10**9)):
        assert divergence.price(np.array([count]), np.array([total]), n).tolist() == [1 + 10**9 * (count + 5) // (total + 5 * n)]


def test_query_against_sql(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        found = open_oracle(folder).execute(ORACLE["op11_divergence"])
        got = op11_divergence(spark, folder)
        assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("side", [256, 4])
def test_many_groups_against_brute_force(spark, monkeypatch, side):
    """Groups beyond one block of rows, terms beyond one block of columns, a language without kept terms, nulls."""
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "COLUMNS", 9)
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"{'Wé' if x % 2 else 'v'}{chr(97 + x % 23)}{chr(97 + x // 23)}" for x in rng.zipf(1.4, 40) % 300), "xx", f"s{rng.integers(0, 11)}")
            for _ in range(300)]
    rows += [("only here", "yy", "a"), (None, "yy", "b"), ("", "yy", None), (None, None, None), ("Tie tie", "zz", "one"), *[("a b a", "ww", "p")] * 4,
             ("1 2 3", "ww", "q")]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING").selectExpr("*", "'x' AS value", "1 AS term", "2 AS g").repartition(5)
    got = sorted((tuple(r) for r in divergence.source_divergence(docs, least_docs=4).collect()), key=repr)
    assert got == brute(rows, 4)


def test_messy_rows(spark, messy, nothing):
    rows = [(r.text, r.lang, r.source) for r in messy.collect()]
    got = sorted((tuple(r) for r in divergence.source_divergence(messy, least_docs=2).collect()), key=repr)
    assert got == brute(rows, 2)
    assert divergence.source_divergence(nothing).count() == 0
