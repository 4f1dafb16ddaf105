import math
import random

import pytest

from negmine import models
from negmine.operators import distill as d, scoring

rng = random.Random(9)
SCORED = [(f"s{i}", f"query {i}", [f"d{i}_{j}" for j in range(n)], [rng.choice([0.0, -0.0, 1.5, 2.0, -3.25]) for _ in range(n)])
          for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9] * 4)]
SCORED += [("short", "q", ["a", "b", "c"], [1.0, 2.0]), ("nan", "q", ["a", "b", "c"], [1.0, float("nan"), 2.0]),
           ("none", "q", ["a", "b", "c"], [1.0, None, 2.0]), ("null", "q", None, None)]


def model(sample, k, scale, top_n):
    """What one sample gives, by the definition."""
    _, query, docs, scores = sample
    if not docs or not scores or len(docs) != len(scores) or len(docs) < 1 + k:
        return []
    if any(s is None or math.isnan(s) for s in scores):
        return []
    best = scores.index(max(scores))
    rest = sorted((j for j in range(len(docs)) if j != best), key=lambda j: -scores[j])[:top_n]
    groups = [rest[a:a + k] for a in range(0, len(rest) - k + 1, k)]
    return [(query, docs[best], *[docs[j] for j in g], *[scores[j] * scale for j in [best, *g]]) for g in groups]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "sample_id STRING, query STRING, docs ARRAY<STRING>, scores ARRAY<DOUBLE>")


@pytest.mark.parametrize("k, top_n", [(2, None), (2, 3), (3, 2), (1, None), (3, 7), (9, None)])
@pytest.mark.parametrize("parts", [1, 7])
def test_rows(scored, k, top_n, parts):
    rows = d.distillation_rows(scored.repartition(parts), k, top_n=top_n).collect()
    got = sorted((r[:2 + k] + tuple(r.label)) for r in rows)
    want = sorted(x for s in SCORED for x in model(s, k, 0.025, top_n))
    assert [x[:2 + k] for x in got] == [x[:2 + k] for x in want]
    for a, b in zip(got, want):
        assert a[2 + k:] == pytest.approx(b[2 + k:], rel=1e-6)
        assert a[2 + k] == max(a[2 + k:])


def test_skipped_count(scored):
    kept, skipped = d.skipped_count(scored, 2).first()
    usable = sum(bool(model(s, 2, 1, None)) for s in SCORED)
    assert (kept, skipped) == (usable, len(SCORED) - usable)


def test_no_shuffle(scored):
    text = d.distillation_rows(scored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("temperature, similarity", [(1.0, "cos"), (2.0, "dot")])
def test_loss(spark, temperature, similarity):
    rows = [([rng.gauss(0, 1) for _ in range(4)], [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)],
             [rng.random() for _ in range(3)]) for _ in range(20)]

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def soft(v):
        e = [math.exp(x / temperature) for x in v]
        return [x / sum(e) for x in e]

    total = 0.0
    for q, docs, label in rows:
        sims = [dot(q, x) / (math.sqrt(dot(q, q) * dot(x, x)) if similarity == "cos" else 1) for x in docs]
        total += sum(t * math.log(t / s) for t, s in zip(soft(label), soft(sims)))
    df = spark.createDataFrame(rows, "query_vec ARRAY<DOUBLE>, doc_vecs ARRAY<ARRAY<DOUBLE>>, label ARRAY<DOUBLE>")
    n, loss = d.distill_loss(df, temperature, similarity).first()
    assert n == 20 and loss == pytest.approx(total / 20 * temperature ** 2)


def test_scoring_keeps_order_and_cap(spark):
    samples = spark.createDataFrame(
        [(i, "red cat", f"red cat {i}", [f"cat {i} {j}" for j in range(i)]) for i in range(9)],
        "sample_id LONG, anchor STRING, positive STRING, negatives ARRAY<STRING>").repartition(5)
    got = {r.sample_id: r for r in scoring.score_samples(samples, models.overlap_scorer, batch_size=3).collect()}
    for i in range(9):
        assert got[i].docs == [f"red cat {i}"] + [f"cat {i} {j}" for j in range(min(i, 4))]
        assert got[i].scores == [1.0] + [0.5] * min(i, 4)
    assert [r.sample_id for r in scoring.restore_order(samples).collect()] == list(range(9))
