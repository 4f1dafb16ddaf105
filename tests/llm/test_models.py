"""Quality model, language model and certified rules."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from negmine.llm import language_crf, quality_gam, risk_rules
from negmine.llm.bytehash import chunks
from tests.llm.conftest import LONG

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, messy, nothing):
    docs, labels = tables(spark)
    model = quality_gam.learn(docs, labels)
    assert model.pairs and len(model.tables) == len(quality_gam.FEATURES)
    got = quality_gam.score_quality(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()
    mess = quality_gam.score_quality(messy, model).collect()
    assert len(mess) == messy.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in mess)
    assert {r.held_out for r in mess if r.doc_id is None} == {False}
    assert quality_gam.score_quality(nothing, model).count() == 0
    blank = quality_gam.learn(nothing, labels)
    assert {r.score for r in quality_gam.score_quality(messy, blank).collect()} == {0.5}


def test_tables_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, size=(4000, 4))
    y = ((x[:, 0] > 0) == (x[:, 1] > 0)).astype(float)  # neither feature alone says anything
    model = quality_gam.fit_gam(x[:3000], y[:3000], n_pairs=2)
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.9


def test_language_on_held_out_rows(spark, messy, nothing):
    docs, _ = tables(spark)
    model = language_crf.learn(docs)
    got = language_crf.identify(docs, model, keep=["lang"]).where("held_out").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert (np.diag(model.move).min() > model.move[~np.eye(len(model.labels), dtype=bool)].max())  # words mostly stay in a language
    mess = language_crf.identify(messy, model, keep=["node", "score"]).collect()
    assert len(mess) == messy.count()
    by = {r.doc_id: r for r in mess if r.doc_id is not None}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 8, 11)) and by[9].lang_pred != "und"
    assert language_crf.identify(nothing, model).count() == 0
    blank = language_crf.learn(nothing)
    assert {r.lang_pred for r in language_crf.identify(messy, blank).collect()} == {"und"}


def test_code_switching(spark):
    docs, _ = tables(spark)
    model = language_crf.learn(docs)
    en, de = (docs.where(F.col("lang") == x).where("length(text) > 800").orderBy("doc_id").first().text[:600] for x in ("en", "de"))
    sums = language_crf.language_sums(model, pa.array([en + " " + de, en, de]))
    share = sums / sums.sum(1, keepdims=True)
    at = {x: model.labels.index(x) for x in ("en", "de")}
    assert share[0, at["en"]] > 0.25 and share[0, at["de"]] > 0.25
    assert share[1, at["en"]] > 0.9 and share[2, at["de"]] > 0.9


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    k, n = 3, 5
    model = language_crf.Crf(["a", "b", "c"], np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((k, k)))
    emission = rng.normal(size=(n, k))
    marginal, moves = language_crf.forward_backward(model, emission, np.zeros(n, np.int64), np.arange(n))
    want, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in np.ndindex(*(k,) * n):
        w = np.exp(model.start[path[0]] + sum(emission[i, x] for i, x in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, x in enumerate(path):
            want[i, x] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    assert np.allclose(marginal, want / total) and np.allclose(moves, pairs / total)


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(zip(w, w[1:], w[2:]))
    covered = {j + i for j in range(len(w) - 2) if three[tuple(w[j:j + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_counts(spark, messy, nothing):
    docs, labels = tables(spark)
    for source in (docs, messy):
        got = risk_rules.apply_rules(source, labels)
        have = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()]
        assert sorted(have) == sorted(base(r.text) for r in source.select("text").collect())
        assert got.where("base_failed and kept").count() == 0
    assert risk_rules.apply_rules(nothing, labels).count() == 0
    assert sum(len(risk_rules.base_counts(c)) for c in chunks(pa.array(["x\nx\nx " + LONG, None]))) == 2


def test_binomial_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (200, 7, 0.05), (5, 5, 0.3), (5, 9, 0.3)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(n, k) + 1))
        assert risk_rules.tail(n, k, p) == pytest.approx(want)


def test_certified_cutoffs():
    def counts(stratum, label, n, beyond):
        return {"stratum": stratum, "_label": label, "n": n} | {
            f"{rule}:{i}": beyond(rule, i) for rule, x in risk_rules.RULES.items() for i in range(len(x[3]))}

    good = counts("en", 1, 10_000, lambda rule, i: 0 if i < 5 else 400)
    bad = counts("en", 0, 1000, lambda rule, i: 100 * i if rule == "symbols" else 0)
    few = [counts("xx", 1, 100, lambda rule, i: 0), counts("xx", 0, 100, lambda rule, i: 50)]
    assert risk_rules.certify([good, bad, *few]) == {"en": {"symbols": risk_rules.RULES["symbols"][3][4]}}  # too few labels: no rule
    assert risk_rules.certify([]) == {}


def test_false_rejections_stay_within_the_risk():
    """Over repeated draws the cutoffs reject more good documents than allowed in at most the stated share of draws."""
    rng, wrong = np.random.default_rng(3), 0
    for _ in range(100):
        share = 0.0066  # just over the risk per rule, so every certified cutoff that rejects at all is an error
        good = {"stratum": "s", "_label": 1, "n": 3000} | {f"{r}:{i}": int(rng.binomial(3000, share)) for r, x in risk_rules.RULES.items() for i in range(len(x[3]))}
        bad = {"stratum": "s", "_label": 0, "n": 3000} | {f"{r}:{i}": 3000 for r, x in risk_rules.RULES.items() for i in range(len(x[3]))}
        wrong += bool(risk_rules.certify([good, bad], risk=0.02, level=0.05))
    assert wrong <= 12


def test_kept_text_passes_once(spark, messy, documents):
    model = language_crf.learn(documents)
    got = language_crf.identify(messy, model, keep=["text", "node"])
    assert got.columns[:3] == ["doc_id", "text", "node"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(r.doc_id), str(r.text)) for r in messy.collect())
