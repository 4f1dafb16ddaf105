import hashlib
from collections import Counter

import numpy as np
import pytest

from negmine.llm import repeats


def brute(texts: dict, length: int) -> dict:
    """What is left of every text, straight from the definition."""
    data = {k: t.encode() for k, t in texts.items()}
    count = Counter(b[i:i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").repartition(4)


def test_table(documents, texts):
    assert got(repeats.remove_repeats(documents)) == brute(texts, 200)


@pytest.mark.parametrize("length", [12, 40])
def test_small_alphabet(spark, length, monkeypatch):
    monkeypatch.setattr(repeats, "_CUTS", (1, 4, repeats.span_of(length)))
    rng = np.random.default_rng(length)
    texts = {i: "".join(rng.choice(list("ab" if i % 3 else "abcdé"), size=int(rng.integers(0, 160)))) for i in range(60)}
    texts[60], texts[61], texts[62] = "ab" * 100, "a" * 90, "a" * 91
    for i in range(63, 70):  # one passage in different places
        texts[i] = "".join(rng.choice(list("wxyz"), size=i)) + "PASSAGE" * 9 + "".join(rng.choice(list("wxyz"), size=100 - i))
    assert got(repeats.remove_repeats(rows(spark, texts), length=length)) == brute(texts, length)


def test_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_MANY", 2)
    rng = np.random.default_rng(1)
    word = ["".join(rng.choice(list("abcdefghij"), size=6)) for _ in range(400)]
    passage = " ".join(word[:45])
    texts = {i: " ".join(rng.choice(word, size=60)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(rng.choice(word, size=40))
             for i in range(120)}
    for i in range(120, 150):  # near copies of one text
        near = texts[1].split(" ")
        near[int(rng.integers(len(near)))] = "changed"
        texts[i] = " ".join(near)
    for i in range(150, 160):
        texts[i] = texts[2]
    assert got(repeats.remove_repeats(rows(spark, texts))) == brute(texts, 200)


def test_messy(messy, nothing):
    out = repeats.remove_repeats(messy).collect()
    assert len(out) == messy.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_bytes == 0 and r.n_removed == 0 for k in (1, 2) for r in by[k])
    assert all(r.n_removed == r.n_bytes for k in (5, 6, 7, 10) for r in by[k])
    assert by[4][0].kept_sha256 == hashlib.sha256(b"one").hexdigest()
    assert by[5][0].spans[0].lo == 0 and by[5][0].spans[0].hi == by[5][0].n_bytes
    assert repeats.remove_repeats(nothing).count() == 0
