import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from negmine.llm import bpe, token_counts
from tests.llm.conftest import LONG

PATH = public_tokenizers.path(bpe.DEFAULT)


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def public(codec):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    entries = list(codec.bytes_of.values())
    numbers = [codec.whole.find(e) for e in entries]
    assert sorted(numbers) == list(range(len(entries)))
    assert codec.whole.find(b"no such entry at all") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_like_the_public_library(codec, public, texts):
    for text in [*texts.values(), "", "<|endoftext|>", " " * 999, "ab" * 3000, "日本語 😀\x00\x01", LONG[:20_000]]:
        assert codec.encode(text) == public.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, public, text):
    assert codec.encode(text) == public.encode_ordinary(text)


def test_slices_of_long_texts(codec, monkeypatch):
    monkeypatch.setattr(bpe, "_SLICE", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    text = "The quick brown fox, 12 dogs; and zyxwvut again and again! " * 9
    ids = codec.encode(text)
    assert bpe.digest(codec, text) == (
        len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_rows(spark, messy, nothing, public):
    got = bpe.encode_digests(messy).collect()
    want = [(r.doc_id, len(public.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest())
            for r in messy.collect()]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert bpe.encode_digests(nothing).count() == 0
    there = bpe.decode_ids(bpe.encode_ids(messy)).collect()
    assert sorted((bytes(r.bytes) for r in there)) == sorted((r.text or "").encode() for r in messy.collect())


def test_length_table(spark, messy, nothing, public, monkeypatch):
    monkeypatch.setattr(token_counts, "_BLOCK", 16)
    lengths = sorted(len(public.encode_ordinary(r.text or "")) for r in messy.collect())
    table = token_counts.length_table(token_counts.token_lengths(messy))
    rows = {r.n_tokens: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_ge == sum(x >= limit for x in lengths) and r.tokens_ge == sum(x for x in lengths if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r.total_tokens == sum(lengths) and r.n_all == len(lengths)
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    asked = [0, 1, 5, 100, 4096, 10**7]
    got = {r.lim: r for r in token_counts.at_limits(table, asked).collect()}
    assert all(got[x].truncated_total == sum(min(n, x) for n in lengths) and got[x].docs_cut == sum(n > x for n in lengths) for x in asked)
    half = token_counts.quantile_lengths(table, [0.5]).first()
    assert half.n_tokens == next(x for x in lengths if 2 * sum(y <= x for y in lengths) >= len(lengths))
    assert token_counts.length_table(token_counts.token_lengths(nothing)).count() == 0


def test_lengths_of_very_long_texts(spark, codec):
    texts = [" " * 1_000_000, "a" * 300_000, "word " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(docs).collect()}
    assert got == {i: len(codec.encode(t)) for i, t in enumerate(texts)}


def test_frequent_words_are_remembered():
    """A word that keeps coming is worked out once, however many others pass."""
    asked = []
    known = bpe.Remembered(lambda w: asked.append(w) or len(w), 10)
    for i in range(100):
        assert known["often"] == 5 and known[f"w{i}"] == len(f"w{i}")
        assert len(known) <= 10 and len(known.older) <= 10
    assert asked.count("often") == 1


def test_remembered_ids_in_both_generations(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for old in (codec.known, codec.known.older):
        old.clear()
    for i in range(100):
        assert codec.known[f" word{i}"] == " ".join(map(str, codec.pre_token(f" word{i}")))
        assert len(codec.known) + len(codec.known.older) <= 10


def test_a_merge_looks_up_its_two_neighbours_only(codec, public, monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    for word in (b" tionanier", " ètionanier".encode(), b"ab" * 500):
        pairs = Counted(codec.pairs)
        monkeypatch.setattr(codec, "pairs", pairs)
        ids = codec.merge(word)
        assert public.decode_bytes(ids) == word and ids == public._encode_single_piece(word)
        assert pairs.asked <= 2 * (len(word) - len(ids))
