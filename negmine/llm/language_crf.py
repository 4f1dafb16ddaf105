"""Language of texts, word by word, with a linear-chain conditional random field.

Features of a word are its prefixes, suffixes and inner n-grams (hashed) and
whether it stands in the lexicon of a language.  Learned transitions link a word
to the one before; forward-backward gives each word's probabilities, and a text
is of the language with the largest sum.  A chain is a run of up to ``CHAIN``
words of one text, so long texts give many chains and none is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from negmine.llm.batches import bound_batches
from negmine.llm.bytehash import CHUNK_BYTES, Chunk, byte_class, chunks, lowered, span_hash

LETTERS = byte_class("[A-Za-z]", wide=True)
_LETTER = re.compile(r"[^\W\d_]")
CHAIN = 64
_BITS = 17
_AFFIXES = 3
_GRAMS = (1, 2, 3, 4)


@dataclass
class Crf:
    """Weights: ``emit`` (feature, label), ``lexicon`` hashes with a label mask row each, ``move`` (label, label)."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    lexical: np.ndarray


def word_features(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words as (features, owner)."""
    length = ends - starts
    which = np.arange(len(starts))
    features, owner = [], []

    def add(kind: int, s, e, own):
        features.append((span_hash(prefix, s, e) * np.uint64(2 * kind + 1) + np.uint64(kind * 7919)) >> np.uint64(64 - _BITS))
        owner.append(own)

    for n in range(1, _AFFIXES + 1):
        fits = length >= n
        add(n, starts[fits], starts[fits] + n, which[fits])
        add(10 + n, ends[fits] - n, ends[fits], which[fits])
    for n in _GRAMS:
        count = np.maximum(length - n + 1, 0)
        own = np.repeat(which, count)
        at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        add(20 + n, at, at + n, own)
    return np.concatenate(features).astype(np.int64), np.concatenate(owner)


def lexicon_rows(lexicon: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word hash in the lexicon, or -1."""
    if not len(lexicon):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
    return np.where(lexicon[at] == words, at, -1)


def emissions(model: Crf, features: np.ndarray, owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    n, k = len(places), len(model.labels)
    out = np.stack([np.bincount(owner, model.emit[features, j], n) for j in range(k)], axis=1)
    known = places >= 0
    out[known] += model.member[places[known]] @ model.lexical
    return out


def chains(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the words of every row into chains: (chain of each word, place within it)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    new = (place % CHAIN) == 0
    return np.cumsum(new) - 1, place % CHAIN


def forward_backward(model: Crf, emission: np.ndarray, chain: np.ndarray, place: np.ndarray):
    """Marginals per word, and the expected number of moves between labels over all chains."""
    k, n = len(model.labels), int(chain[-1]) + 1 if len(chain) else 0
    top = emission.max(axis=1, keepdims=True) if len(emission) else emission
    local = np.ones((CHAIN, n, k))
    there = np.zeros((CHAIN, n), dtype=bool)
    local[place, chain] = np.exp(emission - top)
    there[place, chain] = True
    move = np.exp(model.move)
    alpha, beta = np.zeros((CHAIN, n, k)), np.ones((CHAIN, n, k))
    alpha[0] = np.exp(model.start) * local[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    steps = int(place.max()) + 1 if len(place) else 0
    live = [np.flatnonzero(there[t]) for t in range(steps)]
    for t in range(1, steps):
        a = (alpha[t - 1, live[t]] @ move) * local[t, live[t]]
        alpha[t, live[t]] = a / a.sum(1, keepdims=True)
    moves = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        on = live[t + 1]
        right = local[t + 1, on] * beta[t + 1, on]
        b = right @ move.T
        moves += _pairs(alpha[t, on], move, right)
        beta[t, on] = b / b.sum(1, keepdims=True)
    out = alpha[place, chain] * beta[place, chain]
    return out / out.sum(1, keepdims=True), moves


def _pairs(left: np.ndarray, move: np.ndarray, right: np.ndarray) -> np.ndarray:
    scale = ((left @ move) * right).sum(1, keepdims=True)
    return (left / scale).T @ right * move


def _read(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for chunk in chunks(lowered(column), size):
        starts, ends, rows = chunk.words(LETTERS)
        yield chunk, starts, ends, rows, span_hash(chunk.prefix_hash(), starts, ends)


def language_sums(model: Crf, column: pa.Array) -> np.ndarray:
    """Per text the summed probabilities of its words; all zero without words."""
    return _sums(model, column)[:, :-1]


def _sums(model: Crf, column: pa.Array) -> np.ndarray:
    """As ``language_sums``, and last the sum over the words of the largest probability."""
    if not model.labels:
        return np.zeros((len(column), 1))
    out = []
    for chunk, starts, ends, rows, words in _read(column):
        if not len(words):
            out.append(np.zeros((len(chunk), len(model.labels) + 1)))
            continue
        different, first, back = np.unique(words, return_index=True, return_inverse=True)
        features, owner = word_features(chunk.prefix_hash(), starts[first], ends[first])
        emission = emissions(model, features, owner, lexicon_rows(model.lexicon, different))[back]
        chain, place = chains(rows)
        marginal, _ = forward_backward(model, emission, chain, place)
        out.append(np.stack([np.bincount(rows, p, len(chunk)) for p in (*marginal.T, marginal.max(1))], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(model.labels) + 1))


def fit_crf(texts: list[str], langs: list[str], labels: list[str], lexicon_size: int = 2000, epochs: int = 2,
            rate: float = 0.15, words_per_text: int = 512, seed: int = 7) -> Crf:
    """Learn from labelled texts by gradient steps on the likelihood of the labels.

    Chains are spliced from pieces of different texts, so that moves between languages are seen.
    At most ``words_per_text`` words of a text, in pieces spread over all of it, enter the sample.
    """
    k, rng = len(labels), np.random.default_rng(seed)
    model = Crf(labels, np.zeros((1 << _BITS, k)), np.zeros((k, k)), np.zeros(k), np.zeros(0, np.uint64),
                np.zeros((0, k)), np.zeros((k, k)))
    if k < 2 or not texts:
        return model
    target = np.array([labels.index(x) for x in langs])
    pieces: list[tuple[int, np.ndarray]] = []
    uniques, spans = {}, []
    counts: list[dict[int, int]] = [{} for _ in range(k)]
    for chunk, starts, ends, rows, words in _read(pa.array(texts, pa.large_string())):
        different, first, back = np.unique(words, return_index=True, return_inverse=True)
        features, owner = word_features(chunk.prefix_hash(), starts[first], ends[first]) if len(words) else ((), ())
        bounds = np.searchsorted(np.sort(owner), np.arange(len(different) + 1)) if len(words) else [0]
        features = features[np.argsort(owner, kind="stable")] if len(words) else features
        number = np.empty(len(different), dtype=np.int64)
        for i, h in enumerate(different.tolist()):
            if h not in uniques:
                uniques[h] = len(spans)
                spans.append(features[bounds[i]:bounds[i + 1]])
            number[i] = uniques[h]
        cut = np.searchsorted(rows, np.arange(len(chunk) + 1))
        for r in range(len(chunk)):
            own, label = number[back[cut[r]:cut[r + 1]]], target[chunk.first + r]
            for w in set(own.tolist()):
                counts[label][w] = counts[label].get(w, 0) + 1
            parts = [own[i:i + 16] for i in range(0, len(own), 16)]
            stride = max(1, -(-len(parts) * 16 // words_per_text))
            pieces += [(label, p) for p in parts[::stride]]
    hashes = np.array(list(uniques), dtype=np.uint64)
    chosen = sorted({w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:lexicon_size] if c[w] > 1})
    order = np.argsort(hashes[chosen]) if chosen else []
    chosen = np.array(chosen, dtype=np.int64)[order] if len(order) else np.zeros(0, np.int64)
    model.lexicon = hashes[chosen]
    model.member = np.array([[1.0 if c.get(w, 0) > 1 else 0.0 for c in counts] for w in chosen.tolist()]).reshape(-1, k)
    place_of = np.full(len(spans), -1)
    place_of[chosen] = np.arange(len(chosen))
    state = [np.full_like(x, 1e-6) for x in (model.emit, model.move, model.start, model.lexical)]

    def step(x, seen, gradient, at=...):
        seen[at] += gradient**2
        x[at] += rate * gradient / np.sqrt(seen[at])

    for _ in range(epochs):
        queue = rng.permutation(len(pieces))
        for lo in range(0, len(queue), 1024):
            part = [pieces[i] for i in queue[lo:lo + 1024]]
            word = np.concatenate([p for _, p in part])
            if not len(word):
                continue
            gold = np.repeat([g for g, _ in part], [len(p) for _, p in part])
            chain, place = np.arange(len(word)) // CHAIN, np.arange(len(word)) % CHAIN
            different, back = np.unique(word, return_inverse=True)
            features = np.concatenate([spans[w] for w in different])
            owner = np.repeat(np.arange(len(different)), [len(spans[w]) for w in different])
            places = place_of[different]
            marginal, moves = forward_backward(model, emissions(model, features, owner, places)[back], chain, place)
            error = -marginal
            error[np.arange(len(word)), gold] += 1
            per_word = np.stack([np.bincount(back, error[:, j], len(different)) for j in range(k)], axis=1)
            touched, again = np.unique(features, return_inverse=True)
            slope = np.stack([np.bincount(again, per_word[owner, j], len(touched)) for j in range(k)], axis=1)
            step(model.emit, state[0], slope, touched)
            linked = place[1:] > 0
            step(model.move, state[1], np.bincount(gold[:-1][linked] * k + gold[1:][linked], minlength=k * k).reshape(k, k) - moves)
            step(model.start, state[2], error[place == 0].sum(0))
            known = places >= 0
            step(model.lexical, state[3], model.member[places[known]].T @ per_word[known])
    model.emit = model.emit.astype(np.float32)
    return model


def training_side(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def learn(docs: DataFrame, max_rows: int = 2400, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Crf:
    """Fit on about ``max_rows`` labelled rows, as many of each language, chosen by a hash of the id."""
    known = (docs.where(training_side(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    labels = sorted(totals)
    each = max_rows // max(1, len(labels))
    share = F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in totals.items():
        wanted = wanted | ((F.col("lang") == lang) & (share < int(1_000_000 * min(1.0, each / n))))
    rows = sorted(known.where(wanted).collect(), key=lambda r: (r["id"], r["lang"], r["text"]))
    return fit_crf([r["text"] for r in rows], [r["lang"] for r in rows], labels)


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None, sure_col: str | None = None) -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score``, the mean probability of that language over the words.

    ``sure_col`` names a further column: the mean over the words of the probability of each word's own best language,
    which is high for a text in several known languages too.
    A null text or one without a letter is ``und`` with score 0, and so is every text if no language was learned.
    Ties go to the first language by name.  Rows with a null id are not held out.  Columns of ``keep`` are carried
    along after the id, but for those with the name of a result; no other column is read.
    """
    labels = model.labels
    keep = [k for k in keep or [] if k not in (id_col, "held_out", "lang_pred", "score", sure_col)]
    plain = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"  # then the text passes once
    rest = [k for k in keep if not (plain and k == text_col)]
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sums = _sums(model, column)
            sums, best_sums = sums[:, :-1], sums[:, -1]
            total = sums.sum(1) if len(labels) else np.zeros(len(column))
            best = sums.argmax(1) if len(labels) else np.zeros(len(column), int)
            langs, scores, sure = [], [], []
            for i, all_words in enumerate(total):
                if all_words > 0 and _has_letter(column, i):
                    langs.append(labels[best[i]])
                    scores.append(min(1.0, float(sums[i, best[i]] / all_words)))
                    sure.append(min(1.0, float(best_sums[i] / all_words)))
                else:
                    langs.append("und")
                    scores.append(0.0)
                    sure.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.float64()),
                 *([column] if plain else [])],
                names=["_id", "_rest", "lang_pred", "score", "_sure", *(["_text"] if plain else [])])

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       F.struct(*rest, F.lit(0).alias("_none")).alias("_rest"))
    out = base.mapInArrow(run, f"_id {base.schema['_id'].dataType.simpleString()}, _rest {base.schema['_rest'].dataType.simpleString()}, lang_pred string, score double, _sure double"
                          + (", _text string" if plain else ""))
    return out.select(F.col("_id").alias(id_col), *((F.col("_rest")[k] if k in rest else F.col("_text")).alias(k) for k in keep),
                      F.coalesce(~training_side("_id"), F.lit(False)).alias("held_out"), "lang_pred", "score",
                      *([F.col("_sure").alias(sure_col)] if sure_col else []))


def _has_letter(column: pa.Array, i: int) -> bool:
    return bool(_LETTER.search(column[i].as_py()))
