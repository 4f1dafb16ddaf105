"""Prompt requests for synthetic queries."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from negmine.constants import (
    FEW_SHOT_PICK,
    MAX_DOC_CHARS,
    QUERIES_PER_DOCUMENT,
    REQUEST_API_VERSION,
    REQUEST_MAX_TOKENS,
    SEED,
)
from negmine.functions.binding import let
from negmine.functions.text import truncate_text
from negmine.sources.readers import cap_corpus

_TASK = "Write {n} different search queries that should lead a reader to the document below."
_STYLE = "Queries asked over this collection look like these; keep to their style:"
_FORMAT = "Answer with JSON only, holding exactly {n} queries:"
_VARIETY = "Vary length, aspect and intent."


# Rounds of the permutation; each takes two of the sixteen 16-bit words of a digest, as an affine map modulo this prime.
_ROUNDS, _PRIME = 8, 65_537


def _turn(factor: Column, shift: Column, odd: int, rows: int, columns: int):
    """One round: the row moves by a function of the column, or in odd rounds the column by one of the row."""
    def moved(by: Column, at: Column, size: int) -> Column:
        return (at + (by * factor + shift) % _PRIME) % size

    if odd:
        return lambda cell: F.struct(cell["row"].alias("row"), moved(cell["row"], cell["column"], columns).alias("column"))
    return lambda cell: F.struct(moved(cell["column"], cell["row"], rows).alias("row"), cell["column"].alias("column"))


def pick_places(n: int, key: Column, n_shots: int) -> Column:
    """``n_shots`` different places below ``n`` (all, if there are fewer), chosen and ordered by a hash of ``key``.

    A Feistel network permutes a rectangle of ``rows`` x ``columns`` cells, keyed by the digest: in turn one
    coordinate is shifted by a random affine function of the other.  The rectangle has fewer than ``rows`` cells
    beyond ``n``, so among the first ``n_shots`` images and that many more there are enough below ``n``; the
    others are passed over.  No place comes twice, and a rerun picks the same.  Every ordered pair of places occurs;
    measured, each does so within a fifth of its even share (with four rounds it would be two thirds).
    """
    if n >= _PRIME * _PRIME:
        raise ValueError("a pool this large needs longer words of the digest")
    rows = math.isqrt(n - 1) + 1
    columns = -(-n // rows)
    wanted = min(n_shots, n)
    images = wanted + rows * columns - n
    if wanted <= 0:
        return F.array().cast("array<bigint>")

    def permuted(words: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), F.lit(images - 1)), lambda x: F.struct(
            F.floor(x / columns).alias("row"), (x % columns).cast("long").alias("column")))
        for i in range(_ROUNDS):
            cells = F.transform(cells, _turn(F.get(words, F.lit(2 * i)), F.get(words, F.lit(2 * i + 1)), i % 2, rows, columns))
        places = F.transform(cells, lambda cell: cell["row"] * columns + cell["column"])
        return F.slice(F.filter(places, lambda x: x < n), 1, wanted)

    def words_of(digest: Column) -> Column:
        pieces = [F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long") for i in range(2 * _ROUNDS)]
        return let(F.array(*pieces), permuted)

    return let(F.sha2(key, 256), words_of)


def pick_few_shot(docs: DataFrame, samples: list[str], n_shots: int = FEW_SHOT_PICK,
                  seed: int = SEED) -> DataFrame:
    """Add ``picked``: ``n_shots`` of the sample queries per ``doc_id``, without replacement.

    Any two samples can meet, in either order, see ``pick_places``.  The pool, bounded by the sample reader, is a
    one-row table read once as a scalar subquery; plan and generated code do not grow with it.
    """
    if not samples:
        return docs.withColumn("picked", F.array().cast("array<string>"))
    pool = SparkSession.active().createDataFrame([(list(samples),)], "pool ARRAY<STRING>").scalar()
    key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id"))
    placed = docs.withColumn("picked", pick_places(len(samples), key, n_shots))
    taken = [F.get(pool, F.get("picked", F.lit(i)).cast("int")) for i in range(min(n_shots, len(samples)))]
    return placed.withColumn("picked", F.array(*taken).cast("array<string>"))


def render_prompt(text: Column, picked: Column | None, n_queries: int = QUERIES_PER_DOCUMENT) -> Column:
    """Prompt for one document; the text is pasted in, never interpreted."""
    shape = json.dumps({"queries": [f"query{i + 1}" for i in range(n_queries)]})
    closing = _FORMAT.format(n=n_queries) + "\n" + shape
    parts = [F.lit(_TASK.format(n=n_queries) + "\n\n")]
    if picked is not None:
        listed = F.array_join(F.transform(picked, lambda q: F.concat(F.lit("- "), q)), "\n")
        parts += [F.lit(_STYLE + "\n"), listed, F.lit("\n\n")]
        closing += "\n" + _VARIETY
    return F.concat(*parts, F.lit("Document:\n"), text, F.lit("\n\n" + closing))


def request_json(record_id: Column, prompt: Column, max_tokens: int = REQUEST_MAX_TOKENS,
                 api_version: str = REQUEST_API_VERSION) -> Column:
    """The request record as one JSON line."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    model_input = F.struct(
        F.lit(api_version).alias("anthropic_version"),
        F.lit(max_tokens).alias("max_tokens"),
        F.array(message).alias("messages"),
    )
    return F.to_json(F.struct(record_id.alias("recordId"), model_input.alias("modelInput")))


def build_query_requests(corpus: DataFrame, samples: list[str] | None = None,
                         n_queries: int = QUERIES_PER_DOCUMENT, max_chars: int = MAX_DOC_CHARS,
                         n_shots: int = FEW_SHOT_PICK, max_docs: int | None = None,
                         seed: int = SEED) -> DataFrame:
    """``record_id, prompt, request_json`` per document; a projection without shuffle.

    Repeated documents each get a request.
    """
    asked = cap_corpus(corpus, max_docs).select("doc_id", truncate_text(F.col("text"), max_chars).alias("text"))
    if samples:
        asked = pick_few_shot(asked, samples, n_shots, seed)
    prompt = render_prompt(F.col("text"), F.col("picked") if samples else None, n_queries)
    prompts = asked.select(F.col("doc_id").alias("record_id"), prompt.alias("prompt"))
    return prompts.withColumn("request_json", request_json(F.col("record_id"), F.col("prompt")))
