"""JSON-lines and Parquet sinks.

Spark publishes a written folder only when every task has committed, so a
failed job leaves no half-written result behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_corpus(corpus: DataFrame, path: str) -> None:
    """``{"id", "text"}`` lines, UTF-8."""
    lines = corpus.select(F.col("doc_id").alias("id"), "text")
    lines.write.mode("errorifexists").json(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """One request record per line; refuses to replace an earlier set."""
    requests.select("request_json").write.mode("errorifexists").text(path)


def write_samples(samples: DataFrame, path: str, compression: str = "none") -> None:
    """``{"anchor", "positive", "negatives"}`` lines.

    Samples hold the same texts many times over; any ``compression`` that Spark's JSON sink knows makes them a fraction.
    """
    samples.select("anchor", "positive", "negatives").write.mode("errorifexists").json(path, compression=compression)


def write_scored(scored: DataFrame, path: str) -> None:
    """``{"query", "docs", "scores"}`` lines."""
    scored.select("query", "docs", "scores").write.mode("errorifexists").json(path)
