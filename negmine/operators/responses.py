"""Generated responses to query-document pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from negmine.functions.binding import let
from negmine.functions.json_text import strict_json, string_or_null, variant_kind
from negmine.functions.text import strip_ws
from negmine.operators.hotkeys import join_unique
from negmine.staging import stage

OK, EMPTY, MALFORMED = "ok", "empty", "malformed"
_FENCE = "```"


def read_records(raw: DataFrame) -> DataFrame:
    """``line_id, record_id, record``; ``record`` is NULL unless the line is a JSON object."""
    value = raw.select("line_id", strict_json(strip_ws(F.col("value"))).alias("v"))
    record = value.select("line_id", F.when(variant_kind(F.col("v")) == "OBJECT", F.col("v")).alias("record"))
    return record.withColumn("record_id", F.try_variant_get("record", "$.recordId", "string"))


def response_text(record: Column) -> Column:
    """Text of the first content block of type ``text``; later ones are never tried."""
    blocks = F.try_variant_get(record, "$.modelOutput.content", "array<variant>")
    is_text = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    return string_or_null(F.get(is_text, F.lit(0)), "$.text")


def strip_fence(text: Column) -> Column:
    """Trim, then drop a code fence around the whole text."""
    def unfenced(t: Column) -> Column:
        opened = F.regexp_replace(t, r"^```[\p{L}\p{N}_]*\n?", "")
        return F.when(t.startswith(_FENCE), F.regexp_replace(opened, r"\n?```\z", "")).otherwise(t)

    return let(strip_ws(text), unfenced)


def _listed(value: Column) -> Column:
    """The query list: a list itself, or the ``queries`` member of an object."""
    def as_list(v: Column) -> Column:
        return F.when(variant_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))

    return let(value, lambda v: F.when(
        variant_kind(v) == "OBJECT", let(F.try_variant_get(v, "$.queries", "variant"), as_list)).otherwise(as_list(v)))


def _usable(listed: Column) -> Column:
    """Text elements, trimmed, without blank ones."""
    texts = F.filter(listed, lambda x: variant_kind(x) == "STRING")
    return F.filter(F.transform(texts, lambda x: strip_ws(F.try_variant_get(x, "$", "string"))), lambda q: q != "")


def parsed_queries(text: Column) -> Column:
    """``STRUCT<status, queries>`` of a response text.

    The whole text must be JSON; failing that, the widest brace-to-brace part
    of the raw text must be.  No list, or an empty one, is ``empty``; a list of
    unusable elements is ``ok`` without queries.
    """
    def result(listed: Column) -> Column:
        found = F.coalesce(F.size(listed) > 0, F.lit(False))
        none = F.array().cast("array<string>")
        return F.struct(F.when(found, OK).otherwise(EMPTY).alias("status"),
                        F.when(found, _usable(listed)).otherwise(none).alias("queries"))

    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    value = let(strict_json(strip_fence(text)), lambda v: F.when(v.isNotNull(), v).otherwise(strict_json(braces)))
    return let(_listed(value), result)


def parse_queries(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``queries ARRAY<STRING>`` and ``status`` for a response text."""
    parsed = df.withColumn("_parsed", parsed_queries(F.col(text_col)))
    return parsed.select("*", "_parsed.status", "_parsed.queries").drop("_parsed")


def parse_records(records: DataFrame) -> DataFrame:
    """Read records with ``queries`` and ``status`` in place of ``record``."""
    texts = records.withColumn("text", response_text(F.col("record")))
    status = F.when(F.col("record").isNull(), MALFORMED).otherwise(F.col("status"))
    kept = [c for c in records.columns if c != "record"]
    return parse_queries(texts).select(*kept, "queries", status.alias("status"))


def parse_responses(raw: DataFrame) -> DataFrame:
    """``line_id, record_id, queries, status`` of response lines, none of them blank."""
    return parse_records(read_records(raw))


def dedupe_last(corpus: DataFrame) -> DataFrame:
    """``doc_id, doc_idx``: the last position of each id; one copy per task is shuffled."""
    return corpus.groupBy("doc_id").agg(F.max("doc_idx").alias("doc_idx"))


def _with_key(records: DataFrame) -> DataFrame:
    """Add ``_key``: the record id, or for a line without one a key of its own.

    Lines without an id match nothing, and must not all meet in one task.
    """
    own = F.concat(F.lit("\u0000"), F.col("line_id").cast("string"))
    return records.withColumn("_key", F.coalesce("record_id", own))


def _with_position(records: DataFrame, corpus: DataFrame, how: str) -> DataFrame:
    """Join the position of the id; many answers for one document do not meet in one task."""
    ids = dedupe_last(corpus).withColumnRenamed("doc_id", "_key")
    return join_unique(stage(_with_key(records), "records"), ids, "_key", how).drop("_key")


def join_known(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records whose id the corpus has, with its position; unknown ids drop out."""
    return _with_position(records, corpus, "inner")


def unknown_ids(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records whose id the corpus lacks."""
    return _with_position(records, corpus, "left").filter(F.col("doc_idx").isNull()).drop("doc_idx")


def explode_queries(parsed: DataFrame) -> DataFrame:
    """One pair per query; nothing is de-duplicated."""
    exploded = parsed.select("line_id", "record_id", "doc_idx", F.posexplode("queries").alias("_pos", "query"))
    return exploded.select(
        F.concat_ws(":", F.col("line_id").cast("string"), F.col("_pos").cast("string")).alias("query_id"),
        "query", F.col("record_id").alias("doc_id"), "doc_idx",
    )


def stage_counts(parsed: DataFrame) -> DataFrame:
    """One row: lines, lines with a known id, pairs and errors.

    A line that is no record, or a known record without a query list, is an error.
    """
    known = F.col("doc_idx").isNotNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(known).alias("known"),
        F.coalesce(F.sum(F.when(known, F.size("queries")).cast("long")), F.lit(0)).alias("pairs"),
        F.count_if(F.col("malformed") | (known & (F.col("status") == EMPTY))).alias("errors"),
    )


def parse_known(raw: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every response line with its position (NULL if unknown) and parsed queries.

    Ids are matched before texts are parsed, so responses for unknown documents
    cost no parsing.
    """
    placed = _with_position(read_records(raw), corpus, "left")
    needed = placed.withColumn("malformed", F.col("record").isNull()).withColumn(
        "record", F.when(F.col("doc_idx").isNotNull(), F.col("record")))
    return parse_records(needed)


def query_doc_pairs(raw: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``query_id, query, doc_id, doc_idx`` and the one-row counts.

    The parsed lines are staged once; both results read them.
    """
    parsed = stage(parse_known(raw, corpus), "parsed-responses")
    return explode_queries(parsed.filter(F.col("doc_idx").isNotNull())), stage_counts(parsed)
