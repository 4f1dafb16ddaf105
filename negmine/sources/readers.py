"""JSON-lines readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from negmine.constants import FEW_SHOT_POOL, SAMPLE_QUERY_FIELDS
from negmine.functions.json_text import has_key, needed_record, record_with, strict_json, strict_record, variant_kind
from negmine.functions.text import concat_fields, first_truthy, is_blank, strip_ws
from negmine.operators.numbering import (
    number_in_place,
    number_rows,
    number_staged,
    running_total,
    scan_position,
    with_scan_counter,
)
from negmine.sources.json_array import array_elements, is_array
from negmine.sources.quarantine import find_unreadable, skipped_table, unreadable_file, without_files
from negmine.staging import stage

log = logging.getLogger(__name__)

_RESPONSE_FILE = r"\.jsonl\.out(\.(gz|bz2|zst|lz4|snappy|deflate))?$"

CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
SAMPLE = T.StructType([
    T.StructField("anchor", T.StringType()),
    T.StructField("positive", T.StringType()),
    T.StructField("negatives", T.ArrayType(T.StringType())),
])
SCORED = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("docs", T.ArrayType(T.StringType())),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
])


def default_id(df: DataFrame) -> DataFrame:
    """A missing ``doc_id`` becomes the decimal position."""
    return df.withColumn("doc_id", F.coalesce("doc_id", F.col("doc_idx").cast("string")))


def cap_corpus(corpus: DataFrame, max_docs: int | None) -> DataFrame:
    """The first ``max_docs`` documents by position; 0 or None keeps all."""
    return corpus.filter(F.col("doc_idx") < max_docs) if max_docs else corpus


def _corpus_lines(spark: SparkSession, path) -> DataFrame:
    return with_scan_counter(scan_position(spark.read.text(path)).filter(~is_blank(F.col("value"))))


def _numbered_corpus(parsed: DataFrame, max_docs: int | None) -> DataFrame:
    """Stage the column ``doc`` once as columns, then number the rows in file order."""
    staged = stage(
        parsed.select(
            F.col("doc.id").alias("doc_id"),
            F.coalesce("doc.text", F.lit("")).alias("text"),
            "_file", "_start", "_scan",
        ),
        "corpus",
    )
    corpus = default_id(number_staged(staged)).select("doc_idx", "doc_id", "text")
    return cap_corpus(corpus, max_docs)


def read_corpus(spark: SparkSession, path, max_docs: int | None = None) -> DataFrame:
    """``doc_idx, doc_id, text`` of a JSON-lines corpus, in file order.

    Lines are parsed once and staged as columns, so later jobs that need ids
    only never read the text again.
    """
    record = needed_record(strip_ws(F.col("value")), CORPUS)
    return _numbered_corpus(_corpus_lines(spark, path).withColumn("doc", record), max_docs)


def read_valid_corpus(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """``read_corpus`` of a file that ``validate_corpus`` finds valid; raises as ``require_valid_corpus`` does.

    Good and bad lines are counted by the scan that stages the corpus, so a valid file is read and parsed once.
    Only a file with a bad line is read again, to tell the line and the reason.
    """
    _needs_jsonl(path)
    record = record_with(strip_ws(F.col("value")), CORPUS, "text")
    seen = Observation("corpus lines")
    good = F.col("doc").isNotNull()
    parsed = _corpus_lines(spark, path).withColumn("doc", record).observe(
        seen, F.count_if(good).alias("valid"), F.count_if(~good).alias("bad"))
    corpus = _numbered_corpus(parsed, max_docs)
    counts = seen.get
    if counts["bad"] or not counts["valid"]:
        require_valid_corpus(spark, path)
        raise ValueError(f"{counts['bad']} lines are no corpus records")
    return corpus


def _needs_jsonl(path: str) -> None:
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"expected a .jsonl path, got {path}")


def validate_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row: valid documents, first bad line (1-based, blank lines counted), reason.

    Only one small row per input split leaves the scan.
    """
    _needs_jsonl(path)
    lines = with_scan_counter(scan_position(spark.read.text(path)))
    blank = is_blank(F.col("value"))
    parsed = lines.withColumn("v", F.when(~blank, strict_json(strip_ws(F.col("value")))))
    reason = (
        F.when(blank, F.lit(None))
        .when(F.col("v").isNull(), "the line is no JSON value")
        .when((variant_kind(F.col("v")) != "OBJECT") | ~has_key(F.col("v"), "text"), "no object with a text")
    )
    checked = parsed.select("_file", "_start", "_scan", reason.alias("reason"), blank.alias("blank"))
    splits = stage(
        checked.groupBy("_file", "_start").agg(
            F.min("_scan").alias("_first"),
            F.count(F.lit(1)).alias("_rows"),
            F.count_if(~F.col("blank") & F.col("reason").isNull()).alias("valid"),
            F.min(F.when(F.col("reason").isNotNull(), F.struct("_scan", "reason"))).alias("bad"),
        ),
        "checked-splits",
    )
    placed = running_total(splits, ["_file", "_start"], "_rows", "_before")
    bad_line = F.col("_before") + F.col("bad._scan") - F.col("_first") + 1
    first = F.min(F.when(F.col("bad").isNotNull(), F.struct(bad_line.alias("line"), "bad.reason")))
    return placed.agg(F.coalesce(F.sum("valid"), F.lit(0)).alias("document_count"), first.alias("b")).select(
        "document_count", F.col("b.line").alias("first_bad_line"), F.col("b.reason").alias("reason")
    )


def require_valid_corpus(spark: SparkSession, path: str) -> int:
    """Document count of a valid corpus; raises on the first bad line or an empty file."""
    report = validate_corpus(spark, path).first()
    if report.first_bad_line is not None:
        raise ValueError(f"line {report.first_bad_line}: {report.reason}")
    if report.document_count == 0:
        raise ValueError("the corpus holds no documents")
    return report.document_count


def parse_field_list(fields: str) -> list[str]:
    """``"title, body,"`` to ``["title", "body"]``."""
    names = [f.strip() for f in fields.split(",") if f.strip()]
    if not names:
        raise ValueError("at least one text field is needed")
    return names


def extract_text(df: DataFrame, id_col: str, fields, max_docs: int | None = None,
                 order_by: list[str] | None = None) -> DataFrame:
    """``doc_idx, doc_id, text`` from the text fields of any table.

    Only the id and the named fields are read.  Documents without any text are
    dropped first, so the cap counts kept documents.  Positions follow the scan,
    without a shuffle, or the columns ``order_by``.
    """
    names = parse_field_list(fields) if isinstance(fields, str) else list(fields)
    keys = {f"_by{i}": F.col(c) for i, c in enumerate(order_by or [])}
    kept = df.select(
        F.col(id_col).cast("string").alias("doc_id"),
        concat_fields(*[F.col(n) for n in names]).alias("text"),
        *[c.alias(name) for name, c in keys.items()],
    ).filter(F.col("text") != "")
    numbered = number_rows(kept, list(keys)) if keys else number_in_place(kept)
    return cap_corpus(numbered.select("doc_idx", "doc_id", "text"), max_docs)


def _response_lines(spark: SparkSession, path) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", "*.jsonl.out*").option("recursiveFileLookup", "true")
    lines = scan_position(reader.text(path))
    return lines.filter(F.col("_file").rlike(_RESPONSE_FILE))


def read_responses_told(spark: SparkSession, path, skip_bad_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """``line_id, value`` of every ``*.jsonl.out`` file under ``path``, and ``file, reason`` of those left out.

    A file that cannot be read to its end is left out whole.  Only if there is one are the others read again to
    find all of them.
    """
    lines = _response_lines(spark, path)

    def staged(kept: DataFrame) -> DataFrame:
        return stage(with_scan_counter(kept.filter(~is_blank(F.col("value")))), "responses")

    bad = {}
    try:
        written = staged(lines)
    except Exception as error:
        first = unreadable_file(error) if skip_bad_files else None
        if first is None:
            raise
        bad = find_unreadable(lines, first)
        log.warning("%d response files cannot be read and are left out: %s", len(bad), bad)
        written = staged(without_files(lines, bad))
    return number_staged(written, "line_id").select("line_id", "value"), skipped_table(spark, bad)


def unreadable_responses(spark: SparkSession, path) -> DataFrame:
    """``file, reason`` of every response file that cannot be read to its end."""
    return skipped_table(spark, find_unreadable(_response_lines(spark, path)))


def read_responses(spark: SparkSession, path, skip_bad_files: bool = False) -> DataFrame:
    """``line_id, value`` of every ``*.jsonl.out`` file under ``path``, compressed or not.

    With ``skip_bad_files`` an unreadable file is left out whole, see ``read_responses_told``.
    """
    return read_responses_told(spark, path, skip_bad_files)[0]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, anchor, positive, negatives`` of every ``*.jsonl`` and ``*.json`` file, compressed or not.

    A record without anchor or positive stops the job.
    """
    reader = spark.read.option("pathGlobFilter", "*.{jsonl,json}{,.gz,.bz2,.zst,.lz4,.snappy,.deflate}")
    lines = scan_position(reader.text(path)).filter(~is_blank(F.col("value")))
    parsed = with_scan_counter(lines).withColumn("s", needed_record(strip_ws(F.col("value")), SAMPLE))

    def needed(field: str):
        missing = F.raise_error(F.lit(f"sample without '{field}'")).cast("string")
        return F.coalesce(F.col(f"s.{field}"), missing).alias(field)

    none = F.array().cast("array<string>")
    staged = stage(
        parsed.select(needed("anchor"), needed("positive"),
                      F.coalesce("s.negatives", none).alias("negatives"), "_file", "_start", "_scan"),
        "samples",
    )
    return number_staged(staged, "sample_id").select("sample_id", "anchor", "positive", "negatives")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """``query, docs, scores`` from JSON lines or from files that are one JSON array each.

    The first character decides.  Both forms are read in as many tasks as the bytes ask for; lines need no shuffle.
    """
    if is_array(spark, path):
        records = array_elements(spark, path)
    else:
        records = spark.read.text(path).filter(~is_blank(F.col("value")))
    return records.select(needed_record(strip_ws(F.col("value")), SCORED).alias("r")).select("r.*")


def sample_query(df: DataFrame):
    """First non-empty of the sample query fields that the table has."""
    return first_truthy(*[F.col(c) for c in SAMPLE_QUERY_FIELDS if c in df.columns])


def sample_queries(df: DataFrame, order_by: list[str], max_samples: int = FEW_SHOT_POOL) -> DataFrame:
    """``q``: the first ``max_samples`` records, then without the blank ones."""
    first = df.select(*order_by, sample_query(df).alias("q")).orderBy(*order_by).limit(max_samples)
    return first.select(*order_by, strip_ws(F.col("q")).alias("q")).filter(F.col("q") != "")


def read_sample_queries(spark: SparkSession, path: str | None,
                        max_samples: int = FEW_SHOT_POOL) -> list[str]:
    """Up to ``max_samples`` example queries; none (and a warning) if the file or a line is unreadable."""
    if not path:
        return []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SAMPLE_QUERY_FIELDS])
    try:
        lines = scan_position(spark.read.text(path)).filter(~is_blank(F.col("value")))
        first = with_scan_counter(lines).orderBy("_file", "_start", "_scan").limit(max_samples)
        place = ["_file", "_start", "_scan"]
        parsed = stage(first.select(*place, strict_record(strip_ws(F.col("value")), schema).alias("r")), "sample-queries")
        bad = parsed.filter(F.col("r").isNull()).count()  # at most max_samples rows
        if bad:
            log.warning("no sample queries from %s: %d malformed lines", path, bad)
            return []
        rows = sample_queries(parsed.select(*place, "r.*"), place, max_samples).collect()
        return [r.q for r in sorted(rows, key=lambda r: tuple(r[c] for c in place))]
    except PySparkException as error:
        log.warning("no sample queries from %s: %s", path, error)
        return []
