"""The chain from a corpus to distillation rows.

Every step is written under ``out/<step>`` before the next one reads it.  A step
that has been written completely, from the same settings and input files, is read
back instead of repeated, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from negmine.operators.distill import distillation_rows, skipped_count
from negmine.operators.inference import generate_queries
from negmine.operators.negatives import mine_bm25_negatives, mine_semantic_negatives, training_samples
from negmine.operators.requests import build_query_requests
from negmine.operators.responses import explode_queries, parse_known, stage_counts
from negmine.operators.scoring import score_samples
from negmine.plans.config import RunConfig
from negmine.sources.readers import (
    cap_corpus,
    extract_text,
    read_responses_told,
    read_sample_queries,
    read_valid_corpus,
    unreadable_responses,
)
from negmine.sources.quarantine import SKIPPED
from negmine.sources.writers import write_requests, write_samples, write_scored
from negmine.staging import stage_scope

log = logging.getLogger(__name__)


def require_non_empty(df: DataFrame, step: str) -> DataFrame:
    """Stop the run if a written step holds nothing."""
    if df.isEmpty():
        raise ValueError(f"step '{step}' gave no rows")
    return df


class _Steps:
    """Written steps of one run, each with the settings it was made from."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.made_from = spark, out.rstrip("/"), {}

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def files(self, path: str | None) -> list[str]:
        """Name, size and time of the input files, as far as they can be listed."""
        if not path:
            return []
        try:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            listed = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("at"),
                               F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("names")).first()
            return [str(x) for x in listed]
        except Exception as error:  # not files, for instance a table service
            log.warning("input %s is not watched for changes: %s", path, type(error).__name__)
            return [path]

    def step(self, name: str, settings: dict, make, may_be_empty: bool = False) -> DataFrame:
        """The step's rows, made again if its settings or those of a step before have changed."""
        self.made_from = {**self.made_from, **settings}
        wanted = json.dumps(self.made_from, sort_keys=True, default=str)
        path, note = f"{self.out}/{name}", f"{self.out}/_settings/{name}"
        same = self._exists(f"{path}/_SUCCESS") and self._exists(f"{note}/_SUCCESS") and (
            self.spark.read.text(note, wholetext=True).first().value.strip() == wanted)
        if not same:
            with stage_scope(self.spark):
                make().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(wanted,)], "value STRING").coalesce(1).write.mode("overwrite").text(note)
        rows = self.spark.read.parquet(path)
        return rows if may_be_empty else require_non_empty(rows, name)

    def lines(self, name: str, df: DataFrame, write) -> None:
        """A JSON-lines copy of a step; written again whenever it is asked for."""
        path = f"{self.out}/{name}-lines"
        if self._exists(path):
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        write(df, path)


def _load_corpus(spark: SparkSession, config: RunConfig) -> DataFrame:
    if config.input_type == "jsonl":
        return read_valid_corpus(spark, config.corpus_path, config.max_corpus_documents)
    table = spark.read.format(config.table_format).load(config.corpus_path)
    return extract_text(table, config.id_column, config.text_fields, config.max_corpus_documents)


def run(spark: SparkSession, config: RunConfig, out: str, make_generator=None, make_scorer=None,
        make_encoder=None) -> DataFrame:
    """Distillation rows for a corpus; models are given as factories.

    With ``responses_path`` the answers of an external service are read instead of asking the generator.  What was
    left out on the way stands in the step ``counts``: lines, known ids, pairs, errors, unknown ids, and samples
    that could not be used.
    """
    if config.miner == "semantic" and make_encoder is None:
        raise ValueError("miner 'semantic' needs make_encoder")
    if not config.responses_path and make_generator is None:
        raise ValueError("give make_generator, or responses_path for answers that exist already")
    if make_scorer is None:
        raise ValueError("make_scorer is needed")
    steps, all_ = _Steps(spark, out), asdict(config)

    def of(*names):
        return {name: all_[name] for name in names}

    corpus = steps.step("corpus", of("input_type", "corpus_path", "table_format", "id_column", "text_fields", "max_corpus_documents")
                        | {"corpus_files": steps.files(config.corpus_path)}, lambda: _load_corpus(spark, config))

    def requests():
        samples = read_sample_queries(spark, config.sample_queries_path)
        return build_query_requests(cap_corpus(corpus, config.max_query_documents), samples,
                                    config.queries_per_document, config.max_doc_chars, seed=config.seed)

    asked = steps.step("requests", of("sample_queries_path", "max_query_documents", "queries_per_document", "max_doc_chars", "seed")
                       | {"sample_files": steps.files(config.sample_queries_path)}, requests)
    if config.write_lines:
        steps.lines("requests", asked, write_requests)

    told = {}

    def responses():
        if config.responses_path:
            lines, told["skipped"] = read_responses_told(spark, config.responses_path, config.skip_bad_files)
            return lines
        # written once, so the counter is a lasting line id
        return generate_queries(asked, make_generator).withColumn("line_id", F.monotonically_increasing_id())

    answers = steps.step("responses", of("responses_path", "skip_bad_files") | {"response_files": steps.files(config.responses_path)}, responses)

    def skipped():
        if not (config.responses_path and config.skip_bad_files):
            return spark.createDataFrame([], SKIPPED)
        # a run that was cut off after the responses looks for the files anew
        return told["skipped"] if told else unreadable_responses(spark, config.responses_path)

    left_out = steps.step("skipped_files", {}, skipped, may_be_empty=True)
    parsed = steps.step("parsed", {}, lambda: parse_known(answers, corpus))
    pairs = steps.step("pairs", {}, lambda: explode_queries(parsed.filter(F.col("doc_idx").isNotNull())))

    def negatives():
        if config.miner == "semantic":
            return mine_semantic_negatives(pairs, corpus, make_encoder, config.mined_negatives, config.semantic_search)
        return mine_bm25_negatives(pairs, corpus, config.mined_negatives, pad_zero=config.pad_zero)

    mined = steps.step("negatives", of("miner", "mined_negatives", "pad_zero", "semantic_search"), negatives, may_be_empty=True)
    # texts that nobody scores are not fetched, unless the samples themselves are asked for
    used = mined if config.write_lines else mined.filter(F.col("rank") <= config.scoring_max_negatives)
    samples = steps.step("samples", of("write_lines", "scoring_max_negatives"), lambda: training_samples(pairs, used, corpus))
    scored = steps.step("scored", of("scoring_batch_size"), lambda: score_samples(
        samples.withColumn("sample_id", F.col("query_id")), make_scorer,
        config.scoring_max_negatives, config.scoring_batch_size))
    if config.write_lines:
        steps.lines("samples", samples, write_samples)
        steps.lines("scored", scored, write_scored)

    def counts():
        usable = skipped_count(scored, config.num_negatives).first()
        return stage_counts(parsed).select(
            "*", (F.col("lines") - F.col("known")).alias("unknown"),
            F.lit(usable.kept).alias("usable_samples"), F.lit(usable.skipped).alias("skipped_samples"),
            F.lit(left_out.count()).alias("skipped_files"))

    report = steps.step("counts", of("num_negatives"), counts)
    log.info("counts: %s", report.first().asDict())
    return steps.step("distillation", of("num_negatives", "teacher_score_scale_factor", "top_n"), lambda: distillation_rows(
        scored, config.num_negatives, config.teacher_score_scale_factor, config.top_n))
