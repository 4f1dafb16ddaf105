"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from checks import fixtures as fx
from negmine import models
from negmine.functions import text as tx
from negmine.functions.vectors import inner_product, l2_norm, l2_normalize
from negmine.operators import bm25, distill, inference, knn, negatives, numbering, requests, responses, scoring
from negmine.sources import readers, writers
from negmine.staging import new_stage_path, spread

TOP = 25
KEPT = 20


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _ranked(df: DataFrame) -> DataFrame:
    return _long(df, "rank").select("query_id", "doc_idx", "score", "rank")


# --- sources and sinks --------------------------------------------------------


def read_corpus(spark, sf):
    docs = fx.table(spark, sf, "documents")
    record = F.to_json(F.struct(F.when(F.col("lang") != "fr", F.col("doc_id").cast("string")).alias("id"), "text"))
    path = fx.written_lines(docs.select("doc_id", record.alias("value")), "doc_id", ".jsonl")
    return readers.read_corpus(spark, path).select("doc_idx", "doc_id", F.md5("text").alias("text_md5"))


def read_valid_corpus(spark, sf):
    docs = fx.table(spark, sf, "documents")
    record = F.to_json(F.struct("text", F.when(F.col("lang") != "fr", F.col("doc_id")).alias("id"), "source"))
    path = fx.written_lines(docs.select("doc_id", record.alias("value")), "doc_id", ".jsonl")
    return readers.read_valid_corpus(spark, path).select("doc_idx", "doc_id", F.md5("text").alias("text_md5"))


def extract_text(spark, sf):
    return readers.extract_text(fx.table(spark, sf, "part"), "p_partkey", "p_name, p_brand,p_type,", order_by=["p_partkey"])


def with_doc_index(spark, sf):
    turns = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return numbering.number_rows(turns, ["conv_id", "turn"])


def read_responses(spark, sf):
    path = fx.written_lines(fx.responses(spark, sf), "line_id", ".jsonl.out")
    records = responses.read_records(readers.read_responses(spark, path))
    return records.select("line_id", "record_id", F.md5(responses.response_text(F.col("record"))).alias("answer_md5"))


def read_samples(spark, sf):
    made = fx.samples(spark, sf).withColumn(
        "negatives", F.when(F.col("sample_id") % 5 != 0, F.col("negatives")))
    path = fx.written_lines(made.select("sample_id", F.to_json(F.struct("anchor", "positive", "negatives")).alias("value")),
                            "sample_id", ".json", in_ranges=True, compressed=True)
    return readers.read_samples(spark, path).select(
        "sample_id", "anchor", F.md5("positive").alias("positive_md5"),
        F.size("negatives").cast("long").alias("n_negatives"), F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


def _scored_rows(df):
    return df.select("query", F.array_join("docs", "|").alias("docs"),
                     F.array_join(F.transform("scores", lambda s: F.round(s * 10).cast("int").cast("string")), "|").alias("scores"))


def read_scored(spark, sf):
    made = fx.scored(spark, sf)
    path = fx.written_lines(made.select("sample_id", F.to_json(F.struct("query", "docs", "scores")).alias("value")),
                            "sample_id", ".jsonl")
    return _scored_rows(readers.read_scored(spark, path))


def read_scored_array(spark, sf):
    rows = fx.scored(spark, sf).select("sample_id", F.to_json(F.struct("query", "docs", "scores")).alias("line"),
                                       (F.col("sample_id") % 64).alias("part"))
    order = Window.partitionBy("part").orderBy("sample_id")
    value = F.concat(F.when(F.row_number().over(order) == 1, "[").otherwise(","), "line",
                     F.when(F.lead("sample_id").over(order).isNull(), "]").otherwise(""))
    path = new_stage_path(spark, "arrays")
    # one array a file; the window has sorted the rows of a part into one task
    rows.select(value.alias("value"), "part").write.partitionBy("part").text(path)
    return _scored_rows(readers.read_scored(spark, path))


def read_sample_queries(spark, sf):
    turns = fx.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return readers.sample_queries(turns, ["conv_id", "turn"])


def write_corpus(spark, sf):
    path = new_stage_path(spark, "sink")
    writers.write_corpus(fx.corpus(spark, sf), path)
    return spark.read.schema(readers.CORPUS).json(path).select("id", F.md5("text").alias("text_md5"))


def write_requests(spark, sf):
    path = new_stage_path(spark, "sink")
    writers.write_requests(requests.build_query_requests(fx.corpus(spark, sf)), path)
    return _requests_read(spark.read.text(path).withColumnRenamed("value", "request_json"))


def write_samples(spark, sf):
    path = new_stage_path(spark, "sink")
    writers.write_samples(fx.samples(spark, sf), path, "lz4")
    return spark.read.schema(readers.SAMPLE).json(path).select(
        "anchor", F.md5("positive").alias("positive_md5"), F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


def write_scored(spark, sf):
    path = new_stage_path(spark, "sink")
    writers.write_scored(fx.scored(spark, sf), path)
    return _scored_rows(readers.read_scored(spark, path))


def validate_corpus(spark, sf):
    docs = fx.table(spark, sf, "documents")
    good = F.to_json(F.struct("text"))
    value = F.when(F.col("lang") == "de", F.to_json(F.struct(F.col("text").alias("body")))).when(
        F.col("lang") == "es", F.concat(good, F.lit(" }"))).otherwise(good)
    path = fx.written_lines(docs.select("doc_id", value.alias("value")), "doc_id", ".jsonl")
    return readers.validate_corpus(spark, path)


# --- projections ----------------------------------------------------------------


def concat_fields(spark, sf):
    part = fx.table(spark, sf, "part")
    brand = F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand"))
    kind = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    joined = tx.concat_fields(F.col("p_name"), brand, kind, F.col("p_size"))
    return part.select("p_partkey", joined.alias("text")).filter(F.col("text") != "")


def default_id(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_idx"), F.when(F.col("lang") != "fr", F.col("source")).alias("doc_id"))
    return readers.default_id(docs)


def cap_corpus(spark, sf):
    return readers.cap_corpus(fx.corpus(spark, sf), 500).select("doc_idx", "doc_id", F.md5("text").alias("text_md5"))


def truncate_text(spark, sf):
    cut = tx.truncate_text(F.col("text"), 8000)
    return fx.corpus(spark, sf).select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("text_md5"))


def pick_few_shot(spark, sf):
    picked = requests.pick_few_shot(fx.corpus(spark, sf).select("doc_id"), fx.few_shot_pool(spark, sf))
    return picked.select("doc_id", F.md5(F.array_join("picked", "|")).alias("picked_md5"))


def render_prompt(spark, sf):
    prompt = requests.render_prompt(F.col("text"), None)
    return fx.corpus(spark, sf).select("doc_id", F.md5(prompt).alias("prompt_md5"))


def _requests_read(df):
    parsed = F.from_json("request_json", "recordId STRING, modelInput STRUCT<max_tokens: BIGINT, messages: ARRAY<STRUCT<role: STRING, content: STRING>>>")
    return df.select(parsed.alias("r")).select(
        F.col("r.recordId").alias("record_id"), F.col("r.modelInput.max_tokens").alias("max_tokens"),
        F.get("r.modelInput.messages", F.lit(0)).getField("role").alias("role"),
        F.md5(F.get("r.modelInput.messages", F.lit(0)).getField("content")).alias("prompt_md5"))


def build_requests(spark, sf):
    line = requests.request_json(F.col("doc_id"), F.col("text"))
    return _requests_read(fx.corpus(spark, sf).select(line.alias("request_json")))


def build_query_requests(spark, sf):
    return _requests_read(requests.build_query_requests(fx.corpus(spark, sf), fx.few_shot_pool(spark, sf)))


def response_text(spark, sf):
    records = responses.read_records(fx.responses(spark, sf))
    return records.select("line_id", responses.response_text(F.col("record")).alias("answer"))


def strip_fence(spark, sf):
    return fx.responses(spark, sf).select("line_id", responses.strip_fence(F.col("answer")).alias("answer"))


def parse_queries(spark, sf):
    parsed = responses.parse_queries(fx.responses(spark, sf), "answer")
    return parsed.select("line_id", "status", F.array_join("queries", "|").alias("queries"))


def explode_queries(spark, sf):
    known = fx.responses(spark, sf).withColumns({"record_id": F.col("line_id").cast("string"), "doc_idx": F.col("line_id")})
    return responses.explode_queries(responses.parse_queries(known, "answer"))


def assemble_docs(spark, sf):
    docs = scoring.assemble_docs(F.col("positive"), F.col("negatives"))
    return fx.samples(spark, sf).select("sample_id", F.size(docs).cast("long").alias("n"),
                                        F.md5(F.array_join(docs, "|")).alias("docs_md5"))


def filter_scored(spark, sf):
    return distill.filter_scored(fx.scored(spark, sf)).select("sample_id", F.size("docs").cast("long").alias("n"))


def format_pair(spark, sf):
    pair = inference.format_pair(F.col("anchor"), F.col("positive"))
    return fx.samples(spark, sf).select("sample_id", F.md5(pair).alias("pair_md5"))


# --- joins ------------------------------------------------------------------------


def pairs_join_corpus(spark, sf):
    records = responses.read_records(fx.responses(spark, sf))
    return responses.join_known(records, fx.corpus(spark, sf)).select("line_id", "record_id", "doc_idx")


def unknown_ids(spark, sf):
    records = responses.read_records(fx.responses(spark, sf))
    return responses.unknown_ids(records, fx.corpus(spark, sf)).select("line_id", "record_id")


def dedupe_last(spark, sf):
    repeated = fx.corpus(spark, sf).withColumn("doc_id", (F.col("doc_idx") % 900).cast("string"))
    return responses.dedupe_last(readers.cap_corpus(repeated, 950))


def bm25_candidates(spark, sf):
    found = bm25.bm25_candidates(fx.benchmark_queries(spark, sf), bm25.build_postings(fx.corpus(spark, sf)))
    return _long(found, "n_terms", "n_matches", "sum_tf")


def knn_candidates(spark, sf):
    found = knn.knn_scan(fx.vector_queries(spark, sf), fx.vectors(spark, sf), TOP, half=False)
    return found.select("query_id", "doc_idx", "score")


def exclude_positive(spark, sf):
    found = knn.knn_scan(fx.vector_queries(spark, sf), fx.vectors(spark, sf), 5)
    return _ranked(negatives.exclude_positive(found, fx.own_vectors(spark, sf)))


def attach_text(spark, sf):
    docs = fx.corpus(spark, sf)
    mined = negatives.mine_bm25_negatives(fx.pairs(spark, sf), docs, 5)
    return _long(negatives.attach_text(mined, docs), "rank").select(
        "query_id", "rank", "doc_idx", F.md5("text").alias("text_md5"))


def attach_scores(spark, sf):
    exploded = fx.scored(spark, sf).select("sample_id", "query", F.posexplode(F.arrays_zip("docs", "scores")).alias("pos", "x"))
    flat = exploded.select("sample_id", "query", "pos", F.col("x.docs").alias("doc"), F.coalesce("x.scores", F.lit(0.0)).alias("score"))
    back = scoring.attach_scores(flat)
    return back.select("sample_id", _scored_rows_of("docs"), _scores_of("scores"))


def _scored_rows_of(name):
    return F.array_join(name, "|").alias(name)


def _scores_of(name):
    return F.array_join(F.transform(name, lambda s: F.round(s * 10).cast("int").cast("string")), "|").alias(name)


# --- index and aggregates ----------------------------------------------------------


def tokenize(spark, sf):
    return bm25.tokenize(fx.corpus(spark, sf)).select(
        "doc_idx", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def term_freq(spark, sf):
    return bm25.build_postings(fx.corpus(spark, sf)).tf.select("doc_idx", "term", "tf")


def doc_length(spark, sf):
    return bm25.build_postings(fx.corpus(spark, sf)).doc_len


def corpus_stats(spark, sf):
    return _rounded(bm25.build_postings(fx.corpus(spark, sf)).corpus_stats, "avgdl")


def term_stats(spark, sf):
    return _rounded(bm25.build_postings(fx.corpus(spark, sf)).term_stats, "idf")


def bm25_score(spark, sf):
    found = bm25.bm25_scores(fx.benchmark_queries(spark, sf), bm25.build_postings(fx.corpus(spark, sf)))
    return _rounded(found, "best", "total")


def collect_negatives(spark, sf):
    docs = fx.corpus(spark, sf)
    mined = negatives.mine_bm25_negatives(fx.pairs(spark, sf), docs, 5)
    listed = negatives.collect_negatives(negatives.attach_text(mined, docs))
    return listed.select("query_id", F.size("negatives").cast("long").alias("n"),
                         F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


def stage_counts(spark, sf):
    return responses.query_doc_pairs(fx.responses(spark, sf), fx.corpus(spark, sf))[1]


def best_doc(spark, sf):
    return _long(distill.with_best(distill.filter_scored(fx.scored(spark, sf))), "best").select(
        "sample_id", "best", "positive", "positive_score")


def distill_loss(spark, sf):
    """Each vector against its three successors; fixed arithmetic as the teacher."""
    vecs = fx.vectors(spark, sf).select("doc_idx", "embedding")
    following = vecs.select(F.col("embedding").alias("v"), F.explode(F.array(*[
        F.struct((F.col("doc_idx") - j).alias("doc_idx"), F.lit(j).alias("j")) for j in (1, 2, 3)])).alias("x"))
    listed = following.groupBy(F.col("x.doc_idx").alias("doc_idx")).agg(
        F.sort_array(F.collect_list(F.struct("x.j", "v"))).alias("l"))
    label = F.transform("l", lambda x: (((F.col("doc_idx") * 7919 + x.j * 104729) % 50).cast("double") / 10 * 0.025).cast("float"))
    rows = vecs.join(listed, "doc_idx").select(
        F.col("embedding").alias("query_vec"), F.transform("l", lambda x: x.v).alias("doc_vecs"), label.alias("label"))
    return _rounded(distill.distill_loss(rows), "loss")


# --- ranking ------------------------------------------------------------------------


def bm25_topk(spark, sf):
    return _ranked(bm25.bm25_topk(fx.benchmark_queries(spark, sf), bm25.build_postings(fx.corpus(spark, sf)), TOP))


def bm25_topk_block(spark, sf):
    return _ranked(bm25.bm25_topk(fx.benchmark_queries(spark, sf), bm25.build_postings(fx.corpus(spark, sf)), TOP,
                                  mode="block", seed_floors=True))


def zero_score_padding(spark, sf):
    return _ranked(bm25.bm25_topk(fx.pairs(spark, sf), bm25.build_postings(fx.corpus(spark, sf)), 40, pad_zero=True))


def vector_topk(spark, sf):
    unit = knn.unit_vectors(fx.vectors(spark, sf))
    asked = knn.unit_vectors(fx.vector_queries(spark, sf))
    return _ranked(knn.vector_topk(asked, unit, 10))


def hard_negatives(spark, sf):
    ranked = bm25.bm25_topk(fx.pairs(spark, sf), bm25.build_postings(fx.corpus(spark, sf)), 10)
    return _long(negatives.hard_negatives(ranked, fx.pairs(spark, sf), 7), "rank")


def _rest(name):
    return F.array_join(F.transform(name, lambda x: F.concat(
        x.doc, F.lit("@"), F.round(x.score * 10).cast("int").cast("string"))), "|")


def rank_rest(spark, sf):
    return distill.rank_rest(distill.filter_scored(fx.scored(spark, sf))).select(
        "sample_id", "positive", _rest("rest").alias("rest"))


def top_n_rest(spark, sf):
    return distill.rank_rest(distill.filter_scored(fx.scored(spark, sf)), 3).select(
        "sample_id", "positive", _rest("rest").alias("rest"))


def chunk_negatives(spark, sf):
    ranked = distill.rank_rest(distill.filter_scored(fx.scored(spark, sf)))
    return _long(distill.chunk_rest(ranked), "chunk_no").select("sample_id", "chunk_no", _rest("chunk").alias("chunk"))


def restore_order(spark, sf):
    mixed = fx.scored(spark, sf).repartition(7, "query")
    return numbering.number_in_place(scoring.restore_order(mixed).select("sample_id", "query"), "place")


# --- composites -----------------------------------------------------------------------


def query_doc_pairs(spark, sf):
    return fx.pairs(spark, sf)


def mine_bm25_negatives(spark, sf):
    docs, asked = fx.corpus(spark, sf), fx.pairs(spark, sf)
    made = negatives.training_samples(asked, negatives.mine_bm25_negatives(asked, docs, KEPT), docs)
    return _sample_rows(made)


def _sample_rows(made):
    return made.select("query_id", "anchor", F.md5("positive").alias("positive_md5"),
                       F.size("negatives").cast("long").alias("n"), F.md5(F.array_join("negatives", "|")).alias("negatives_md5"))


def mine_semantic_negatives(spark, sf):
    docs, asked = fx.corpus(spark, sf), fx.pairs(spark, sf)
    mined = negatives.mine_semantic_negatives(asked, docs, models.hashing_encoder, KEPT)
    return _sample_rows(negatives.training_samples(asked, mined, docs))


def score_samples(spark, sf):
    done = scoring.score_samples(fx.samples(spark, sf), models.overlap_scorer)
    return done.select("sample_id", "query", F.md5(F.array_join("docs", "|")).alias("docs_md5"),
                       F.array_join(F.transform("scores", lambda s: F.round(s * 60).cast("int").cast("string")), "|").alias("scores"))


def _distilled(spark, sf, k, top_n):
    rows = distill.distillation_rows(fx.scored(spark, sf), k, top_n=top_n)
    labels = [F.round(F.get("label", F.lit(i)).cast("double"), 6).alias(f"label{i}") for i in range(k + 1)]
    return rows.select("query", "positive", *[f"negative{i + 1}" for i in range(k)], *labels)


def distillation_rows(spark, sf):
    return _distilled(spark, sf, 2, None)


def distillation_rows_k3(spark, sf):
    return _distilled(spark, sf, 3, 4)


def skipped_samples(spark, sf):
    return distill.skipped_count(fx.scored(spark, sf))


# --- vectors and models -----------------------------------------------------------------


def encode(spark, sf):
    made = inference.encode(spread(fx.corpus(spark, sf), "doc_idx"), "text", models.hashing_encoder)
    buckets = made.select("doc_idx", F.posexplode("embedding").alias("bucket", "n"))
    return _long(buckets.filter(F.col("n") > 0), "bucket", "n")


def l2_normalize_vectors(spark, sf):
    scaled = F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float"))
    unit = fx.vectors(spark, sf).select("doc_idx", l2_normalize(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return unit.select("doc_idx", F.round(l2_norm(F.col("u")), 5).alias("norm"), F.round(total, 5).alias("total"))


def inner_product_next(spark, sf):
    vecs = fx.vectors(spark, sf)
    following = vecs.select((F.col("doc_idx") - 1).alias("doc_idx"), F.col("embedding").alias("other"))
    return vecs.join(following, "doc_idx").select(
        "doc_idx", F.round(inner_product(F.col("embedding"), F.col("other")), 6).alias("ip"))


def knn_blocked(spark, sf):
    found = knn.knn_scan(fx.vector_queries(spark, sf), fx.vectors(spark, sf), TOP, seed_floors=True, batch_bytes=128 << 10)
    return _ranked(found)


def knn_lsh(spark, sf):
    return _ranked(knn.knn_lsh(fx.vector_queries(spark, sf), fx.vectors(spark, sf), 10))


def knn_lsh_all_cells(spark, sf):
    return _ranked(knn.knn_lsh(fx.vector_queries(spark, sf), fx.vectors(spark, sf), 10, n_cells=16, n_probes=16,
                               code_bytes=0, block_docs=20, block_queries=100))


def knn_cells(spark, sf):
    """Four of sixteen cells around the vectors of smallest md5, documents in their two nearest."""
    return _ranked(knn.knn_lsh(fx.vector_queries(spark, sf), fx.vectors(spark, sf), 10, n_cells=16, n_probes=4,
                               rounds=0, code_bytes=0, boundary=1e9))


def score_pairs(spark, sf):
    rows = inference.score_pairs(fx.samples(spark, sf).select(
        "sample_id", F.col("anchor").alias("query"), F.col("positive").alias("doc")), models.overlap_scorer)
    return _rounded(rows, "score").select("sample_id", "score")


def generate_queries(spark, sf):
    asked = requests.build_query_requests(fx.corpus(spark, sf))
    lines = inference.generate_queries(asked, models.spread_generator)
    parsed = responses.parse_responses(lines.withColumn("line_id", F.monotonically_increasing_id()))
    return parsed.select("record_id", "status", F.array_join("queries", "|").alias("queries"))


REGISTERED = {
    "read_corpus": read_corpus, "read_valid_corpus": read_valid_corpus, "extract_text": extract_text, "with_doc_index": with_doc_index,
    "read_responses": read_responses, "read_samples": read_samples, "read_scored": read_scored, "read_scored_array": read_scored_array,
    "read_sample_queries": read_sample_queries, "write_corpus": write_corpus, "write_requests": write_requests,
    "write_samples": write_samples, "write_scored": write_scored,
    "validate_corpus": validate_corpus, "concat_fields": concat_fields, "default_id": default_id,
    "cap_corpus": cap_corpus, "truncate_text": truncate_text, "pick_few_shot": pick_few_shot,
    "render_prompt": render_prompt, "build_requests": build_requests, "response_text": response_text,
    "strip_fence": strip_fence, "parse_queries": parse_queries, "explode_queries": explode_queries,
    "assemble_docs": assemble_docs, "filter_scored": filter_scored, "format_pair": format_pair,
    "pairs_join_corpus": pairs_join_corpus, "unknown_ids": unknown_ids, "dedupe_last": dedupe_last,
    "bm25_candidates": bm25_candidates, "knn_candidates": knn_candidates, "exclude_positive": exclude_positive,
    "attach_text": attach_text, "attach_scores": attach_scores,
    "tokenize": tokenize, "term_freq": term_freq, "doc_length": doc_length, "corpus_stats": corpus_stats,
    "term_stats": term_stats, "bm25_score": bm25_score, "collect_negatives": collect_negatives,
    "stage_counts": stage_counts, "best_doc": best_doc, "distill_loss": distill_loss,
    "bm25_topk": bm25_topk, "bm25_topk_block": bm25_topk_block, "zero_score_padding": zero_score_padding,
    "vector_topk": vector_topk, "hard_negatives": hard_negatives, "rank_rest": rank_rest,
    "top_n_rest": top_n_rest, "chunk_negatives": chunk_negatives, "restore_order": restore_order,
    "build_query_requests": build_query_requests, "query_doc_pairs": query_doc_pairs,
    "mine_bm25_negatives": mine_bm25_negatives, "mine_semantic_negatives": mine_semantic_negatives,
    "score_samples": score_samples, "distillation_rows": distillation_rows,
    "distillation_rows_k3": distillation_rows_k3, "skipped_samples": skipped_samples,
    "encode": encode, "l2_normalize": l2_normalize_vectors, "inner_product": inner_product_next,
    "knn_blocked": knn_blocked, "knn_lsh": knn_lsh, "knn_lsh_all_cells": knn_lsh_all_cells, "knn_cells": knn_cells,
    "score_pairs": score_pairs, "generate_queries": generate_queries,
}
