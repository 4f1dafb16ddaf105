"""negmine: retrieval training data at corpus scale, as Spark DataFrame jobs."""

# ruff: noqa: F401 (the public names)

from negmine.operators.bm25 import Postings, bm25_topk, build_postings, tokenize
from negmine.operators.distill import distill_loss, distillation_rows
from negmine.operators.inference import encode, generate_queries, score_pairs
from negmine.operators.knn import knn_lsh, knn_scan, recall, unit_vectors, vector_topk
from negmine.operators.negatives import (
    hard_negatives,
    mine_bm25_negatives,
    mine_semantic_negatives,
    training_samples,
)
from negmine.operators.requests import build_query_requests
from negmine.operators.responses import parse_responses, query_doc_pairs
from negmine.operators.scoring import score_samples
from negmine.plans.config import RunConfig, merge_config
from negmine.plans.run import run
from negmine.sources.readers import (
    extract_text,
    read_corpus,
    read_responses,
    read_responses_told,
    read_sample_queries,
    read_samples,
    read_scored,
    read_valid_corpus,
    require_valid_corpus,
    validate_corpus,
)
from negmine.shipping import ship
from negmine.sources.writers import write_corpus, write_requests, write_samples, write_scored
from negmine.staging import drop_stages, stage, stage_scope
