"""Configuration of one run: defaults, overridden by the user."""

from __future__ import annotations

from dataclasses import dataclass, fields

from negmine import constants as c


@dataclass(frozen=True)
class RunConfig:
    input_type: str = "jsonl"            # "jsonl": a corpus file; "table": any Spark table
    corpus_path: str | None = None
    table_format: str = "parquet"
    id_column: str = "id"
    text_fields: str = "content"
    sample_queries_path: str | None = None
    max_corpus_documents: int | None = None   # None: all
    max_query_documents: int | None = None    # None: queries for all documents
    queries_per_document: int = c.QUERIES_PER_DOCUMENT
    max_doc_chars: int = c.MAX_DOC_CHARS
    mined_negatives: int = c.NEGATIVES_PER_QUERY
    miner: str = "bm25"                  # "bm25" or "semantic"
    semantic_search: str = "block"       # "block": exact; "lsh": approximate, by a trained index
    scoring_max_negatives: int = c.SCORED_NEGATIVES
    scoring_batch_size: int = 4
    num_negatives: int = c.NEGATIVES_PER_ROW
    teacher_score_scale_factor: float = c.TEACHER_SCALE
    top_n: int | None = None
    responses_path: str | None = None    # answers of an external service; None: ask the generator
    skip_bad_files: bool = False
    pad_zero: bool = False               # fill short lexical results with documents of score 0
    write_lines: bool = False            # also write JSON lines of requests, samples and scored samples
    seed: int = c.SEED


def merge_config(user: dict | None = None) -> RunConfig:
    """Defaults with the user's values on top; text values take the type of the default."""
    user = user or {}
    known = {f.name: f.default for f in fields(RunConfig)}
    unknown = sorted(set(user) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")

    def typed(name, value):
        default = known[name]
        if isinstance(default, bool):
            if str(value).lower() not in ("true", "false"):
                raise ValueError(f"{name} must be true or false")
            return str(value).lower() == "true"
        if isinstance(value, str) and isinstance(default, (int, float)):
            return type(default)(value)
        counts = ("top_n", "max_corpus_documents", "max_query_documents")
        return int(value) if name in counts and value is not None else value

    config = RunConfig(**{name: typed(name, value) for name, value in user.items()})
    if config.input_type not in ("jsonl", "table"):
        raise ValueError("input_type must be 'jsonl' or 'table'")
    if config.miner not in ("bm25", "semantic"):
        raise ValueError("miner must be 'bm25' or 'semantic'")
    if config.semantic_search not in ("block", "lsh"):
        raise ValueError("semantic_search must be 'block' or 'lsh'")
    return config
