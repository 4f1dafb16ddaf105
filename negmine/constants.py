"""Fixed values shared by the operators."""

# English stop words dropped by the lexical tokeniser.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
]

# A word is two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# BM25 parameters.
BM25_K1 = 1.5
BM25_B = 0.75

# The request record.
REQUEST_API_VERSION = "bedrock-2023-05-31"
REQUEST_MAX_TOKENS = 1024

# Defaults of one run.
MAX_DOC_CHARS = 8000
ELLIPSIS = "..."
FEW_SHOT_POOL = 100
FEW_SHOT_PICK = 10
QUERIES_PER_DOCUMENT = 5
NEGATIVES_PER_QUERY = 20
OVERFETCH = 5
SCORED_NEGATIVES = 4
ENCODE_BATCH = 256
SCORE_BATCH = 8
NEGATIVES_PER_ROW = 2
TEACHER_SCALE = 0.025
TEMPERATURE = 1.0
SEED = 42

# Fixed value: what the pair scorer is asked.
PAIR_INSTRUCTION = "Predict whether passage B contains an answer to query A."

# Columns tried, in this order, for a sample query.
SAMPLE_QUERY_FIELDS = ["text", "query", "anchor"]

# Scores are compared after rounding to this many decimals, so that sums taken
# in another order cannot reorder equal documents.
SCORE_DECIMALS = 9
