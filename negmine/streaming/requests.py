"""Request building over a folder that keeps receiving corpus files.

Request building looks at one record at a time, so the same projection serves a
stream.  Records must carry their id: a position needs the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from negmine.functions.json_text import needed_record
from negmine.functions.text import is_blank, strip_ws
from negmine.operators.requests import build_query_requests
from negmine.sources.readers import CORPUS


def corpus_stream(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of every JSON-lines file that arrives.

    A line that is no record, or a record without an id, stops the stream: no answer could be matched to its request.
    """
    lines = spark.readStream.text(path).filter(~is_blank(F.col("value")))
    docs = lines.select(needed_record(strip_ws(F.col("value")), CORPUS).alias("doc"))
    missing = F.raise_error(F.lit("a record without id on the stream")).cast("string")
    return docs.select(F.coalesce("doc.id", missing).alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))


def write_request_stream(corpus: DataFrame, path: str, checkpoint: str,
                         samples: list[str] | None = None) -> StreamingQuery:
    """Append request lines for what has arrived, each record once, then stop."""
    requests = build_query_requests(corpus, samples).select("request_json")
    return (requests.writeStream.format("text").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
