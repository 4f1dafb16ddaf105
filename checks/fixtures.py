"""Inputs derived by Spark from the given tables, all of them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from negmine.functions.binding import let
from negmine.staging import new_stage_path, spread, stage
from negmine.operators.responses import query_doc_pairs
from negmine.sources.readers import sample_queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir) -> DataFrame:
    """``documents`` with its id as position."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("doc_id"), "text")


def benchmark_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def few_shot_pool(spark, sf_dir) -> list[str]:
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    rows = sample_queries(turns, ["conv_id", "turn"]).collect()
    return [r.q for r in sorted(rows, key=lambda r: (r.conv_id, r.turn))]


def with_spread_queries(docs: DataFrame) -> DataFrame:
    """Add ``words``, ``q1``, ``q2``: six words each, from all over the text."""
    return _spread_queries(spread(docs, "doc_id"))


def _spread_queries(docs: DataFrame) -> DataFrame:
    def picked(words, shift):
        places = [F.get(words, F.floor(F.size(words) * (2 * i + shift) / 12).cast("int")) for i in range(6)]
        return F.concat_ws(" ", *places)

    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N} ]", " "), " "), lambda w: w != "")
    made = let(words, lambda w: F.struct(w.alias("words"), picked(w, 0).alias("q1"), picked(w, 1).alias("q2")))
    return docs.withColumn("_q", made).select("*", "_q.*").drop("_q")


def responses(spark, sf_dir) -> DataFrame:
    """``line_id, shape, answer, value``: one response per document, in eight shapes."""
    docs = with_spread_queries(table(spark, sf_dir, "documents"))
    both = F.concat(F.lit('{"queries": ["'), "q1", F.lit('", "'), "q2", F.lit('"]}'))
    one = F.concat(F.lit('["'), "q1", F.lit('"]'))
    shape = F.col("doc_id") % 8
    answer = (
        F.when(shape == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here: "), both, F.lit(" Enjoy.")))
        .when(shape == 3, one)
        .when(shape == 4, F.concat(F.lit('{"queries": ["'), "q1", F.lit('",')))
        .when(shape == 5, F.lit(""))
        .when(shape == 6, F.concat(F.lit('{"queries": [1, "'), "q1", F.lit('", null, "  "]}')))
        .otherwise(both)
    )
    record_id = F.when(shape == 7, F.concat(F.lit("unknown-"), F.col("doc_id").cast("string"))).otherwise(
        F.col("doc_id").cast("string"))
    block = F.struct(F.lit("text").alias("type"), answer.alias("text"))
    value = F.to_json(F.struct(record_id.alias("recordId"), F.struct(F.array(block).alias("content")).alias("modelOutput")))
    # as response files would be: written before they are parsed
    return stage(docs.select(F.col("doc_id").alias("line_id"), shape.alias("shape"), answer.alias("answer"),
                             value.alias("value")), "responses")


def pairs(spark, sf_dir) -> DataFrame:
    return query_doc_pairs(responses(spark, sf_dir).select("line_id", "value"), corpus(spark, sf_dir))[0]


# Ids of a block of neighbours, and how many next ids a sample takes its negatives from.
BLOCK_IDS, FOLLOWING = 500, 5
# Bytes of input for a task that makes samples.
SAMPLE_TASK_BYTES = 32 << 20


def samples(spark, sf_dir) -> DataFrame:
    """One training sample per document: its query, its text, the texts of the next five.

    Documents lie in blocks of ids, the first of a block in the one before too, so the next five are a range of a
    window inside the block and every text is shuffled once.  Blocks are dealt in ranges of the ids, as many as the bytes ask for.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SAMPLE_TASK_BYTES)
    block, before = (F.floor((F.col("doc_id") - j) / BLOCK_IDS) for j in (0, FOLLOWING))
    placed = docs.withColumn("_block", F.explode(F.array_distinct(F.array(block, before))))
    near = Window.partitionBy("_block").orderBy("doc_id").rangeBetween(1, FOLLOWING)
    listed = placed.repartitionByRange(tasks, "_block").withColumn("_next", F.collect_list(F.struct("doc_id", "text")).over(near))
    own = listed.where(F.col("_block").eqNullSafe(block))
    negatives = F.when(F.col("doc_id").isNotNull(), F.transform(F.sort_array("_next"), lambda x: x.text))
    return _spread_queries(own).select(
        F.col("doc_id").alias("sample_id"), F.col("q1").alias("anchor"), F.col("text").alias("positive"),
        F.coalesce(negatives, F.array().cast("array<string>")).alias("negatives"))


def scored(spark, sf_dir) -> DataFrame:
    """One scored sample per document, with ties, short samples and length mismatches."""
    docs = with_spread_queries(table(spark, sf_dir, "documents"))
    n = "CAST(doc_id % 8 AS INT)"
    return stage(docs.select(
        F.col("doc_id").alias("sample_id"),
        F.concat_ws("#", "q1", F.col("doc_id").cast("string")).alias("query"),
        F.expr(f"transform(slice(sequence(0, 7), 1, {n}), p -> concat(p, ':', coalesce(get(words, CAST((size(words) * p) DIV 8 AS INT)), '')))").alias("docs"),
        F.expr(f"transform(slice(sequence(0, 7), 1, {n} - IF(doc_id % 11 = 0 AND {n} > 0, 1, 0)), p -> CAST((doc_id * 7919 + p * 104729) % 50 AS DOUBLE) / 10)").alias("scores"),
    ), "scored")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_idx"), "embedding", "label")


def vector_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def own_vectors(spark, sf_dir) -> DataFrame:
    """Each vector's own position, as the positive to leave out."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("vec_id").alias("doc_idx"))


def written_lines(lines: DataFrame, order: str, name: str, in_ranges: bool = False, compressed: bool = False) -> str:
    """Write the column ``value`` in order, as files named ``*<name>``; the folder's path.

    ``in_ranges``: the partitions are ranges of ``order`` already, so nothing is shuffled for it.
    """
    spark = lines.sparkSession
    path = new_stage_path(spark, "lines") + ".jsonl"
    ordered = lines.sortWithinPartitions(order) if in_ranges else lines.orderBy(order)
    ordered.select("value").write.text(path, compression="lz4" if compressed else "none")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        file = status.getPath()
        if file.getName().startswith("part-"):
            fs.rename(file, jvm.org.apache.hadoop.fs.Path(folder, file.getName().replace(".txt", name)))
    return path
