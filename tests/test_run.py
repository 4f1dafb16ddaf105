import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from negmine import models
from negmine.operators.requests import build_query_requests, pick_few_shot, pick_places
from negmine.plans.config import merge_config
from negmine.plans.run import require_non_empty, run
from negmine.streaming.requests import corpus_stream, write_request_stream

ANIMALS = ["cat", "dog", "bird", "fish", "horse", "mouse", "snake", "whale"]
TEXTS = [f"{a} number {i} lives near {ANIMALS[(i + 3) % 8]} and eats {ANIMALS[(i + 5) % 8]} food daily"
         for i, a in enumerate(ANIMALS * 4)]


def corpus_file(tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(json.dumps({"text": t}) for t in TEXTS))
    return str(path)


@pytest.mark.parametrize("miner", ["bm25", "semantic"])
def test_whole_run_and_resume(spark, tmp_path, miner):
    config = merge_config({"corpus_path": corpus_file(tmp_path), "miner": miner})
    out = str(tmp_path / "out")
    args = (spark, config, out, models.spread_generator, models.overlap_scorer, models.hashing_encoder)
    rows = run(*args)
    assert rows.columns == ["query", "positive", "negative1", "negative2", "label"]
    assert rows.count() == 2 * 2 * len(TEXTS)  # two queries per document, five scored texts, two rows each

    def broken():
        raise AssertionError("a finished step ran again")

    again = run(spark, config, out, broken, broken, broken)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_run_from_a_table(spark, tmp_path):
    table = str(tmp_path / "table")
    spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], "key INT, body STRING, note STRING").write.parquet(table)
    config = merge_config({"input_type": "table", "corpus_path": table, "id_column": "key", "text_fields": "body,note",
                           "max_query_documents": "5", "num_negatives": "4"})
    rows = run(spark, config, str(tmp_path / "out"), models.spread_generator, models.overlap_scorer)
    assert rows.count() == 5 * 2 and "negative4" in rows.columns


def test_empty_step_stops(spark, tmp_path):
    def silent():
        return lambda prompts: ["" for _ in prompts]

    config = merge_config({"corpus_path": corpus_file(tmp_path)})
    with pytest.raises(ValueError, match="step 'pairs' gave no rows"):
        run(spark, config, str(tmp_path / "out"), silent, models.overlap_scorer)
    with pytest.raises(ValueError, match="'x'"):
        require_non_empty(spark.range(0), "x")


def test_config():
    assert merge_config({}).num_negatives == 2
    merged = merge_config({"num_negatives": "3", "teacher_score_scale_factor": "0.5", "top_n": "4"})
    assert (merged.num_negatives, merged.teacher_score_scale_factor, merged.top_n) == (3, 0.5, 4)
    for bad in ({"input_type": "ftp"}, {"miner": "x"}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            merge_config(bad)


def test_few_shot(spark):
    docs = spark.range(500).select(F.col("id").cast("string").alias("doc_id"))
    for n in (1, 2, 7, 12, 100):
        pool = [f"s{i}" for i in range(n)]
        picked = [r.picked for r in pick_few_shot(docs, pool).collect()]
        assert all(len(set(p)) == len(p) == min(10, n) for p in picked)
        assert {q for p in picked for q in p} == set(pool)
        assert n < 12 or len({tuple(p) for p in picked}) > 20
    one = pick_few_shot(docs, ["a", "b", "c"], 2, seed=1).collect()
    assert one == pick_few_shot(docs, ["a", "b", "c"], 2, seed=1).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 17])
def test_few_shot_every_ordered_pair_occurs_alike(spark, n):
    pool = [f"s{i}" for i in range(n)]
    docs = spark.range(20_000).select(F.col("id").cast("string").alias("doc_id"))
    picked = pick_few_shot(docs, pool, 2).groupBy("picked").count().collect()
    want = {(a, b) for a in pool for b in pool if a != b} if n > 1 else {("s0",)}
    assert {tuple(r.picked) for r in picked} == want
    even = 20_000 / len(want)
    assert all(abs(r["count"] - even) < 5 * even ** 0.5 + 0.2 * even for r in picked)


def test_few_shot_places_against_a_plain_permutation(spark):
    def plain(n, key, shots):
        digest = hashlib.sha256(key.encode()).hexdigest()
        w = [int(digest[i:i + 4], 16) for i in range(0, 64, 4)]
        rows = next(a for a in range(1, n + 1) if a * a >= n)
        columns = -(-n // rows)
        found = []
        for x in range(rows * columns):
            row, column = divmod(x, columns)
            for i in range(0, 16, 4):
                row = (row + (column * w[i] + w[i + 1]) % 65537) % rows
                column = (column + (row * w[i + 2] + w[i + 3]) % 65537) % columns
            found.append(row * columns + column)
        assert sorted(found) == list(range(rows * columns))
        return [x for x in found if x < n][:shots]

    keys = spark.range(40).select(F.col("id").cast("string").alias("k"))
    for n, shots in ((1, 3), (2, 2), (6, 4), (97, 10), (1000, 10), (70_001, 3)):
        got = {r.k: r.p for r in keys.select("k", pick_places(n, F.col("k"), shots).alias("p")).collect()}
        assert got == {str(k): plain(n, str(k), shots) for k in range(40)}


def test_few_shot_plan_does_not_grow_with_the_pool(spark):
    docs = spark.range(5).select(F.col("id").cast("string").alias("doc_id"))
    sizes = [len(pick_few_shot(docs, [f"sample query {i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()) for n in (100, 10_000)]
    assert sizes[1] < 1.1 * sizes[0]


def test_prompt_text_is_inert(spark):
    nasty = 'a {document} %s $1 \\ "quoted" {{x}}'
    corpus = spark.createDataFrame([(0, "0", nasty)], "doc_idx LONG, doc_id STRING, text STRING")
    row = build_query_requests(corpus, ["{sample} %d"], n_queries=3).first()
    record = json.loads(row.request_json)
    assert nasty in row.prompt and "- {sample} %d" in row.prompt and '["query1", "query2", "query3"]' in row.prompt
    assert record["recordId"] == "0" and record["modelInput"]["messages"] == [{"role": "user", "content": row.prompt}]
    assert record["modelInput"]["max_tokens"] == 1024
    assert "Exchange" not in build_query_requests(corpus)._jdf.queryExecution().executedPlan().toString()


def test_requests_on_a_stream(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for name, ids in (("a", "12"), ("b", "3")):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": i, "text": f"text {i}"}) for i in ids))
        query = write_request_stream(corpus_stream(spark, inbox), out, state)
        query.awaitTermination(60)
    got = sorted(json.loads(r.value)["recordId"] for r in spark.read.text(out).collect())
    assert got == ["1", "2", "3"]


def test_changed_settings_and_inputs_are_made_again(spark, tmp_path):
    out, path = str(tmp_path / "out"), corpus_file(tmp_path)
    models_ = (models.spread_generator, models.overlap_scorer)
    first = run(spark, merge_config({"corpus_path": path}), out, *models_)
    assert "negative2" in first.columns and "negative3" not in first.columns
    second = run(spark, merge_config({"corpus_path": path, "num_negatives": 4, "max_query_documents": 3}), out, *models_)
    assert "negative4" in second.columns and second.count() == 3 * 2
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"text": t}) for t in TEXTS[:9]))
    assert run(spark, merge_config({"corpus_path": path}), out, *models_).select("query").distinct().count() <= 18


def test_all_documents_are_asked_by_default(spark):
    config = merge_config({})
    assert config.max_corpus_documents is None and config.max_query_documents is None
    assert merge_config({"max_query_documents": "7", "pad_zero": "true"}).pad_zero is True


def answer(doc, queries):
    return json.dumps({"recordId": doc, "modelOutput": {"content": [{"type": "text", "text": json.dumps({"queries": queries})}]}})


def test_answers_of_an_external_service(spark, tmp_path):
    answers = tmp_path / "answers"
    answers.mkdir()
    (answers / "a.jsonl.out").write_text("\n".join([
        answer("0", ["cat food", "zzz"]), answer("1", ["dog lives"]), answer("999", ["unknown"]), "broken", answer("2", [])]))
    (answers / "manifest.json").write_text("x")
    config = merge_config({"corpus_path": corpus_file(tmp_path), "responses_path": str(answers), "pad_zero": True, "write_lines": True})
    out = tmp_path / "out"
    rows = run(spark, config, str(out), make_scorer=models.overlap_scorer)
    assert rows.select("query").distinct().count() == 3  # "zzz" matches nothing and is padded
    counts = spark.read.parquet(str(out / "counts")).first()
    assert (counts.lines, counts.known, counts.unknown, counts.pairs, counts.errors) == (5, 3, 2, 3, 2)
    assert counts.skipped_samples == 0 and counts.usable_samples == 3
    assert len(spark.read.text(str(out / "requests-lines")).collect()) == len(TEXTS)
    assert spark.read.json(str(out / "samples-lines")).count() == 3 and spark.read.json(str(out / "scored-lines")).count() == 3
    unpadded = merge_config({"corpus_path": corpus_file(tmp_path), "responses_path": str(answers)})
    run(spark, unpadded, str(out), make_scorer=models.overlap_scorer)
    assert spark.read.parquet(str(out / "counts")).first().skipped_samples == 1


def test_unreadable_answers_are_counted(spark, tmp_path):
    answers = tmp_path / "answers"
    answers.mkdir()
    (answers / "a.jsonl.out").write_text(answer("0", ["cat food"]))
    whole = gzip.compress("\n".join(answer(str(i), ["dog lives"]) for i in range(20_000)).encode())
    (answers / "b.jsonl.out.gz").write_bytes(whole[:len(whole) // 2])
    config = {"corpus_path": corpus_file(tmp_path), "responses_path": str(answers)}
    with pytest.raises(Exception, match="b.jsonl.out.gz"):
        run(spark, merge_config(config), str(tmp_path / "strict"), make_scorer=models.overlap_scorer)
    out = tmp_path / "out"
    run(spark, merge_config({**config, "skip_bad_files": True}), str(out), make_scorer=models.overlap_scorer)
    counts = spark.read.parquet(str(out / "counts")).first()
    assert (counts.lines, counts.skipped_files) == (1, 1)
    assert spark.read.parquet(str(out / "skipped_files")).first().file.endswith("b.jsonl.out.gz")


def test_missing_models_are_told_first(spark, tmp_path):
    config = merge_config({"corpus_path": corpus_file(tmp_path), "miner": "semantic"})
    with pytest.raises(ValueError, match="make_encoder"):
        run(spark, config, str(tmp_path / "out"), models.spread_generator, models.overlap_scorer)
    with pytest.raises(ValueError, match="make_generator"):
        run(spark, merge_config({"corpus_path": "x"}), str(tmp_path / "out"), make_scorer=models.overlap_scorer)


@pytest.mark.parametrize("line, told", [('{"text":"a"}', "without id"), ('{"id":"1","text":"a"} x', "malformed"), ("{", "malformed")])
def test_stream_refuses_what_no_answer_could_match(spark, tmp_path, line, told):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":"0","text":"fine"}\n' + line)
    query = write_request_stream(corpus_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    with pytest.raises(Exception, match=told):
        query.awaitTermination(60)
