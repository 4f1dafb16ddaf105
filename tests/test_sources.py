import gzip
import json

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from negmine import staging
from negmine.functions import text as tx
from negmine.operators import numbering as n
from negmine.sources import json_array as ja, readers as rd, writers as wr


def put(path, lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_corpus_ids_blanks_and_cap(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", ['{"text":"a"}', "", '{"id":"x","text":"b"}', "  \t", '{"id":7,"text":"c"}', '{"text":"d"}', ""])
    assert rows(rd.read_corpus(spark, path)) == [(0, "0", "a"), (1, "x", "b"), (2, "7", "c"), (3, "3", "d")]
    assert rows(rd.read_corpus(spark, path, 2)) == [(0, "0", "a"), (1, "x", "b")]
    assert rd.read_corpus(spark, path, 0).count() == 4


def test_corpus_order_over_files_and_splits(spark, tmp_path, setting):
    setting("spark.sql.files.maxPartitionBytes", "700")
    setting("spark.sql.files.openCostInBytes", "0")
    want = []
    for name, count in (("a.jsonl", 40), ("b.jsonl", 5), ("c.jsonl", 90)):
        texts = [f"{name}-{i}-" + "x" * (i % 37) for i in range(count)]
        put(tmp_path / name, [json.dumps({"text": t}) if i % 4 else json.dumps({"text": t}) + "\n" for i, t in enumerate(texts)])
        want += texts
    corpus = rd.read_corpus(spark, str(tmp_path))
    assert [r.text for r in sorted(corpus.collect(), key=lambda r: r.doc_idx)] == want
    assert [r.doc_idx for r in corpus.orderBy("doc_idx").collect()] == list(range(len(want)))


def test_corpus_bad_line_stops(spark, tmp_path):
    with pytest.raises(Exception, match="malformed record"):
        rd.read_corpus(spark, put(tmp_path / "c.jsonl", ['{"text":"a"}', "{"]))


@pytest.mark.parametrize("lines, want", [
    (['{"text":"a"}', "", '{"id":"1","text":null}'], (2, None, None)),
    (['{"text":"a"}', "", '{"body":"a"}', "{"], (1, 3, "no object with a text")),
    (["", '{"text":"a"} x'], (0, 2, "the line is no JSON value")),
    (['["text"]'], (0, 1, "no object with a text")),
    (["", "  "], (0, None, None)),
])
def test_validate(spark, tmp_path, lines, want):
    path = put(tmp_path / "c.jsonl", lines)
    assert tuple(rd.validate_corpus(spark, path).first()) == want


def test_validate_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="jsonl"):
        rd.validate_corpus(spark, str(tmp_path / "c.txt"))
    with pytest.raises(ValueError, match="line 2: the line is no JSON value"):
        rd.require_valid_corpus(spark, put(tmp_path / "a.jsonl", ['{"text":"a"}', "x"]))
    with pytest.raises(ValueError, match="no documents"):
        rd.require_valid_corpus(spark, put(tmp_path / "b.jsonl", [""]))
    assert rd.require_valid_corpus(spark, put(tmp_path / "d.jsonl", ['{"text":"a"}'])) == 1


def test_validate_line_numbers_over_splits(spark, tmp_path, setting):
    setting("spark.sql.files.maxPartitionBytes", "200")
    setting("spark.sql.files.openCostInBytes", "0")
    lines = ['{"text":"%s"}' % ("y" * (i % 23)) for i in range(120)]
    lines[77], lines[101] = "oops", "oops"
    assert rd.validate_corpus(spark, put(tmp_path / "c.jsonl", lines)).first().first_bad_line == 78


def test_extract_text(spark):
    df = spark.createDataFrame([(3, "t", None, 1.5), (1, "", "", None), (2, "a", "b", None)],
                               "id INT, title STRING, body STRING, price DOUBLE")
    got = rd.extract_text(df, "id", "title, body,price", order_by=["id"])
    assert rows(got) == [(0, "2", "a b"), (1, "3", "t 1.5")]
    assert rows(rd.extract_text(df, "id", ["title"], max_docs=1, order_by=["id"])) == [(0, "2", "a")]
    placed = rd.extract_text(df.coalesce(1), "id", "title")
    assert rows(placed) == [(0, "3", "t"), (1, "2", "a")]
    with pytest.raises(ValueError):
        rd.parse_field_list(" , ")


@pytest.mark.parametrize("parts", [1, 7])
def test_number_rows(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("same")).repartition(parts)
    got = n.number_rows(df, ["k"]).collect()
    assert all(r.k == r.doc_idx for r in got)
    assert sorted(r.doc_idx for r in n.number_rows(df, ["same"]).collect()) == list(range(1000))
    assert sorted(r.doc_idx for r in n.number_in_place(df).collect()) == list(range(1000))


def test_running_total(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(300)], "k INT, amount INT").repartition(5)
    total, want = 0, {}
    for k, amount in sorted(map(tuple, df.collect())):
        want[k] = total
        total += amount
    assert {r.k: r.before for r in n.running_total(df, ["k"], "amount", "before").collect()} == want


def test_responses_listing(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    put(tmp_path / "a.jsonl.out", ["1", "", "2"])
    put(tmp_path / "deep" / "er" / "b.jsonl.out", ["3"])
    put(tmp_path / "manifest.json.out", ["x"])
    got = rd.read_responses(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in got) == ["1", "2", "3"]
    assert sorted(r.line_id for r in got) == [0, 1, 2]


def test_samples(spark, tmp_path):
    put(tmp_path / "a.jsonl", ['{"anchor":"q","positive":"p","negatives":["n"]}', "", '{"anchor":"q2","positive":"p2"}'])
    put(tmp_path / "b.json", ['{"anchor":"q3","positive":"p3","negatives":[]}'])
    put(tmp_path / "c.txt", ["ignored"])
    assert sorted((r.anchor, r.positive, r.negatives) for r in rd.read_samples(spark, str(tmp_path)).collect()) == [
        ("q", "p", ["n"]), ("q2", "p2", []), ("q3", "p3", [])]
    other = tmp_path / "other"
    other.mkdir()
    put(other / "a.jsonl", ['{"anchor":"q"}'])
    with pytest.raises(Exception, match="sample without 'positive'"):
        rd.read_samples(spark, str(other))


def test_scored_both_forms(spark, tmp_path):
    data = [{"query": "q", "docs": ["a", "b"], "scores": [1.5, 2]}, {"query": "r", "docs": [], "scores": []}]
    array = put(tmp_path / "a.json", [json.dumps(data, indent=2)])
    lines = put(tmp_path / "b.jsonl", [json.dumps(x) for x in data])
    want = [("q", ["a", "b"], [1.5, 2.0]), ("r", [], [])]
    assert rows(rd.read_scored(spark, array)) == rows(rd.read_scored(spark, lines)) == want


def test_sample_queries(spark, tmp_path):
    lines = ['{"text":""}', '{"query":" q "}', "", '{"text":"","query":"","anchor":"a"}', '{"text":"t","query":"q2"}', '{"text":"late"}']
    path = put(tmp_path / "s.jsonl", lines)
    assert rd.read_sample_queries(spark, path) == ["q", "a", "t", "late"]
    assert rd.read_sample_queries(spark, path, 3) == ["q", "a"]  # the limit counts records, blank ones too
    assert rd.read_sample_queries(spark, None) == []
    assert rd.read_sample_queries(spark, str(tmp_path / "missing.jsonl")) == []


def test_sinks_refuse_to_replace(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "ü", "täxt\n")], "doc_idx LONG, doc_id STRING, text STRING")
    path = str(tmp_path / "out")
    wr.write_corpus(corpus, path)
    assert rows(rd.read_corpus(spark, path)) == [(0, "ü", "täxt\n")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        wr.write_corpus(corpus, path)


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \x1c\x85",), ("x\n",), ("",)], "t STRING")
    assert [r.s for r in df.select(tx.strip_ws(F.col("t")).alias("s")).collect()] == ["a", "x", ""]
    assert [r.b for r in df.select(tx.is_blank(F.col("t")).alias("b")).collect()] == [False, False, True]
    long = spark.createDataFrame([("é" * 8001,), ("é" * 8000,)], "t STRING")
    assert [r.c for r in long.select(tx.truncate_text(F.col("t"), 8000).alias("c")).collect()] == ["é" * 8000 + "...", "é" * 8000]
    words = spark.createDataFrame([("The Straße, a ÜBER_x 42 of 7 cat cat",)], "t STRING")
    assert words.select(tx.tokens(F.col("t")).alias("w")).first().w == ["straße", "über_x", "42", "cat", "cat"]


TWO = '{"text":"b"}{"text":"c"}'


@pytest.mark.parametrize("line", [TWO, '{"text":"b"},{"text":"c"}', '{"text":"a"} trailing', '{"text":"a"}]', '{"text":"a","text":"b"}', '["text"]', "3"])
def test_a_line_is_one_record(spark, tmp_path, line):
    path = put(tmp_path / "c.jsonl", ['{"text":"ok"}', line])
    with pytest.raises(Exception, match="malformed record"):
        rd.read_corpus(spark, path).collect()
    assert rd.validate_corpus(spark, path).first().first_bad_line == 2


def test_other_readers_want_one_record_too(spark, tmp_path):
    sample, scored = '{"anchor":"a","positive":"p"}', '{"query":"q","docs":["d"],"scores":[NaN]}'
    for name, line, read in (("s", sample, rd.read_samples), ("d", scored, rd.read_scored)):
        (tmp_path / name).mkdir()
        put(tmp_path / name / "x.jsonl", [line, ""])
        assert read(spark, str(tmp_path / name)).count() == 1
        for bad in (line + line, line + " x"):
            (tmp_path / name / "x.jsonl").unlink()
            put(tmp_path / name / "x.jsonl", [line, bad])
            with pytest.raises(Exception, match="malformed record"):
                read(spark, str(tmp_path / name)).collect()


def test_a_malformed_sample_query_gives_none(spark, tmp_path, caplog):
    path = put(tmp_path / "s.jsonl", ['{"text":"q"}', '{"text":', '{"text":"r"}'])
    assert rd.read_sample_queries(spark, path) == [] and "malformed" in caplog.text
    assert rd.read_sample_queries(spark, path, 1) == ["q"]


def test_texts_of_any_length(spark, tmp_path):
    path = put(tmp_path / "c.jsonl", [json.dumps({"id": "long", "text": "z" * 21_000_000}), '{"text":"b"}'])
    assert tuple(rd.validate_corpus(spark, path).first()) == (2, None, None)
    got = rd.read_corpus(spark, path).select("doc_id", F.length("text").alias("n"))
    assert sorted((r.doc_id, r.n) for r in got.collect()) == [("1", 1), ("long", 21_000_000)]


def test_text_does_not_move_for_its_number(spark, tmp_path):
    for i in range(6):
        put(tmp_path / f"{i}.jsonl", ['{"text":"x"}'] * 5)
    plan = rd.read_corpus(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    plain = n.number_in_place(spark.range(100).withColumn("text", F.lit("x")))
    assert "SortMergeJoin" not in plain._jdf.queryExecution().executedPlan().toString()


def test_scored_array_on_one_line(spark, tmp_path):
    path = put(tmp_path / "a.json", [json.dumps([{"query": "q", "docs": ["d"] * 3, "scores": [1.0] * 3}] * 500)])
    assert rd.read_scored(spark, path).count() == 500


def zipped(path, lines, share=1.0):
    whole = gzip.compress("\n".join(lines).encode())
    path.write_bytes(whole[:int(len(whole) * share)])


def test_truncated_files_are_left_out_whole_and_told(spark, tmp_path):
    place = tmp_path / "an swers"
    place.mkdir()
    many = [str(i * 7919 % 10007) for i in range(20_000)]
    for i in range(9):
        zipped(place / f"f {i}.jsonl.out.gz", many, 0.5 if i % 3 == 1 else 1.0)
    put(place / "plain.jsonl.out", ["a", "b"])
    put(place / "x.jsonl.output", ["no response file"])
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        rd.read_responses(spark, str(place))
    lines, skipped = rd.read_responses_told(spark, str(place))
    assert lines.count() == 6 * 20_000 + 2
    assert lines.select("line_id").distinct().count() == 6 * 20_000 + 2
    found = {r.file.rsplit("/", 1)[1]: r.reason for r in skipped.collect()}
    assert set(found) == {f"f%20{i}.jsonl.out.gz" for i in (1, 4, 7)}
    assert all("EOF" in reason or "end of" in reason.lower() for reason in found.values())
    assert rows(rd.unreadable_responses(spark, str(place))) == rows(skipped)


def test_no_bad_file_costs_no_second_read(spark, tmp_path, monkeypatch):
    put(tmp_path / "a.jsonl.out", ["1"])
    monkeypatch.setattr(rd, "find_unreadable", None)
    lines, skipped = rd.read_responses_told(spark, str(tmp_path))
    assert lines.count() == 1 and skipped.isEmpty()


def test_valid_corpus_is_read_once(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "c.jsonl", ['{"text":"a"}', "", '{"id":7,"text":null}', '{"text":3,"other":{"text":[1]}}'])
    want = [(0, "0", "a"), (1, "7", ""), (2, "2", "3")]
    assert rows(rd.read_corpus(spark, path)) == want and rd.require_valid_corpus(spark, path) == 3
    monkeypatch.setattr(rd, "validate_corpus", None)
    assert rows(rd.read_valid_corpus(spark, path)) == want
    assert rows(rd.read_valid_corpus(spark, path, 1)) == want[:1]


@pytest.mark.parametrize("line", ["{", '{"body":"a"}', '{"text":"a"} x', '["text"]', '{"text":"a"}{"text":"b"}', "7", '{"text":NaN}', "null",
                                  '{"text":"a","text":"b"}', "{'text':'a'}", '{"v":{"text":"a"}}', '{"a":1},"text":{"b":2}'])
def test_bad_line_is_told_as_by_validation(spark, tmp_path, line):
    path = put(tmp_path / "c.jsonl", ['{"text":"fine"}', "", line, '{"text":"fine"}'])
    for read in (rd.require_valid_corpus, rd.read_valid_corpus):
        with pytest.raises(ValueError, match="^line 3: "):
            read(spark, path)


def test_corpus_path_and_emptiness_are_told(spark, tmp_path):
    with pytest.raises(ValueError, match="jsonl"):
        rd.read_valid_corpus(spark, str(tmp_path / "c.txt"))
    with pytest.raises(ValueError, match="no documents"):
        rd.read_valid_corpus(spark, put(tmp_path / "b.jsonl", ["", " "]))


def scored_records(n):
    bits = ['plain', 'a } b', '{"x": [', '\\"', 'back\\\\', '[]}]}', '","', 'ü\n}', '']
    return [{"query": f"{i} {bits[i % 9]}", "docs": [bits[(i + j) % 9] * (i % 4) for j in range(i % 5)], "scores": [j / 8 for j in range(i % 5)]}
            | ({"more": {"deep": [{"a": "}"}, {}]}} if i % 3 == 0 else {}) for i in range(n)]


@pytest.mark.parametrize("form", ["one line", "indented"])
@pytest.mark.parametrize("split", ["37", "300", "100000"])
def test_array_files_are_split_anywhere(spark, tmp_path, setting, form, split):
    setting("spark.sql.files.maxPartitionBytes", split)
    setting("spark.sql.files.openCostInBytes", "0")
    records = scored_records(60)
    for name, part in (("a.json", records[:35]), ("b.json", records[35:])):
        (tmp_path / name).write_text(" " + json.dumps(part, indent=None if form == "one line" else 2) + "\n", encoding="utf-8")
    (tmp_path / "c.json").write_text("[ \n]")
    want = sorted((r["query"], r["docs"], r["scores"]) for r in records)
    assert rows(rd.read_scored(spark, str(tmp_path))) == want
    if split == "300":
        assert ja.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("text", [
    '[{"query":"a"}', '[{"query":"a"},', '[{"query":"a"}]]', '[{"query":"a"} {"query":"b"}]', '[{"query":"a"},5]', '[5,{"query":"a"}]',
    '[{"query":"a"},]', '[{"query":"a}]', '[{"query":"a"}] x', '[[{"query":"a"}]]', '[{"query":"a"}][{"query":"b"}]'])
def test_broken_arrays_stop(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="malformed"):
        rd.read_scored(spark, str(tmp_path / "a.json")).collect()


def test_samples_window_gives_the_next_five(spark, tmp_path, monkeypatch):
    """Blocks, gaps, repeated and missing ids; every text is shuffled once, not once per sample that holds it."""
    monkeypatch.setattr(fixtures, "BLOCK_IDS", 7)
    ids = [None, -3, 0, 1, 2, 2, 5, 6, 7, 8, 13, 14, 20, 21, 22, 100]
    rows = [(x, f"text {i}") for i, x in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    made = fixtures.samples(spark, str(tmp_path))
    got = sorted((r.positive, r.sample_id, r.negatives) for r in made.collect())
    near = {t: [u for y, u in sorted((y, u) for y, u in rows if x is not None and y is not None and x < y <= x + 5)] for x, t in rows}
    assert got == sorted((t, x, near[t]) for x, t in rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_read_samples_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", ["n"]), ("b", "q", [])], "anchor STRING, positive STRING, negatives ARRAY<STRING>").coalesce(1)
    wr.write_samples(rows, f"{tmp_path}/plain")
    wr.write_samples(rows, f"{tmp_path}/packed", "lz4")
    plain, packed = (rd.read_samples(spark, f"{tmp_path}/{x}").collect() for x in ("plain", "packed"))
    assert plain == packed and len(plain) == 2


def test_spread_bounds_a_task(spark, tmp_path, monkeypatch):
    spark.range(100_000).withColumn("x", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(staging, "_SPREAD_BYTES", 100_000)
    assert staging.spread(spark.read.parquet(f"{tmp_path}/t"), "id").rdd.getNumPartitions() > 20
