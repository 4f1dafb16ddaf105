import json

import pytest
from pyspark.sql import functions as F

from negmine.operators import responses as r

# response text -> (status, queries)
TEXTS = {
    '{"queries":["a"]}': ("ok", ["a"]),
    ' \n{"queries":["a"," b "]}\n': ("ok", ["a", "b"]),
    '```json\n{"queries":["a"]}\n```': ("ok", ["a"]),
    '```\n["a","b"]\n```': ("ok", ["a", "b"]),
    '["a"]': ("ok", ["a"]),
    'Here: {"queries": ["a"]} Enjoy.': ("ok", ["a"]),
    'Here:\n{"queries":\n["a"]}\nEnjoy.': ("ok", ["a"]),
    '{"queries":["a"]} trailing': ("ok", ["a"]),
    '{"queries":["a"]}],[x': ("ok", ["a"]),
    '["a"],["b"]': ("empty", []),
    '["a"]],[["b"]': ("empty", []),
    '{"queries":["a"]}}': ("empty", []),
    '{"queries":["a"]} x {y}': ("empty", []),
    '["a"] x': ("empty", []),
    "{'queries':['a']}": ("empty", []),
    '{"queries":[]}': ("empty", []),
    "{}": ("empty", []),
    "null": ("empty", []),
    "0": ("empty", []),
    "5": ("empty", []),
    '"abc"': ("empty", []),
    '{"queries":"abc"}': ("empty", []),
    '{"queries":null}': ("empty", []),
    '{"queries":{"a":1}}': ("empty", []),
    '{"queries":["  "]}': ("ok", []),
    '{"queries":[1]}': ("ok", []),
    '{"queries":[1,"a",null,"  ",["b"],{"c":1},true]}': ("ok", ["a"]),
    '{"queries":["a"': ("empty", []),
    '{"queries":["a"],"queries":["b"]}': ("empty", []),
    '{"queries":["a", NaN]}': ("empty", []),
    "": ("empty", []),
    "no json": ("empty", []),
    '{"queries":["überü \\n x"]}': ("ok", ["überü \n x"]),
}


def test_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i INT, text STRING")
    got = {row.text: (row.status, row.queries) for row in r.parse_queries(df).collect()}
    assert got == TEXTS


def record(blocks, record_id="d"):
    return json.dumps({"recordId": record_id, "modelOutput": {"content": blocks}})


GOOD = {"type": "text", "text": '{"queries":["a"]}'}
RECORDS = [
    (record([GOOD]), "ok", ["a"]),
    (record([{"type": "text", "text": ""}, GOOD]), "empty", []),       # only the first text block counts
    (record([{"type": "tool", "text": "x"}, GOOD]), "ok", ["a"]),
    (record([]), "empty", []),
    (record(None), "empty", []),
    (json.dumps({"recordId": "d"}), "empty", []),
    (json.dumps({"recordId": "d", "modelOutput": None}), "empty", []),
    (record([{"type": "text", "text": 5}]), "empty", []),
    (record([{"type": "text", "text": {"queries": ["a"]}}]), "empty", []),
    ('{"recordId": "d"', "malformed", []),
    ("[1]", "malformed", []),
    (record([GOOD]) + " x", "malformed", []),
]


def test_records(spark):
    raw = spark.createDataFrame([(i, x[0]) for i, x in enumerate(RECORDS)], "line_id LONG, value STRING")
    got = {x.line_id: (x.status, x.queries) for x in r.parse_responses(raw).collect()}
    assert got == {i: (x[1], x[2]) for i, x in enumerate(RECORDS)}


def test_pairs_and_counts(spark):
    corpus = spark.createDataFrame([(0, "x", "t0"), (1, "d", "t1"), (2, "x", "t2"), (3, "7", "t3")],
                                   "doc_idx LONG, doc_id STRING, text STRING")
    two = {"type": "text", "text": '["q1","q2"]'}
    lines = [
        record([two], "x"),                              # the last position of a repeated id
        record([GOOD], 7),                               # numbers and texts are the same id
        record([two], "unknown"),                        # neither pair nor error
        record([{"type": "text", "text": ""}], "unknown"),
        record([{"type": "text", "text": "?"}], "d"),    # error
        record([{"type": "text", "text": "[1]"}], "d"),  # no error
        "{",                                             # error
        json.dumps({"modelOutput": {}}),                 # no id: neither
        record([two], "x"),                              # not de-duplicated
    ]
    raw = spark.createDataFrame(list(enumerate(lines)), "line_id LONG, value STRING")
    pairs, counts = r.query_doc_pairs(raw, corpus)
    assert sorted(map(tuple, pairs.collect())) == [
        ("0:0", "q1", "x", 2), ("0:1", "q2", "x", 2), ("1:0", "a", "7", 3),
        ("8:0", "q1", "x", 2), ("8:1", "q2", "x", 2)]
    assert tuple(counts.first()) == (9, 5, 5, 2)
    assert {x.line_id for x in r.unknown_ids(r.read_records(raw), corpus).collect()} == {2, 3, 6, 7}


@pytest.mark.parametrize("text, want", [
    ("```json\nx\n```", "x"), ("  ```\nx```  ", "x"), ("```x y```", " y"), ("x```", "x```"), (" x ", "x"),
])
def test_fence(spark, text, want):
    assert spark.range(1).select(r.strip_fence(F.lit(text)).alias("t")).first().t == want
