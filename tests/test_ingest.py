from __future__ import annotations

import json

import pytest

from marginalia.operators.ingest import diagnose, split_load

OPTIONS = {"a": ["x", "y z"], "b": ["é", "q"]}
SETS = {k: frozenset(v) for k, v in OPTIONS.items()}
DEEP = '{"a": ' + "[" * 200_000 + "]" * 200_000 + ', "b": "q"}'

CASES = [
    ('{"a": "x", "b": "q"}', None),
    ('  \n```json\n{"b":"\\u00e9","a":"y z"}\n``` ', None),
    ('```{"a":"x","b":"q"}```', None),
    ("``````", "syntax"),
    ('```json{"a":"x","b":"q"}', "syntax"),
    ('```\n```{"a":"x","b":"q"}```\n```', "syntax"),
    (None, "syntax"),
    ("", "syntax"),
    ("   ", "syntax"),
    ('{"a":"x","b":"q",}', "syntax"),
    ('{"a":"x","b":"q"} {}', "syntax"),
    ('[{"a":"x","b":"q"}]', "syntax"),
    ('{"a":"x","b":NaN}', "syntax"),
    ('{"a":"x\n","b":"q"}', "syntax"),
    ("{'a':'x','b':'q'}", "syntax"),
    ('﻿{"a":"x","b":"q"}', "syntax"),
    ("{}", "columns"),
    ('{"a":"x"}', "columns"),
    ('{"a":"x","a":"x"}', "columns"),
    ('{"a":"x","b":"q","b":"q"}', "columns"),
    ('{"a":"x","c":{"b":"q"}}', "columns"),
    ('{"a":"X","b":"q"}', "values"),
    ('{"a":["x"],"b":"q"}', "values"),
    ('{"a":null,"b":"q"}', "values"),
    ('{"a":"x ","b":"q"}', "values"),
    ('{"a":"x","b":' + "9" * 6000 + "}", "values"),
    (DEEP, "values"),
    (DEEP[:-1], "syntax"),
    (DEEP.replace('"b"', '"c"'), "columns"),
    (json.dumps({"a": "x" * 300_000, "b": "q"}), "values"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_reason(k):
    assert diagnose(CASES[k][0], SETS) == CASES[k][1]


def test_split_equals_brute_force(spark):
    rows = [(i, t, "extra") for i, (t, _) in enumerate(CASES)] * 2
    rows += [(None, CASES[0][0], ""), (None, "bad", ""), (None, "bad", ""), (None, "{}", "")]
    raw = spark.createDataFrame(rows, "row_id long, generated_text string, reason string")
    loaded, failed = split_load(raw, "row_id", "generated_text", OPTIONS)
    got = {r.row_id: r.reason for r in failed.collect() if r.row_id is not None}
    assert got == {i: r for i, (_, r) in enumerate(CASES) if r}
    assert sorted(r.reason for r in failed.collect() if r.row_id is None) == ["columns", "syntax"]
    assert sorted((r.row_id is None, r.a, r.b) for r in loaded.collect()) == [(False, "x", "q"), (False, "x", "q"), (False, "y z", "é"), (True, "x", "q")]


def test_empty(spark):
    loaded, failed = split_load(spark.createDataFrame([], "k long, t string"), "k", "t", OPTIONS)
    assert loaded.columns == ["k", "a", "b"] and loaded.count() == 0 and failed.count() == 0


def test_no_record_is_lost_to_escapes(spark):
    from marginalia.operators import ingest

    long = "x" * 401
    options = {"a": [long, "y"], "b": ["q"]}
    escaped = "".join(f"\\u{ord(c):04x}" for c in long)
    rows = [(1, f'{{"a":"{escaped}","b":"q"}}'), (2, '{"a":"' + "\\u0079" + '","b":"\\u0071"}'), (3, f'{{"a":"{escaped}\\u0078","b":"q"}}')]
    df = spark.createDataFrame(rows, "row_id long, generated_text string")
    loaded, failed = split_load(df, "row_id", "generated_text", options)
    assert failed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.row_id: r.a for r in loaded.collect()} == {1: long, 2: "y"} and [tuple(r) for r in failed.collect()] == [(3, "values")]
    assert ingest.flat_object_pattern(2, 7).count("{0,7}") == 4


def test_a_row_the_strict_load_leaves_over_is_loaded(spark, monkeypatch):
    from marginalia.operators import ingest

    monkeypatch.setattr(ingest, "flat_object_pattern", lambda n, escapes: "^never$")
    df = spark.createDataFrame([(1, '{"a":"x","b":"q"}'), (2, "{}")], "row_id long, generated_text string")
    loaded, failed = split_load(df, "row_id", "generated_text", OPTIONS)
    assert [tuple(r) for r in loaded.collect()] == [(1, "x", "q")] and [tuple(r) for r in failed.collect()] == [(2, "columns")]
