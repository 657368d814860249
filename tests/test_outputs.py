"""Spans written as JSON by a model, and injected models."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import bio, detect

SPAN = {"start": 0, "end": 4, "entity_type": "PERSON"}


@pytest.mark.parametrize(
    ("output", "error"),
    [
        (json.dumps({"spans": [SPAN]}), None), ('{"spans":[]}', None), ("nope", "not JSON"), ("[1]", "no JSON object"), (json.dumps({"spans": [], "x": 1}), "the one key"),
        ('{"spans":"x"}', "JSON list"), ('{"spans":{}}', "JSON list"), ('{"spans":[1]}', "stands for"), (json.dumps({"spans": [{**SPAN, "score": 1}]}), "other keys"),
        (json.dumps({"spans": [{**SPAN, "start": True}]}), "integer"), (json.dumps({"spans": [{**SPAN, "start": 0.0}]}), "integer"), (json.dumps({"spans": [{**SPAN, "end": 99}]}), "offsets lie"),
        (json.dumps({"spans": [{**SPAN, "entity_type": " "}]}), "blank"), (json.dumps({"spans": [{**SPAN, "entity_type": "A "}]}), "white space"), (json.dumps({"spans": [{**SPAN, "entity_type": 1}]}), "blank"),
        (json.dumps({"spans": [{**SPAN, "start": 2}, {**SPAN, "end": 1}]}), "before its"), (json.dumps({"spans": [SPAN, {**SPAN, "start": 3, "end": 6}]}), "inside its"), (None, "not JSON"),
    ],
)
def test_object_output(one, output, error):
    spans, e = one(("John Smith", output), "text string, output string", detect.parse_object_output(F.col("text"), F.col("output")))
    if error is None:
        assert e is None and len(spans) == len(json.loads(output)["spans"])
    else:
        assert spans is None and error in e


def test_object_output_types(one):
    row = ("John Smith", json.dumps({"spans": [SPAN]}))
    assert "asked for" in one(row, "text string, output string", detect.parse_object_output(F.col("text"), F.col("output"), {"EMAIL"}))[1]


def test_list_output(spark):
    rows = [(1, "John", '[{"start":0,"end":4,"entity_type":"PERSON","score":0.5,"more":1}]'), (2, "John", "{}"), (3, "John", '[{"start":0,"end":9,"entity_type":"P"}]'), (4, "John", None)]
    got = {r.id: r for r in detect.parse_list_output(spark.createDataFrame(rows, "id int, text string, output string"), "text", "output").collect()}
    assert tuple(got[1].spans[0]) == (0, 4, "PERSON", 0.5) and got[2].error and "ends past" in got[3].error and got[4].spans is None
    rate = detect.failure_rate(detect.parse_list_output(spark.createDataFrame(rows, "id int, text string, output string"), "text", "output")).first()
    assert (rate.examples, rate.failures, rate.failure_rate) == (4, 3, 0.75)


def test_injected_model(spark):
    load = lambda: lambda t: [(0, len(t), "US_SSN", 0.5), (0, 1, "ODD")] if t else []
    df = spark.createDataFrame([("abc",), ("abc",), (None,), ("",)], "text string")
    run = detect.detector("analyzer", load=load)
    got = df.select("text", run(F.col("text")).alias("s")).collect()
    assert [tuple(s) for s in got[0].s] == [(0, 1, "ODD", None), (0, 3, "SOCIAL_SECURITY_NUMBER", 0.5)] and got[2].s is None and got[3].s == []
    cached = detect.cached_predictions(df, "text", load).collect()
    assert len(cached) == 4
    with pytest.raises(ValueError):
        detect.detector("none")
    with pytest.raises(ValueError):
        detect.detector("regex", merge_person=True)


def test_generator(spark):
    def load():
        return lambda messages: '{"spans":[{"start":0,"end":4,"entity_type":"PERSON"}]}' if messages[1]["content"].startswith("John") else "Sorry."

    df = spark.createDataFrame([("John Smith",), ("Smith",), (None,)], "text string").withColumn("r", detect.generated_spans(F.col("text"), load))
    got = {r.text: r.r for r in df.collect()}
    assert [tuple(s) for s in got["John Smith"].spans] == [(0, 4, "PERSON", None)] and got["Smith"].error == "not JSON" and got[None].spans is None
    assert df.select(detect.detector("generator", load=load)(F.col("text")).alias("s")).filter("s is null").count() == 2


def pairs():
    """A model of two letters a token, where words in capitals are P; nested so that workers need no test module."""
    def load():
        from spanloom.operators.bio import TokenModel

        def tokenize(words):
            rows = [(ord(w[k]), i, (k, min(k + 2, len(w)))) for i, w in enumerate(words) for k in range(0, len(w), 2)]
            return [1, *(r[0] for r in rows), 2], [None, *(r[1] for r in rows), None], [(0, 0), *(r[2] for r in rows), (0, 0)]

        return TokenModel(tokenize, lambda ids: [("I-P" if 65 <= i <= 90 else "O", 0.5 + k / 100) for k, i in enumerate(ids)])

    return load


def test_windowed_inference(spark):
    text = "aa BBBB cc DDDDDD ee " * 6
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "A")], "id int, text string")
    got = {r.id: r.s for r in df.select("id", detect.detector("windows", load=pairs(), max_length=9, overlap=3)(F.col("text")).alias("s")).collect()}
    assert got[2] is None and got[3] == [] and [tuple(s)[:3] for s in got[4]] == [(0, 1, "P")]
    whole = {r.id: r.s for r in df.select("id", detect.detector("windows", load=pairs())(F.col("text")).alias("s")).collect()}
    assert [tuple(s)[:3] for s in whole[1]] == [(m.start(), m.end(), "P") for m in re.finditer("[A-Z]+", text)]
    covered = {i for s in got[1] for i in range(s.start, s.end)}  # a name cut by a window may come in part, none is lost
    assert all(covered & set(range(s.start, s.end)) for s in whole[1]) and covered <= {i for i, c in enumerate(text) if c.isupper()}
    none = df.select(detect.detector("windows", load=pairs(), entities={"Q"})(F.col("text")).alias("s")).filter("size(s) > 0")
    assert none.count() == 0
    assert bio.token_windows(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and bio.token_windows(0, 4, 1) == [] and bio.token_windows(3, 4, 1) == [(0, 3)]


@pytest.mark.parametrize("row", [([0, 5], [(0, 1), (0, 1)]), ([0], [(0, 1), (0, 1)]), ([0], [(0, 9)]), ([0], [(2, 1)]), ([-1], [(0, 1)])])
def test_offsets_that_do_not_fit_are_errors(one, row):
    schema = "w array<struct<word:string,start:int,end:int>>, i array<int>, l array<struct<start:int,end:int>>"
    offsets = bio.global_offsets(F.col("w"), F.col("i"), F.col("l"))
    assert one(([("abc", 4, 7)], [None, 0], [(0, 0), (1, 3)]), schema, offsets) == [(0, 0), (5, 7)]
    with pytest.raises(Exception, match="token"):
        one(([("abc", 4, 7)], *row), schema, offsets)
