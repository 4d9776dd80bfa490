"""Typed fields and leaves of values of unknown shape."""

import json

from pyspark.sql import functions as F

from polyscene.functions import variants
from polyscene.operators import resume

RAW = ['{"caption": "said", "x": {"y": [1, {"z": "deep"}]}}', '{"caption": 5}', '{"caption": ["a"], "q": null}', '{"caption": {"a": " "}}', '"alone"', "[[[[[7]]]]]", "{}", "null", "not json", None, '{"caption": "' + resume.PLACEHOLDERS[0] + '", "more": ["' + resume.PLACEHOLDERS[2] + '"]}', '{"caption": "' + resume.PLACEHOLDERS[0] + '", "n": 3}', '{"a": true, "b": false}']


def rows(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw string")
    return df.withColumn("v", variants.parsed(F.col("raw")))


def walked(x):
    if isinstance(x, dict):
        return [y for v in x.values() for y in walked(v)]
    return [y for v in x for y in walked(v)] if isinstance(x, list) else [] if x is None else [x]


def test_fields_that_are_no_texts_are_blank(spark):
    got = {r["i"]: r["c"] for r in rows(spark).select("i", variants.text_field(F.col("v"), "$.caption").alias("c")).collect()}
    assert got == {i: "said" if i == 0 else resume.PLACEHOLDERS[0] if i in (10, 11) else "" for i in range(len(RAW))}
    one = rows(spark).filter("i = 0").select(variants.text_fields(F.col("v"), ["caption", "x", "none"]).alias("f")).first()["f"]
    assert one.asDict() == {"caption": "said", "x": "", "none": ""}


def test_leaves_of_any_depth(spark):
    got = {}
    for r in variants.leaves(rows(spark), ["i"], "v").collect():
        got.setdefault(r["i"], []).append((r["kind"] == "STRING", r["text"]))
    for i, raw in enumerate(RAW):
        try:
            want = walked(json.loads(raw)) if raw else []
        except ValueError:
            want = []
        assert sorted(got.get(i, [])) == sorted((isinstance(x, str), x if isinstance(x, str) else str(x).lower()) for x in want)
    assert {r["depth"] for r in variants.leaves(rows(spark).filter("i = 5"), ["i"], "v").collect()} == {5}


def test_completeness(spark):
    done = lambda **how: {r["i"] for r in variants.complete(rows(spark), ["i"], "v", resume.PLACEHOLDERS, **how).filter("complete").collect()}
    assert done() == {0, 1, 2, 4, 5, 12} and done(trial=True) == {0, 1, 2, 4, 5, 10, 11, 12}
    assert variants.complete(rows(spark).limit(0), ["i"], "v", []).count() == 0
