"""What a model's calls answer is stored before it is parsed."""

from pyspark.sql import functions as F

from polyscene.operators import models


def test_answers_leave_the_few_tasks_of_the_calls_as_stored_text(spark):
    rows = spark.createDataFrame([(k, f"r{k}") for k in range(30)], "k long, r string")
    got = models.asking(lambda r: '{"a": "%s"}' % r if r != "r7" else "no JSON", "k", F.col("r"), "map<string, string>", "made", 2, lambda _: None)(rows)
    assert "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    out = {r["k"]: r for r in got.collect()}
    assert len(out) == 30 and all(r["made"]["a"] == f"r{k}" and r["error"] is None and r["tries"] == 1 for k, r in out.items() if k != 7)
    assert out[7]["made"] is None and out[7]["error"]
