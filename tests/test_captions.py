"""Captions from evidence that meets once a sample."""

import random

from pyspark.sql import functions as F

from polyscene.functions import dims
from polyscene.operators import narrative, selection

KIND = "sample_id long, evidence_id long, modality string, category string, tokens array<string>, reliability double, support_score double, sentence string"


def some(spark):
    rng, rows = random.Random(4), []
    words = [w for own in dims.ROUTE_KEYWORDS.values() for w in own][:12] + list("abcdefgh")
    for k in range(120):
        said = sorted(set(rng.choices(words, k=rng.randint(0, 6))))
        rows.append((k // 20 if k else None, k, dims.FUSION_ORDER[k % 5], dims.CATEGORY_NAMES[k % 33], said, rng.choice([0.2, 0.8]), rng.choice([0.0, 0.3]), f"Row {k}.. "))
    return spark.createDataFrame(rows, KIND)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_details_need_one_grouping_and_no_join(spark):
    plan = plan_of(narrative.cross_modal_details(some(spark)))
    assert "Join" not in plan and plan.count("Aggregate [") == 1
    got = {r["sample_id"]: r["details"] for r in narrative.cross_modal_details(some(spark)).collect()}
    assert set(got) == {None, *range(6)} and got[None] == ""


def test_captions_need_one_grouping_and_no_join(spark):
    plan = plan_of(narrative.section_captions(some(spark)))
    assert "Join" not in plan and plan.count("Aggregate [") == 1
    rows = {r["sample_id"]: r for r in narrative.section_captions(some(spark)).collect()}
    assert {k: r["cross_modal_details"] for k, r in rows.items()} == {r["sample_id"]: r["details"] for r in narrative.cross_modal_details(some(spark)).collect()}
    assert set(rows) == {None, *range(6)} and not any(rows[None][1:])


def alike(a, b, above):
    both = len(set(a) & set(b))
    return bool(a and b) and both / (len(a) + len(b) - both) > above


def greedy(rows, above):
    kept = []
    for x in rows:
        if not any(alike(x[1], k[1], above) for k in kept):
            kept.append(x)
    return kept


def test_folds_that_end_early_keep_what_whole_ones_do(spark):
    rng = random.Random(9)
    lists = [[(i, sorted(set(rng.choices(range(12), k=rng.randint(0, 12))))) for i in range(rng.randint(0, 25))] for _ in range(80)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<struct<id: int, tokens: array<int>>>")
    even = lambda s: s["id"] % 4 == 3
    ids = lambda c: F.transform(c, lambda s: s["id"])
    out = df.select("k", ids(selection.distinct_greedy(F.col("x"), 0.5, 2, even)).alias("a"), ids(selection.distinct_twice(F.col("x"), 0.6, 0.4, 3)).alias("b"), ids(selection.distinct_greedy(F.col("x"), 0.5)).alias("c"))
    for r in out.collect():
        once = greedy(lists[r["k"]], 0.5)
        assert r["c"] == [i for i, _ in once]
        assert r["a"] == ([i for i, _ in once if i % 4 == 3] or [i for i, _ in once])[:2]
        assert r["b"] == [i for i, _ in greedy(greedy(lists[r["k"]], 0.6), 0.4)][:3]
