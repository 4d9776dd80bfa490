"""Best matches from the inverted index, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyscene.functions import dims
from polyscene.operators import matching, support

KIND = "sample_id string, evidence_id long, modality string, category string, tokens array<string>"


def rows_of(sizes, seed=3, words=60):
    rng = random.Random(seed)
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            tokens = sorted({f"w{int(rng.paretovariate(0.7))}" if rng.random() < 0.8 else f"x{rng.randrange(words)}" for _ in range(rng.randint(0, 12))})
            out.append((s, len(out), rng.choice(dims.FUSION_ORDER), "counting", tokens))
    rng.shuffle(out)
    return out


def as_set(df):
    return {(r["evidence_id"], r["other_modality"]): (r["sample_id"], r["modality"], r["other_evidence_id"], round(r["score"], 12), round(r["lexical"], 12)) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"BLOCK": 16, "STRIPE": 5, "PAIRS": 50, "WIDE": 7}, {"TOKENS": 40}])
def test_equals_all_pairs(spark, how, monkeypatch):
    for k, v in how.items():
        monkeypatch.setattr(matching, k, v)
    df = spark.createDataFrame(rows_of({"a": 70, "b": 40, "c": 1, "d": 20}), KIND).repartition(5)
    assert as_set(matching.best_pairs(df)) == as_set(support.best_match(support.pairs(df)))


def test_support_is_the_same(spark):
    df = spark.createDataFrame(rows_of({"a": 30, "b": 12}, 5), KIND)
    both = [sorted(map(str, support.support(df, p).collect())) for p in (matching.best_pairs(df), support.pairs(df))]
    assert both[0] == both[1]


def test_counts_by_matrices_and_one_by_one():
    rng = np.random.default_rng(1)
    a, b = rng.random((40, 300)) < 0.05, rng.random((30, 300)) < 0.05
    a[:, :5] = b[:, :5] = True
    index = lambda x: (np.nonzero(x.T)[1], np.nonzero(x.T)[0])
    got = matching.shared(index(a), index(b), 40, 30)
    assert (got == a.astype(int) @ b.T.astype(int)).all()


def test_ties_nulls_copies_and_nothing(spark):
    rows = [("s", 5, "rgb", "x", ["a"]), ("s", 3, "ir", "x", ["a"]), ("s", 4, "ir", "x", ["a"]), ("s", 9, None, "x", ["a"]), (None, 1, "ir", "x", ["a"]), ("s", 2, "audio", "x", None), ("s", 8, "depth", "x", []), ("s", 5, "rgb", "x", ["a"])]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as score", "2 as other_modality", "3 as _block")
    assert {k: v[2] for k, v in as_set(matching.best_pairs(df)).items()} == {(5, "ir"): 3, (3, "rgb"): 5, (4, "rgb"): 5}
    assert matching.best_pairs(df.limit(0)).collect() == []


def test_one_sample_with_most_rows(spark):
    """Blocks bound what a group holds; ids of other types work too."""
    n = 9000
    df = spark.range(n).select(F.lit("s").alias("sample_id"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("evidence_id"), F.element_at(F.array(*map(F.lit, ["rgb", "ir"])), (F.col("id") % 2 + 1).cast("int")).alias("modality"), F.array(F.lit("common"), F.concat(F.lit("p"), F.floor(F.col("id") / 2).cast("string"))).alias("tokens"))
    got = matching.best_pairs(df)
    assert got.count() == n and got.filter("score = 1 and abs(int(substr(evidence_id, 2)) - int(substr(other_evidence_id, 2))) = 1").count() == n
