import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from polyscene.llm import toxicity


def case(make, spark, n=600):
    rng = random.Random(8)
    clean = [f"w{i}" for i in range(300)]
    texts, bad = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if i % 8 == 0:
            words[1:1] = [rng.choice(["Vile", "rotten", "gnarlfoo", "gnarlbar", "gnarlbaz"]) for _ in range(3)]
            bad.append(i)
        texts.append(" ".join(words))
    texts += ["", None, "vile rotten " * 4000]
    rows = [(i, 1, int(i in bad)) for i in range(n) if i % 2 == 0] + [(0, 1, 0), (2, None, None), (10**6, 0, 1)]
    return make(texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), bad, n


def test_held_out_rows_are_told_apart(make, spark):
    docs, labels, bad, n = case(make, spark)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs.withColumn("predicted", F.lit("x")), labels).collect()}
    test = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert np.mean([got[i]["predicted"] for i in test if i in bad]) >= 0.9
    assert np.mean([got[i]["predicted"] for i in test if i not in bad]) <= 0.05
    assert got[n]["score"] == got[n + 1]["score"] and got[n]["predicted"] == 0 and got[n + 2]["predicted"] == 1
    out = toxicity.clean(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_without_labels(make, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score_documents(make(["a", None]), none).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(empty, none).count() == 0
    orphan = spark.createDataFrame([(99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(make(["a"]), orphan).count() == 1


def cloud(n, share, rng):
    return [sorted(np.flatnonzero(rng.random(6) < share).tolist()) for _ in range(n)]


def dense(rows):
    x = np.zeros((len(rows), 7))
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, own] = 1
    return x


def test_risk_and_gradient_by_brute_force():
    rng = np.random.default_rng(2)
    p, u = cloud(40, 0.7, rng), cloud(200, 0.3, rng)
    w, x = rng.normal(size=7), dense(u)
    loss, grad = toxicity.unlabelled_risk(toxicity.Rows(u, 6), w)
    assert abs(loss - np.log1p(np.exp(x @ w)).sum()) < 1e-9 and np.allclose(grad, x.T @ (1 / (1 + np.exp(-x @ w))))
    prior, h = 0.2, 1e-6

    def risk(w):
        g, gp = x @ w, dense(p) @ w
        clean = np.log1p(np.exp(g)).mean() - prior * np.log1p(np.exp(gp)).mean()
        return prior * np.log1p(np.exp(-gp)).mean() + max(0.0, clean) + toxicity.RIDGE / 2 * (w[:-1] ** 2).sum()

    one = toxicity.Descent(toxicity.Rows(p, 6), prior)
    slope = np.array([(risk(one.w + h * e) - risk(one.w - h * e)) / (2 * h) for e in np.eye(7)])
    before = one.w.copy()
    loss, grad = toxicity.unlabelled_risk(toxicity.Rows(u, 6), one.w)
    one.step(loss / len(u), grad / len(u), 0.1)
    assert np.allclose(one.m, 0.1 * slope, atol=1e-6)
    fitted = toxicity.nnpu(toxicity.Rows(p, 6), toxicity.Rows(u, 6), prior)
    assert risk(fitted.w) < risk(before) and np.isfinite(fitted.w).all()
    assert (dense(p) @ fitted.w).mean() > (x @ fitted.w).mean()


def test_passes_use_every_row(spark):
    rng = np.random.default_rng(4)
    p, u = toxicity.Rows(cloud(30, 0.7, rng), 6), cloud(90, 0.3, rng)
    mine, theirs = toxicity.Descent(p, 0.3), toxicity.Descent(p, 0.3)
    toxicity.passed(spark.createDataFrame([(r,) for r in u], "own array<int>").repartition(3), mine)
    for _ in range(toxicity.PASSES):
        loss, grad = toxicity.unlabelled_risk(toxicity.Rows(u, 6), theirs.w)
        theirs.step(loss / 90, grad / 90, toxicity.SLOW)
    assert np.allclose(mine.w, theirs.w)


def test_features_are_counted_over_all_training_rows(spark):
    owned = spark.createDataFrame([([0, 1],), ([1],), ([],), ([1],)], "own array<int>").repartition(2)
    sums, n = toxicity.counted(owned, 3)
    assert sums.tolist() == [1, 3, 0] and n == 4
    assert toxicity.surely(np.array([20, 10, 3]), 30, np.array([100, 330, 0]), 1000).tolist() == [True, False, True]


def test_repeated_rows_ties_and_odd_columns(make, spark):
    docs, labels, bad, n = case(make, spark, 200)
    twice = docs.union(docs.filter("doc_id = 8")).withColumn("a.b", F.lit(1)).withColumn("own", F.lit(2))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score_documents(twice, labels).collect()]
    assert len(got) == docs.count() + 1 and len({s for i, s in got if i == 8}) == 1
    assert toxicity.clean(twice, labels).columns == twice.columns
