"""Lagged correlation by FFT, against the join and against one lag at a time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyscene.operators import align


def one_by_one(a, b, lags):
    """a, b: dicts of index to value."""
    out = {}
    for lag in range(-lags, lags + 1):
        both = sorted(set(a) & {i - lag for i in b})
        x, y = np.array([a[i] for i in both]), np.array([b[i + lag] for i in both])
        if len(both) >= 3 and x.std() >= align.FLAT and y.std() >= align.FLAT:
            out[lag] = len(both), float(((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std()))
    return out


def trace(rng, n, start=0, gaps=0.0):
    x = np.cumsum(rng.normal(size=n)) + 40
    return {start + i: float(v) for i, v in enumerate(x) if rng.random() >= gaps or i in (0, n - 1)}


def same(got, want):
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def split(t):
    return np.array(sorted(t)), np.array([t[k] for k in sorted(t)])


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_equals_one_lag_at_a_time(gaps):
    rng = np.random.default_rng(5)
    for n, m, start in ((200, 180, 0), (90, 300, 25), (300, 40, -60), (5, 7, 2), (3, 3, 0), (2, 9, 0), (1, 1, 0), (50, 50, 400)):
        a, b = trace(rng, n, 0, gaps), trace(rng, m, start, gaps)
        lag, count, c = align.correlated(split(a), split(b), 120)
        same({int(k): (int(x), y) for k, x, y in zip(lag, count, c, strict=True)}, one_by_one(a, b, 120))


def test_flat_stretches():
    a = {i: 5.0 if i < 150 else float(i % 7) for i in range(200)}
    b = {i: float((i * 3) % 5) if i < 40 else 9.0 for i in range(200)}
    lag, count, c = align.correlated(split(a), split(b), 190)
    same({int(k): (int(x), y) for k, x, y in zip(lag, count, c, strict=True)}, one_by_one(a, b, 190))


def test_native_frame_rates():
    rng = np.random.default_rng(7)
    x = rng.normal(size=100_000)
    idx = np.arange(100_000)
    began = time.process_time()
    lag, _, c = align.correlated((idx, x), (idx + 137, x + 0.1 * rng.normal(size=100_000)), 450)
    assert time.process_time() - began < 2 and lag[np.argmax(c)] == 137 and len(lag) == 901


def test_equals_the_join(spark):
    rng = np.random.default_rng(9)
    rows = [("s", "d", None, i, v) for i, v in trace(rng, 300).items()] + [("t", "d", None, i, v) for i, v in trace(rng, 200, 3, 0.1).items()]
    ref = spark.createDataFrame([(s, d, i, v) for s, d, _, i, v in rows], "sample string, side string, idx int, value double")
    made = [(s, "d", m, i, v) for s in "stu" for m in ("ir", "event") for i, v in trace(rng, 250, -5, 0.1 if m == "ir" else 0).items()]
    targets = spark.createDataFrame(made, "sample string, side string, modality string, idx int, value double").repartition(5)
    key = ["sample", "side", "modality"]
    as_map = lambda df: {(r["sample"], r["modality"], r["lag"]): (r["n"], r["correlation"]) for r in df.collect()}
    want = as_map(align.lag_correlations(ref, targets, key, 60))
    same(as_map(align.frame_lags(ref, targets, key, 60)), want)
    assert {k[0] for k in want} == {"s", "t"}
    assert align.frame_lags(ref.limit(0), targets, key, 9).count() == 0
    null = targets.limit(9).withColumn("value", F.lit(None).cast("double"))
    assert align.frame_lags(ref, null, key, 9).count() == 0
