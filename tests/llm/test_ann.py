import numpy as np
import pytest

from polyscene.llm import ann


def table(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(x, ids, q, k):
    s = x @ x[q]
    order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
    return [(v, -f) for f, v in order[:k]]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_recall_scores_and_order(spark, cloud, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 40)
    got = {}
    for r in ann.search(table(spark, cloud)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    x, hits = cloud.astype(float), 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, rows in got.items():
        assert [r[2] for r in rows] == list(range(1, 21)) and q not in [r[0] for r in rows]
        assert all(r[1] == pytest.approx(float(x[q] @ x[r[0]]), abs=1e-12) for r in rows)
        assert [r[:1] for r in rows] == [r[:1] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
        hits += len({r[0] for r in rows} & {v for v, _ in brute(x, range(1500), q, 20)})
    assert hits >= 0.9 * 20 * len(got)


def test_dense_groups_are_found_whole(spark, monkeypatch):
    """A third of the vectors nearly share one code; a block's first reranking holds few of them."""
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0] + 0.003 * rng.normal(size=(300, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    got = {}
    for r in ann.search(table(spark, x).selectExpr("*", "1 as id", "2 as vec"), rerank=24).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    plain = x.astype(float)
    assert all(got[q] == {v for v, _ in brute(plain, range(900), q, 20)} for q in range(0, 900, 20))


def test_copies_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(60)] + [(100, [0.5, 0.5], 0), (100, [0.5, 0.5], 0), (120, None, 0), (140, [0.0, 0.0], 0), (160, [float("nan"), 1.0], 0), (180, [1.0, None], 0), (200, [1.0], 0), (None, [1.0, 1.0], 0)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 40, 100]
    assert got[0] == [(i, 1.0) for i in range(1, 21)] and got[20] == [(i, 1.0) for i in range(20)]
    assert got[100] == [(i, 0.5) for i in range(20)]


def test_few_and_none(spark):
    assert len(ann.search(table(spark, np.eye(3, dtype=np.float32), [0, 1, 2])).collect()) == 2
    assert ann.search(table(spark, np.zeros((0, 3)))).count() == 0
    assert ann.search(table(spark, np.eye(1, dtype=np.float32), [20])).count() == 0


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    q = ann.Quantiser.fit(x)
    codes = q.encode(x)
    back = q.centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :64]
    rest, unit = x - back, x / np.linalg.norm(x, axis=1)[:, None]
    parallel = (rest * unit).sum(1) ** 2
    plain = ((q.halves(x)[:, :, None] - q.centres[None]) ** 2).sum(-1).argmin(-1)
    other = x - q.centres[np.arange(plain.shape[1]), plain].reshape(len(x), -1)[:, :64]
    assert ann.loss_ratio(64) > 1 and parallel.mean() < ((other * unit).sum(1) ** 2).mean()
