import hashlib

import numpy as np
import pytest

from polyscene.llm import codes


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute(rows, parts, entries, rounds):
    """In Python's integers, a row at a time. rows: vec_id, vector, label."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = [[int(np.floor(1024 * v)) for v in r[1]] for r in rows]
    wide = len(x[0]) // parts
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[part(v, p) for v in x[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for v in x:
                own.setdefault(near(part(v, p), book)[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(book)]
    out, labels = [], {}
    for (i, _, label), v in zip(rows, x, strict=True):
        got = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
        labels[label] = labels.get(label, 0) + out[-1][3]
    said = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted((i, code, error, labels[label], said) for i, label, code, error in out)


def coded(df, **how):
    rows, books = codes.compress(df, **how)
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], codes.digest(books)) for r in codes.with_label_errors(rows).collect())


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_equals_single_rows(spark, scale, monkeypatch):
    """Integers of 32 bits, of 64 and beyond."""
    monkeypatch.setattr(codes, "BLOCK", 37)
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=8) * scale], int(i) % 3 if i % 4 else None) for i in rng.permutation(300)]
    want = [(i, c, e if e < 1 << 63 else None, s if s < 1 << 63 else None, d) for i, c, e, s, d in brute(rows, 4, 16, 3)]
    assert [(*g[:3], g[4]) for g in coded(table(spark, rows).repartition(5), entries=16, rounds=3)] == [(*w[:3], w[4]) for w in want]
    if scale < 1e9:
        assert coded(table(spark, rows).repartition(3), entries=16, rounds=3) == want


def test_dealing_and_merging_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-3, 3, 8) / 1024], i % 2) for i in range(200)]  # many ties
    want = coded(table(spark, rows).repartition(1), entries=32)
    monkeypatch.setattr(codes, "FAN", 2)
    assert coded(table(spark, rows).repartition(17), entries=32) == want == brute(rows, 4, 32, codes.ROUNDS)


def test_unusable_rows_copies_and_clashing_columns(spark):
    good = [(i, [i / 8, -i / 8, 1.0, 0.0], None if i % 2 else 5) for i in range(6)]
    bad = [(50, None, 5), (51, [], 5), (52, [1.0, None, 1.0, 1.0], 5), (53, [1.0, float("nan"), 1.0, 1.0], 5), (54, [1.0, float("-inf"), 1.0, 1.0], 5), (55, [1.0, 2.0], 5)]
    df = table(spark, good + good[:2] + bad).selectExpr("*", "'x' as ids", "1 as body", "2 as error", "3 as code")
    got = coded(df)
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 3, 4, 5] and got == brute(good + good[:2], 4, 256, codes.ROUNDS)
    assert all(g[2] == 0 for g in got)


def test_lengths_that_do_not_divide_and_null_ids(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (3, [1.5, 2.0, 3.0, 4.0, 5.0, 6.0], 1)]
    frame, books = codes.compress(table(spark, rows), entries=1)
    assert [b.shape[1] for b in books] == [2, 2, 1, 1] and {r["code"] for r in frame.collect()} == {"00000000"}
    _, first = codes.compress(table(spark, rows), entries=1, rounds=0)
    assert first[0][0][0] == 1536  # null ids come last


def test_nothing(spark):
    for rows in ([], [(1, None, 1)]):
        out = codes.compress_embeddings(table(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    with pytest.raises(ValueError, match="two hex digits"):
        codes.compress(table(spark, []), entries=257)
