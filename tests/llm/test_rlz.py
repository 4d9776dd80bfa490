import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from polyscene.llm import rlz


def brute(texts, ids=None):
    ids = ids or list(range(len(texts)))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in sorted(zip(ids, words, strict=True), key=lambda x: x[0]):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def texts(messy):
    """Shared passages cut at every place, few different words, and repeats within a text."""
    rng = random.Random(9)
    base = [f"k{rng.randint(0, 400)}" for _ in range(120)]
    more = []
    for _ in range(60):
        a, n = rng.randint(0, 100), rng.randint(8, 40)
        more.append(" ".join([f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 15))] + base[a : a + n] + [f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 15))]))
    more += [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(6)] + ["x " * 50, "x " * 30]
    return messy + more


@pytest.mark.parametrize("held", [1 << 19, 50])
def test_matches_brute_force(make, texts, monkeypatch, held):
    monkeypatch.setattr(rlz, "HELD", held)
    docs = make(texts).withColumn("doc", F.lit("x")).repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz.substring_dedup(docs).collect())
    assert got == brute(texts)


def test_repeated_and_null_ids(spark, empty):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(5, passage), (5, passage), (5, "other " + passage), (None, passage + " end"), (9, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in rlz.substring_dedup(docs).collect())
    assert got == [(5, 20, 0), (5, 20, 0), (5, 21, 0), (9, 20, 20), (99, 21, 20)]
    assert rlz.substring_dedup(empty).count() == 0


def test_real_output(make):
    passage = " ".join(f"p{i}" for i in range(20))
    got = {r["doc_id"]: (r["kept_text"], r["n_factors"]) for r in rlz.parsed(make([passage, "a  " + passage + "\nb"]), real=True).collect()}
    assert got == {0: (passage, 0), 1: ("a b", 1)}
