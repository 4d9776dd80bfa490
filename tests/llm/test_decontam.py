import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from polyscene.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, window=8):
    pats = {}
    for name, t in items:
        w = words(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            pats.setdefault(tuple(w[j : j + window]), set()).add(name)
    out = []
    for t in texts:
        w, found = words(t), set()
        hit = [False] * len(w)
        for p, names in pats.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit[j : j + len(p)] = [True] * len(p)
                    found |= {str(n) for n in names if n is not None}
        out.append((len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.fixture(scope="module")
def case(messy, spark):
    rng = random.Random(2)
    source = [t for t in messy if t and len(t.split()) > 30]
    items = [(i, " ".join(rng.choice(source).split()[k : k + n])) for i, (k, n) in enumerate((rng.randint(0, 9), rng.choice([1, 3, 8, 9, 20])) for _ in range(14))]
    items += [(5, items[5][1]), (20, items[4][1].upper()), (21, ""), (22, None), (None, items[3][1]), (23, "!!")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_matches_brute_force(case, messy, make, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items, bench = case
    got = decontam.scan(make(messy), bench, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    mine = [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got]
    assert mine == brute(messy, items)


def test_longest_match(make, spark):
    w = [f"w{i}" for i in range(40)]
    docs = make(["x " + " ".join(w[5:30]) + " y " + " ".join(w[10:19]), " ".join(w[:7])])
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = decontam.scan(docs, bench, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    assert [r["longest_match"] for r in got] == [25, 0]


def test_locations_and_longest_match_by_brute_force(case, messy, make):
    """Every maximal match is verbatim, and no longer one starts where it starts."""
    items, bench = case
    long = {str(i): words(t) for i, t in items if i is not None and t}
    got = decontam.scan(make(messy), bench, {"doc_id": F.col("doc_id")}, locate=True).orderBy("doc_id").collect()
    every = [words(t) for _, t in items if t]
    for r, t in zip(got, messy, strict=True):
        w, best = words(t), 0
        for i in range(len(w)):
            for x in every:
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    best = max(best, n if n >= 8 or n == len(x) else 0)
        assert r["longest_match"] == best == max((m["length"] for m in r["matches"]), default=0)
        for m in r["matches"]:
            if m["item"] in long:
                a, b = m["start"], m["item_start"]
                assert m["length"] >= 8 or w[a : a + m["length"]] in every
                assert any(w[a : a + m["length"]] == x[b : b + m["length"]] for x in every)


def test_a_window_of_many_items_and_documents(make, spark):
    shared = " ".join(f"t{i}" for i in range(8))
    bench = spark.createDataFrame([(i, f"u{i} {shared} v{i}") for i in range(300)], "item_id long, text string")
    got = decontam.scan(make([f"x{i} {shared} y{i}" for i in range(400)]), bench, {"doc_id": F.col("doc_id")}).collect()
    assert {(r["n_items"], r["n_hit"], r["longest_match"]) for r in got} == {(300, 8, 8)}


def test_suffix_array():
    import numpy as np

    rng = random.Random(1)
    flat = [rng.randint(0, 2) for _ in range(200)] + [-1] + [1] * 30
    assert decontam.suffixes(np.array(flat)).tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
    assert decontam.suffixes(np.zeros(0, np.int32)).tolist() == []


def test_filter_keeps_columns_and_clean_rows(make, spark, empty):
    a, b = " ".join(f"p{i}" for i in range(9)), " ".join(f"q{i}" for i in range(9))
    docs = make([a + " " + b, a, "clean", None]).withColumn("contaminated", F.lit("x")).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 4


def test_filter_drops_every_verbatim_match(make, spark):
    a, b = " ".join(f"p{i}" for i in range(20)), "q0 q1 q2"
    window, less = " ".join(f"p{i}" for i in range(6, 14)), " ".join(f"p{i}" for i in range(6, 13))
    docs = make([f"x {a} y", f"x {window} y", f"x {less} y", f"x {b} y", "x q0 q1 y", a + " " + b, None, f"z {less} z"])
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 4, 6, 7]
    unnamed = spark.createDataFrame([(None, a)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, unnamed).collect()) == [2, 3, 4, 6, 7]


def test_pipeline_stage_drops_a_document_with_one_item(make, spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"p{i}" for i in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontaminated(spark, make([f"before {item} after", "clean"]), str(tmp_path))
    assert [r["doc_id"] for r in out.collect()] == [1]
