from itertools import permutations

import pytest

from polyscene.llm import audit

NAMES = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(docs, labels):
    """docs: doc_id, text, lang; labels: doc_id to (good, toxic)."""
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        first = min((j for j, u, _ in docs if (u or "") == t and j is not None), default=None)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first is not None and i > first}
        fails.append((lang or "", {k for k, v in own.items() if v}, labels.get(i, (False, False))))
    out, shapley = {}, {}
    for part in {p for p, _, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                every = [f for f in fails if f[0] == part and letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(f[1] == {letter} for f in every), sum(f[2][0] for f in gone), sum(f[2][1] for f in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in df.collect()}


@pytest.fixture
def rows(messy):
    long_ = " ".join(f"w{i}" for i in range(120))
    texts = [*messy[-30:], long_, long_, long_ + " #", long_.upper(), "same " * 150, long_, "x\x0by\x0cz\x85q\xa0r", None, None]
    return [(i if i != 7 else None, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)]


def test_equals_counting_by_hand(spark, rows):
    labels = [(i, q, x) for i, q, x in [(1, 1, 0), (2, 1, 1), (30, 1, 1), (31, 1, None), (32, 0, 1), (32, 1, 0), (35, None, 1), (None, 1, 1), (999, 1, 1)]]
    said = {1: (True, False), 2: (True, True), 30: (True, True), 31: (True, False), 32: (True, True), 35: (False, True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "2 as part", "3 as good", "'n' as digest")
    got = found(audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute(rows, said) and len(got) == 600 * 3


def test_repeated_ids_and_no_labels(spark):
    docs = [(4, "same text", "en")] * 3 + [(6, "same text", "de")] * 2 + [(None, "same text", "en")]
    got = found(audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["en", "EABCD", 1][:2] == [4, 0] and got["de", "EABCD", 1][:2] == [0, 2]
    assert got == brute(docs, {})


def test_a_text_in_most_rows(spark):
    """One text in many parts and rows: all but one row are copies, wherever they are."""
    docs = [(i, "copy of one", ["en", "de", "fr"][i % 3]) for i in range(3000)] + [(5000 + i, f"own {i}", "en") for i in range(50)]
    got = found(audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(8), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert [got[p, "EABCD", 1][1] for p in ("en", "de", "fr")] == [999, 1000, 1000]


def test_nothing(spark, empty):
    assert audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_no_python_runs(spark, make, messy):
    plan = audit.audit(make(messy), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))
