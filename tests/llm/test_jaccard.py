"""The near-duplicate stage against brute force over five-word shingles."""

import random

import pytest

from polyscene.llm import jaccard, simhash


def words_of(t):
    return (t or "").lower().split()


def sets_of(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    own, root = [sets_of(t) for t in texts], list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(own)):
        for i in range(j):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    return {i: up(i) for i in range(len(own))}


def near_copies():
    """Copies at 0.7 to 0.99, chains of edits, a hot group of near copies, and a line that many texts share."""
    rng = random.Random(8)
    prose = lambda n: [f"{rng.choice('bcdfgh')}{rng.randint(0, 9999)}" for _ in range(n)]
    texts, line = [], prose(40)
    for k in range(40):
        base = prose(120)
        texts.append(base)
        texts.append([x if i >= 1 + k % 20 else "new" + x for i, x in enumerate(base)])
    chain = prose(100)
    for k in range(30):
        chain = list(chain)
        chain[rng.randrange(100)] = f"c{k}"
        texts.append(chain)
    hot = prose(90)
    for k in range(60):
        copy = list(hot)
        copy[rng.randrange(90)] = f"h{k}"
        texts.append(copy)
    texts += [line + prose(rng.randint(3, 30)) for _ in range(40)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts] + [None, "", "one two", "One two", "one two three"]


@pytest.mark.parametrize("common, block, bitmap", [(3, 2048, 26), (1 << 30, 7, 6)])
def test_components_match_brute_force(make, monkeypatch, common, block, bitmap):
    """Also with groups cut into small blocks and a bitmap that all ids share."""
    for k, v in (("COMMON", common), ("BLOCK", block), ("BITMAP", bitmap)):
        monkeypatch.setattr(jaccard, k, v)
    if block < 10:
        monkeypatch.setattr(simhash, "HOT_FLOOR", 3)
    texts = near_copies()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(make(texts)).collect()}
    assert got == brute(texts)


def test_stage_drops_near_copies_beyond_four_bits(make):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    copy = [x if i % 67 or not i else f"n{i}" for i, x in enumerate(base)]  # two of 200 words differ: 186 of 206 shingles
    far = [x if i % 20 else f"f{i}" for i, x in enumerate(base)]
    texts = [" ".join(x) for x in (base, copy, far)]
    assert sorted(r["doc_id"] for r in simhash.deduplicate(make(texts)).collect()) == [0, 2]


def test_repeated_ids_do_not_hide_links(spark):
    base = [f"w{i}" for i in range(60)]
    a, b = " ".join(base), " ".join(["x", *base[1:]])
    rows = [(1, "some other words of no account"), (1, a), (2, b), (3, "words"), (None, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard.classes(docs).collect()) == [(0, 3), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_groups_reach_python_row_by_row(spark, make, monkeypatch):
    """No lists of members are built, and groups that stand in several Arrow batches stay whole."""
    plans, inner = [], jaccard.every
    monkeypatch.setattr(jaccard, "every", lambda *a: plans.append(inner(*a)) or plans[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        texts = near_copies()
        got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(make(texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(texts)
    assert len(plans) == 2 and not any("collect_list" in p._jdf.queryExecution().toString() for p in plans)


def test_links_are_followed_once(make, monkeypatch):
    """Components of all links are built in one go; links of later steps only extend them."""
    asked = []

    def counted(nodes, edges, own=simhash.components):
        asked.append({frozenset(r) for r in edges.select("a", "b").collect()})
        return own(nodes, edges)

    monkeypatch.setattr(jaccard, "components", counted)
    monkeypatch.setattr(simhash, "components", counted)
    texts = near_copies()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(make(texts)).collect()}
    assert got == brute(texts)
    assert len(asked) <= 3 and all(not (a & b) for i, a in enumerate(asked) for b in asked[:i])
