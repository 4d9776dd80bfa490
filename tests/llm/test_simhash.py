import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from polyscene.llm import simhash


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(ids, fps):
    root = {i: i for i in range(len(ids))}
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    return {ids[i]: min(ids[j] for j in range(len(ids)) if root[j] == root[i]) for i in range(len(ids))}


def test_fingerprints(messy):
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in messy] == [brute(t) for t in messy]


@pytest.mark.parametrize(("leaf", "shard"), [(256, 2048), (8, 5)])
def test_components(make, messy, monkeypatch, leaf, shard):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHARD", shard)
    fps = [brute(t) for t in messy]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make(messy).withColumn("fp", F.lit("x"))).collect()}
    wanted = components_of(list(range(len(messy))), fps)
    assert {i: r["component_id"] for i, r in got.items()} == wanted
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" for i in got)


def test_links_of_planted_chains(spark, monkeypatch):
    """Chains and balls of fingerprints, over trees deep enough to overlap."""
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for start in list(fps)[:12]:
        x = start
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    own = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp long")
    place = {int(x): i for i, x in enumerate(own.view(np.int64))}
    rows = simhash.links(df, len(own)).collect()
    a, b = (np.array([place[r[c]] for r in rows], int) for c in "ab")
    assert (np.bitwise_count(own[a] ^ own[b]) > 0).all()
    mine, true = simhash.Forest(len(own)), simhash.Forest(len(own))
    mine.join(a, b)
    true.join(*np.nonzero(np.bitwise_count(own[:, None] ^ own[None]) <= 4))
    every = np.arange(len(own))
    assert (mine.roots(every) == true.roots(every)).all()


def test_long_chain_of_labels(spark):
    nodes = spark.createDataFrame([(i, 1000 - i) for i in range(40)], "key long, id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 38)], "a long, b long")
    got = {r["key"]: r["least"] for r in simhash.components(nodes, edges).collect()}
    assert got == {i: 1000 - 38 for i in range(39)}


def test_components_are_extended_by_further_edges(spark, monkeypatch):
    """As of all edges at once; ids repeat; edges within components cost no round of labels."""
    rng = random.Random(3)
    nodes = spark.createDataFrame([(k, (k * 7) % 50) for k in range(200)], "key long, id long")
    # a large component, whose members share a head, and small ones
    first = [(0, k) for k in range(1, 90)] + [(rng.randrange(90, 200), rng.randrange(90, 200)) for _ in range(30)]
    more = [(rng.randrange(200), rng.randrange(200)) for _ in range(25)]
    edges = [spark.createDataFrame([(a, b) for a, b in e if a != b], "a long, b long") for e in (first, more)]
    found = simhash.components(nodes, edges[0])
    rows = lambda df: {r["key"]: (r["least"], r["head"]) for r in df.collect()}
    wanted = rows(simhash.components(nodes, edges[0].union(edges[1])))
    got = simhash.extended(nodes, found, edges[1])
    assert got.count() == len(wanted) and rows(got) == wanted
    monkeypatch.setattr(simhash, "components", None)
    assert rows(simhash.extended(nodes, got, edges[0])) == wanted


def test_dedup_keeps_one_of_each(spark, empty):
    rows = [(3, "a b c d e"), (1, "A b C d e"), (1, "a b c d e"), (7, "other words here now"), (None, "a b c d e"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(1))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 7, 8]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
