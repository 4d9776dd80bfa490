import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polyscene.llm import packing
from polyscene.llm.queries import PACKED, vocabulary


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(vocabulary(PACKED))
    tok.no_truncation()
    tok.no_padding()
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def one_by_one(lengths, tokens, documents, cost, by):
    """Best-fit decreasing, a piece at a time."""
    cap = np.array([tokens, documents, cost], float)
    weight, bins = np.array(packing.WEIGHTS), []
    for n in sorted(lengths, reverse=True):
        size = np.array([n, 1, n * n], float)
        best = None
        for k, left in enumerate(bins):
            if (left >= size).all():
                score = ((left / cap - size / cap) ** 2 @ weight) if by == "norm" else (left / cap * (size / cap)) @ weight
                if best is None or score < best[0] - 1e-12:
                    best = score, k
        if best is None:
            bins.append(cap - size)
        else:
            bins[best[1]] = bins[best[1]] - size
    return len(bins)


def checked(rows, texts, library, most, tokens=None, documents=None, cost=None):
    """Every piece is where and what it should be; the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, own in by_doc.items():
        ids, at = [*library(texts[i]), 1], 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            body = ids[at : at + most]
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(body))
            assert r["ids_crc32"] == zlib.crc32(np.array(body, "<u4").tobytes())
            at += len(body)
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= (tokens or most) and len(own) <= (documents or at) and sum(r["length"] ** 2 for r in own) <= (cost or at * at)
    return len(by_sequence)


ODD = ["İSTANBUL ΣΑΣ ǅ", "a\x1cb\x85c\xa0d\x0be", "don't they're 'S 12 ½ ①", "<|endoftext|>x<|startoftext|> y", "é ́x  ̈́", "𝔘𝔫𝔦 👩‍👩‍👧 한국어", "a_b--c!!?", "﻿x​y"]


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_packs_as_one_by_one(spark, make, messy, library, by):
    texts = messy + ODD
    rows = packing.pack(make(texts).repartition(3), vocabulary(PACKED), {"doc_id": F.col("doc_id")}, 128, by=by).collect()
    n = checked(rows, texts, library, 128)
    assert n == one_by_one([r["length"] for r in rows], 128, 128, 128 * 128, by)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_constraint_holds(spark, make, messy, library, by):
    rows = packing.pack(make(messy), vocabulary(PACKED), {"doc_id": F.col("doc_id")}, 128, 3, 6400, by=by).collect()
    n = checked(rows, messy, library, 80, 128, 3, 6400)
    assert n == one_by_one([r["length"] for r in rows], 128, 3, 6400, by)


@pytest.mark.parametrize("bounds", [(100, 100, 10000), (100, 4, 10000), (100, 7, 2500)])
def test_plan_equals_single_pieces(bounds):
    rng = random.Random(7)
    for _ in range(20):
        lengths = [rng.choice([1, 2, 3, 7, 12, 25, 33, 50]) for _ in range(rng.randint(1, 400))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        for by in ("norm", "dot"):
            opened, runs = packing.planned(counts, *bounds, by)
            assert opened == one_by_one(lengths, *bounds, by)
            assert sum(r[2] for r in runs) == len(lengths)


def test_near_the_least_number():
    rng = np.random.default_rng(3)
    lengths, n = np.unique(np.clip(rng.lognormal(6, 1, 200_000).astype(int), 1, 4096), return_counts=True)
    opened, runs = packing.planned(dict(zip(lengths.tolist(), n.tolist(), strict=True)), 4096, 4096, 4096 * 4096, "norm")
    assert opened <= 1.001 * -(-int(lengths @ n) // 4096) and len(runs) < 20_000


def test_long_texts_and_small_tables(spark, make, messy, library, monkeypatch):
    want = checked(packing.pack(make(messy), vocabulary(PACKED), {"doc_id": F.col("doc_id")}, 64).collect(), messy, library, 64)
    work = packing.WordIds(open(vocabulary(PACKED), encoding="utf-8").read())
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "WORDS", 20)
    assert [x.tolist() for x in work.encode([t and t.encode() for t in messy])] == [library(t) for t in messy]
    assert want > 1


def test_another_vocabulary(spark, make, messy):
    """One that keeps white space is left to the library."""
    tok = Tokenizer.from_file(vocabulary())
    tok.no_truncation()
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    rows = packing.pack(make(messy[:20]), vocabulary(), {"doc_id": F.col("doc_id")}, 64, by="norm").collect()
    checked(rows, messy[:20], ids, 64)


def test_sequences_hold_their_tokens(spark, make, messy, library):
    packed = packing.pack(make(messy), vocabulary(PACKED), {"doc_id": F.col("doc_id")}, 64, ids=True)
    rows = packing.sequences(packed).collect()
    met = {}
    for r in rows:
        at = 0
        assert len(r["token_ids"]) == sum(r["lengths"]) <= 64
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            met.setdefault(d, []).extend(r["token_ids"][at : at + n])
            at += n
    assert sorted(met) == list(range(len(messy)))
    assert all(sorted(met[i]) == sorted([*library(t), 1]) for i, t in enumerate(messy))


def test_nulls_repeats_clashes_and_nothing(spark, empty):
    path = vocabulary(PACKED)
    assert packing.pack_documents(empty, path).collect() == []
    rows = [(1, None, 5, 6), (1, None, 5, 6), (None, "  ", 5, 6), (2, "word", 5, 6)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int"), path).collect()
    assert len(got) == 4 and {r["sequence_id"] for r in got} == {0} and sorted(r["length"] for r in got) == [1, 1, 1, 2]
    assert sorted(r["offset"] for r in got) == [0, 2, 3, 4]
