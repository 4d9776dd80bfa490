import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyscene.llm import bpe, common, queries


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def texts(messy):
    rng = random.Random(1)
    odd = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext", "it's we'll I'M x's", "²½ 3٢", "é ്", "日本語 テスト", "👍🏽 ok", "\x1c\x1d a", "tab\t\tend  ", "  lead", "_under__score", " x\u0085y", "a  b", "퟿"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(60)) for _ in range(40)]
    return messy + odd


def expected(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out = []
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((ids, t.decode(ids, skip_special_tokens=False)))
    return out


@pytest.mark.parametrize("size, words", [(1, 1), (900, 1 << 20), (1 << 20, 30), (32 << 20, 500_000)])
def test_digests_match_the_library(make, path, texts, monkeypatch, size, words):
    """Whatever the slices: one of a text each, some of each, or one of all."""
    monkeypatch.setattr(bpe, "SLICE_TEXT", size)
    monkeypatch.setattr(bpe, "SLICE_WORDS", words)
    docs = make(texts).withColumn("body", F.lit(1)).withColumn("slice", F.lit(2)).withColumn("a.b", F.lit(3))
    got = bpe.tokenize(docs, path, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    for r, (ids, back) in zip(got, expected(path, texts), strict=True):
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), texts[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_real_outputs_round_trip(make, path, texts, empty):
    got = bpe.tokenize(make(texts), path, {"doc_id": F.col("doc_id")}, outputs=("token_ids", "decoded")).orderBy("doc_id").collect()
    assert [list(r["token_ids"]) for r in got] == [ids for ids, _ in expected(path, texts)]
    assert [r["decoded"] for r in got] == [t or "" for t in texts]
    assert bpe.tokenize(empty, path, {"doc_id": F.col("doc_id")}).count() == 0


def test_each_distinct_word_is_encoded_once(make, path, spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_TEXT", 1)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    rows = bpe.cut(make(["a b a", " b", None, "a b a"]).coalesce(1), {"doc_id": F.col("doc_id")}, source, bpe.odd_characters(source), "text").cache()
    words = rows.filter("number is not null")
    assert sorted(r["word"] for r in words.select("word").distinct().collect()) == [" a", " b", "a"] and words.count() > 3
    ids = bpe.encoded(words.select("slice", "number", "word", "special"), source, "")
    assert sum(len(r["number"]) for r in ids.collect()) == 4 * words.count()


def test_repeated_rows_and_planes(spark, path):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x y"), (2, None)], "doc_id long, text string")
    got = bpe.tokenize(docs, path, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == 4 and len({r["ids_sha256"] for r in got if r["n_tokens"]}) == 1
    for x in ([], [0], [3, 256, 1], [1 << 20, 5]):
        assert bpe.unplaned(bpe.planes(x)).tolist() == x


def test_invalid_bytes_decode_as_the_library_does(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        pieces = bpe.pieces_of(f.read())
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(len(pieces)) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(np.array(ids, np.int64), bpe.Pieces(pieces, np.uint8)) == t.decode(ids, skip_special_tokens=False)


def test_shuffled_words_leave_the_disk_and_numbers_are_packed(spark, path):
    """Of a tokenization that is over, no shuffled word stays; a chunk's numbers take less than two bytes a word."""

    def left():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words[min(int(rng.paretovariate(0.7)), 2999)] for _ in range(400))) for i in range(200)], "doc_id long, text string")
    before = left()
    bpe.stored(docs.repartition(3, "text"), "x", cleanup=True)
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before
    with open(path, encoding="utf-8") as f:
        source = f.read()
    odd = bpe.odd_characters(source)
    split = bpe.Splitter(source, odd)
    rows = bpe.cut(docs.coalesce(1), {"doc_id": F.col("doc_id")}, source, odd, "text")
    held = [len(r["body"]) for r in rows.filter("body is not null").collect()]
    assert sum(held) < 2 * sum(len(split.plain(r["text"])) for r in docs.collect())


def test_words_are_dropped_once_their_ids_are_stored(spark, make, path, texts, monkeypatch):
    """Of the rows of words nothing stays but their ids; short and long runs of numbers unpack."""
    gone = []
    monkeypatch.setattr(bpe, "dropped", lambda s, p: (gone.append(p), common.dropped(s, p)))
    monkeypatch.setattr(bpe, "LONG", 40)
    got = bpe.tokenize(make(texts), path, {"doc_id": F.col("doc_id")}, outputs=("token_ids",)).orderBy("doc_id").collect()
    assert [list(r["token_ids"]) for r in got] == [ids for ids, _ in expected(path, texts)]
    assert len(gone) == 1 and not os.path.exists(gone[0].removeprefix("file:"))
    for runs in ([[], []], [[3], [1 << 20, 5, 7]], [list(range(30)), list(range(1 << 17, (1 << 17) + 30))]):
        assert [x.tolist() for x in bpe.unpacked(bpe.packed(*runs))] == runs
