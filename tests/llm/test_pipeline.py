"""The pipeline on planted rows, each stage judged on its own input."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from polyscene.llm.queries import vocabulary


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = {i: prose(rng.randint(20, 60)) for i in range(160)}
    toxic = [i for i in range(160) if i % 9 == 4]
    for i in toxic:
        texts[i] = f"vile {texts[i]} rotten vile scoundrel"
    items = {k: prose(12) for k in range(4)}
    leaks = {200: f"{prose(9)} {items[0]} {prose(5)} {items[1]}", 201: f"{prose(9)} {items[2]}"}
    private = {210: f"{prose(9)} write to jo.doe@mail.example.com from 10.0.0.7 soon"}
    copies = {220: texts[0], 221: texts[0].upper(), 222: texts[1]}
    blanks = {230: None, 231: ""}
    every = {**texts, **leaks, **private, **copies, **blanks}
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 5}", len(t) if t is not None else None) for i, t in every.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, every, toxic


def test_stages_take_effect(spark, corpus):
    path, every, toxic = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(every) - set(seen[0]) == set(toxic)
    assert set(seen[0]) - set(seen[1]) == {220, 221, 222, 231}  # null and empty texts are alike
    assert set(seen[1]) - set(seen[2]) == {200, 201}  # one item is enough
    assert set(seen[3]) == set(seen[2]) == set(seen[4])
    assert seen[3][210]["text"].endswith("write to [EMAIL] from [IP] soon") and seen[3][210]["n_chars"] == len(seen[3][210]["text"])
    assert all(seen[3][i]["text"] == every[i] for i in seen[3] if i != 210)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    for i, r in seen[4].items():
        ids = t.encode(seen[3][i]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_is_the_stages(spark, corpus):
    path, every, toxic = corpus
    got = corpus_pipeline.run(spark, path)
    assert len(corpus_pipeline.STAGES) == 5 and got.count() == len(every) - len(toxic) - 6


def test_empty_corpus(spark, corpus, tmp_path):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
