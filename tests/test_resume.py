"""Resuming by completeness: what failed or came back blank is asked again, what is complete is not."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from polyscene.operators import cascade, models, resume, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find tests
JOBS = "key string, manifest string, segment_id string"
KIND = f"map<string, map<string, {runs.QA}>>"


@pytest.fixture
def told(tmp_path):
    """A client that notes its requests in a file, and the requests noted so far."""
    path = str(tmp_path / "asked")

    def client_of(answer):
        def client(request):
            with open(path, "a") as f:
                f.write(request.replace("\n", " ") + "\n")
            return answer(request)

        return client

    def asked():
        if not os.path.exists(path):
            return []
        with open(path) as f:
            out = f.read().splitlines()
        os.remove(path)
        return out

    return client_of, asked


def segments_of(request):
    return [j["segment_id"] for j in json.loads(request)]


def good(request):
    return json.dumps({s: {"action": {"caption": f"told {s}", "question": "q", "answer": "a"}} for s in segments_of(request)})


def partly(request):
    """Fails for manifest b, leaves s2 out, gives blanks for s3 and placeholders for s4."""
    if "s5" in request:
        raise RuntimeError("429 quota")
    said = {"s1": "told s1", "s3": "  ", "s4": resume.PLACEHOLDERS[0]}
    return json.dumps({s: {"action": {"caption": said[s], "question": "", "answer": ""}} for s in segments_of(request) if s in said})


def test_segments_are_asked_until_complete(spark, told):
    client_of, asked = told
    jobs = spark.createDataFrame([(f"k{i}", "b" if i > 4 else "a", f"s{i}") for i in range(1, 7)], JOBS)
    nothing = spark.createDataFrame([("old", "s9", {"action": ("c", "q", "a")}), ("blank", "s8", {})], f"key string, segment_id string, annotations map<string, {runs.QA}>")
    ask = lambda answer: models.asking(client_of(answer), "manifest", F.to_json("jobs"), KIND, "responses", pause=lambda _: None)

    run = runs.run_segments(jobs, ask(partly), nothing)
    first = spark.createDataFrame(run.collect(), run.schema)
    assert sorted(len(segments_of(r)) for r in asked()) == [2, 2, 2, 4]  # manifest b three times
    got = {r["key"]: (r["state"], r["tries"], r["error"]) for r in first.collect()}
    assert got == {
        "k1": ("complete", 1, None),
        **{k: ("pending", 1, None) for k in ("k2", "k3", "k4")},
        **{k: ("failed", 3, "429 quota") for k in ("k5", "k6")},
        "old": ("complete", 1, None),
        "blank": ("pending", 1, None),
    }
    second = runs.run_segments(jobs, ask(good), first)
    got = {r["key"]: (r["state"], r["tries"], r["error"], (r["annotations"].get("action") or {"caption": None})["caption"]) for r in second.collect()}
    assert got["k1"] == ("complete", 1, None, "told s1") and got["k3"] == ("complete", 2, None, "told s3") and got["k5"] == ("complete", 4, None, "told s5")
    assert got["blank"][0] == "pending" and got["old"][3] == "c"
    assert sorted(s for r in asked() for s in segments_of(r)) == ["s2", "s3", "s4", "s5", "s6"]


def test_a_trial_takes_placeholders(spark):
    jobs = spark.createDataFrame([("k1", "a", "s1")], JOBS)
    done = spark.createDataFrame([("k1", "s1", {"action": (resume.PLACEHOLDERS[0], "", "")})], f"key string, segment_id string, annotations map<string, {runs.QA}>")
    no_call = lambda m: m.select("manifest", F.lit(None).cast(KIND).alias("responses"))
    assert [r["state"] for r in runs.run_segments(jobs, no_call, done, trial=True).collect()] == ["complete"]
    got = runs.run_segments(jobs, no_call, done).first()
    assert (got["state"], got["tries"], got["error"]) == ("failed", 2, "no answer")


def test_pairs_are_asked_until_complete(spark, told):
    client_of, asked = told
    pairs = spark.createDataFrame([(p, f"f-{p}") for p in "abcd"], "pair_key string, night_file string")

    def flaky(request):
        if request == "c":
            raise ValueError("no frames")
        return json.dumps({"action": {"caption": "", "question": "", "answer": ""} if request == "b" else {"caption": f"told {request}", "question": "q", "answer": "a"}}) if request != "d" else "not JSON"

    ask = lambda answer: models.asking(client_of(answer), "pair_key", F.col("pair_key"), f"map<string, {runs.QA}>", "annotations", pause=lambda _: None)
    run = runs.run_modality("rgb", pairs, ask(flaky), ["action"])
    first = spark.createDataFrame(run.collect(), run.schema)
    assert {r["pair_key"]: (r["state"], r["tries"]) for r in first.collect()} == {"a": ("complete", 1), "b": ("pending", 1), "c": ("failed", 3), "d": ("failed", 1)}
    asked()
    steady = lambda r: json.dumps({"action": {"caption": f"again {r}", "question": "q", "answer": "a"}})
    second = {r["pair_key"]: r for r in runs.run_modality("rgb", pairs, ask(steady), ["action"], first).collect()}
    assert sorted(asked()) == ["b", "c", "d"]
    assert {k: (r["state"], r["tries"], r["annotations"]["action"]["caption"], r["night_file"]) for k, r in second.items()} == {
        "a": ("complete", 1, "told a", "f-a"), "b": ("complete", 2, "again b", "f-b"), "c": ("complete", 4, "again c", "f-c"), "d": ("complete", 2, "again d", "f-d")
    }


ITEMS = [("p1", "day1", "m1"), ("p2", "day2", None), ("p3", None, "m3"), ("p4", "day4", "m4")]


def hear(request, wrong=()):
    if any(w in request for w in wrong):
        raise RuntimeError("overloaded")
    if request.startswith("Say"):
        return "```json\nseen " + request.split("\n")[1] + "\n```"
    if request.startswith("Tell"):
        return "heard " + " given ".join(request.split("\n")[1:])
    return 'Here: [{"question_type": "Sound Source", "question": "what?", "answer": "' + request.split("\n")[1] + '", "context": "c", "timestamp": "0:01"}, {"question_type": "sound source", "answer": "x"}, 7]'


def test_stages_feed_one_another_and_are_resumed_alone(spark, told):
    client_of, asked = told
    items = spark.createDataFrame(ITEMS, "pair string, frames string, media string")
    stages = cascade.audio_stages(F.col("frames"), F.col("media"))
    run = lambda answer, done=None: cascade.run(items, "pair", stages, client_of(answer), done, pause=lambda _: None)
    states = lambda df: {(r["pair"], r["stage"]): (r["state"], r["tries"]) for r in df.collect()}

    first = run(lambda r: hear(r, ("day4", "heard m1")))
    assert states(first) == {
        ("p1", "hia"): ("complete", 1), ("p1", "caption"): ("complete", 1), ("p1", "qa_pairs"): ("failed", 3),
        ("p2", "hia"): ("complete", 1), ("p2", "caption"): ("blocked", 0), ("p2", "qa_pairs"): ("blocked", 0),
        ("p3", "hia"): ("blocked", 0), ("p3", "caption"): ("blocked", 0), ("p3", "qa_pairs"): ("blocked", 0),
        ("p4", "hia"): ("failed", 3), ("p4", "caption"): ("blocked", 0), ("p4", "qa_pairs"): ("blocked", 0),
    }
    asked()
    second = run(hear, first)
    assert len(asked()) == 4  # p1's last stage, and all of p4
    assert {k: v for k, v in states(second).items() if k[0] in ("p1", "p4")} == {
        ("p1", "hia"): ("complete", 1), ("p1", "caption"): ("complete", 1), ("p1", "qa_pairs"): ("complete", 4),
        ("p4", "hia"): ("complete", 4), ("p4", "caption"): ("complete", 1), ("p4", "qa_pairs"): ("complete", 1),
    }
    assert run(hear, second).count() == 12 and asked() == []
    notes = {r["pair"]: r for r in cascade.audio_annotations(second, "pair").collect()}
    assert notes["p4"]["captions"] == {"audio_hia": "seen day4", "audio_chronological_caption": "heard m4 given seen day4"}
    assert {k: (v["answer"], v["caption"], v["timestamp"]) for k, v in notes["p4"]["categories"].items()} == {"audio_sound_source": ("heard m4 given seen day4", "c", "0:01"), "audio_sound_source_2": ("x", "", None)}
    assert notes["p3"]["captions"] == {} and notes["p3"]["categories"] == {}


def test_changed_answers_are_fed_on(spark, told):
    client_of, asked = told
    items = spark.createDataFrame(ITEMS[:1], "pair string, frames string, media string")
    stages = cascade.audio_stages(F.col("frames"), F.col("media"), ("nothing seen", "nothing heard"))
    first = cascade.run(items, "pair", stages, client_of(lambda r: hear(r, ("day1",))), None, pause=lambda _: None)
    assert {r["stage"]: r["state"] for r in first.collect()} == {"hia": "failed", "caption": "complete", "qa_pairs": "complete"}
    assert "nothing seen" in {r["stage"]: r["answer"] for r in first.collect()}["caption"]
    asked()
    second = {r["stage"]: (r["answer"], r["tries"]) for r in cascade.run(items, "pair", stages, client_of(hear), first, pause=lambda _: None).collect()}
    assert len(asked()) == 3 and second["caption"] == ("heard m1 given seen day1", 1) and "given seen day1" in second["qa_pairs"][0]


def test_no_items(spark):
    items = spark.createDataFrame([], "pair string, frames string, media string")
    assert cascade.run(items, "pair", cascade.audio_stages(F.col("frames"), F.col("media")), models.offline).count() == 0


def test_values_of_any_nesting_count(spark):
    kind = "a struct<x: array<map<string, string>>, n: struct<k: int, s: string>>, i int"
    rows = [(([{"u": " "}, {"v": None}], (None, "")), 0), (([{"u": "said"}], None), 1), ((None, (3, None)), 2), (([{"u": resume.PLACEHOLDERS[0]}], (3, resume.PLACEHOLDERS[2])), 3), (None, 4), ((None, None), 5)]
    df = spark.createDataFrame(rows, kind)
    for trial, want in ((False, {1, 2}), (True, {1, 2, 3})):
        assert {r["i"] for r in df.filter(resume.whole(df, "a", trial)).collect()} == want
