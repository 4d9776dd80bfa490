"""Operators on small rows, and by their properties."""

import random

import numpy as np
from pyspark.sql import functions as F

from polyscene.functions import dims
from polyscene.operators import align, reports, resume, segments, selection
from polyscene.operators import evidence as ev


def test_tables_are_whole():
    assert len(dims.CATEGORIES) == 33 and len(dims.SECTIONS) == 10 and len(dims.GROUPS) == 7
    assert all(p in dims.PROFILE_WEIGHTS for _, p, *_ in dims.CATEGORIES.values())


def test_unknown_category_gets_defaults(spark):
    rows = dims.with_category(spark.createDataFrame([("counting",), ("mystery",)], "category string"))
    got = {r["category"]: (r["known_category"], r["gate"], r["sections"]) for r in rows.collect()}
    assert got == {"counting": (True, "support_required", ["counting"]), "mystery": (False, "support_required", ["others"])}


def test_explode_keeps_what_has_text(spark):
    kind = "modality string, pair_key string, annotations map<string, struct<caption: string, question: string, answer: string>>"
    rows = spark.createDataFrame([("rgb", "d\\Run_day_rgb", {"counting": ("c", "1. p 2. q", "1. a 2. b"), "action": (" ", "", None)})], kind)
    got = ev.explode_annotations(rows).orderBy("qa_ord").collect()
    assert [(r["sample_id"], r["qa_index"], r["question"], r["answer"], r["sentence"]) for r in got] == [("run", 1, "p", "a", "c"), ("run", 2, "q", "b", "c")]


def test_dedup_outcomes_and_idempotence(spark):
    rows = [(1, 1, 3.0, "What?", "Cup", ["cup", "what"]), (1, 2, 2.0, "what?", "cup", ["cup", "what"]), (1, 3, 1.0, "x", "y", ["cup", "what"]), (1, 4, 0.5, "z", "w", ["bowl"])]
    items = spark.createDataFrame(rows, "k int, id long, score double, question string, answer string, tokens array<string>")
    got = {r["id"]: r["outcome"] for r in selection.deduplicated(items, ["k"]).collect()}
    assert got == {1: "kept", 2: "duplicate_exact_qa", 3: "duplicate_similar_qa", 4: "kept"}
    kept = items.filter(F.col("id").isin([k for k, v in got.items() if v == "kept"]))
    assert {r["outcome"] for r in selection.deduplicated(kept, ["k"]).collect()} == {"kept"}


def test_semantic_dedup_names_the_best_twin(spark):
    rows = [(1, 1, 3.0, "q", "red cup", [], [1.0, 0.0]), (1, 2, 2.0, "q", "red cup", [], [0.95, 0.3122]), (1, 3, 1.0, "q", "no", [], [1.0, 0.0]), (1, 4, 0.5, "q", "red cup", [], [0.0, 1.0])]
    items = spark.createDataFrame(rows, "k int, id long, score double, question string, answer string, tokens array<string>, vector array<double>")
    got = {r["id"]: (r["outcome"], r["duplicate_of"]) for r in selection.deduplicated(items, ["k"], exact=False, above=None, cosine_from=0.9).collect()}
    assert got[2] == ("duplicate_semantic_qa", 1) and got[3] == ("kept", None) and got[4] == ("kept", None)


def _loop(rows, shortest):
    rows = [list(r) for r in rows]
    while len(rows) > 1:
        short = next((i for i, (a, b) in enumerate(rows) if b - a < shortest), None)
        if short is None:
            break
        i = max(1, short)
        rows[i - 1 : i + 1] = [[rows[i - 1][0], rows[i][1]]]
    return [tuple(r) for r in rows]


def test_merge_matches_the_repeated_repair(spark):
    rng = random.Random(3)
    cases = []
    for k in range(60):
        at, rows = 0.0, []
        for _ in range(rng.randint(1, 7)):
            a = at + rng.choice([0, 1, 4])
            at = a + rng.choice([2, 9, 16, 30])
            rows.append((a, at))
        cases.append((k, rows))
    data = [(k, [("x", a, b, 0.5, [], "") for a, b in rows]) for k, rows in cases]
    df = spark.createDataFrame([(k, r) for k, r in data], f"k int, s array<{segments.SEGMENT}>")
    got = {r["k"]: [(x["start"], x["end"]) for x in r["m"]] for r in df.select("k", segments.merged(F.col("s")).alias("m")).collect()}
    assert got == {k: _loop(rows, segments.SHORTEST) for k, rows in cases}


def test_clamp_orders_and_cuts(spark):
    raw = [("a", 0.0, 5.0, 2.0, None, None), ("", 3.0, 9.0, None, None, None), ("c", 8.0, 8.5, 0.1, None, None), ("d", 20.0, 50.0, -1.0, None, None)]
    df = spark.createDataFrame([(30.0, raw)], f"d double, s array<{segments.SEGMENT}>")
    got = df.select(segments.clamped(F.col("s"), F.col("d")).alias("x")).first()["x"]
    assert [(x["label"], x["start"], x["end"], x["confidence"]) for x in got] == [("a", 0.0, 5.0, 1.0), ("task segment 2", 5.0, 9.0, 0.5), ("d", 20.0, 30.0, 0.0)]


def test_lags_stay_within_a_sample(spark):
    rows = [(s, m, i, float((i * 7 + (s == "b") * i * i) % 11)) for s in "ab" for m in ("rgb", "ir") for i in range(60)]
    t = spark.createDataFrame(rows, "sample string, modality string, idx long, value double")
    out = align.lag_correlations(t.filter("modality = 'rgb'").drop("modality"), t.filter("modality = 'ir'"), ["sample", "modality"], 2)
    assert {(r["sample"], r["n"], round(r["correlation"], 9)) for r in out.filter("lag = 0").collect()} == {("a", 60, 1.0), ("b", 60, 1.0)}


def test_many_segments_have_ids_of_their_own(spark):
    one = [("x", float(i), i + 1.0, 0.5, [], "") for i in range(1002)]
    df = spark.createDataFrame([("p", one)], f"p string, s array<{segments.SEGMENT}>")
    ids = [r["segment_id"] for r in segments.numbered(df, "p", "s").collect()]
    assert len(set(ids)) == 1002 and {"p_seg_001", "p_seg_1002"} <= set(ids)


def test_recordings_without_segments_are_one(spark):
    kind = f"prefix string, duration double, modalities array<string>, raw array<{segments.SEGMENT}>, error string"
    good = [("Cut", 0.0, 20.0, 0.9, None, "n")]
    rows = [("a", 60.0, ["rgb"], good, None), ("b", 60.0, ["rgb", "audio"], good, "boom"), ("c", None, ["ir"], None, None), ("d", 9.0, ["ir"], [("x", 5.0, 5.0, 0.1, None, None)], None)]
    got = {r["prefix"]: (r["status"], [(s["label"], s["start"], s["end"], s["confidence"], s["evidence"]) for s in r["segments"]]) for r in segments.manifests(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"] == ("suggested", [("cut", 0.0, 20.0, 0.9, ["rgb"])])
    assert got["b"] == ("fallback", [("semantic task", 0.0, 60.0, 0.0, ["rgb", "audio"])])
    assert got["c"] == ("fallback", [("semantic task", 0.0, 0.0, 0.0, ["ir"])]) and got["d"] == ("suggested", [("semantic task", 0.0, 9.0, 0.0, ["ir"])])


def test_alignment_says_why_a_video_is_left_out(spark):
    videos = spark.createDataFrame(
        [("s", "rgb", "r.mp4", True, 10.0, 60.0, False), ("s", "ir", "i.mp4", True, 10.0, 50.0, False), ("s", "event", "e.mp4", False, 0.0, 0.0, True), ("s", "depth", "d.mp4", True, 5.0, 40.0, True), ("t", "ir", "i.mp4", True, 10.0, 9.0, False)],
        "sample string, modality string, file string, opened boolean, fps double, duration double, flat boolean",
    )
    picked = spark.createDataFrame([("s", "ir", -20, 0.9, -2.0, 10, 0.0, "modality_prior", "high")], "sample string, modality string, lag int, correlation double, offset_seconds double, raw_best_lag int, peak_margin double, selected_by string, confidence_label string")
    got = {(r["sample"], r["modality"]): r for r in align.alignment(videos, picked, ["sample"], ["ir", "event", "depth"]).collect()}
    assert len(got) == 6
    ir = got["s", "ir"]
    assert (ir["offset_seconds"], ir["reference_start"], ir["reference_end"], ir["target_start"], ir["target_end"]) == (-2.0, 2.0, 52.0, 0.0, 50.0) and ir["warnings"] == [align.BY_PRIOR]
    assert got["s", "event"]["selected_by"] == "unavailable" and got["s", "event"]["warnings"] == ["Could not open event video: e.mp4"]
    assert got["s", "depth"]["warnings"][-1] == align.FLAT_TRACE and len(got["s", "depth"]["warnings"]) == 2
    assert got["t", "event"]["selected_by"] == "missing" and got["t", "ir"]["offset_seconds"] is None


def test_exports_need_every_target(spark):
    samples = spark.createDataFrame([("a", "r", 60.0, True), ("b", "r", 60.0, True), ("c", "r", 60.0, False), ("d", "r", 5.0, True)], "k string, file string, duration double, exists boolean")
    full = [(k, m, o, 50.0, "f", True) for k in "acd" for m, o in (("event", -3.0), ("depth", 2.0), ("ir", 0.0))]
    aligned = spark.createDataFrame([*full, ("b", "event", 0.0, 50.0, "f", True)], "k string, modality string, offset_seconds double, duration double, file string, exists boolean")
    got = {r["k"]: (r["status"], r["reason"], r["start"], r["length"]) for r in align.exports(samples, aligned, ["k"]).collect()}
    assert got["a"] == ("exported", None, 3.0, 45.0) and got["d"] == ("exported", None, 3.0, 2.0)
    assert got["b"][1] == "Missing DEPTH alignment." and got["c"][1] == "RGB reference file does not exist: r"
    window = align.shared_window(samples, aligned, ["k"]).filter("k = 'a'").first()
    assert (window["window_start"], window["window_end"]) == (3.0, 48.0)


def test_plot_scale(spark):
    t = spark.createDataFrame([("a", i, float(i)) for i in range(101)] + [("b", i, 5.0) for i in range(3)], "k string, idx int, value double")
    got = {(r["k"], r["idx"]): r["value"] for r in align.plotted(t, ["k"]).collect()}
    assert got["a", 0] == 0.0 and got["a", 100] == 1.0 and abs(got["a", 50] - 0.5) < 1e-9 and got["b", 1] == 0.0


def test_points_in_half_open_intervals(spark):
    points = spark.createDataFrame([(1, 0.0), (1, 4.9), (1, 5.0), (1, 25.0), (2, 1.0)], "k int, at double")
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 26.0)], "k int, start double, end double")
    got = segments.points_in(points, spans, "k", "at", 10.0).orderBy("at").collect()
    assert [(r["at"], r["start"]) for r in got] == [(0.0, 0.0), (4.9, 0.0), (5.0, 5.0), (25.0, 5.0)]


def test_known_lag_is_found(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    rows = [("ref", i, float(v)) for i, v in enumerate(a)] + [("ir", i + 4, float(v)) for i, v in enumerate(a)]
    t = spark.createDataFrame(rows, "modality string, idx long, value double")
    lags = align.lag_correlations(t.filter("modality = 'ref'").drop("modality"), t.filter("modality = 'ir'"), ["modality"], 8).cache()
    best = align.selected_offsets(align.scored_lags(lags, 1.0, F.lit(200), F.col("modality"), {"ir": (8.0, 0.0, 8.0, 0.0)}), ["modality"]).first()
    assert best["lag"] == 4 and best["confidence_label"] == "high"
    packed = spark.createDataFrame([("ir", a.tolist(), [0.0] * 4 + a.tolist())], "key string, reference array<double>, target array<double>")
    top = align.lag_table(packed, 8).orderBy(F.desc("correlation")).first()
    assert top["lag"] == 4


def test_smoothing_window_is_odd():
    assert [align.smoothing_window(f) for f in (1, 10, 30)] == [3, 5, 11]
    assert align.smoothing_window(30, 6) == 5 and align.smoothing_window(30, 2) == 1


def test_consensus_prefers_near_candidates(spark):
    rows = spark.createDataFrame([(1, "ir", 0.2, 0.9, "high"), (1, "depth", 9.0, 0.2, "low"), (1, "event", 9.0, 0.2, "low")], "s int, modality string, offset_seconds double, correlation double, confidence_label string")
    near = spark.createDataFrame([(1, "depth", 1.0, 0.5), (1, "depth", 2.0, 0.7), (1, "depth", 8.0, 0.9)], "s int, modality string, offset_seconds double, score double")
    got = {r["modality"]: (r["offset_seconds"], r["confidence_label"], r["rejected_offset_seconds"]) for r in align.consensus(rows, ["s"], near).collect()}
    assert got == {"ir": (0.2, "high", None), "depth": (2.0, "medium", 9.0), "event": (0.2, "low", 9.0)}


def test_resume_and_reports(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, resume.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["k"] for r in resume.pending(new, old, ["k"]).collect()] == [3]
    got = {(r["dimension"], r["value"]): r["n"] for r in reports.counts(old.union(new), ["k", "v"]).collect()}
    assert got[("k", "2")] == 2 and got[("v", "a")] == 1


def test_coalesced_keeps_given_nulls(spark):
    rows = spark.createDataFrame([(1, 0, ["x"], None, "n"), (1, 1, ["x", "y"], "b", "c")], "k int, o int, has array<string>, x string, y string")
    assert tuple(resume.coalesced(rows, "k", "o", ["x", "y"]).first()) == (1, None, "c")


def test_completeness(spark):
    kind = "k int, a map<string, struct<caption: string, question: string, answer: string>>"
    rows = [(1, {"x": (" ", None, "")}), (2, {"x": ("Demo caption", "Demo question?", None)}), (3, {"x": ("Demo caption", "", ""), "y": ("real", "", "")}), (4, {}), (5, None)]
    df = spark.createDataFrame(rows, kind)
    assert [r["c"] for r in df.orderBy("k").select(resume.complete(F.col("a")).alias("c")).collect()] == [False, False, True, False, False]
    assert [r["c"] for r in df.orderBy("k").select(resume.complete(F.col("a"), trial=True).alias("c")).collect()] == [False, True, True, False, False]


def test_modality_choice():
    assert resume.chosen_modalities(None) == resume.chosen_modalities(["IR", "all"]) == dims.REASONING_ORDER
    assert resume.chosen_modalities([" IR", "rgb", "ir", ""]) == ["ir", "rgb"]
    for bad in ([], [" "], ["smell"]):
        try:
            resume.chosen_modalities(bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_batches_and_responses(spark):
    jobs = spark.createDataFrame([("m", 2, "b"), ("m", 1, "a"), ("n", 1, "c")], "manifest string, pos int, id string")
    got = {r["manifest"]: [j["id"] for j in r["jobs"]] for r in resume.by_manifest(jobs, "manifest", "pos").collect()}
    assert got == {"m": ["a", "b"], "n": ["c"]}
    kind = "struct<caption: string>"
    df = spark.createDataFrame([({"s1": ("x",), "k2": ("y",)}, "s1", "k1"), ({"s1": ("x",), "k2": ("y",)}, "s2", "k2"), ({}, "s3", "k3")], f"m map<string, {kind}>, s string, k string")
    out = [r["x"]["caption"] for r in df.select(resume.response_of(F.col("m"), F.col("s"), F.col("k"), kind).alias("x")).collect()]
    assert out == ["x", "y", None]


def test_audio_sections_nest(spark):
    df = spark.createDataFrame([({"audio_hia": "h", "audio_counting": "c"},)], "m map<string, string>")
    row = df.select(ev.nested_audio(F.col("m")).alias("x")).first()["x"]
    assert (row["captions"], row["categories"]) == ({"audio_hia": "h"}, {"audio_counting": "c"})


def test_payload_and_frames(spark):
    kind = "recording string, segment_id string, task_label string, start double, end double, start_timestamp string, end_timestamp string, start_seconds double, end_seconds double, annotations map<string, struct<caption: string, question: string, answer: string>>"
    jobs = spark.createDataFrame([("r", "a", None, 0.0, 2.0, "", "", 0.0, None, None), ("r", "b", "x", 50.0, 60.0, "", "", 50.0, 60.0, None)], kind)
    frames = spark.createDataFrame([("r", i, f"f{i}") for i in (0, 10, 19, 20)], "recording string, idx int, path string")
    got = segments.with_frames(jobs, frames, 10.0).collect()
    assert [(r["segment_id"], r["frames"]) for r in got] == [("a", ["f0", "f10", "f19"])]
    row = jobs.filter("segment_id = 'a'").select(segments.payload(F.col("annotations")).alias("p")).first()["p"]
    assert row["segment"]["task_label"] == "" and row["segment"]["end_seconds"] == 0.0 and row["annotations"] == {}
