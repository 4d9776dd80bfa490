"""Exports, model calls, frames and sentence selection on small rows."""

import numpy as np
from pyspark.sql import functions as F

from polyscene.operators import export, facts, models, narrative
from polyscene.sources import files

UNIT = "sample_id string, modality string, section string, caption string, question string, answer string, n int"


def test_units_keep_what_the_modality_asks_for(spark):
    a = "annotations map<string, struct<caption: string, question: string, answer: string>>"
    visual = spark.createDataFrame([("depth", "d/Wash_Night_depth", {"b": (" ", "q", "a"), "a": ("much noise", None, None)})], f"modality string, pair_key string, {a}")
    got = export.visual_units(visual).collect()
    assert [(r["sample_id"], r["section"], r["question"], r["confidence"]) for r in got] == [("Wash_Night", "a", "", 0.35)]
    c = "pair_key string, categories map<string, struct<timestamp: string, caption: string, question: string, answer: string>>"
    audio = spark.createDataFrame([("x_audio", {"audio_counting": ("00:01", "", "q", ""), "audio_x": (None, "", " ", "")})], c)
    assert [(r["section"], r["timestamp"], r["confidence"]) for r in export.audio_units(audio).collect()] == [("audio_counting", "00:01", 0.8)]


def test_grouped_pairs_and_cells(spark):
    rows = [("s", "rgb", "counting", "c", "1. p 2. q", "1. a 2. b", 0), ("s", "audio", "Audio_Temporal_Attribute_2", "c", "q", "a", 1), ("s", "ir", "mystery", "c", "q", "", 2), ("s", "ir", "action", "", "q", "a", 3)]
    units = spark.createDataFrame(rows, UNIT)
    pairs = export.grouped_pairs(units, ["n"])
    got = sorted((r["reasoning_group"], r["modality"], r["source_unit_index"], r["pair_index"]) for r in pairs.collect())
    assert got == [("audio_visual_reasoning", "audio", 0, 1), ("object_reasoning", "rgb", 0, 1), ("object_reasoning", "rgb", 0, 2), ("temporal_sequence_reasoning", "audio", 0, 1), ("ungrouped", "ir", 0, 1)]
    cells = export.every_cell(pairs.groupBy("sample_id", "reasoning_group", "modality").agg(F.count("*").alias("n")), units)
    assert cells.count() == 35 and cells.agg(F.sum("n")).first()[0] == 5
    again = export.split_units(export.split_units(units.filter("n = 0"), []).drop("pair_index"), [])
    assert again.count() == 2


def test_report_columns(spark):
    rows = spark.createDataFrame([("k", "counting", ["a", "b"], 1.5)], "sample_key string, section string, sections array<string>, fusion_score double")
    out = export.fused_rows(rows, rows.limit(0))
    assert out.columns == export.FUSED_COLUMNS and len(out.columns) == 41
    row = out.first()
    assert (row["status"], row["sections"], row["fusion_score"], row["answer"]) == ("selected", "a,b", "1.5", "")
    seg = export.segment_rows(spark.createDataFrame([("x", 3, "c")], "segment_id string, source_unit_index int, caption string"))
    assert seg.columns == export.SEGMENT_COLUMNS and (seg.first()["unit_index"], seg.first()["pair_index"], seg.first()["evidence"]) == (3, 1, "c")


def test_metadata_wins(spark):
    rows = spark.createDataFrame([("a", "own", 1), ("b", "own", 2)], "k string, side string, v int")
    meta = spark.createDataFrame([("a", "day", "n")], "k string, side string, notes string")
    got = {r["k"]: (r["side"], r["notes"], r["v"]) for r in export.with_metadata(rows, meta, "k", ["side", "notes"]).collect()}
    assert got == {"a": ("day", "n", 1), "b": ("own", None, 2)}


def test_calls_are_tried_again(spark):
    waits = []
    seen = iter([RuntimeError("429 quota"), RuntimeError("odd"), "fine"])

    def client(_):
        x = next(seen)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.called(client, "r", sleep=waits.append) == ("fine", None, 3) and waits == [30.0, 4.0]
    rows = spark.createDataFrame([("a", "x"), ("b", "boom")], "key string, request string")

    def shaky(r):
        if r == "boom":
            raise ValueError("no " + r)
        return r.upper()

    got = {r["key"]: (r["answer"], r["error"], r["tries"]) for r in models.answered(rows, shaky, pause=lambda _: None).collect()}
    assert got == {"a": ("X", None, 1), "b": (None, "no boom", 3)}
    assert models.answered(rows).filter("answer like '{%'").count() == 2


def test_vectors_are_unit_long(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in models.embedded(rows, lambda t: np.array([[len(x), 3.0 * bool(x)] for x in t])).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[2] == [0.0, 0.0]


def test_frames(spark, tmp_path):
    for n in ("run/day/frame_10.png", "run/day/frame_2.png", "run_night_rgb/frame_1.png"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = {(r["pair"], r["side"]): [p.rsplit("_", 1)[1] for p in r["frames"]] for r in files.cached_frames(files.media(spark, str(tmp_path))).collect()}
    assert got == {("run", "day"): ["2.png", "10.png"], ("run", "night"): ["1.png"]}
    counts = spark.createDataFrame([(0,), (1,), (3,), (100,)], "n long")
    assert [r["x"] for r in counts.select(files.sampled_indices(F.col("n")).alias("x")).collect()] == [[], [0], [0, 1, 2], [0, 25, 50, 74, 99]]
    assert spark.range(1).select(files.mime_type(F.lit("WAV")).alias("x")).first()["x"] == "audio/wav"


def test_facts_and_clauses(spark):
    kinds = [("audio_source", "", "", "", "audio_causality"), ("dynamic_counting", "", "", "", "count"), ("x", "How many cups?", "", "", "count"), ("x", "Where is it?", "", "", "spatial_relation"), ("x", "", "yes", "", "verification"), ("x", "", "", "a kitchen", "scene"), ("x", "", "", "", "environment")]
    df = spark.createDataFrame(kinds, "s string, q string, a string, c string, wanted string")
    got = df.select(facts.fact_type(*[F.col(x) for x in "sqac"]).alias("x"), "wanted").collect()
    assert [r["x"] for r in got] == [r["wanted"] for r in got]
    one = spark.range(1)
    c = lambda *x: one.select(facts.clause(*map(F.lit, x)).alias("x")).first()["x"]
    assert c("rgb", "count", "cups", "3") == "RGB counts 3 cups" and c("ir", "scene", "", "a room") == "IR sets the scene as a room"
    assert one.select(facts.entity(F.lit("How many red cups are there?"), F.lit("3"), F.lit("count")).alias("x")).first()["x"] == "red cups"
    assert one.select(narrative.joined(F.array(F.lit("a.."), F.lit("b"))).alias("x")).first()["x"] == "a. b."


def test_cross_modal_lines(spark):
    rows = [("s", 1, "rgb", "object_recognition", ["board"], 0.9, 0.5, "A board."), ("s", 2, "ir", "object_recognition", ["board"], 0.8, 0.5, "A warm board"), ("s", 3, "audio", "audio_hia", ["sound"], 0.9, 0.5, "A sound")]
    df = spark.createDataFrame(rows, "sample_id string, evidence_id long, modality string, category string, tokens array<string>, reliability double, support_score double, sentence string")
    got = narrative.cross_modal_details(df).first()["details"]
    assert got == "RGB and IR cues agree on the visual layout: A board. Audio evidence matches the rest of the sample: A sound."
