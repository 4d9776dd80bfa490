"""Readers, writers and the resumable stream on temporary folders."""

import json

import pytest

from polyscene.sources import files
from polyscene.streaming import upsert


def test_results_modes(spark, tmp_path):
    good, bad = tmp_path / "r.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"a_rgb": {"day_file": "x", "annotations": {"action": {"caption": "c", "question": 3}}}}))
    bad.write_text("[")
    row = files.results(spark, str(good)).first()
    assert row["pair_key"] == "a_rgb" and row["annotations"]["action"]["caption"] == "c"
    assert files.results(spark, str(tmp_path / "no.json"), mode="lenient").count() == 0
    assert files.results(spark, str(bad), mode="resume").count() == 0
    with pytest.raises(Exception):
        files.results(spark, str(bad), mode="lenient").count()


def test_manifests_keep_the_last(spark, tmp_path):
    for name, label in (("a", "old"), ("b", "new")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x_task_segments.json").write_text(json.dumps({"source_prefix": "x", "segments": [{"segment_id": "x_seg_001", "task_label": label}]}))
    assert [r["task_label"] for r in files.manifests(spark, str(tmp_path)).collect()] == ["new"]


def test_media(spark, tmp_path):
    for n in ("run_day_rgb.mp4", "run_day_event.mp4", "run_night_with_audio.mp4", "run_day_with_audio.mp4", "notes.txt"):
        (tmp_path / n).write_bytes(b"x")
    found = files.media(spark, str(tmp_path))
    sets = files.modality_sets(found, "day").collect()
    assert len(sets) == 1 and sets[0]["pair"] == "run" and sets[0]["rgb"].endswith("run_day_rgb.mp4") and sets[0]["ir"] is None
    assert [r["path"].rsplit("/", 1)[1] for r in files.preferred_audio(found).collect()] == ["run_night_with_audio.mp4"]
    assert files.media_samples(found).count() == 2


def test_recordings_and_folders(spark, tmp_path):
    for n in ("v/run_day_rgb.mp4", "v/run_night_rgb.mp4", "v/walk_day_rgb.mp4", "v/run_day_with_audio_rgb.mp4", "c/run_night_ir/frame_1.png", "c/run_day_rgb/frame_1.png"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    found = files.media(spark, str(tmp_path))
    rgb = files.rgb_recordings(found)
    got = sorted((r["pair"].rsplit("/", 1)[1], r["side"]) for r in rgb.collect())
    assert got == [("run", "day"), ("run", "night"), ("walk", "day")]
    audio = rgb.filter("pair like '%run'").select("pair").distinct()
    assert [r["pair"].rsplit("/", 1)[1] for r in files.without_audio(rgb, audio).collect()] == ["walk"]
    assert [r["name"] for r in files.frame_folders(found).collect()] == ["run_day_rgb", "run_night_ir"]
    assert [r["name"] for r in files.frame_folders(found, "ir", "night").collect()] == ["run_night_ir"]


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "q", y'), ("b", "z")], "k string, v string")
    files.write_rows(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == [("a", 'x "q", y'), ("b", "z")]
    files.write_nested(rows, "k", str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_upsert_stream(spark, tmp_path):
    kind = "k int, n int, v string"
    for i, rows in enumerate(([(1, 0, "a"), (2, 0, "b")], [(2, 1, "c"), (3, 1, "d")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        upsert.upsert_stream(stream, str(tmp_path / "out"), ["k"], ["n"], str(tmp_path / "check")).awaitTermination(120)
    got = upsert.current(spark, str(tmp_path / "out"))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]
