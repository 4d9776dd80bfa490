"""Runs about model calls on small rows."""

from pyspark.sql import functions as F

from polyscene.functions import text
from polyscene.operators import runs


def test_segment_jobs_default_what_is_absent(spark):
    kind = "path string, source_prefix string, split_dir string, side string, source_files map<string,string>, segments array<struct<segment_id: string, start: double>>"
    rows = [("m/Day_split/cut_task_segments.json", None, "", None, None, [("cut_seg_001", 0.0), ("", 1.0), (None, 2.0)]), ("m/x/a_task_segments.json", "pre", "S", "day", {"rgb": "f"}, [("pre_seg_001", 0.0)]), ("m/x/b_task_segments.json", "p", "S", "day", None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {r["key"]: (r["source_prefix"], r["side"], r["source_files"]) for r in runs.segment_jobs(df, "data/").collect()}
    assert got == {"data/Day_split/cut_seg_001": ("cut", "unknown", {}), "data/S/pre_seg_001": ("pre", "day", {"rgb": "f"})}
    assert [r["key"] for r in runs.segment_jobs(df, "data", trial=True).collect()] == ["data/Day_split/cut_seg_001"]


def test_audio_annotations_come_in_many_shapes(spark):
    raw = ['{"audio_hia": {"caption": "c"}, "audio_chronological_caption": "t", "categories": {"sound": {"caption": "x", "timestamp": "1"}, "bad": "no"}}', '{"audio_hia": "plain"}', "[]", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r["i"]: r["x"] for r in df.select("i", runs.batched_audio(F.col("raw")).alias("x")).collect()}
    assert got[0]["captions"] == {"audio_hia": "c", "audio_chronological_caption": "t"} and list(got[0]["categories"]) == ["sound"]
    assert got[0]["categories"]["sound"].asDict() == {"timestamp": "1", "caption": "x", "question": "", "answer": ""}
    assert got[1]["captions"] == {"audio_hia": "plain"} and got[2]["captions"] == {} and got[3]["categories"] == {}


def test_a_modality_runs_over_what_is_left(spark):
    pairs = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3")], "pair_key string, night_file string")
    kind = f"pair_key string, annotations map<string, {runs.QA}>"
    answers = spark.createDataFrame([("a", {"counting": ("c", "q", "a"), "action": ("c", None, "a")})], kind)
    done = spark.createDataFrame([("c", "f3", {"counting": ("old", "", "")}, "rgb")], f"pair_key string, night_file string, annotations map<string, {runs.QA}>, modality string")
    got = {r["pair_key"]: r for r in runs.run_modality("rgb", pairs, lambda _: answers, ["counting", "action"], done, {"caption": "none"}).collect()}
    assert got["a"]["annotations"]["counting"]["question"] == "q" and got["a"]["annotations"]["action"]["caption"] == "none"
    assert got["b"]["annotations"]["counting"]["caption"] == "none" and got["c"]["annotations"] == {"counting": got["c"]["annotations"]["counting"]}


def test_segments_find_their_answers(spark):
    jobs = spark.createDataFrame([("k1", "m", "s1"), ("k2", "m", "s2"), ("k3", "n", "s3"), ("k4", "n", "s4")], "key string, manifest string, segment_id string")
    done = spark.createDataFrame([("k4", "s4", {"x": "old"})], "key string, segment_id string, annotations map<string,string>")
    asked = []

    def call(manifests):
        asked.extend(sorted((r["manifest"], len(r["jobs"])) for r in manifests.collect()))
        return spark.createDataFrame([("m", {"s1": {"x": "1"}, "k2": {"x": "2"}})], "manifest string, responses map<string, map<string,string>>")

    got = {r["key"]: r["annotations"] for r in runs.run_segments(jobs, call, done).collect()}
    assert got == {"k1": {"x": "1"}, "k2": {"x": "2"}, "k3": {}, "k4": {"x": "old"}} and asked == [("m", 2), ("n", 1)]


def test_small_helpers(spark):
    files = spark.createDataFrame([("d/Run_day_rgb.mp4", "d", "Run_day_rgb", "mp4"), ("d/Run_night_rgb.mp4", "d", "Run_night_rgb", "mp4"), ("d/x.txt", "d", "x", "txt")], "path string, folder string, stem string, extension string")
    assert runs.video_pairs(files, "RGB").count() == 1
    frames = spark.createDataFrame([(i,) for i in range(10)], "idx int")
    assert [r["idx"] for r in runs.every_nth(frames, F.lit(29.97), 10.0).orderBy("idx").collect()] == [0, 2, 4, 6, 8]
    assert runs.one_of(frames, ["idx"], 3).first()["idx"] == 3 and runs.one_of(frames, ["idx"], 30).count() == 0
    parts = spark.createDataFrame([("a.png", bytearray(b"hi")), ("b.wav", None)], "path string, content binary")
    assert [tuple(r) for r in runs.encoded_parts(parts).collect()] == [("a.png", "image/png", "aGk=")]
    maps = spark.createDataFrame([([1, 2], None), ([3], [4])], "day array<int>, night array<int>")
    assert tuple(runs.map_totals(maps).first()) == (3, 1)
    one = spark.range(1)
    assert one.select(text.json_list(F.lit("so [1, [2]] it is"))).first()[0] == "[1, [2]]" and one.select(text.json_list(F.lit("no"))).first()[0] is None
    assert "Categories: a, b" in one.select(runs.prompt("About", {"side": F.lit("day")}, ["a", "b"])).first()[0]
    cache = spark.createDataFrame([("run", "day", ["f"]), ("run", "night", ["g"])], "pair string, side string, frames array<string>")
    assert runs.cached(cache, "Run_day", "night").count() == 1 and len(runs.categories_of("event")) == 9
