"""Text and key functions on literals."""

import pytest
from pyspark.sql import functions as F

from polyscene.functions import text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.clean, "  a \t b\n", "a b"),
        (text.tokens, "The RED cup, the red cup 12 x", ["12", "cup", "red"]),
        (text.sentences, "One. Two!  Three", ["One.", "Two!", "Three"]),
        (text.numbered_text, "1. a 2) b", ["a", "b"]),
        (text.numbered_text, "plain", ["plain"]),
        (text.numbered_text, "", []),
        (text.question_items, "who? why?", ["who?", "why?"]),
        (text.answer_items, "One. Two.", ["One.", "Two."]),
        (text.number_tokens, "two of 3, x4", ["3", "two"]),
        (text.direction_tokens, "left of the Right side", ["left", "right"]),
        (text.polarity_tokens, "not visible", ["negative", "positive"]),
        (text.polarity_tokens, "nothing", []),
        (text.yes_no, " Yes ", True),
        (text.looks_like_question, "Where is it", True),
        (text.first_fragment, "1. red cup 2. bowl", "red cup"),
        (text.trim_answer, "The red cup, on a shelf", "red cup"),
        (text.trim_answer, "a b c d e f g on the i j", "b c d e f g"),
        (text.trim_answer, "Red. Blue things", "Red"),
        (text.timestamp, 3661.2345, "01:01:01.234"),
        (text.timestamp, -1.0, "00:00:00.000"),
        (text.timestamp, 59.9996, "00:01:00.000"),
        (text.slug, " Sound / Source! ", "sound_source"),
        (text.slug, "!!", "qa_pair"),
        (text.without_fence, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.json_object, 'so {"a": {"b": 1}} there', '{"a": {"b": 1}}'),
        (text.json_object, "none", None),
        (text.fusion_key, "dataset\\cut_split\\Cut-Carrot_day_rgb.mp4", "cut_carrot"),
        (text.reasoning_key, "dataset\\x\\Wash_event", "Wash"),
        (text.pair_key, "a/b/Run_night_rgb.mp4", "a/b/run_rgb"),
        (text.section_name, " Audio_Counting_2 ", "audio_counting"),
    ],
)
def test_function(spark, f, given, wanted):
    assert value(spark, f(F.lit(given))) == wanted


def test_numbered_items_need_two_markers(spark):
    assert [tuple(r) for r in value(spark, text.numbered_items(F.lit("1. red; 2. blue.")))] == [(1, "red"), (2, "blue")]
    assert value(spark, text.numbered_items(F.lit("1. red"))) == []


def test_pairs_by_number_then_place(spark):
    pairs = lambda q, a: [tuple(r) for r in value(spark, text.fused_pairs(F.lit(q), F.lit(a)))]
    assert pairs("1. p 2. q", "2. b 1. a") == [(1, "p", "a"), (2, "q", "b")]
    assert pairs("1. p 2. q", "3. a 4. b") == [(1, "p", "a"), (2, "q", "b")]
    assert pairs("p", "a") == [(None, "p", "a")]
    assert pairs("", "a") == []


def test_exported_pairs_pad(spark):
    got = value(spark, text.exported_pairs(F.lit("1. p 2. q 3. r"), F.lit("1. a 2. b")))
    assert [tuple(r) for r in got] == [("p", "a"), ("q", "b"), ("r", "")]


@pytest.mark.parametrize(("a", "b", "wanted"), [(["x"], ["x"], 1.0), (["x", "y"], ["y", "z"], 1 / 3), ([], ["x"], 0.0), ([], [], 0.0)])
def test_jaccard(spark, a, b, wanted):
    array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    assert value(spark, text.jaccard(array(a), array(b))) == pytest.approx(wanted)
    assert value(spark, text.jaccard(array(b), array(a))) == pytest.approx(wanted)
