"""The fusion run on small result files, and what sections say and ask."""

import pytest
from pyspark.sql import functions as F

from polyscene.functions import dims
from polyscene.operators import evidence, facts, fields, narrative, reports, support
from polyscene.plans import fusion

RESULTS = "modality string, pair_key string, annotations map<string, struct<caption: string, question: string, answer: string>>"
WORDS = "orange carrot wooden board sharp peeler metal bowl"


def results(spark):
    one = lambda c, q, a: {"caption": c, "question": q, "answer": a}
    rows = [
        ("rgb", "d/Cut_day_rgb", {"object_recognition": one(f"The {WORDS}.", f"Which tools lie near the {WORDS}?", "A carrot"), "counting": one("", f"How many carrots near the {WORDS}?", "3 carrots"), "non_common": one("", f"What is odd near the {WORDS}?", "A carrot bowl")}),
        ("ir", "d/Cut_night_ir", {"object_recognition": one("", f"Which tools lie near the {WORDS}?", "A carrot"), "counting": one("", f"How many carrots near the {WORDS}?", "5 carrots")}),
        ("depth", "d/Cut_depth", {"depth_object_recognition": one("", f"Which tools lie near the {WORDS}?", "A carrot")}),
        ("audio", "d/Cut_audio", {"audio_hia": one("A sound of steady chopping, then silence.", "", "")}),
        ("rgb", "d/Other_day_rgb", {"navigation": one("", "Where is the exit?", "left")}),
    ]
    return spark.createDataFrame(rows, RESULTS)


@pytest.fixture(scope="module")
def fused(spark):
    out = fusion.fuse_results(results(spark))
    return out, {(r["sample_id"], r["modality"], r["category"]): r for r in out.candidates.collect()}


def test_reviewed_items_take_no_part_in_deduplication(fused):
    out, rows = fused
    assert len(rows) == 8 and {r["outcome"] for r in rows.values()} <= {"selected", "review", "dropped"}
    same = [rows["cut", m, c] for m, c in (("rgb", "object_recognition"), ("ir", "object_recognition"), ("depth", "depth_object_recognition"))]
    assert sorted(r["outcome"] for r in same) == ["dropped", "dropped", "selected"]
    assert {r["drop_reason"] for r in same if r["outcome"] == "dropped"} == {"duplicate_exact_qa"}
    odd = rows["cut", "rgb", "non_common"]
    assert odd["outcome"] in ("review", "dropped") and (odd["outcome"] == "dropped" or odd["review_reasons"][0] == "anomaly_category")


def test_contradictions_are_conflicts(fused):
    _, rows = fused
    count = rows["cut", "rgb", "counting"]
    assert count["by_modality"]["ir"]["relation"] == "conflict" and count["by_modality"]["ir"]["conflict_types"] == ["numeric"] and count["conflicting"] == "ir"
    assert count["outcome"] == "dropped" or {"conflicting_support_detected", "possible_numeric_conflict"} <= set(count["review_reasons"])


def test_captions_stand_in_for_questions(fused):
    _, rows = fused
    heard = rows["cut", "audio", "audio_hia"]
    assert heard["qa"]["qa_source"] == "caption_fallback" and heard["qa"]["question"] == "What sound is described?" and heard["qa"]["answer"] == "steady chopping"
    assert rows["cut", "rgb", "counting"]["qa"]["qa_source"] == "original_modality"


def test_counts_add_up(fused):
    out, rows = fused
    got = {(r["dimension"], r["value"]): r["n"] for r in out.diagnostics().collect()}
    assert sum(n for (d, _), n in got.items() if d == "outcome") == len(rows)
    assert sum(n for (d, _), n in got.items() if d == "drop_reason") == got["outcome", "dropped"]
    assert sum(n for (d, _), n in got.items() if d == "priority") == got.get(("outcome", "review"), 0)
    assert {r["sample_id"] for r in out.sections.collect()} == {"cut", "other"}
    assert sum(r["candidate_count"] for r in out.modality_summary().collect()) == len(rows)
    place = [r["position"] for r in out.review.filter("sample_id = 'cut'").collect()]
    assert sorted(place) == list(range(1, len(place) + 1))


def test_the_last_result_of_a_sample_counts(spark):
    one = lambda w: {"counting": {"caption": "", "question": f"How many {w}?", "answer": "2"}}
    rows = [("rgb", "b/cut_carrot_day_rgb.mp4", one("late"), 1), ("rgb", "a/cut_carrot_rgb.mp4", one("early"), 0), ("ir", "a/cut_carrot_ir.mp4", one("other"), 0)]
    df = spark.createDataFrame(rows, f"{RESULTS}, position long")
    got = sorted(r["question"] for r in fusion.fuse_results(df).candidates.collect())
    assert got == ["How many late?", "How many other?"]
    assert {r["pair_key"] for r in evidence.last_results(df.drop("position")).collect()} == {"b/cut_carrot_day_rgb.mp4", "a/cut_carrot_ir.mp4"}


def test_evidence_states_facts(spark, fused):
    out, rows = fused
    told = {(r["sample_id"], r["modality"], r["section"]): r for r in out.facts.collect()}
    assert len(told) == len(rows)
    count = told["cut", "rgb", "counting"]
    assert [count[c] for c in ("fact_type", "entity", "attribute", "value", "confidence")] == ["count", f"carrots near the {WORDS}", "count", "3 carrots", 0.85]
    assert count["support"] == rows["cut", "rgb", "counting"]["support_score"] and count["source_answer"] == "3 carrots"
    place = told["other", "rgb", "navigation"]
    assert [place[c] for c in ("fact_type", "entity", "attribute", "value")] == ["spatial_relation", "Where is the exit?", "location", "left"]
    assert told["cut", "audio", "audio_hia"]["value"].startswith("A sound of steady")


def test_graphs_take_the_best_facts(spark, fused):
    out, _ = fused
    graph = {}
    for r in out.scene_graph().orderBy("rank").collect():
        graph.setdefault((r["sample_id"], r["for_section"]), []).append((r["rank"], r["fact_type"], r["modality"], r["score"]))
    assert {k: len(v) for k, v in graph.items() if k[0] == "cut"} == {("cut", "scene_overview"): 2, ("cut", "visible_objects_and_layout"): 3, ("cut", "motion_and_event_cues"): 2, ("cut", "audio_cues"): 1}
    assert {t for _, t, _, _ in graph["cut", "visible_objects_and_layout"]} <= {"object_presence", "count", "non_common"}
    assert all([x[3] for x in v] == sorted((x[3] for x in v), reverse=True) for v in graph.values())
    asked = {(r["sample_id"], r["section"]): r for r in out.questions().collect()}
    assert len(asked) == 12
    heard = asked["cut", "audio_cues"]
    if heard["caption"]:
        assert heard["qa_source"] == "semantic_fact" and heard["fact_type"] == "sound" and heard["category"] == "audio" and heard["question"] == "What audio cue is grounded?"
    assert all((r["question"] == "") == (r["caption"] == "") for r in asked.values())


def test_equal_facts_are_one(spark):
    rows = [("s", i, m, c, q, a, "cap", 0.5, 0.5) for i, (m, c, q, a) in enumerate([("rgb", "counting", "How many red cups are there?", "1. 3 2. 4"), ("rgb", "counting", "How many red cups do I see?", "3"), ("ir", "counting", "How many red cups do I see?", "3"), ("rgb", "note", "Is it on?", "YES"), ("rgb", "counting", "How many?", ""), (None, None, None, None)])]
    ev = spark.createDataFrame(rows, "sample_id string, evidence_id int, modality string, category string, question string, answer string, caption string, support_score double, reliability double")
    got = {r["id"]: r for r in facts.facts(ev).collect()}
    assert sorted(got) == [0, 2, 3, 4, 5] and got[0]["entity"] == "red cups" and got[3]["value"] == "Yes" and got[4]["entity"] == "" and got[4]["value"] == "cap"
    assert [r["id"] for r in facts.top(facts.facts(ev.filter("modality is not null")), "visible_objects_and_layout", 9).orderBy("rank").collect()] == [2, 0, 4]
    assert facts.facts(ev.limit(0)).count() == 0


def test_relaxed_mode_keeps_no_less(spark, fused):
    strict = {k for k, r in fused[1].items() if r["keep"]}
    relaxed = {(r["sample_id"], r["modality"], r["category"]) for r in fusion.fuse_results(results(spark), relaxed=True).candidates.filter("keep").collect()}
    assert strict <= relaxed


def test_vectors_share_in_the_score(spark):
    rows = [(1, 1, "rgb", "object_recognition", ["a", "b"], [1.0, 0.0]), (1, 2, "ir", "object_recognition", ["a", "b"], [0.6, 0.8]), (1, 3, "depth", "counting", ["z"], [1.0, 0.0])]
    ev = spark.createDataFrame(rows, "sample_id long, evidence_id long, modality string, category string, tokens array<string>, vector array<double>")
    got = {(r["evidence_id"], r["other_evidence_id"]): r for r in support.pairs(ev).collect()}
    w = dims.CATEGORIES["object_recognition"][2]
    assert abs(got[1, 2]["score"] - (w * 1.0 + (1 - w) * 0.4)) < 1e-9 and got[1, 2]["semantic"] == got[2, 1]["semantic"]
    assert abs(got[3, 1]["score"] - (1 - dims.CATEGORIES["counting"][2])) < 1e-9
    assert support.support(ev, support.pairs(ev)).filter("evidence_id = 1").first()["semantic_match"] == 3


def test_routes_hear_the_question(spark):
    rows = [(k, "rgb", "note", [t], 1.0, 0.0, q, "") for k, (t, q) in enumerate([("left", ""), ("move", "Where is it?"), ("move", "What action comes next?")])]
    ev = spark.createDataFrame(rows, "evidence_id int, modality string, category string, tokens array<string>, reliability double, support_score double, question string, answer string")
    got = {r["evidence_id"]: r["section"] for r in narrative.routed(ev).collect()}
    assert got == {0: "visible_objects_and_layout", 1: "visible_objects_and_layout", 2: "motion_and_event_cues"}


CAPTIONS = [
    ("visible_objects_and_layout", "To the LEFT of the sink sits a blue cup, full.", "What is to the LEFT of the sink?", "blue cup"),
    ("visible_objects_and_layout", "The lamp is located to the right of the door.", "What is to the right of the door?", "lamp"),
    ("visible_objects_and_layout", "A power strip with 4 outlets.", "How many outlets are on the power strip?", "4"),
    ("visible_objects_and_layout", "Resting on the cutting board are a carrot and peels.", "What is on the cutting board?", "carrot"),
    ("visible_objects_and_layout", "A quiet room.", "What object is explicitly mentioned in the layout?", "quiet room"),
    ("motion_and_event_cues", "At approximately frame 12, a hand enters the frame.", "What enters the frame at approximately frame 12?", "hand"),
    ("motion_and_event_cues", "No independent dynamic entities are seen.", "Are any independent dynamic entities recognized?", "No"),
    ("motion_and_event_cues", "Later on. A person enters the scene.", "What enters the scene?", "person"),
    ("audio_cues", "The audio changes from hum to a loud bang.", "What does the audio change to?", "loud bang"),
    ("cross_modal_details", "Here sounds align with chopping.", "What activity do the sounds align with?", "chopping"),
    ("scene_overview", "It shows a tidy workshop with tools.", "What setting is described in the scene overview?", "tidy workshop"),
    ("scene_overview", "Somewhere in an office.", "What setting is described in the scene overview?", "office room"),
    ("final_unified_caption", "It is a kitchen.", "What setting is described in the unified caption?", "kitchen counter"),
    ("final_unified_caption", "Nothing much.", "What does the unified caption describe?", "Nothing much"),
]


def test_captions_are_asked_about(spark):
    for section in {c[0] for c in CAPTIONS}:
        mine = [c for c in CAPTIONS if c[0] == section]
        rows = spark.createDataFrame([(c[1],) for c in mine], "caption string")
        q, a = fields.caption_question(section, F.col("caption"))
        got = {r["caption"]: (r["q"], r["a"]) for r in rows.select("caption", q.alias("q"), a.alias("a")).collect()}
        assert got == {c[1]: (c[2], c[3]) for c in mine}


def test_facts_are_asked_about(spark):
    rows = spark.createDataFrame([("count", "cups", "3", "x"), ("spatial_relation", "the cup", "left", "x"), ("scene", "", "", "said")], "fact_type string, entity string, value string, answer string")
    fact = F.struct(*[F.col(c) for c in rows.columns])
    got = {r["fact_type"]: r["q"] for r in rows.select("fact_type", fields.field_question("visible_objects_and_layout", F.lit("c"), fact).alias("q")).collect()}
    assert (got["count"]["question"], got["count"]["answer"]) == ("How many cups are identified?", "3")
    assert got["spatial_relation"]["question"] == "Where is the cup located?" and got["scene"]["answer"] == "said" and got["scene"]["qa_source"] == "semantic_fact"
    bare = rows.select(fields.field_question("audio_cues", F.lit("")).alias("q")).first()["q"]
    assert (bare["question"], bare["answer"], bare["qa_source"]) == ("", "", "generated_from_caption")


def test_sections_speak_for_modalities(spark):
    rel = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    one = spark.range(1)
    ask = lambda s, d: one.select(fields.primary_category(s, rel(d)).alias("x")).first()["x"]
    assert ask("visible_objects_and_layout", {"rgb": 0.1, "ir": 0.9}) == "rgb" and ask("visible_objects_and_layout", {"depth": 0.5, "ir": 0.5, "audio": 0.9}) == "ir"
    assert ask("motion_and_event_cues", {"event": 0.1, "rgb": 0.9}) == "event" and ask("audio_cues", {"ir": 0.2, "depth": 0.8}) == "depth" and ask("scene_overview", {"rgb": 1.0}) == "fused"


def test_counters_of_a_run(spark):
    kind = "outcome string, section string, sections array<string>, category string, modality string, outlier boolean, reason string, gate string, review_reasons array<string>, priority string, drop_reason string"
    rows = [
        ("selected", "counting", ["counting", "others", "counting"], "counting", "rgb", False, "passed", "soft", [], "none", None),
        ("selected", None, None, None, None, None, None, None, None, None, None),
        ("review", "counting", ["counting"], "counting", "ir", True, "passed", "soft", ["a", "b", "a"], "high", None),
        ("dropped", "counting", ["counting"], "counting", "ir", True, "score_gate", "soft", [], "none", "score_gate"),
        ("dropped", "counting", ["counting"], "counting", "ir", True, "passed", "soft", [], "none", "duplicate_exact_qa"),
        ("elsewhere", "x", ["x"], "x", "x", True, "x", "x", ["x"], "x", "x"),
    ]
    got = {(r["counter"], r["value"]): r["n"] for r in reports.fusion_counters(spark.createDataFrame(rows, kind)).collect()}
    assert got == {
        **{(c, v): 1 for c, v in [("section", "counting"), ("multi_section", "counting"), ("multi_section", "others"), ("category", "counting"), ("modality", "rgb"), ("selection_reason", "passed"), ("reliability_gate", "soft")]},
        **{(c, "unknown"): 1 for c in ("section", "category", "modality", "selection_reason", "reliability_gate")},
        ("outlier", "not_outlier"): 2, ("review", "no_review_flag"): 2,
        **{(c, v): 1 for c, v in [("review_section", "counting"), ("review_multi_section", "counting"), ("review_category", "counting"), ("review_modality", "ir"), ("review_priority", "high"), ("review_reason", "a"), ("review_reason", "b")]},
        ("dropped_reason", "score_gate"): 1, ("dropped_reason", "duplicate_exact_qa"): 1,
    }
    assert reports.fusion_counters(spark.createDataFrame([], kind)).collect() == []
