"""Questions and answers of a section: from a fact, from a caption's wording, or from the evidence itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Wordings of captions. Of each: expression (any case), question, answer; {n} is a group.
SETTINGS = [
    r"(?:view|shot) of the ([^.]+?)(?: prepared for| setup|\.|,)",
    r"shows (?:a|an) ([^.]+?)(?: with|\.|,)",
    r"shows (?:the )?([^.]+? room)(?: with|\.|,)",
    r"shows (?:the )?([^.]+? workspace)(?: with|\.|,)",
    r"shows (?:the )?([^.]+? counter)(?: prepared|\.|,)",
]
PLACES = {"kitchen": "kitchen counter", "office": "office room"}
BESIDE = "What is to the {1} of the {2}?"
ENTERS = (r"At approximately frame ([0-9]+), ([^.]+?) enter[s]? the frame", "What enters the frame at approximately frame {1}?", "{2}")
WORDINGS = {
    "visible_objects_and_layout": [
        (r"To the (right|left) of the ([^.]+?) (?:is|sits|stands|lies|are)\s+(?:a|an|the) ([^.]+?)(?:[.,]|$)", BESIDE, "{3}"),
        (r"The ([^.]+?) is located to the (right|left) of the ([^.]+?)(?:[.,]|$)", "What is to the {2} of the {3}?", "{1}"),
        (r"(?s)^(?=.*power strip).*?with ([0-9]+) outlets", "How many outlets are on the power strip?", "{1}"),
        (r"Resting on the cutting board are (?: |,|and )*([^ ,.][^.,]*?)(?: and |[.,]|$)", "What is on the cutting board?", "{1}"),
    ],
    "motion_and_event_cues": [
        (r"no independent dynamic entities", "Are any independent dynamic entities recognized?", "No"),
        ENTERS,
        (r"The sequence begins with ([^.]+?)(?:[.,]|$)", "What does the sequence begin with?", "{1}"),
        (r"(?<![^.])([^.]+?) enter[s]? the scene", "What enters the scene?", "{1}"),
    ],
    "audio_cues": [
        (r"audio changes from [^.]* to ([^.]+?)(?:[.,]|$)", "What does the audio change to?", "{1}"),
        (r"sound of ([^.]+?)(?:,| followed by|\.|$)", "What sound is described?", "{1}"),
        (r"audio features ([^.]+?)(?:[.,]|$)", "What sound is featured in the audio?", "{1}"),
    ],
    "cross_modal_details": [
        (r"reinforced by ([^.]+?) that make", "Which modality makes the scene clearer?", "{1}"),
        (r"Motion-based evidence matches ([^.]+?)(?:[.,]|$)", "What sequence do the motion cues match?", "{1}"),
        (r"sounds align with ([^.]+?)(?:[.,]|$)", "What activity do the sounds align with?", "{1}"),
    ],
    "final_unified_caption": [ENTERS],
}
# What is asked of a caption without such a wording, and of one that names a setting.
PLAIN = {
    "scene_overview": "What setting is described in the scene overview?",
    "visible_objects_and_layout": "What object is explicitly mentioned in the layout?",
    "motion_and_event_cues": "What motion cue is described?",
    "audio_cues": "What audio cue is described?",
    "cross_modal_details": "What cross-modal detail is stated?",
    "final_unified_caption": "What does the unified caption describe?",
}
UNIFIED_SETTING = "What setting is described in the unified caption?"
# What is asked of a fact in a section.
FACT_QUESTIONS = {
    "scene_overview": "What scene context is grounded by the semantic facts?",
    "visible_objects_and_layout": "What object or layout fact is grounded?",
    "motion_and_event_cues": "What motion or event cue is grounded?",
    "audio_cues": "What audio cue is grounded?",
    "cross_modal_details": "What cross-modal detail is supported by the facts?",
    "final_unified_caption": "What unified scene does the semantic graph describe?",
}
OTHER_FACT = "What semantic fact is grounded?"
# Narrative section of a report section.
NARRATIVE_SECTION = {
    "scene_and_context": "scene_overview",
    "temporal_sequence": "scene_overview",
    "motion_and_action": "motion_and_event_cues",
    "audio_understanding": "audio_cues",
}


def _group(caption: Column, pattern: str, k: int) -> Column:
    return F.trim(F.regexp_extract(caption, f"(?i){pattern}", k))


def _filled(template: str, caption: Column, pattern: str) -> Column:
    """The template with its groups put in."""
    parts = re.split(r"\{(\d)\}", template)
    return F.concat(*[_group(caption, pattern, int(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts) if p or k % 2])


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def _once(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def caption_question(section: str, caption: Column) -> tuple[Column, Column]:
    """Question and answer that a caption's wording gives in a section of the narrative; of unknown sections as of the whole."""
    both = _captioned(section if section in PLAIN else "final_unified_caption", caption)
    return both["question"], both["answer"]


def _captioned(section: str, caption: Column) -> Column:
    named = [(caption.rlike(f"(?i){p}"), F.lit(None).cast("string"), _group(caption, p, 1)) for p in SETTINGS]
    named += [(F.lower(caption).contains(word), F.lit(None).cast("string"), F.lit(place)) for word, place in PLACES.items()]
    rules = [(caption.rlike(f"(?i){p}"), _filled(q, caption, p), _filled(a, caption, p)) for p, q, a in WORDINGS.get(section, [])]
    if section in ("scene_overview", "final_unified_caption"):
        asked = UNIFIED_SETTING if section == "final_unified_caption" else PLAIN[section]
        rules = [(c, F.lit(asked), a) for c, _, a in named] + rules
    # the first wording that fits; what it names is trimmed once
    found = _first([(c, F.struct(q.alias("q"), a.alias("a"))) for c, q, a in rules], F.struct(F.lit(PLAIN[section]).alias("q"), caption.alias("a")))
    trimmed = lambda x: _once(F.struct(x["q"].alias("q"), text.trim_answer(x["a"]).alias("a")), lambda y: F.struct(text.clean(y["q"]).alias("question"), F.when(y["a"] != "", y["a"]).otherwise(text.trim_answer(caption)).alias("answer")))
    return _once(found, trimmed)


def fact_question(section: str, kind: Column, entity: Column, value: Column, source_answer: Column) -> tuple[Column, Column]:
    """Question and answer that a fact gives in a section."""
    e, v = F.trim(entity), F.trim(value)
    last = F.lit("") if section == "visible_objects_and_layout" else source_answer
    question, answer = F.lit(FACT_QUESTIONS.get(section, OTHER_FACT)), F.when(v != "", v).when(e != "", e).otherwise(last)
    if section == "visible_objects_and_layout":
        both = (e != "") & (v != "")
        where, many = F.concat(F.lit("Where is "), e, F.lit(" located?")), F.concat(F.lit("How many "), e, F.lit(" are identified?"))
        question = F.when(both & (kind == "spatial_relation"), where).when(both & (kind == "count"), many).otherwise(question)
    return text.clean(question), text.clean(F.when(answer != "", answer).otherwise(source_answer))


def field_question(section: str, caption: Column, fact: Column | None = None) -> Column:
    """question, answer, qa_source of a section's caption. fact: the section's best fact (fact_type, entity, value, answer), or null."""
    made = _captioned(section if section in PLAIN else "final_unified_caption", caption).withField("qa_source", F.lit("generated_from_caption"))
    blank = F.struct(F.lit("").alias("question"), F.lit("").alias("answer"), F.lit("generated_from_caption").alias("qa_source"))
    if fact is not None:
        fq, fa = fact_question(section, *[fact[c] for c in ("fact_type", "entity", "value", "answer")])
        made = F.when(fact.isNotNull(), F.struct(fq.alias("question"), fa.alias("answer"), F.lit("semantic_fact").alias("qa_source"))).otherwise(made)
    return F.when(F.coalesce(caption, F.lit("")) == "", blank).otherwise(made)


def evidence_question(section: Column, question: Column, answer: Column, caption: Column) -> Column:
    """An evidence's own question and answer if it has both, else those of its caption in its report section."""
    own = F.struct(question.alias("question"), answer.alias("answer"), F.lit("original_modality").alias("qa_source"))
    first = None
    for s in dict.fromkeys(NARRATIVE_SECTION.values()):
        made = field_question(s, caption).withField("qa_source", F.lit("caption_fallback"))
        names = [k for k, v in NARRATIVE_SECTION.items() if v == s]
        first = F.when(section.isin(names), made) if first is None else first.when(section.isin(names), made)
    last = field_question("visible_objects_and_layout", caption).withField("qa_source", F.lit("caption_fallback"))
    return F.when((question != "") & (answer != ""), own).otherwise(first.otherwise(last))


def supporting(reliability: Column) -> Column:
    """Modalities of a map from modality to reliability, the most reliable first; ties in order of display, then of name."""
    from ..functions import dims

    one = F.transform(F.map_entries(reliability), lambda e: F.struct((-e["value"]).alias("far"), dims.display_rank(e["key"]).alias("rank"), e["key"].alias("modality")))
    return F.transform(F.array_sort(one), lambda x: x["modality"])


def primary_category(section: str, reliability: Column) -> Column:
    """The modality that a section speaks for, or `fused`. reliability: of the sample's modalities, as a map."""
    order = supporting(reliability)
    best = F.coalesce(F.get(order, F.lit(0)), F.lit("fused"))
    visual = F.filter(order, lambda m: m.isin("rgb", "ir", "depth"))
    seen = F.when(F.array_contains(visual, "rgb"), F.lit("rgb")).otherwise(F.coalesce(F.get(visual, F.lit(0)), best))
    if section == "visible_objects_and_layout":
        return seen
    if section == "motion_and_event_cues":
        return F.when(F.array_contains(order, "event"), F.lit("event")).otherwise(seen)
    if section == "audio_cues":
        return F.when(F.array_contains(order, "audio"), F.lit("audio")).otherwise(best)
    return F.lit("fused")
