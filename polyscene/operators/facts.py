"""Facts that evidence states: what kind, about what, and what is said of it; and the best of them for each section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, text

# How a fact's type is told. The first row counts whose tests all hold. Tests look into the section's name
# (`section`: anywhere in it; `named`: it is an audio section), the question (`asked`: how it begins), the answer
# (`number`: one stands in it; `yes_no`: it is one) or all of it with the caption (`said`: anywhere; `alone`: as a word).
TYPE_RULES: list[tuple[dict[str, list[str]], str]] = [
    ({"named": ["audio"], "section": ["chronological", "temporal"]}, "audio_event"),
    ({"named": ["audio"], "section": ["source", "causality", "inferential"]}, "audio_causality"),
    ({"named": ["audio"]}, "sound"),
    ({"section": ["object_recognition"]}, "object_presence"),
    ({"section": ["spatial_reasoning", "navigation"]}, "spatial_relation"),
    ({"section": ["counting"]}, "count"),
    ({"section": ["dynamic_recognition", "scene_sequence"]}, "motion"),
    ({"section": ["action"]}, "action"),
    ({"section": ["light_recongnition", "light_recognition", "light_change"]}, "lighting"),
    ({"section": ["text_recognition"]}, "object_presence"),
    ({"section": ["non_common"]}, "non_common"),
    ({"said": ["sound", "audio", "scraping", "thwack"], "cause": ["cause", "result", "due to"]}, "audio_causality"),
    ({"said": ["sound", "audio", "scraping", "thwack"], "cause": ["characteristics", "texture", "tempo", "source", "identification"]}, "audio_event"),
    ({"said": ["sound", "audio", "scraping", "thwack"]}, "sound"),
    ({"said": ["light", "illumination", "brightness", "shadow", "luminous"]}, "lighting"),
    ({"asked": ["how many", "how much"]}, "count"),
    ({"number": []}, "count"),
    ({"asked": ["where", "which side", "in which direction"]}, "spatial_relation"),
    ({"said": ["to the left", "to the right", "on the", "in front", "behind", "above", "below"]}, "spatial_relation"),
    ({"asked": ["what action", "what is happening", "what occurs", "what does", "what do"]}, "action"),
    ({"said": ["enter", "lift", "grasp", "pick up", "move", "motion", "moving", "sequence"]}, "motion"),
    ({"asked": ["when", "at what frame"]}, "temporal"),
    ({"said": ["frame_"]}, "temporal"),
    ({"alone": ["frame"]}, "temporal"),
    ({"yes_no": []}, "verification"),
    ({"asked": ["is ", "are ", "was ", "were ", "did ", "does ", "do "]}, "verification"),
    ({"said": ["setting", "scene", "workspace", "kitchen", "room", "environment"]}, "scene"),
    ({"said": ["object", "device", "tool", "item", "carrot", "bowl", "knife", "peeler", "laptop", "hands"]}, "object_presence"),
    ({"said": ["match", "correspond", "consistent", "align", "reinforced", "cross modal"]}, "cross_modal"),
    ({"said": ["unsafe", "odd", "wrong", "uncommon", "non common", "impossible"]}, "non_common"),
]
OTHER_TYPE = "environment"
# What a fact of a type is about; other types are about a `fact`.
ATTRIBUTES = {
    "count": "count",
    "sound": "audio",
    "audio_event": "audio",
    "audio_causality": "audio",
    "lighting": "illumination",
    "verification": "truth_value",
    "action": "motion",
    "motion": "motion",
    "temporal": "time",
    "scene": "scene_type",
    "non_common": "anomaly",
    "cross_modal": "agreement",
    "spatial_relation": "location",
}
# Words that end what is counted, and words in an answer that make its question the thing that is placed.
COUNTED_UNTIL = ["are", "is", "do", "does", "appear", "visible", "present", "in", "on"]
COUNTED_CUT = ["are", "is", "do", "does", "move", "moves", "enter", "enters", "appear", "appears", "start", "starts", "begin", "begins", "in", "on", "at", "with", "during", "while", "to"]
PLACES = ["left", "right", "above", "below", "in front", "behind", "center", "middle"]
# Types that a section is made of, and those that it prefers.
EVERY_TYPE = ["scene", "environment", "object_presence", "spatial_relation", "count", "lighting", "action", "motion", "temporal", "sound", "audio_event", "audio_causality", "verification", "cross_modal", "non_common"]
SECTION_TYPES = {
    "scene_overview": ["scene", "environment", "object_presence", "lighting"],
    "visible_objects_and_layout": ["object_presence", "spatial_relation", "count", "non_common"],
    "motion_and_event_cues": ["action", "motion", "temporal", "verification"],
    "audio_cues": ["sound", "audio_event", "audio_causality"],
    "cross_modal_details": ["cross_modal"],
    "final_unified_caption": EVERY_TYPE,
}
PREFERRED_TYPES = {**SECTION_TYPES, "scene_overview": ["scene", "environment", "lighting", "object_presence", "count"]}
# A fact's confidence, and how many facts a section's graph takes; strict, relaxed.
CONFIDENCE = 0.85
GRAPH_LIMITS = {
    False: {"scene_overview": 2, "visible_objects_and_layout": 3, "motion_and_event_cues": 2, "audio_cues": 2},
    True: {"scene_overview": 4, "visible_objects_and_layout": 6, "motion_and_event_cues": 4, "audio_cues": 4},
}
# The verb of a fact's clause; other types are noted.
VERBS = {
    "object_presence": "grounds",
    "action": "captures",
    "motion": "captures",
    "sound": "captures",
    "audio_event": "captures",
    "audio_causality": "captures",
    "lighting": "describes",
    "verification": "confirms",
    "temporal": "anchors the event at",
    "non_common": "flags",
    "scene": "sets the scene as",
    "cross_modal": "links",
}


def fact_type(section: Column, question: Column, answer: Column, caption: Column) -> Column:
    """The type that TYPE_RULES give. Each text is put in lower case once."""
    whole = F.struct(F.lower(section).alias("section"), F.lower(F.trim(question)).alias("question"), answer.alias("answer"), F.lower(F.concat_ws(" ", section, question, answer, caption)).alias("said"))

    def rules(x: Column) -> Column:
        tests = {
            "named": lambda w: x["section"].rlike("|".join(f"^{v}|{v}_" for v in w)),
            "section": lambda w: x["section"].rlike("|".join(w)),
            "asked": lambda w: x["question"].rlike("^(?:" + "|".join(w) + ")"),
            "number": lambda _: x["answer"].rlike(f"{text.EDGE}[0-9]+{text.END}"),
            "yes_no": lambda _: text.yes_no(x["answer"]),
            "said": lambda w: x["said"].rlike("|".join(w)),
            "cause": lambda w: x["said"].rlike("|".join(w)),
            "alone": lambda w: x["said"].rlike(f"{text.EDGE}(?:{'|'.join(w)}){text.END}"),
        }
        out = F.lit(OTHER_TYPE)
        for needed, kind in reversed(TYPE_RULES):
            out = F.when(reduce(lambda a, b: a & b, (tests[t](w) for t, w in needed.items())), kind).otherwise(out)
        return out

    return F.get(F.transform(F.array(whole), rules), F.lit(0))


def attribute(question: Column, kind: Column) -> Column:
    """What the fact is about; the place of a part `of the` whole is relative."""
    relative = (kind == "spatial_relation") & F.lower(text.clean(question)).contains(" of the ")
    return F.when(relative, F.lit("relative_location")).otherwise(dims.choose(kind, ATTRIBUTES, "fact"))


def entity(question: Column, answer: Column, kind: Column) -> Column:
    """What the fact is of: the thing that is counted, the question of a time or of a place by direction, else the answer's first item."""
    first, asked = text.first_fragment(answer), text.clean(question)
    alone = lambda w: rf"{text.EDGE}(?:{'|'.join(w)}){text.END}"
    ends = "|".join([*(rf"\s+{w}{text.END}" for w in COUNTED_UNTIL), r"\?", "$"])
    counted = F.regexp_extract(asked, rf"(?i)how many\s+(.+?)(?:{ends})", 1)
    counted = text.clean(F.get(F.split(text.clean(counted), f"(?i){alone(COUNTED_CUT)}"), F.lit(0)))
    by_question = (kind == "temporal") | ((kind == "spatial_relation") & F.lower(first).rlike("|".join(PLACES)))
    named = F.when((kind == "count") & asked.rlike(rf"(?i)how many\s+."), counted).when(by_question, asked).otherwise(first)
    return F.when(first == "", F.lit("")).otherwise(named)


def value(answer: Column, caption: Column, kind: Column) -> Column:
    """What is said: the answer's first item, without an answer the caption, or the number in it of a count."""
    first, shown = text.first_fragment(answer), text.clean(caption)
    number = F.regexp_extract(shown, f"{text.EDGE}([0-9]+){text.END}", 1)
    truth = F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1 << 30)))
    of_caption = F.when((kind == "count") & (number != ""), number).otherwise(shown)
    return F.when(first == "", of_caption).when(kind == "verification", truth).otherwise(first)


TUPLE = ["modality", "section", "fact_type", "entity", "attribute", "value"]


def facts(evidence: DataFrame) -> DataFrame:
    """sample_id, id, the six columns of TUPLE, confidence, support, reliability, and the source's question, answer and caption.

    evidence: sample_id, evidence_id, modality, category, question, answer, caption, support_score, reliability. What
    several rows of a sample state alike is one fact, that of the first row.
    """
    q, a, c = (F.coalesce(x, F.lit("")) for x in ("question", "answer", "caption"))
    rows = evidence.select("sample_id", F.col("evidence_id").alias("id"), "modality", F.col("category").alias("section"), *[text.clean(x).alias(f"source_{n}") for n, x in (("question", q), ("answer", a), ("caption", c))], F.lit(CONFIDENCE).alias("confidence"), F.col("support_score").alias("support"), "reliability", fact_type(F.col("category"), q, a, c).alias("fact_type"))
    kind = F.col("fact_type")
    said = [F.col(f"source_{n}") for n in ("question", "answer", "caption")]
    rows = rows.withColumns({"entity": entity(said[0], said[1], kind), "attribute": attribute(said[0], kind), "value": value(said[1], said[2], kind)})
    rest = [x for x in rows.columns if x not in (*TUPLE, "sample_id", "id")]
    first = rows.groupBy("sample_id", *TUPLE).agg(F.min("id").alias("id"), F.min_by(F.struct(*rest), "id").alias("x"))
    return first.select("sample_id", "id", *TUPLE, *[F.col(f"x.{r}").alias(r) for r in rest])


def score(kind: Column, section: Column, confidence: Column, reliability: Column, support: Column, thing: Column) -> Column:
    """How well a fact suits a section."""
    listed = lambda table: F.array_contains(F.try_element_at(F.create_map(*[x for s, t in table.items() for x in (F.lit(s), F.array(*map(F.lit, t)))]), section), kind)
    of = lambda table, amount: F.when(F.coalesce(listed(table), F.lit(False)), amount).otherwise(0.0)
    wide = F.when((section == "cross_modal_details") & (F.size(F.split(text.clean(thing), " ")) > 1), 0.1).otherwise(0.0)
    return confidence * 0.8 + reliability * 0.6 + support * 0.5 + of(SECTION_TYPES, 0.7) + of(PREFERRED_TYPES, 0.35) + wide


def ranked(rows: DataFrame, sections: list[str]) -> DataFrame:
    """rows for each of the sections, of its types if a sample has any, else of all, each fact once, with for_section, score and rank.

    One exchange by sample and section serves all windows. A section of cross-modal details that has facts of its own
    type has no others.
    """
    each = rows.withColumn("for_section", F.explode(F.array(*map(F.lit, sections))))
    own = [F.col("for_section").eqNullSafe(s) & F.col("fact_type").isin(SECTION_TYPES[s]) for s in sections]
    here = Window.partitionBy("sample_id", "for_section")
    each = each.withColumn("_own", reduce(lambda a, b: a | b, own)).withColumn("_any", F.max("_own").over(here)).filter("_own or not _any")
    each = each.withColumn("score", score(*[F.col(c) for c in ("fact_type", "for_section", "confidence", "reliability", "support", "entity")])).filter("score > 0")
    once = Window.partitionBy("sample_id", "for_section", *[c for c in TUPLE if c != "section"]).orderBy("id")
    each = each.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    order = here.orderBy(F.round("score", 9).desc(), F.desc("confidence"), F.desc("reliability"), "modality", "id")
    return each.withColumn("rank", F.row_number().over(order)).drop("_own", "_any", "_n")


def top(rows: DataFrame, section: str, most: int) -> DataFrame:
    """The best facts of each sample in one section."""
    return ranked(rows, [section]).filter(F.col("rank") <= most)


def graph(rows: DataFrame, relaxed: bool = False) -> DataFrame:
    """The facts of each section's graph: as many as the section takes."""
    limits = GRAPH_LIMITS[relaxed]
    most = dims.choose(F.col("for_section"), limits, 0)
    return ranked(rows, list(limits)).filter(F.col("rank") <= most)


def clause(modality: Column, kind: Column, thing: Column, said: Column) -> Column:
    """A fact as a clause."""
    who, what = F.upper(modality), F.when(said != "", said).otherwise(thing)
    named = (thing != "") & (said != "") & ~text.looks_like_question(thing)
    words = lambda *parts: F.concat_ws(" ", who, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when((kind == "spatial_relation") & named, words("places", thing, said))
        .when((kind == "spatial_relation") & (said != ""), words("places", said))
        .when(kind == "count", words("counts", F.when(named, F.concat_ws(" ", said, thing)).otherwise(said)))
        .when(kind.isin(list(VERBS)), words(dims.choose(kind, VERBS, ""), what))
        .when(named & (F.lower(thing) != F.lower(said)), words("grounds", thing, "as", said))
        .otherwise(words("notes", what))
    )
