"""Section routing and captions from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text

# What a section's own rules add: (where to look, what for, how much), and the share and limit of keywords.
# Looked at are the category (anywhere in it), the question (its beginning), what is said (anywhere in it), or tokens (none of them).
ROUTE_RULES = {
    "scene_overview": [
        ("category", ["overview", "setting", "environment", "context"], 0.6),
        ("said", ["setting", "environment", "scene context", "overall scene"], 0.4),
        ("question", ["where", "how many", "what action", "what tool", "what object", "is ", "are ", "was "], -0.45),
        ("category", ["layout", "spatial", "count", "object", "motion", "event", "audio", "sound", "action", "dynamic"], -0.3),
    ],
    "visible_objects_and_layout": [
        ("category", ["layout", "spatial", "count", "object"], 0.55),
        ("question", ["where", "how many", "which object", "what object", "what item", "what brand", "what logo"], 0.45),
        ("category", ["scene", "overview", "audio", "sound", "motion", "event"], -0.15),
    ],
    "motion_and_event_cues": [
        ("category", ["dynamic", "action", "scene_sequence", "event_action", "event_dynamic", "event_scene", "motion"], 0.7),
        ("question", ["what action", "what tool do", "what am i doing", "what do i", "what does", "when"], 0.45),
        ("said", ["peel", "slice", "pick up", "put down", "grasp", "lift", "enter", "move"], 0.25),
        ("tokens", ["move", "motion", "moving", "enter", "lift", "reach", "pick", "grasp", "peel", "contact", "activity", "interaction", "hands"], -0.2),
    ],
    "audio_cues": [
        ("category", ["audio", "sound", "speech", "music", "noise"], 0.75),
        ("tokens", ["audio", "sound", "speech", "music", "noise", "silence", "scraping", "chopping", "rhythmic"], -0.3),
    ],
}
KEYWORD_SHARE = {"scene_overview": (0.05, 0.25), "visible_objects_and_layout": (0.08, 0.35), "motion_and_event_cues": (0.08, 0.35), "audio_cues": (0.1, 0.4)}
# Least score of a sentence, and how many a section takes; strict, relaxed.
LEAST = {False: 0.45, True: 0.2}
LIMITS = {
    False: {"scene_overview": 2, "visible_objects_and_layout": 3, "motion_and_event_cues": 2, "audio_cues": 2},
    True: {"scene_overview": 4, "visible_objects_and_layout": 6, "motion_and_event_cues": 4, "audio_cues": 4},
}


def words_of_interest() -> list[str]:
    """Every token that a route looks for."""
    own = [w for rules in ROUTE_RULES.values() for kind, words, _ in rules if kind == "tokens" for w in words]
    return sorted({*own, *(w for words in dims.ROUTE_KEYWORDS.values() for w in words)})


def route_score(section: str, modality: Column, category: Column, tokens: Column, reliability: Column, support: Column) -> Column:
    """How well evidence fits a section: modality, reliability, support, category and keywords; without the section's own rules."""
    base = F.lit(0.3)
    for m, w in zip(dims.FUSION_ORDER, dims.ROUTE_WEIGHTS.get(section, ()), strict=section in dims.ROUTES):
        base = F.when(modality == m, F.lit(w)).otherwise(base)
    hints = dims.ROUTE_HINTS.get(section, [])
    bonus = F.when(category.rlike("^(?:" + "|".join(hints) + ")"), 0.35).when(category.rlike("|".join(hints)), 0.25).otherwise(0.0) if hints else F.lit(0.0)
    outlier = F.when((reliability < 0.5) & (support < dims.MIN_SUPPORT), 1.0).otherwise(0.0)
    return base + reliability * 0.6 + support * 1.2 + bonus + F.least(F.lit(0.45), _hits(section, tokens) * 0.08) - outlier


def _hits(section: str, tokens: Column) -> Column:
    words = dims.ROUTE_KEYWORDS.get(section, [])
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) if words else F.lit(0)


def route_bonus(section: str, category: Column, question: Column, answer: Column, tokens: Column) -> Column:
    """What the section's own rules add."""
    q, said, key = F.lower(F.trim(question)), F.lower(F.concat_ws(" ", question, answer)), F.lower(category)
    holds = {
        "category": lambda words: key.rlike("|".join(words)),
        "said": lambda words: said.rlike("|".join(words)),
        "question": lambda words: q.rlike("^(?:" + "|".join(words) + ")"),
        "tokens": lambda words: ~F.arrays_overlap(tokens, F.array(*map(F.lit, words))),
    }
    share, most = KEYWORD_SHARE[section]
    out = F.least(F.lit(most), _hits(section, tokens) * share)
    for kind, words, amount in ROUTE_RULES[section]:
        out = out + F.when(holds[kind](words), amount).otherwise(0.0)
    return out


def routed(evidence: DataFrame, relaxed: bool = False) -> DataFrame:
    """evidence with section and section_score: the best of four; ties go to the later name, close calls to a known modality's own.

    evidence: modality, category, tokens, reliability, support_score, and question and answer if there are any. In
    relaxed mode the least score is lower and close calls stay with the best.
    """
    return placed(evidence, relaxed).filter(F.col("section_score") > LEAST[relaxed])


def placed(evidence: DataFrame, relaxed: bool = False) -> DataFrame:
    """As routed, with the evidence that fits nowhere; its section is null."""
    said = [F.coalesce(F.col(c), F.lit("")) if c in evidence.columns else F.lit("") for c in ("question", "answer")]
    args = [F.col(c) for c in ("modality", "category", "reliability", "support_score")]

    def ranked(words: Column) -> Column:
        m, c, r, v = args
        scores = [F.struct(F.round(route_score(s, m, c, words, r, v) + route_bonus(s, c, *said, words), 9).alias("score"), F.lit(s).alias("section")) for s in dims.ROUTES]
        return F.sort_array(F.array(*scores), asc=False)

    # sections look for few words, so the rest of the tokens is left behind once; one row out of each, and no filter moves below
    words = F.array_intersect("tokens", F.array(*map(F.lit, words_of_interest())))
    scored = evidence.select("*", F.explode(F.transform(F.array(words), ranked)).alias("_order"))
    scored = scored.withColumn("section_score", F.col("_order")[0]["score"])
    best = F.col("_order")[0]["section"]
    if not relaxed:
        own = F.when(F.col("modality") == "audio", F.lit("audio_cues")).when(F.col("modality") == "event", F.lit("motion_and_event_cues")).when(F.col("modality").isin("rgb", "ir", "depth"), F.lit("visible_objects_and_layout")).otherwise(best)
        best = F.when(F.round(F.col("_order")[0]["score"] - F.col("_order")[1]["score"], 9) < 0.02, own).otherwise(best)
    return scored.select(*evidence.columns, "section_score", F.when(F.col("section_score") > LEAST[relaxed], best).alias("section"))


def ended(sentence: Column) -> Column:
    """A sentence with one full stop."""
    return F.concat(F.regexp_replace(sentence, r"\.+$", ""), F.lit("."))


def joined(sentences: Column) -> Column:
    """Sentences with one full stop each, joined by spaces."""
    return F.array_join(F.transform(sentences, ended), " ")


#: Modalities that a section prefers, if any of them is there.
PREFERRED = {"audio_cues": ["audio"], "motion_and_event_cues": ["event", "rgb", "ir"], "visible_objects_and_layout": ["rgb", "ir", "depth"]}


# Categories of which a section takes evidence without its keywords.
NAMED = {"visible_objects_and_layout": "spatial|count|object", "motion_and_event_cues": "dynamic|action|scene_sequence|event_scene"}


def gathered(evidence: DataFrame, sections: list[str], relaxed: bool = False) -> DataFrame:
    """sample_id, reliable (its reliable modalities), all: its evidence, each with `fits`, the score for each of `sections` it may stand in.

    Evidence meets once, with its sentence, however many sections ask for it; tokens are hashes, of what may stand
    somewhere. Evidence without a sample is left out of the lists. Other columns of evidence that routes add are kept.

    evidence: sample_id, evidence_id, modality, category, tokens, reliability, support_score, and sentence, section and
    section_score if there are any.
    """
    args = [F.col(c) for c in ("modality", "category")], [F.col(c) for c in ("reliability", "support_score")]
    interest = F.array_intersect("tokens", F.array(*map(F.lit, words_of_interest())))

    def fit(section: str, words: Column) -> Column:
        score = F.round(route_score(section, *args[0], words, *args[1]), 9)
        takes = score > LEAST[relaxed]
        if not relaxed and section in dims.ROUTES:
            hit = _hits(section, words) > 0
            takes = takes & (hit | F.col("category").rlike(NAMED[section]) if section in NAMED else hit)
        return F.when(takes, score).alias(section)

    own = [c for c in ("sentence", "section", "section_score") if c in evidence.columns]
    rows = evidence.select("*", F.explode(F.transform(F.array(interest), lambda w: F.struct(*[fit(s, w) for s in sections]))).alias("fits"))
    used = F.coalesce(*[F.col(f"fits.{s}") for s in sections], *[F.when(F.col("section").isNotNull(), 1.0) for c in own if c == "section"]).isNotNull()
    keys = F.when(used, text.token_keys(F.col("tokens"))).otherwise(F.array().cast("array<bigint>")).alias("tokens")
    said = [F.when(used, F.col(c)).alias(c) if c == "sentence" else F.col(c) for c in own]
    one = F.struct(F.col("evidence_id").alias("id"), "modality", "fits", keys, *said)
    return rows.groupBy("sample_id").agg(  # within one sample
        F.collect_set(F.when(F.col("reliability") >= 0.5, F.col("modality"))).alias("reliable"),
        F.collect_list(F.when(F.col("sample_id").isNotNull(), one)).alias("all"),
    )


def ranked(every: Column, section: str, most: int, relaxed: bool = False) -> Column:
    """Of a sample's evidence (all of `gathered`), a section's by score, near-copies dropped, its preferred modalities if there are any."""
    from .selection import distinct_greedy

    fits = F.filter(every, lambda x: x["fits"][section].isNotNull())
    ordered = F.array_sort(F.transform(fits, lambda x: F.struct((-x["fits"][section]).alias("far"), *[x[c].alias(c) for c in ("id", "modality", "tokens", "sentence")])))
    preferred = (lambda x: F.coalesce(x["modality"].isin(PREFERRED[section]), F.lit(False))) if section in PREFERRED else None
    kept = distinct_greedy(ordered, 0.7, most, preferred)
    if section == "audio_cues":
        kept = F.when(F.exists(every, lambda x: F.coalesce(x["modality"] == "audio", F.lit(False))), kept).otherwise(F.slice(kept, 1, 0))
    return kept


def selected_sentences(evidence: DataFrame, section: str, most: int, relaxed: bool = False) -> DataFrame:
    """sample_id, rank, id: a section's sentences by score, near-copies dropped, its preferred modalities if there are any.

    evidence: sample_id, evidence_id, modality, category, tokens, reliability, support_score.
    """
    rows = evidence.drop("section", "section_score").withColumn("sentence", F.lit(None).cast("string"))
    lists = gathered(rows, [section], relaxed)
    return lists.select("sample_id", F.posexplode(ranked(F.col("all"), section, most, relaxed)).alias("pos", "k")).select("sample_id", (F.col("pos") + 1).alias("rank"), F.col("k.id").alias("evidence_id"))


# Lines on agreement: section, the pairs of modalities of which one must be reliable, the line's beginning.
AGREEMENT = [
    ("visible_objects_and_layout", [("rgb", "ir")], "RGB and IR cues agree on the visual layout: "),
    ("motion_and_event_cues", [("event", "rgb"), ("event", "ir")], "Event evidence is consistent with the observed motion: "),
    ("audio_cues", [("audio", "rgb"), ("audio", "ir"), ("audio", "event")], "Audio evidence matches the rest of the sample: "),
]


#: The sections whose evidence the lines on agreement are made of.
AGREEING = [*(section for section, _, _ in AGREEMENT), "cross_modal_details"]


def details(every: Column, reliable: Column, relaxed: bool = False) -> Column:
    """Up to two lines on what reliable modalities agree about, else the two best sentences of all. every, reliable: as from gathered."""
    lines = []
    for section, pairs, intro in AGREEMENT:
        agree = F.exists(F.array(*[F.array(*map(F.lit, p)) for p in pairs]), lambda p: F.size(F.array_intersect(p, reliable)) == 2)
        line = F.get(F.transform(ranked(every, section, 1, relaxed), lambda x: F.concat(F.lit(intro), ended(x["sentence"]))), F.lit(0))
        lines.append(F.when(agree, line))
    found = F.slice(F.array_compact(F.array(*lines)), 1, 2)
    rest = F.coalesce(joined(F.transform(ranked(every, "cross_modal_details", 2, relaxed), lambda x: x["sentence"])), F.lit(""))
    return F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(rest))[0]


def cross_modal_details(evidence: DataFrame, relaxed: bool = False) -> DataFrame:
    """sample_id, details: up to two lines on what reliable modalities agree about, else the two best sentences of all.

    evidence: as for selected_sentences, with sentence.
    """
    rows = gathered(evidence.drop("section", "section_score"), AGREEING, relaxed)
    return rows.select("sample_id", details(F.col("all"), F.col("reliable"), relaxed).alias("details"))


def section_captions(evidence: DataFrame, relaxed: bool = False) -> DataFrame:
    """sample_id and a caption for each section of the narrative, for agreement, and for the whole. evidence: as for routed, with sentence.

    A section's evidence goes by score, near copies dropped at 0.7 and again at 0.65, as many as its limit; the whole
    is the first sentence of each, near copies dropped at 0.55, four at most.
    """
    from .selection import distinct_twice

    def caption(section: str) -> Column:
        own = F.filter("all", lambda x: x["section"] == section)
        ordered = F.array_sort(F.transform(own, lambda x: F.struct((-x["section_score"]).alias("far"), x["id"].alias("id"), x["sentence"].alias("sentence"), x["tokens"].alias("tokens"))))
        return joined(F.transform(distinct_twice(ordered, 0.7, 0.65, LIMITS[relaxed][section]), lambda x: x["sentence"])).alias(section)

    rows = gathered(placed(evidence.drop("section", "section_score"), relaxed), AGREEING, relaxed)
    out = rows.select("sample_id", *map(caption, dims.ROUTES), details(F.col("all"), F.col("reliable"), relaxed).alias("cross_modal_details"))
    return out.withColumn("final_unified_caption", unified([F.col(c) for c in (*dims.ROUTES, "cross_modal_details")]))


def unified(captions: list[Column]) -> Column:
    """The first sentences of captions, near copies dropped, four at most."""
    from .selection import distinct_greedy

    first = F.array_compact(F.array(*[F.try_element_at(text.sentences(c), F.lit(1)) for c in captions]))
    told = F.transform(first, lambda s: F.struct(s.alias("said"), text.tokens(s).alias("tokens")))
    return text.clean(F.array_join(F.transform(distinct_greedy(told, 0.55, 4), lambda x: x["said"]), " "))
