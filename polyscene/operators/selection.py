"""Scores, gates, review reasons and greedy deduplication of question-answer evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from .support import modality_weight

# Categories that a question of each kind may have.
COUNTING = ["counting", "depth_counting", "depth_dynamic_counting", "dynamic_counting", "event_counting", "event_dynamic_counting"]
SPATIAL = ["depth_navigation", "depth_spatial_reasoning", "event_navigation", "event_spatial_reasoning", "navigation", "spatial_reasoning"]
AUDIO = ["audio_chronological_caption", "audio_hia"]
MOTION = ["action", "depth_action", "depth_dynamic_counting", "depth_dynamic_recognition", "depth_scene_sequence", "dynamic_counting", "dynamic_recognition", "event_action", "event_dynamic_counting", "event_dynamic_recognition", "event_scene_sequence", "scene_sequence"]
# Reasons of high and of medium priority.
HIGH = [
    "possible_numeric_conflict", "possible_direction_conflict", "possible_negation_conflict", "no_supporting_modality",
    "conflicting_support_detected", "only_complementary_support", "answer_repeats_question", "uncertain_answer",
]
MEDIUM = [
    "strict_category_low_lexical", "unparsed_numbered_block", "multi_clause_answer", "long_answer", "long_question",
    "semantic_high_lexical_low", "generic_answer", "unsupported_modality_match",
]


def gated(rows: DataFrame, relaxed: bool = False) -> DataFrame:
    """rows with score, keep, reason, gate. rows: category, modality, reliability, support_score, has_qa, qa_index.

    Relaxed mode asks for a lower score.
    """
    least = dims.RELAXED_SCORE if relaxed else dims.MIN_SCORE
    out = dims.with_category(rows)
    outlier = (F.col("reliability") < 0.5) & (F.col("support_score") < dims.MIN_SUPPORT)
    main = F.element_at("sections", 1)
    score = (
        modality_weight(F.col("profile"), F.col("modality")) + F.col("reliability") * 0.6 + F.col("support_score") * 1.2
        - F.when(F.col("known_category"), 0.0).otherwise(0.15) - F.when(outlier, 1.0).otherwise(0.0)
        + F.when(F.col("qa_index").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("has_qa"), 0.15).otherwise(0.0) - F.when(main == "others", 0.2).otherwise(0.0)
    )
    out = out.withColumn("outlier", outlier).withColumn("section", main).withColumn("score", score)
    gate, s, support = F.col("gate"), F.round("score", 9), F.round("support_score", 9)  # so that equal sums compare equal
    reason = (
        F.when(F.col("outlier"), F.lit("outlier"))
        .when(gate == "support_exempt", F.when(s >= min(dims.EXEMPT_SCORE, least), F.lit("passed_support_exempt_gate")).otherwise("score_gate"))
        .when(gate == "review_recommended", F.when(s >= dims.REVIEW_SCORE, F.lit("passed_review_gate")).otherwise("score_gate"))
        .when(s < least, F.lit("score_gate"))
        .when(gate == "support_soft", F.when((support >= dims.MIN_SUPPORT) | (s >= dims.HIGH_SCORE), F.lit("passed_support_soft_gate")).otherwise("low_cross_modal_support"))
        .when(support < dims.STRICT_SUPPORT, F.lit("low_cross_modal_support"))
        .otherwise("passed_support_required_gate")
    )
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason").startswith("passed_"))


def support_level(score: Column) -> Column:
    return F.when(score >= 0.45, F.lit("strong")).when(score >= dims.STRICT_SUPPORT, F.lit("moderate")).when(score >= dims.MIN_SUPPORT, F.lit("weak")).otherwise("very_weak")


def _when(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def mismatch_reasons(category: Column, question: Column, answer: Column) -> list[Column]:
    """Hints that a question belongs to another category."""
    q, both = F.lower(F.trim(question)), F.lower(F.concat_ws(" ", question, answer))
    return [
        _when(q.rlike("^how (?:many|much)") & ~category.isin(COUNTING), "category_mismatch_counting_hint"),
        _when(q.rlike("^(?:where|which side|in which direction)") & ~category.isin(SPATIAL), "category_mismatch_spatial_hint"),
        _when(both.rlike("brand|logo|word|text|written|sticker") & (category != "text_recognition"), "category_mismatch_text_hint"),
        _when(q.rlike("^(?:what|which) (?:sound|audio)") & ~category.isin(AUDIO), "category_mismatch_audio_hint"),
        _when(q.rlike("^(?:what action|what is happening|what occurs|what does|what do|when)") & ~category.isin(MOTION), "category_mismatch_motion_hint"),
    ]


def answer_reasons(question: Column, answer: Column) -> list[Column]:
    """Hints that an answer says little."""
    q, a = F.lower(text.clean(question)), F.lower(text.clean(answer))
    generic = a.isin(["it", "this", "that", "there", "object", "thing", "something", "unknown", "unclear", "none"])
    repeats = (q != "") & ((a == q) | ((F.instr(q, a) > 0) & (F.size(F.split(a, " ")) >= 5)))
    return [
        _when((a != "") & generic, "generic_answer"),
        _when((a != "") & a.rlike("not sure|unclear|cannot tell|can't tell|unknown|maybe|possibly"), "uncertain_answer"),
        _when((a != "") & repeats, "answer_repeats_question"),
    ]


def word_count(c: Column) -> Column:
    clean = text.clean(c)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def review_reasons(category: Column, question: Column, answer: Column, gate: Column, needs_lexical: Column, lexical: Column, semantic: Column, direct: Column, complementary: Column, conflicting: Column, weak: Column, other_answer: Column) -> Column:
    """Why a kept item needs a reviewer, in order. The counts are of modalities in each relation."""
    required = gate == "support_required"
    clauses = F.size(F.regexp_extract_all(F.lower(answer), F.lit(f"{text.EDGE}(?:and|or|while|because|then|followed by){text.END}"), F.lit(0)))
    other = F.coalesce(other_answer, F.lit(""))
    clash = [(text.number_tokens, "numeric"), (text.direction_tokens, "direction"), (text.polarity_tokens, "negation")]
    found = [
        _when(gate == "review_recommended", "anomaly_category"),
        _when((question == "") | (answer == ""), "caption_fallback"),
        _when(word_count(answer) > 12, "long_answer"),
        _when(word_count(question) > 35, "long_question"),
        _when((F.size(text.numbered_items(question)) > 0) | (F.size(text.numbered_items(answer)) > 0), "unparsed_numbered_block"),
        _when(clauses >= 2, "multi_clause_answer"),
        _when((semantic >= 0.75) & (lexical < 0.05), "semantic_high_lexical_low"),
        _when(needs_lexical & (lexical < 0.04), "strict_category_low_lexical"),
        _when(conflicting > 0, "conflicting_support_detected"),
        _when(required & (direct < 1) & (complementary > 0), "only_complementary_support"),
        _when((weak > 0) & (direct < 1), "unsupported_modality_match"),
        _when(required & (direct < 1), "no_supporting_modality"),
        *mismatch_reasons(category, question, answer),
        *answer_reasons(question, answer),
        *[_when(text.conflict(f(answer), f(other)), f"possible_{n}_conflict") for f, n in clash],
    ]
    return F.array_distinct(F.array_compact(F.array(*found)))


def review_priority(reasons: Column) -> Column:
    high = F.arrays_overlap(reasons, F.array(*map(F.lit, HIGH))) | F.exists(reasons, lambda r: r.startswith("category_mismatch_"))
    medium = F.arrays_overlap(reasons, F.array(*map(F.lit, MEDIUM)))
    return F.when(F.size(reasons) == 0, F.lit("none")).when(high, F.lit("high")).when(medium, F.lit("medium")).otherwise("low")


def deduplicated(items: DataFrame, keys: list[str], exact: bool = True, above: float | None = 0.85, cosine_from: float | None = None) -> DataFrame:
    """Each item with outcome: kept, duplicate_exact_qa, duplicate_similar_qa or duplicate_semantic_qa, and duplicate_of.

    items: keys, id, score, question, answer, tokens (and vector for cosine_from). Greedy by score, then id, within
    the keys: a kept item alone can make later ones duplicates. The fold's state is the kept items of one sample.
    """
    meaning, none = cosine_from is not None, F.lit("")  # what no stage asks for is not carried
    of = items.schema["id"].dataType.simpleString()
    vector = F.col("vector") if cosine_from is not None else F.lit(None).cast("array<double>")
    one = F.struct(
        (-F.col("score")).alias("far"), F.col("id").alias("id"), (F.lower(text.clean(F.col("question"))) if exact else none).alias("q"), (F.lower(text.clean(F.col("answer"))) if exact or meaning else none).alias("a"),
        (text.token_keys(F.col("tokens")) if above is not None else F.array().cast("array<bigint>")).alias("tokens"), (F.concat_ws(" ", "question", "answer") if meaning else none).alias("said"), vector.cast("array<double>").alias("vector"),
    )
    ordered = items.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))

    def judge(kept: Column, x: Column) -> Column:
        same = F.exists(kept, lambda k: (x["q"] != "") & (x["a"] != "") & (k["q"] == x["q"]) & (k["a"] == x["a"])) if exact else F.lit(False)
        near = F.exists(kept, lambda k: text.jaccard(x["tokens"], k["tokens"]) > above) if above is not None else F.lit(False)
        return F.when(same, F.lit("duplicate_exact_qa")).when(near, F.lit("duplicate_similar_qa"))

    def meant(kept: Column, x: Column) -> Column:
        if cosine_from is None:
            return F.lit(None).cast(of)
        dot = lambda k: F.aggregate(F.zip_with(x["vector"], k["vector"], lambda u, v: u * v), F.lit(0.0), lambda s, y: s + y)
        fits = F.filter(kept, lambda k: (dot(k) >= cosine_from) & ~duplicate_conflict(x["said"], k["said"]) & compatible(x["a"], k["a"]))
        best = F.try_element_at(F.array_sort(F.transform(fits, lambda k: F.struct((-dot(k)).alias("far"), k["far"].alias("f"), k["id"].alias("id")))), F.lit(1))
        return F.when(F.size(fits) > 0, best["id"]).cast(of)

    kind = f"array<struct<far:double,id:{of},q:string,a:string,tokens:array<bigint>,said:string,vector:array<double>>>"
    done = f"array<struct<id:{of},outcome:string,duplicate_of:{of}>>"
    zero = F.struct(F.array().cast(kind).alias("kept"), F.array().cast(done).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        first = judge(acc["kept"], x)
        twin = F.when(first.isNull(), meant(acc["kept"], x))
        outcome = F.coalesce(first, F.when(twin.isNotNull(), F.lit("duplicate_semantic_qa")), F.lit("kept"))
        row = F.struct(x["id"].cast(of).alias("id"), outcome.alias("outcome"), twin.alias("duplicate_of"))
        return F.struct(F.when(outcome == "kept", F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).cast(kind).alias("kept"), F.concat(acc["done"], F.array(row)).cast(done).alias("done"))

    folded = ordered.select(*keys, F.explode(F.aggregate(F.col("all").cast(kind), zero, step, lambda acc: acc["done"])).alias("d"))
    return folded.select(*keys, "d.*")


def duplicate_conflict(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for f in (text.number_tokens, text.direction_tokens, text.polarity_tokens):
        out = out | text.conflict(f(a), f(b))
    return out


def compatible(a: Column, b: Column) -> Column:
    """Whether two clean lower-case answers can say the same."""
    ta, tb = text.tokens(a), text.tokens(b)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = (F.size(F.split(short, " ")) >= 2) & (F.instr(long, short) > 0)
    words = (F.size(ta) > 0) & (F.size(tb) > 0) & ((text.jaccard(ta, tb) >= 0.7) | inside)
    return (a != "") & (b != "") & ((a == b) | (~text.yes_no(a) & ~text.yes_no(b) & words))


def too_like(x: Column, y: Column, above: float) -> Column:
    """Whether the tokens of two structs score above that; sets whose sizes lie too far apart are not compared."""
    a, b = x["tokens"], y["tokens"]
    return (F.least(F.size(a), F.size(b)) > F.greatest(F.size(a), F.size(b)) * above) & (text.jaccard(a, b) > above)


def distinct_greedy(ordered: Column, above: float, most: int | None = None, preferred: Callable[[Column], Column] | None = None) -> Column:
    """Of structs with tokens, those not too like an earlier kept one; at most so many, of preferred ones if any is kept."""
    empty = F.slice(ordered, 1, 0)
    use = lambda kept: kept if preferred is None else F.filter(kept, preferred)

    def step(acc: Column, x: Column) -> Column:
        like = F.exists(acc, lambda k: too_like(k, x, above))
        over = like if most is None else (F.size(use(acc)) >= most) | like  # what comes after is not asked for
        return F.when(over, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(ordered, empty, step)
    if preferred is not None:
        kept = F.transform(F.array(kept), lambda k: F.when(F.size(use(k)) > 0, use(k)).otherwise(k))[0]
    return kept if most is None else F.slice(kept, 1, most)


def distinct_twice(ordered: Column, above: float, again: float, most: int) -> Column:
    """The first of distinct_greedy at `again` over distinct_greedy at `above`, in one fold that ends once there are so many."""
    empty = F.slice(ordered, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        over = (F.size(acc["kept"]) >= most) | F.exists(acc["once"], lambda k: too_like(k, x, above))
        like = F.exists(acc["kept"], lambda k: too_like(k, x, again))
        longer = lambda c: F.concat(acc[c], F.array(x))
        return F.when(over, acc).otherwise(F.struct(longer("once").alias("once"), F.when(like, acc["kept"]).otherwise(longer("kept")).alias("kept")))

    return F.aggregate(ordered, F.struct(empty.alias("once"), empty.alias("kept")), step, lambda acc: acc["kept"])
