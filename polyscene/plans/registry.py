"""The registered queries of the evidence engine and their SQL.

Every query runs over whole tables and whole texts. Doubles are rounded to six places
and arrays joined to strings on both sides, so that results compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, text, variants
from ..operators import align, cascade, export, facts, fields, matching, models, narrative, reports, resume, runs, segments, selection, support
from ..operators import evidence as ev
from ..sources import files, store
from . import adapters as ad
from . import fusion

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV, PAIRS, QA, TRACES, RECORDINGS = ad.EVIDENCE, f"{ad.EVIDENCE}, {ad.PAIRS}", ad.QUESTIONS, ad.TRACES, ad.RECORDINGS
TOKENS, CLEAN, JACCARD = ad.TOKENS, ad.CLEAN, ad.JACCARD
LAGS = 24
#: Traces are hourly; priors count seconds, so hours stand for seconds here.
REFERENCE = "view"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(c) -> F.Column:
    return F.round(c, 6)


def case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


# --- evidence ---------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a result file holds them: a row a clip and modality with its annotations by category."""
    rows = ad.evidence(spark, d)
    one = F.struct("category", F.struct(F.col("caption"), F.lit("").alias("question"), F.lit(None).cast("string").alias("answer")).alias("a"))
    lists = rows.groupBy("sample_id", "modality").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("annotations"))  # four a clip and modality
    return lists.select("modality", F.concat(F.lit("Day\\Scene-"), F.col("sample_id").cast("string"), F.lit("_night_"), F.col("modality"), F.lit(".mp4")).alias("pair_key"), "annotations")


@query(f"WITH {EV} SELECT 'scene_' || sample_id AS sample_id, modality, category, length(caption) AS caption_chars, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok WHERE caption <> ''")
def evidence_explode(spark, d):
    rows = ev.explode_annotations(_results(spark, d))
    return rows.select("sample_id", "modality", "category", F.length("caption").cast("long").alias("caption_chars"), F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_RAW = "concat('dataset\\', source, '_split\\Day_', lang, '-', doc_id % 7, CASE doc_id % 3 WHEN 0 THEN '_night_' WHEN 1 THEN '_day_' ELSE '_' END, ['rgb','ir','event','audio','depth'][doc_id % 5 + 1], CASE WHEN doc_id % 2 = 0 THEN '.mp4' ELSE '' END)"
_STEM = "lower(regexp_replace(base, '\\.[^.]*$', ''))"


@query(
    f"WITH k AS (SELECT doc_id, {_RAW} AS raw FROM documents), b AS (SELECT *, split_part(replace(raw, '\\', '/'), '/', -1) AS base FROM k), "
    f"s1 AS (SELECT *, regexp_replace(regexp_replace({_STEM}, '_(rgb|ir|event|depth|audio)$', ''), '^(rgb|ir|event|depth|audio)_', '') AS st FROM b), "
    "s2 AS (SELECT *, regexp_replace(regexp_replace(st, '_(night|day)$', ''), '^(night|day)_', '') AS st2 FROM s1), "
    "s3 AS (SELECT *, trim(regexp_replace(replace(regexp_replace(st2, '_(night|day)_(rgb|ir|event|depth|audio)$', ''), '-', '_'), '_+', '_', 'g'), '_') AS st3 FROM s2), "
    f"p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_STEM}, '_night|_day', '', 'g'), 'night|day', '', 'g'), '__+', '_', 'g'), '_') AS pst FROM s3) "
    "SELECT doc_id, st3 AS fusion_key, regexp_replace(base, '_(rgb|ir|event|depth|audio)$', '') AS reasoning_key, regexp_extract(replace(raw, '\\', '/'), '^(.*)/[^/]*$', 1) || '/' || pst AS pair_key FROM p"
)
def normalize_key(spark, d):
    docs, one = ad.table(spark, d, "documents"), F.col("doc_id")
    side = F.when(one % 3 == 0, "_night_").when(one % 3 == 1, "_day_").otherwise("_")
    raw = F.concat(F.lit("dataset\\"), "source", F.lit("_split\\Day_"), "lang", F.lit("-"), (one % 7).cast("string"), side, F.element_at(F.array(*map(F.lit, dims.FUSION_ORDER)), (one % 5 + 1).cast("int")), F.when(one % 2 == 0, ".mp4").otherwise(""))
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", text.fusion_key(F.col("raw")).alias("fusion_key"), text.reasoning_key(F.col("raw")).alias("reasoning_key"), text.pair_key(F.col("raw")).alias("pair_key"))


_NIGHT = " ".join(f"WHEN night AND modality = '{m}' THEN {c}::DOUBLE" for m, c in dims.NIGHT_CONFIDENCE.items())


@query(
    f"WITH {EV}, n AS (SELECT *, evidence_id % 3 = 0 AS night FROM evidence) SELECT evidence_id, (CASE WHEN modality = 'depth' AND regexp_matches(lower(caption), '{'|'.join(dims.UNCERTAIN_PHRASES)}') THEN 0.35::DOUBLE "
    f"{_NIGHT} ELSE {case('modality', {m: f'{c}::DOUBLE' for m, c in dims.CONFIDENCE.items()}, '0.5::DOUBLE')} END) AS confidence FROM n"
)
def confidence_rules(spark, d):
    where = F.when(F.col("evidence_id") % 3 == 0, F.lit("clip_Night_3")).otherwise("clip_3")
    return ad.evidence(spark, d).select("evidence_id", ev.confidence(F.col("modality"), where, F.col("caption")).alias("confidence"))


@query(f"WITH {EV} SELECT t AS token, count(*) AS n_rows, count(DISTINCT modality) AS n_modalities FROM (SELECT modality, unnest(tokens) AS t FROM tok) GROUP BY 1")
def tokenize(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d)).select("modality", F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n_rows"), F.countDistinct("modality").alias("n_modalities"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY conv_id, turn) AS n FROM (SELECT c.*, 'x' AS lang FROM conversations c)), k AS (SELECT conv_id, turn, role, 'audio_' || CASE WHEN trim(regexp_replace(lower(trim(role || ' ' || conv_id % 3 || '!')), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'qa_pair' ELSE trim(regexp_replace(lower(trim(role || ' ' || conv_id % 3 || '!')), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, slug ORDER BY turn) AS n FROM k) SELECT conv_id, turn, CASE WHEN n > 1 THEN slug || '_' || n ELSE slug END AS section FROM r")
def audio_sections(spark, d):
    rows = ad.table(spark, d, "conversations").withColumn("kind", F.concat("role", F.lit(" "), (F.col("conv_id") % 3).cast("string"), F.lit("!")))
    return ev.numbered_sections(rows, ["conv_id"], "kind", ["turn"]).select("conv_id", "turn", "section")


@query(f"WITH {EV}, k AS (SELECT sample_id, modality, min(evidence_id) AS key FROM evidence GROUP BY 1, 2), r AS (SELECT *, {case('modality', {m: i for i, m in enumerate(dims.REASONING_ORDER)}, '99')} AS rank FROM k), u AS (SELECT sample_id, count(*) AS n_units FROM evidence WHERE caption <> '' GROUP BY 1) SELECT r.sample_id, string_agg(modality || '=' || key, ',' ORDER BY rank) AS source_keys, any_value(coalesce(n_units, 0)) AS n_units FROM r LEFT JOIN u USING (sample_id) GROUP BY 1")
def sample_merge(spark, d):
    units = ad.evidence(spark, d).select("sample_id", "modality", F.col("evidence_id").alias("raw_key"), F.col("category").alias("section"), "caption", F.col("evidence_id").alias("ord"))
    keys = F.array_join(F.transform(F.map_entries("source_keys"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return ev.merged_samples(units).select("sample_id", keys.alias("source_keys"), F.size("units").cast("long").alias("n_units"))


# --- support ----------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT sample_id, modality, other_modality, count(*) AS n_pairs, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM pairs GROUP BY 1, 2, 3")
def jaccard_pairs(spark, d):
    p = support.pairs(ad.with_tokens(ad.evidence(spark, d)))
    return p.groupBy("sample_id", "modality", "other_modality").agg(F.count("*").alias("n_pairs"), six(F.max("score")).alias("best"), six(F.avg("score")).alias("mean"))


@query(f"WITH {PAIRS} SELECT evidence_id, other_modality, other_evidence_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id, other_modality ORDER BY score DESC, other_evidence_id) AS n FROM pairs WHERE score > 0) WHERE n = 1")
def best_match(spark, d):
    p = matching.best_pairs(ad.with_tokens(ad.evidence(spark, d)))
    return p.select("evidence_id", "other_modality", "other_evidence_id", six("score").alias("score"))


_WORDS = "words AS (SELECT sample_id, modality, list_distinct(flatten(list(tokens))) AS w FROM tok GROUP BY 1, 2), anchors AS (SELECT sample_id, list(t) AS a FROM (SELECT sample_id, t FROM (SELECT sample_id, modality, unnest(tokens) AS t FROM tok) GROUP BY 1, 2 HAVING count(DISTINCT modality) >= 2) GROUP BY 1), over_ AS (SELECT a.sample_id, a.modality, coalesce(avg(CASE WHEN len(b.w) > 0 THEN " + JACCARD.format("a.w", "b.w") + " END), 0.0) AS o FROM words a JOIN words b ON a.sample_id = b.sample_id AND a.modality <> b.modality GROUP BY 1, 2), rel AS (SELECT w.sample_id, w.modality, CASE WHEN o IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.15::DOUBLE + o * 2.5::DOUBLE + (CASE WHEN a IS NULL THEN 1.0::DOUBLE ELSE len(list_intersect(w.w, a))::DOUBLE / len(a) END) * 1.3::DOUBLE)) END AS reliability FROM words w LEFT JOIN over_ USING (sample_id, modality) LEFT JOIN anchors USING (sample_id))"


@query(f"WITH {EV}, {_WORDS} SELECT sample_id, modality, round(reliability, 6) AS reliability FROM rel")
def anchor_reliability(spark, d):
    return support.reliability(ad.with_tokens(ad.evidence(spark, d))).select("sample_id", "modality", six("reliability").alias("reliability"))


_CAT = "cat(category, gate, profile, lexical_weight, needs_lexical, section, sections) AS (VALUES " + ", ".join(f"('{c}', '{r[0]}', '{r[1]}', {r[2]}::DOUBLE, {str(r[3]).lower()}, '{r[4][0]}', {ad.quoted(r[4])})" for c, r in sorted(dims.CATEGORIES.items())) + ")"
_PROF = "prof(profile, modality, weight, direct, complementary) AS (VALUES " + ", ".join(f"('{p}', '{m}', {x}::DOUBLE, {str(m in dims.PROFILE_SUPPORT[p][0]).lower()}, {str(m in dims.PROFILE_SUPPORT[p][1]).lower()})" for p, w in dims.PROFILE_WEIGHTS.items() for m, x in zip(dims.FUSION_ORDER, w, strict=True)) + ")"
_RANK = case("other_modality", dims.DISPLAY_ORDER, "99")


def _listed(relation: str, least: float) -> str:
    return f"coalesce(string_agg(other_modality, ',' ORDER BY score DESC, {_RANK}, other_modality) FILTER (WHERE relation = '{relation}' AND score >= {least}), '')"


_RELATED = (
    f"{_CAT}, {_PROF}, bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id, other_modality ORDER BY score DESC, other_evidence_id) AS n FROM pairs WHERE score > 0) WHERE n = 1), "
    "related AS (SELECT bm.sample_id, bm.evidence_id, bm.modality, bm.other_modality, round(bm.score, 3) AS score, CASE WHEN direct THEN 'direct_support' WHEN complementary THEN 'complementary_support' ELSE 'weak_or_irrelevant' END AS relation FROM bm JOIN evidence e ON e.evidence_id = bm.evidence_id JOIN cat ON cat.category = e.category JOIN prof ON prof.profile = cat.profile AND prof.modality = bm.other_modality), "
    "lex AS (SELECT evidence_id, max(score) AS lexical FROM pairs GROUP BY 1), "
    f"sup AS (SELECT evidence_id, greatest(coalesce(max(score) FILTER (WHERE relation = 'direct_support'), 0.0::DOUBLE), 0.5::DOUBLE * coalesce(max(score) FILTER (WHERE relation = 'complementary_support'), 0.0::DOUBLE)) AS support, {_listed('direct_support', dims.SUPPORTING)} AS supporting, {_listed('complementary_support', dims.SUPPORTING)} AS complementary, {_listed('weak_or_irrelevant', dims.MIN_SUPPORT)} AS weak FROM related GROUP BY 1), "
    "supported AS (SELECT e.sample_id, e.evidence_id, e.modality, e.category, coalesce(lexical, 0.0::DOUBLE) AS lexical_score, coalesce(support, 0.0::DOUBLE) AS support_score, coalesce(supporting, '') AS supporting, coalesce(complementary, '') AS complementary, coalesce(weak, '') AS weak FROM evidence e LEFT JOIN lex USING (evidence_id) LEFT JOIN sup USING (evidence_id))"
)


@query(f"WITH {PAIRS}, {_RELATED} SELECT evidence_id, round(lexical_score, 6) AS lexical_score, round(support_score, 6) AS support_score, supporting, complementary, weak FROM supported")
def support_relations(spark, d):
    rows = tokenised(spark, d)
    out = support.support(rows, matching.best_pairs(rows))
    return out.select("evidence_id", six("lexical_score").alias("lexical_score"), six("support_score").alias("support_score"), "supporting", "complementary", "weak")


@query("WITH v AS (SELECT vec_id, vec_id // 20 AS sample_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other_id, list_dot_product(a.e, b.e) AS cos FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 9) DESC, other_id) AS n FROM p) SELECT vec_id, other_id, round(cos, 6) AS cosine, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cos - 0.4::DOUBLE) / 0.5::DOUBLE)), 6) AS semantic_score FROM r WHERE n = 1")
def semantic_support(spark, d):
    v = ad.table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("s"), "embedding")
    o = v.select("s", F.col("vec_id").alias("other_id"), F.col("embedding").alias("o"))
    p = v.join(o, "s").filter("vec_id <> other_id").withColumn("cos", support.cosine(F.col("embedding"), F.col("o")))
    best = p.groupBy("vec_id").agg(F.max_by(F.struct("other_id", "cos"), F.struct(F.round("cos", 9), -F.col("other_id"))).alias("b"))
    return best.select("vec_id", "b.other_id", six("b.cos").alias("cosine"), six(support.semantic_score(F.col("b.cos"))).alias("semantic_score"))


# --- selection --------------------------------------------------------------

_GATED = (
    f"{_WORDS}, scored AS (SELECT s.*, cat.gate, cat.profile, cat.section, cat.needs_lexical, cat.sections, reliability, reliability < 0.5 AND support_score < {dims.MIN_SUPPORT} AS outlier, "
    f"weight + reliability * 0.6::DOUBLE + support_score * 1.2::DOUBLE - (CASE WHEN reliability < 0.5 AND support_score < {dims.MIN_SUPPORT} THEN 1.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN s.evidence_id % 2 = 0 THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN s.evidence_id % 3 > 0 THEN 0.15 ELSE 0.0 END)::DOUBLE AS raw FROM supported s JOIN cat USING (category) JOIN prof ON prof.profile = cat.profile AND prof.modality = s.modality JOIN rel ON rel.sample_id = s.sample_id AND rel.modality = s.modality), "
    f"gated AS (SELECT *, CASE WHEN outlier THEN 'outlier' WHEN gate = 'support_exempt' THEN CASE WHEN round(raw, 9) >= {dims.EXEMPT_SCORE} THEN 'passed_support_exempt_gate' ELSE 'score_gate' END WHEN gate = 'review_recommended' THEN CASE WHEN round(raw, 9) >= {dims.REVIEW_SCORE} THEN 'passed_review_gate' ELSE 'score_gate' END WHEN round(raw, 9) < {dims.MIN_SCORE} THEN 'score_gate' WHEN gate = 'support_soft' THEN CASE WHEN support_score >= {dims.MIN_SUPPORT} OR round(raw, 9) >= {dims.HIGH_SCORE} THEN 'passed_support_soft_gate' ELSE 'low_cross_modal_support' END WHEN support_score < {dims.STRICT_SUPPORT} THEN 'low_cross_modal_support' ELSE 'passed_support_required_gate' END AS reason FROM scored)"
)


def tokenised(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its tokens, made once, as several steps read them."""
    rows = ad.with_tokens(ad.evidence(spark, d)).select("sample_id", "evidence_id", "modality", "category", "tokens")
    return store.stored(rows, "tokens")


def gated_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tokenised(spark, d)
    scored = support.support(rows, matching.best_pairs(rows)).join(support.reliability(rows), ["sample_id", "modality"])
    qa = F.when(F.col("evidence_id") % 2 == 0, F.col("evidence_id")).alias("qa_index")
    return selection.gated(scored.select("*", qa, (F.col("evidence_id") % 3 > 0).alias("has_qa")))


@query(f"WITH {PAIRS}, {_RELATED}, {_GATED} SELECT evidence_id, section, gate, round(raw, 6) AS score, reason, CASE WHEN support_score >= 0.45 THEN 'strong' WHEN support_score >= 0.12 THEN 'moderate' WHEN support_score >= 0.08 THEN 'weak' ELSE 'very_weak' END AS support_level FROM gated")
def gate_decision(spark, d):
    return gated_rows(spark, d).select("evidence_id", "section", "gate", six("score").alias("score"), "reason", selection.support_level(F.col("support_score")).alias("support_level"))


_NUM = "list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[0-9]+')), list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda t: list_contains(" + ad.quoted(text.NUMBER_WORDS) + ", t)))))"
_WORD = "regexp_matches(lower({0}), '(^|[^\\p{{L}}\\p{{N}}_])({1})($|[^\\p{{L}}\\p{{N}}_])')"
_COUNT = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"


def _reason(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


_REASONS = [
    _reason("gate = 'review_recommended'", "anomaly_category"),
    _reason("question = '' OR answer = ''", "caption_fallback"),
    _reason(f"{_COUNT.format('answer')} > 12", "long_answer"),
    _reason(f"{_COUNT.format('question')} > 35", "long_question"),
    _reason("len(list_filter(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}_]+'), lambda t: list_contains(['and', 'or', 'while', 'because', 'then'], t))) >= 2", "multi_clause_answer"),
    _reason("regexp_matches(lower(question), '^how (many|much)') AND NOT list_contains(" + ad.quoted(selection.COUNTING) + ", category)", "category_mismatch_counting_hint"),
    _reason("regexp_matches(lower(question), '^(where|which side|in which direction)') AND NOT list_contains(" + ad.quoted(selection.SPATIAL) + ", category)", "category_mismatch_spatial_hint"),
    _reason("regexp_matches(lower(question || ' ' || answer), 'brand|logo|word|text|written|sticker') AND category <> 'text_recognition'", "category_mismatch_text_hint"),
    _reason("regexp_matches(lower(question), '^(what|which) (sound|audio)') AND NOT list_contains(" + ad.quoted(selection.AUDIO) + ", category)", "category_mismatch_audio_hint"),
    _reason("regexp_matches(lower(question), '^(what action|what is happening|what occurs|what does|what do|when)') AND NOT list_contains(" + ad.quoted(selection.MOTION) + ", category)", "category_mismatch_motion_hint"),
    _reason("list_contains(['it', 'this', 'that', 'there', 'object', 'thing', 'something', 'unknown', 'unclear', 'none'], lower(answer))", "generic_answer"),
    _reason("regexp_matches(lower(answer), 'not sure|unclear|cannot tell|can''t tell|unknown|maybe|possibly')", "uncertain_answer"),
    _reason(f"answer <> '' AND question <> '' AND (lower(answer) = lower(question) OR (contains(lower(question), lower(answer)) AND {_COUNT.format('answer')} >= 5))", "answer_repeats_question"),
]
#: number and item of texts with two or more markers such as `1.`.
_ITEMS = (
    "(CASE WHEN len(regexp_extract_all({0}, '(^| )([0-9]+)\\. *', 2)) >= 2 THEN list_filter(list_transform(range(1, len(regexp_extract_all({0}, '(^| )([0-9]+)\\. *', 2)) + 1), lambda i: "
    "{{'n': try_cast(regexp_extract_all({0}, '(^| )([0-9]+)\\. *', 2)[i] AS INT), 't': trim(string_split(regexp_replace({0}, '(^| )[0-9]+\\. *', chr(1), 'g'), chr(1))[i + 1], ' .;')}}), lambda x: x.t <> '') ELSE [] END)"
)
_REVIEW = f"{QA}, {_CAT}, rr AS (SELECT conv_id, turn, list_filter([{', '.join(_REASONS)}], lambda x: x IS NOT NULL) AS reasons FROM qa JOIN cat USING (category))"


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    rows = dims.with_category(ad.questions(spark, d))
    n = lambda x: F.lit(x)
    reasons = selection.review_reasons(F.col("category"), F.col("question"), F.col("answer"), F.col("gate"), F.lit(False), n(1.0), n(0.0), n(1), n(0), n(0), n(0), F.col("answer"))
    return rows.select("conv_id", "turn", F.array_remove(reasons, "unparsed_numbered_block").alias("reasons"))


@query(f"WITH {_REVIEW} SELECT conv_id, turn, array_to_string(reasons, ',') AS reasons FROM rr")
def review_reasons(spark, d):
    return _reviewed(spark, d).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_REVIEW} SELECT conv_id, turn, CASE WHEN len(reasons) = 0 THEN 'none' WHEN len(list_filter(reasons, lambda r: list_contains({ad.quoted(selection.HIGH)}, r) OR starts_with(r, 'category_mismatch_'))) > 0 THEN 'high' WHEN len(list_intersect(reasons, {ad.quoted(selection.MEDIUM)})) > 0 THEN 'medium' ELSE 'low' END AS priority FROM rr")
def review_priority(spark, d):
    return _reviewed(spark, d).select("conv_id", "turn", selection.review_priority(F.col("reasons")).alias("priority"))


@query(f"WITH {QA} SELECT conv_id, turn, array_to_string({_NUM.format('answer')}, ',') AS numbers, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(answer), '[a-z]+'), lambda t: list_contains({ad.quoted(text.DIRECTIONS)}, t)))), ',') AS directions, array_to_string(list_filter([CASE WHEN {_WORD.format('answer', 'no|false|not|none|absent|invisible|without')} THEN 'negative' END, CASE WHEN {_WORD.format('answer', 'yes|true|visible|present')} THEN 'positive' END], lambda x: x IS NOT NULL), ',') AS polarity FROM qa")
def conflict_tokens(spark, d):
    a = F.col("answer")
    return ad.questions(spark, d).select("conv_id", "turn", F.array_join(text.number_tokens(a), ",").alias("numbers"), F.array_join(text.direction_tokens(a), ",").alias("directions"), F.array_join(text.polarity_tokens(a), ",").alias("polarity"))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, lower(caption) ORDER BY evidence_id) AS n FROM evidence) SELECT evidence_id, CASE WHEN n = 1 THEN 'kept' ELSE 'duplicate_exact_qa' END AS outcome FROM r")
def dedup_exact(spark, d):
    rows = ad.evidence(spark, d)
    items = rows.select("sample_id", F.col("evidence_id").alias("id"), F.lit(1.0).alias("score"), F.col("caption").alias("question"), F.col("caption").alias("answer"), F.array().cast("array<string>").alias("tokens"))
    return selection.deduplicated(items, ["sample_id"], above=None).select(F.col("id").alias("evidence_id"), "outcome")


def _fold(above: float, order: str) -> str:
    j = JACCARD.format("x[1].tokens", "k.tokens")
    return f"list_reduce(list_prepend([]::STRUCT(evidence_id BIGINT, tokens VARCHAR[])[], list([{{'evidence_id': evidence_id, 'tokens': tokens}}] ORDER BY {order})), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {j} > {above})) > 0 THEN acc ELSE list_concat(acc, x) END)"


@query(f"WITH {EV}, f AS (SELECT sample_id, unnest({_fold(0.85, 'evidence_id')}) AS k FROM tok GROUP BY sample_id) SELECT sample_id, k.evidence_id AS evidence_id FROM f")
def dedup_lexical(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d))
    items = rows.select("sample_id", F.col("evidence_id").alias("id"), F.lit(1.0).alias("score"), F.lit("").alias("question"), F.lit("").alias("answer"), "tokens")
    kept = selection.deduplicated(items, ["sample_id"], exact=False, above=0.85).filter("outcome = 'kept'")
    return kept.select("sample_id", F.col("id").alias("evidence_id"))


_TWIN = "list_filter(acc.kept, lambda k: list_dot_product(x.item.v, k.v) >= 0.9 AND k.label = x.item.label)"


@query(
    "WITH v AS (SELECT vec_id // 20 AS sample_id, vec_id, 'label ' || label % 2 AS label, (CASE WHEN vec_id % 4 = 3 THEN (SELECT e.embedding FROM embeddings e WHERE e.vec_id = o.vec_id - 1) ELSE embedding END)::DOUBLE[] AS v FROM embeddings o), "
    "f AS (SELECT sample_id, list_reduce(list_prepend({'kept': []::STRUCT(id BIGINT, label VARCHAR, v DOUBLE[])[], 'done': []::STRUCT(id BIGINT, twin BIGINT)[], 'item': NULL::STRUCT(id BIGINT, label VARCHAR, v DOUBLE[])}, list({'kept': []::STRUCT(id BIGINT, label VARCHAR, v DOUBLE[])[], 'done': []::STRUCT(id BIGINT, twin BIGINT)[], 'item': {'id': vec_id, 'label': label, 'v': v}} ORDER BY vec_id)), "
    f"lambda acc, x: {{'kept': CASE WHEN len({_TWIN}) > 0 THEN acc.kept ELSE list_append(acc.kept, x.item) END, 'done': list_append(acc.done, {{'id': x.item.id, 'twin': CASE WHEN len({_TWIN}) > 0 THEN list_sort(list_transform({_TWIN}, lambda k: {{'far': round(-list_dot_product(x.item.v, k.v), 9), 'id': k.id}}))[1].id END}}), 'item': NULL::STRUCT(id BIGINT, label VARCHAR, v DOUBLE[])}}).done AS done FROM v GROUP BY 1), "
    "u AS (SELECT sample_id, unnest(done) AS x FROM f) SELECT sample_id, x.id AS vec_id, CASE WHEN x.twin IS NULL THEN 'kept' ELSE 'duplicate_semantic_qa' END AS outcome, coalesce(x.twin, -1) AS duplicate_of FROM u"
)
def dedup_semantic(spark, d):
    """Every fourth vector is the one before it, so that there are twins; their answers agree or not."""
    v = ad.table(spark, d, "embeddings")
    before = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    v = v.join(before, "vec_id", "left").withColumn("embedding", F.when(F.col("vec_id") % 4 == 3, F.col("before")).otherwise(F.col("embedding")))
    answer = F.concat(F.lit("label "), (F.col("label") % 2).cast("string"))
    items = v.select(F.floor(F.col("vec_id") / 20).alias("sample_id"), F.col("vec_id").alias("id"), F.lit(1.0).alias("score"), F.lit("what is shown").alias("question"), answer.alias("answer"), F.array().cast("array<string>").alias("tokens"), F.col("embedding").cast("array<double>").alias("vector"))
    return selection.deduplicated(items, ["sample_id"], exact=False, above=None, cosine_from=0.9).select("sample_id", F.col("id").alias("vec_id"), "outcome", F.coalesce("duplicate_of", F.lit(-1).cast("long")).alias("duplicate_of"))


# --- the fusion run ------------------------------------------------------------

QAEV, QAPAIRS = ad.QA_EVIDENCE, f"{ad.QA_EVIDENCE}, {ad.PAIRS}"
_DIRS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda t: list_contains({ad.quoted(text.DIRECTIONS)}, t))))"
def _polar(c: str) -> str:
    return f"list_filter([CASE WHEN {_WORD.format(c, 'no|false|not|none|absent|invisible|without')} THEN 'negative' END, CASE WHEN {_WORD.format(c, 'yes|true|visible|present')} THEN 'positive' END], lambda x: x IS NOT NULL)"


_CLASHES = [("nums", "numeric"), ("dirs", "direction"), ("pol", "negation")]


def _sets(column: str, prefix: str) -> str:
    return ", ".join(f"{f} AS {prefix}{n}" for f, n in ((_NUM.format(column), "nums"), (_DIRS.format(column), "dirs"), (_polar(column), "pol")))


def _clash(a: str, b: str, prefix: str, n: str) -> str:
    return f"(len({a}.{prefix}{n}) > 0 AND len({b}.{prefix}{n}) > 0 AND {a}.{prefix}{n} <> {b}.{prefix}{n})"


def _size(names: str) -> str:
    return f"(CASE WHEN {names} = '' THEN 0 ELSE len(string_split({names}, ',')) END)"


_FUSION = (
    f"{_CAT}, {_PROF}, says AS (SELECT evidence_id, {TOKENS.format('question')} AS qtok, {_sets('s', 's_')}, {_sets('answer', 'a_')} FROM (SELECT evidence_id, question, answer, question || ' ' || answer AS s FROM evidence)), "
    "bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id, other_modality ORDER BY score DESC, other_evidence_id) AS n FROM pairs WHERE score > 0) WHERE n = 1), "
    f"related AS (SELECT bm.evidence_id, bm.other_modality, round(bm.score, 3) AS score, CASE WHEN bm.score >= 0.7 AND ({' OR '.join(_clash('x', 'y', 's_', n) for n, _ in _CLASHES)}) AND {JACCARD.format('x.qtok', 'y.qtok')} >= 0.45 THEN 'conflict' WHEN direct THEN 'direct_support' WHEN complementary THEN 'complementary_support' ELSE 'weak_or_irrelevant' END AS relation "
    "FROM bm JOIN evidence e ON e.evidence_id = bm.evidence_id JOIN cat ON cat.category = e.category JOIN prof ON prof.profile = cat.profile AND prof.modality = bm.other_modality JOIN says x ON x.evidence_id = bm.evidence_id JOIN says y ON y.evidence_id = bm.other_evidence_id), "
    "lex AS (SELECT evidence_id, score AS lexical, CASE WHEN score > 0 THEN other_evidence_id END AS match_id FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY score DESC, other_evidence_id) AS n FROM pairs) WHERE n = 1), "
    f"sup AS (SELECT evidence_id, greatest(coalesce(max(score) FILTER (WHERE relation = 'direct_support'), 0.0::DOUBLE), 0.5::DOUBLE * coalesce(max(score) FILTER (WHERE relation = 'complementary_support'), 0.0::DOUBLE)) AS support, {_listed('direct_support', dims.SUPPORTING)} AS supporting, {_listed('complementary_support', dims.SUPPORTING)} AS complementary, {_listed('conflict', dims.MIN_SUPPORT)} AS conflicting, {_listed('weak_or_irrelevant', dims.MIN_SUPPORT)} AS weak FROM related GROUP BY 1), "
    f"{_WORDS}, scored AS (SELECT e.*, cat.gate, cat.section, cat.sections AS cat_sections, cat.needs_lexical, coalesce(lexical, 0.0::DOUBLE) AS lexical_score, match_id, coalesce(support, 0.0::DOUBLE) AS support_score, coalesce(supporting, '') AS supporting, coalesce(sup.complementary, '') AS complementary, coalesce(conflicting, '') AS conflicting, coalesce(weak, '') AS weak, "
    f"reliability, reliability < 0.5 AND coalesce(support, 0.0::DOUBLE) < {dims.MIN_SUPPORT} AS outlier, weight + reliability * 0.6::DOUBLE + coalesce(support, 0.0::DOUBLE) * 1.2::DOUBLE - (CASE WHEN reliability < 0.5 AND coalesce(support, 0.0::DOUBLE) < {dims.MIN_SUPPORT} THEN 1.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN qa_index IS NOT NULL THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN question <> '' AND answer <> '' THEN 0.15 ELSE 0.0 END)::DOUBLE AS raw "
    "FROM evidence e LEFT JOIN lex USING (evidence_id) LEFT JOIN sup USING (evidence_id) JOIN cat USING (category) JOIN prof ON prof.profile = cat.profile AND prof.modality = e.modality JOIN rel ON rel.sample_id = e.sample_id AND rel.modality = e.modality), "
    + _GATED[_GATED.index("gated AS ("):]
    + ", why AS (SELECT g.*, list_filter(["
    + ", ".join([
        *_REASONS[:4],
        _reason(f"len({_ITEMS.format('g.question')}) > 0 OR len({_ITEMS.format('g.answer')}) > 0", "unparsed_numbered_block"),
        _REASONS[4],
        _reason("needs_lexical AND lexical_score < 0.04", "strict_category_low_lexical"),
        _reason(f"{_size('conflicting')} > 0", "conflicting_support_detected"),
        _reason(f"gate = 'support_required' AND {_size('supporting')} < 1 AND {_size('complementary')} > 0", "only_complementary_support"),
        _reason(f"{_size('weak')} > 0 AND {_size('supporting')} < 1", "unsupported_modality_match"),
        _reason(f"gate = 'support_required' AND {_size('supporting')} < 1", "no_supporting_modality"),
        *_REASONS[5:],
        *[_reason(f"match_id IS NOT NULL AND {_clash('x', 'y', 'a_', n)}", f"possible_{name}_conflict") for n, name in _CLASHES],
    ])
    + "], lambda x: x IS NOT NULL) AS found FROM gated g JOIN says x ON x.evidence_id = g.evidence_id LEFT JOIN says y ON y.evidence_id = g.match_id), "
    "kept AS (SELECT *, starts_with(reason, 'passed_') AS keep, CASE WHEN starts_with(reason, 'passed_') THEN found ELSE [] END AS reasons FROM why), "
    f"clean AS (SELECT k.sample_id, k.evidence_id, round(raw, 9) AS score, lower(question) AS q, lower(answer) AS a, tokens FROM kept k JOIN (SELECT evidence_id, tokens FROM tok) t USING (evidence_id) WHERE keep AND len(reasons) = 0), "
    f"folds AS (SELECT sample_id, list_reduce(list_prepend([]::STRUCT(id BIGINT, q VARCHAR, a VARCHAR, tokens VARCHAR[])[], list([{{'id': evidence_id, 'q': q, 'a': a, 'tokens': tokens}}] ORDER BY score DESC, evidence_id)), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (x[1].q <> '' AND x[1].a <> '' AND k.q = x[1].q AND k.a = x[1].a) OR {JACCARD.format('x[1].tokens', 'k.tokens')} > 0.85)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM clean GROUP BY 1), "
    "winners AS (SELECT sample_id, unnest(kept).id AS evidence_id FROM folds), twins AS (SELECT c.evidence_id, bool_or(w.score > c.score OR (w.score = c.score AND w.evidence_id < c.evidence_id)) FILTER (WHERE w.q = c.q AND w.a = c.a AND c.q <> '' AND c.a <> '') AS equal FROM clean c LEFT JOIN (SELECT clean.* FROM clean JOIN winners USING (sample_id, evidence_id)) w ON w.sample_id = c.sample_id WHERE c.evidence_id NOT IN (SELECT evidence_id FROM winners) GROUP BY 1), "
    "fused AS (SELECT k.*, CASE WHEN NOT keep OR twins.evidence_id IS NOT NULL THEN 'dropped' WHEN len(reasons) > 0 THEN 'review' ELSE 'selected' END AS outcome, CASE WHEN NOT keep THEN reason WHEN twins.evidence_id IS NOT NULL THEN CASE WHEN equal THEN 'duplicate_exact_qa' ELSE 'duplicate_similar_qa' END END AS drop_reason, "
    f"CASE WHEN len(reasons) = 0 THEN 'none' WHEN len(list_filter(reasons, lambda r: list_contains({ad.quoted(selection.HIGH)}, r) OR starts_with(r, 'category_mismatch_'))) > 0 THEN 'high' WHEN len(list_intersect(reasons, {ad.quoted(selection.MEDIUM)})) > 0 THEN 'medium' ELSE 'low' END AS priority FROM kept k LEFT JOIN twins USING (evidence_id))"
)


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT evidence_id, outcome, coalesce(drop_reason, '') AS drop_reason, array_to_string(reasons, ',') AS review_reasons, priority, round(raw, 6) AS score, support_score, supporting, complementary, conflicting, weak FROM fused")
def fusion_outcomes(spark, d):
    rows, _ = fusion.judged(ad.qa_evidence(spark, d))
    return rows.select("evidence_id", "outcome", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"), F.array_join("review_reasons", ",").alias("review_reasons"), "priority", six("score").alias("score"), "support_score", "supporting", "complementary", "conflicting", "weak")


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT 'outcome' AS dimension, outcome AS value, count(*) AS n FROM fused GROUP BY 2 UNION ALL SELECT 'drop_reason', drop_reason, count(*) FROM fused WHERE drop_reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM fused WHERE outcome = 'review' GROUP BY 2 UNION ALL SELECT 'review_reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM fused WHERE outcome = 'review') GROUP BY 2")
def fusion_diagnostics(spark, d):
    return fusion.fuse(ad.qa_evidence(spark, d)).diagnostics()


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT sample_id, evidence_id, row_number() OVER (PARTITION BY sample_id ORDER BY round(raw, 9) DESC, evidence_id) AS position FROM fused WHERE outcome = 'review'")
def review_queue(spark, d):
    return fusion.fuse(ad.qa_evidence(spark, d)).review.select("sample_id", "evidence_id", F.col("position").cast("long").alias("position"))


# --- sections and reasoning --------------------------------------------------

_SECTION_ROWS = ", ".join(f"('{s}')" for s in dims.SECTIONS)


@query(f"WITH {EV}, {_CAT}, s AS (SELECT unnest(cat.sections) AS section FROM evidence JOIN cat USING (category)), every(section) AS (VALUES {_SECTION_ROWS}) SELECT every.section, count(s.section) AS n FROM every LEFT JOIN s USING (section) GROUP BY 1")
def sections_explode(spark, d):
    return reports.grouped_by_section(dims.with_category(ad.evidence(spark, d)))


_GROUP_ROWS = ", ".join(f"('{s}', '{g}')" for s, g in dims.section_groups())


@query(f"WITH {EV}, known(section, reasoning_group) AS (VALUES {_GROUP_ROWS}), r AS (SELECT modality, coalesce(reasoning_group, 'ungrouped') AS reasoning_group FROM evidence LEFT JOIN known ON known.section = category), grid AS (SELECT g AS reasoning_group, m AS modality FROM (SELECT unnest({ad.quoted(dims.GROUPS)}) AS g), (SELECT unnest({ad.quoted(dims.REASONING_ORDER)}) AS m)) SELECT grid.reasoning_group, grid.modality, count(r.modality) AS n FROM grid LEFT JOIN r ON r.reasoning_group = grid.reasoning_group AND r.modality = grid.modality GROUP BY 1, 2")
def reasoning_groups(spark, d):
    return reports.reasoning_counts(ad.evidence(spark, d).select(text.section_name(F.col("category")).alias("section"), "modality"))


def _routes() -> str:
    parts = []
    for s in dims.ROUTES:
        base = case("modality", {m: f"{w}::DOUBLE" for m, w in zip(dims.FUSION_ORDER, dims.ROUTE_WEIGHTS[s], strict=True)}, "0.3::DOUBLE")
        hints = "|".join(dims.ROUTE_HINTS[s])
        hits = f"len(list_intersect(tokens, {ad.quoted(dims.ROUTE_KEYWORDS[s])}))::DOUBLE"
        add = lambda c, x: f"(CASE WHEN {c} THEN {x} ELSE 0.0 END)::DOUBLE"
        has = lambda p: f"regexp_matches(lower(category), '{p}')"
        any_ = lambda *w: f"len(list_intersect(tokens, {ad.quoted(list(w))})) > 0"
        own = {
            "scene_overview": f"{add(has('overview|setting|environment|context'), 0.6)} + least(0.25::DOUBLE, {hits} * 0.05::DOUBLE) - {add(has('layout|spatial|count|object|motion|event|audio|sound|action|dynamic'), 0.3)}",
            "visible_objects_and_layout": f"{add(has('layout|spatial|count|object'), 0.55)} + least(0.35::DOUBLE, {hits} * 0.08::DOUBLE) - {add(has('scene|overview|audio|sound|motion|event'), 0.15)}",
            "motion_and_event_cues": f"{add(has('dynamic|action|scene_sequence|event_scene|motion'), 0.7)} + least(0.35::DOUBLE, {hits} * 0.08::DOUBLE) - {add('NOT ' + any_(*'move motion moving enter lift reach pick grasp peel contact activity interaction hands'.split()), 0.2)}",
            "audio_cues": f"{add(has('audio|sound|speech|music|noise'), 0.75)} + least(0.4::DOUBLE, {hits} * 0.1::DOUBLE) - {add('NOT ' + any_(*'audio sound speech music noise silence scraping chopping rhythmic'.split()), 0.3)}",
        }[s]
        bonus = f"(CASE WHEN regexp_matches(category, '^({hints})') THEN 0.35 WHEN regexp_matches(category, '{hints}') THEN 0.25 ELSE 0.0 END)::DOUBLE"
        parts.append(f"{{'score': round({base} + 0.6::DOUBLE + {bonus} + least(0.45::DOUBLE, {hits} * 0.08::DOUBLE) + {own}, 9), 'section': '{s}'}}")
    return f"list_reverse_sort([{', '.join(parts)}])"


@query(f"WITH {EV}, r AS (SELECT evidence_id, modality, {_routes()} AS o FROM tok) SELECT evidence_id, round(o[1].score, 6) AS section_score, CASE WHEN round(o[1].score - o[2].score, 9) < 0.02 THEN CASE modality WHEN 'audio' THEN 'audio_cues' WHEN 'event' THEN 'motion_and_event_cues' ELSE 'visible_objects_and_layout' END ELSE o[1].section END AS section FROM r WHERE o[1].score > 0.45")
def section_route(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d)).select("evidence_id", "modality", "category", "tokens", F.lit(1.0).alias("reliability"), F.lit(0.0).alias("support_score"))
    return narrative.routed(rows).select("evidence_id", six("section_score").alias("section_score"), "section")


# --- splitting ---------------------------------------------------------------

_NUMBERED = "n AS (SELECT conv_id, turn, '1. ' || question || ' 2) ' || answer || ' 3. ' || conv_id AS t FROM qa)"


@query(f"WITH {QA}, {_NUMBERED}, s AS (SELECT conv_id, turn, string_split(regexp_replace(' ' || t, '[ \\t\\n\\r\\f][0-9]+[.)][ \\t\\n\\r\\f]+', chr(1), 'g'), chr(1)) AS p FROM n), i AS (SELECT conv_id, turn, list_filter(list_transform(p[2:], lambda x: trim(x)), lambda x: x <> '') AS items FROM s) SELECT conv_id, turn, len(items) AS n_items, md5(array_to_string(items, '|')) AS items_md5 FROM i")
def split_numbered(spark, d):
    rows = ad.questions(spark, d).select("conv_id", "turn", F.concat(F.lit("1. "), "question", F.lit(" 2) "), "answer", F.lit(" 3. "), F.col("conv_id").cast("string")).alias("t"))
    items = text.numbered_text(F.col("t"))
    return rows.select("conv_id", "turn", F.size(items).cast("long").alias("n_items"), F.md5(F.array_join(items, "|")).alias("items_md5"))


_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH {QA}, s AS (SELECT conv_id, turn, {_SENT.format('answer')} AS a, {_SENT.format('question')} AS q FROM qa), p AS (SELECT conv_id, turn, unnest(range(1, greatest(len(q), len(a)) + 1)) AS pair_index, q, a FROM s) SELECT conv_id, turn, pair_index, md5(coalesce(q[pair_index], '')) AS question_md5, md5(coalesce(a[pair_index], '')) AS answer_md5 FROM p")
def evidence_units_split(spark, d):
    rows = ad.questions(spark, d).select("conv_id", "turn", text.sentences(F.col("question")).alias("q"), text.sentences(F.col("answer")).alias("a"))
    pairs = F.zip_with("q", "a", lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("q"), F.coalesce(y, F.lit("")).alias("a")))
    out = rows.select("conv_id", "turn", F.posexplode(pairs).alias("pos", "p"))
    return out.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pair_index"), F.md5("p.q").alias("question_md5"), F.md5("p.a").alias("answer_md5"))


@query(f"WITH {QA}, x AS (SELECT conv_id, turn, trim(regexp_replace(question, '[?]', '', 'g')) || ' ?' AS q1, trim(regexp_replace(answer, '[?]', '', 'g')) AS a1 FROM qa), s AS (SELECT conv_id, turn, {_SENT.format('a1')} AS a, q1, a1 FROM x), p AS (SELECT conv_id, turn, [trim(q1[:-2]) || '?', 'why?'] AS q, CASE WHEN len(a) > 1 THEN a WHEN a1 = '' THEN []::VARCHAR[] ELSE [a1] END AS a FROM s) SELECT conv_id, turn, greatest(len(q), len(a)) AS n_pairs, md5(array_to_string(q, '|')) AS questions_md5, md5(array_to_string(a, '|')) AS answers_md5 FROM p")
def split_qa_pairs(spark, d):
    bare = lambda c: F.trim(F.regexp_replace(c, r"\?", ""))
    rows = ad.questions(spark, d).select("conv_id", "turn", F.concat(bare("question"), F.lit(" ? why?")).alias("q"), bare("answer").alias("a"))
    rows = rows.select("conv_id", "turn", text.exported_pairs(F.col("q"), F.col("a")).alias("p"))
    side = lambda f: F.md5(F.array_join(F.filter(F.transform("p", lambda x: x[f]), lambda x: x != ""), "|"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n_pairs"), side("question").alias("questions_md5"), side("answer").alias("answers_md5"))


#: A third of the questions as they are, a third numbered alike on both sides, a third with one number that differs.
_LISTED = "CASE conv_id % 3 WHEN 0 THEN {0} WHEN 1 THEN '1. ' || {0} || ' 2. next ' || turn ELSE '4. ' || {0} || ' {1}. last' END"
_PAIRED = (
    "CASE WHEN len(q) = 0 OR len(a) = 0 THEN whole WHEN len(matched) > 0 THEN matched WHEN len(q) = len(a) THEN list_transform(range(1, len(q) + 1), lambda i: {'n': q[i].n, 'q': q[i].t, 'a': a[i].t}) ELSE whole END"
)


@query(
    f"WITH {QA}, n AS (SELECT conv_id, turn, {CLEAN.format(_LISTED.format('question', '9'))} AS qx, {CLEAN.format(_LISTED.format('answer', '8'))} AS ax FROM qa), i AS (SELECT *, {_ITEMS.format('qx')} AS q, {_ITEMS.format('ax')} AS a, CASE WHEN qx <> '' AND ax <> '' THEN [{{'n': NULL::INT, 'q': qx, 'a': ax}}] ELSE [] END AS whole FROM n), "
    "m AS (SELECT *, list_filter(list_transform(q, lambda x: {'n': x.n, 'q': x.t, 'a': list_filter(a, lambda y: y.n = x.n)[-1].t}), lambda x: x.a IS NOT NULL) AS matched FROM i), "
    f"p AS (SELECT conv_id, turn, {_PAIRED} AS p FROM m) SELECT conv_id, turn, len(p) AS n_pairs, md5(coalesce(array_to_string(list_transform(p, lambda x: coalesce(x.n::VARCHAR, '') || '|' || x.q || '|' || x.a), '#'), '')) AS pairs_md5 FROM p"
)
def fused_pairs(spark, d):
    third = F.col("conv_id") % 3
    listed = lambda c, n: text.clean(F.when(third == 0, F.col(c)).when(third == 1, F.concat(F.lit("1. "), c, F.lit(" 2. next "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("4. "), c, F.lit(f" {n}. last"))))
    rows = ad.questions(spark, d).select("conv_id", "turn", text.fused_pairs(listed("question", 9), listed("answer", 8)).alias("p"))
    said = F.transform("p", lambda x: F.concat_ws("|", F.coalesce(x["number"].cast("string"), F.lit("")), x["question"], x["answer"]))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n_pairs"), F.md5(F.array_join(said, "#")).alias("pairs_md5"))


# --- reports -----------------------------------------------------------------


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT modality, count(*) AS candidate_count, count(*) FILTER (WHERE outcome = 'selected') AS selected_count, count(*) FILTER (WHERE outcome = 'review') AS review_count, count(*) FILTER (WHERE outcome = 'dropped') AS dropped_count, round(round(avg(support_score), 9), 3) AS avg_support, round(round(avg(lexical_score), 9), 3) AS avg_lexical, round(round(avg({_size('supporting')}), 9), 3) AS avg_supporting, round(avg(support_score), 9) < 0.12 OR avg({_size('supporting')}) < 0.5 AS needs_review FROM fused GROUP BY 1")
def modality_support_summary(spark, d):
    return reports.modality_summary(fusion.judged(ad.qa_evidence(spark, d))[0])


_DIMS = ["section", "category", "modality", "gate", "reason", "outlier"]


@query(f"WITH {PAIRS}, {_RELATED}, {_GATED} " + " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x}::VARCHAR AS value, count(*) AS n FROM gated GROUP BY 2" for x in _DIMS))
def report_counts(spark, d):
    return reports.counts(gated_rows(spark, d), _DIMS)


def _about(outcome: str, prefix: str) -> list[str]:
    return [f"SELECT '{prefix}{c}' AS counter, {v} AS value FROM fused WHERE outcome = '{outcome}'" for c, v in (("section", "section"), ("multi_section", "unnest(cat_sections)"), ("category", "category"), ("modality", "modality"))]


_COUNTED = " UNION ALL ".join([
    *_about("selected", ""), *[f"SELECT '{c}', {v} FROM fused WHERE outcome = 'selected'" for c, v in (("outlier", "CASE WHEN outlier THEN 'outlier' ELSE 'not_outlier' END"), ("selection_reason", "reason"), ("reliability_gate", "gate"), ("review", "'no_review_flag'"))],
    *_about("review", "review_"), *[f"SELECT '{c}', {v} FROM fused WHERE outcome = 'review'" for c, v in (("review_priority", "priority"), ("review_reason", "unnest(reasons)"))],
    "SELECT 'dropped_reason', drop_reason FROM fused WHERE outcome = 'dropped'",
])


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT counter, value, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL")
def fusion_counters(spark, d):
    return reports.fusion_counters(fusion.judged(ad.qa_evidence(spark, d))[0])


@query(f"WITH {PAIRS}, {_RELATED}, {_GATED} SELECT reason, rank, evidence_id FROM (SELECT reason, evidence_id, row_number() OVER (PARTITION BY reason ORDER BY evidence_id) AS rank FROM gated WHERE NOT starts_with(reason, 'passed_')) WHERE rank <= 50")
def dropped_topn(spark, d):
    return reports.examples(gated_rows(spark, d).filter("not keep"), "reason", "evidence_id").select("reason", F.col("rank").cast("long").alias("rank"), "evidence_id")


@query(f"WITH {QAPAIRS}, {_FUSION} SELECT evidence_id, section, outcome AS queue FROM fused WHERE outcome <> 'dropped'")
def rows_union(spark, d):
    both = fusion.fuse(ad.qa_evidence(spark, d))
    one = lambda df, q: df.select("evidence_id", "section", F.lit(q).alias("queue"))
    return one(both.selected, "selected").unionByName(one(both.review, "review"))


# --- traces ------------------------------------------------------------------


@query(f"WITH {TRACES} SELECT modality, idx, round(e, 6) AS energy FROM (SELECT modality, idx, abs(value - lag(value) OVER (PARTITION BY modality ORDER BY idx)) AS e FROM trace) WHERE e IS NOT NULL")
def motion_energy(spark, d):
    return align.motion_energy(ad.traces(spark, d), ["modality"]).select("modality", "idx", six("value").alias("energy"))


_STD = "b AS (SELECT modality, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM trace GROUP BY 1), c AS (SELECT modality, idx, least(greatest(value, p5), p95) AS c FROM trace JOIN b USING (modality)), m AS (SELECT modality, median(c) AS med, avg(c) AS mean, stddev_pop(c) AS sd FROM c GROUP BY 1), q AS (SELECT modality, median(abs(c - med)) AS mad FROM c JOIN m USING (modality) GROUP BY 1), z AS (SELECT modality, idx, CASE WHEN mad > 1e-6 THEN (c - med) / (mad * 1.4826::DOUBLE) WHEN sd > 1e-6 THEN (c - mean) / sd ELSE 0.0::DOUBLE END AS value FROM c JOIN m USING (modality) JOIN q USING (modality))"
_WIDTH = align.smoothing_window(8.0)
_SMOOTH = f"sm AS (SELECT modality, idx, sum(value) OVER (PARTITION BY modality ORDER BY idx ROWS BETWEEN {_WIDTH // 2} PRECEDING AND {_WIDTH // 2} FOLLOWING) / {_WIDTH} AS value FROM z)"


@query(f"WITH {TRACES}, {_STD} SELECT modality, idx, round(value, 6) AS z FROM z")
def robust_standardize(spark, d):
    return align.standardized(ad.traces(spark, d), ["modality"]).select("modality", "idx", six("value").alias("z"))


@query(f"WITH {TRACES}, {_STD}, {_SMOOTH} SELECT modality, idx, round(value, 6) AS smooth FROM sm")
def smooth_trace(spark, d):
    return align.smoothed(align.standardized(ad.traces(spark, d), ["modality"]), ["modality"], _WIDTH).select("modality", "idx", six("value").alias("smooth"))


_LAGS = f"{TRACES}, {_STD}, {_SMOOTH}, lags AS (SELECT t.modality, lag, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(r.value) >= 1e-6 AND stddev_pop(t.value) >= 1e-6 THEN corr(r.value, t.value) END AS correlation FROM (SELECT *, unnest(range(-{LAGS}, {LAGS} + 1)) AS lag FROM sm WHERE modality <> '{REFERENCE}') t JOIN (SELECT idx, value FROM sm WHERE modality = '{REFERENCE}') r ON r.idx = t.idx - t.lag GROUP BY 1, 2)"


def lag_rows(spark: SparkSession, d: str) -> DataFrame:
    trace = align.smoothed(align.standardized(ad.traces(spark, d), ["modality"]), ["modality"], _WIDTH)
    return align.lag_correlations(trace.filter(F.col("modality") == REFERENCE).drop("modality"), trace.filter(F.col("modality") != REFERENCE), ["modality"], LAGS)


@query(f"WITH {_LAGS} SELECT modality, lag, n, round(correlation, 6) AS correlation FROM lags WHERE correlation IS NOT NULL")
def lag_correlation(spark, d):
    return lag_rows(spark, d).select("modality", F.col("lag").cast("long").alias("lag"), "n", six("correlation").alias("correlation"))


@query(f"WITH {_LAGS} SELECT modality, lag, n, round(correlation, 6) AS correlation FROM lags WHERE correlation IS NOT NULL")
def frame_lag_correlation(spark, d):
    """The same from packed traces, by FFT."""
    trace = align.smoothed(align.standardized(ad.traces(spark, d), ["modality"]), ["modality"], _WIDTH)
    rows = align.frame_lags(trace.filter(F.col("modality") == REFERENCE).drop("modality"), trace.filter(F.col("modality") != REFERENCE), ["modality"], LAGS)
    return rows.select("modality", F.col("lag").cast("long").alias("lag"), "n", six("correlation").alias("correlation"))


#: Every event type stands for the modality with the widest lag search.
_PRIOR = dims.PRIORS["event"]
_SCORED = f"sizes AS (SELECT modality, count(*) AS size FROM sm GROUP BY 1), shorter AS (SELECT t.modality, least(t.size, r.size) AS shorter FROM sizes t, sizes r WHERE r.modality = '{REFERENCE}'), sc AS (SELECT lags.modality, lag, round(correlation, 6) AS correlation, lag::DOUBLE AS offset_seconds, round(correlation + 0.12::DOUBLE * (n::DOUBLE / shorter) - {_PRIOR[3]}::DOUBLE * least(1.0::DOUBLE, abs(lag::DOUBLE - {_PRIOR[1]}) / {_PRIOR[2]}), 6) AS score FROM lags JOIN shorter USING (modality) WHERE correlation IS NOT NULL AND abs(lag) <= {_PRIOR[0]})"


def scored_lag_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = lag_rows(spark, d)
    sizes = ad.traces(spark, d).groupBy("modality").agg(F.count("*").alias("size"))
    ref = sizes.filter(F.col("modality") == REFERENCE).select(F.col("size").alias("ref"))
    both = sizes.join(F.broadcast(ref)).select("modality", F.least("size", "ref").alias("shorter"))  # one row
    names = [r["modality"] for r in ad.table(spark, d, "events").select(F.col("event_type").alias("modality")).distinct().collect()]  # event types
    return align.scored_lags(rows.join(both, "modality"), 1.0, F.col("shorter"), F.col("modality"), {m: _PRIOR for m in names})


_PICK = "pk AS (SELECT modality, max(CASE WHEN s = 1 THEN lag END) AS lag, max(CASE WHEN s = 1 THEN correlation END) AS correlation, max(CASE WHEN c = 1 THEN lag END) AS raw_best_lag, max(CASE WHEN c = 2 THEN correlation END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, lag) AS s, row_number() OVER (PARTITION BY modality ORDER BY correlation DESC, lag) AS c FROM sc) GROUP BY 1), sel AS (SELECT *, CASE WHEN lag = raw_best_lag AND second IS NOT NULL THEN round(correlation - second, 6) ELSE 0.0::DOUBLE END AS peak_margin FROM pk)"
_LABEL = "CASE WHEN correlation >= 0.80 OR (correlation >= 0.55 AND peak_margin >= 0.02) THEN 'high' WHEN correlation >= 0.30 THEN 'medium' ELSE 'low' END"


@query(f"WITH {_LAGS}, {_SCORED}, {_PICK} SELECT modality, lag, correlation, raw_best_lag, peak_margin, CASE WHEN lag = raw_best_lag THEN 'best_correlation' ELSE 'modality_prior' END AS selected_by, {_LABEL} AS confidence_label FROM sel")
def offset_selection(spark, d):
    out = align.selected_offsets(scored_lag_rows(spark, d), ["modality"])
    return out.select("modality", F.col("lag").cast("long").alias("lag"), "correlation", F.col("raw_best_lag").cast("long").alias("raw_best_lag"), "peak_margin", "selected_by", "confidence_label")


@query(f"WITH {_LAGS}, {_SCORED} SELECT modality, rank, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, lag) AS rank FROM sc) WHERE rank <= 8")
def top_lag_candidates(spark, d):
    return align.top_candidates(scored_lag_rows(spark, d), ["modality"]).select("modality", F.col("rank").cast("long").alias("rank"), F.col("lag").cast("long").alias("lag"), six("score").alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.80 OR (l_discount * 10 >= 0.55 AND l_tax >= 0.02) THEN 'high' WHEN l_discount * 10 >= 0.30 THEN 'medium' ELSE 'low' END AS label FROM lineitem")
def confidence_label(spark, d):
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", align.confidence(F.col("l_discount") * 10, F.col("l_tax")).alias("label"))


_OFFSET = "(l_tax - l_discount) * 100"


@query(f"WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS r, l_quantity * 0.9::DOUBLE AS t, {_OFFSET} AS o FROM lineitem), s AS (SELECT *, greatest(0.0::DOUBLE, -o) AS rs, greatest(0.0::DOUBLE, o) AS ts FROM o), l AS (SELECT *, greatest(0.0::DOUBLE, least(r - rs, t - ts)) AS long FROM s) SELECT l_orderkey, l_linenumber, round(rs, 6) AS reference_start, round(rs + long, 6) AS reference_end, round(ts, 6) AS target_start, round(ts + long, 6) AS target_end FROM l")
def overlap_window(spark, d):
    offset = (F.col("l_tax") - F.col("l_discount")) * 100
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *align.overlap(F.col("l_quantity"), F.col("l_quantity") * 0.9, offset))


_CONSENSUS = "r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ir' WHEN 1 THEN 'depth' ELSE 'event' END AS modality, o_orderkey // 3 AS sample, round((o_totalprice % 1000) / 100 - 4, 6) AS off, round((o_totalprice % 97) / 97, 6) AS corr FROM orders), l AS (SELECT *, CASE WHEN corr >= 0.8 THEN 'high' WHEN corr >= 0.3 THEN 'medium' ELSE 'low' END AS label FROM r), a AS (SELECT sample, coalesce(max(off) FILTER (WHERE modality = 'ir' AND label IN ('high', 'medium') AND abs(off) <= 1.0), 0.0::DOUBLE) AS anchor FROM l GROUP BY 1), f AS (SELECT l.*, anchor, (modality = 'depth' AND abs(off - anchor) > 3 AND (label = 'low' OR corr < 0.55)) OR (modality = 'event' AND abs(off - anchor) > 5 AND (label = 'low' OR corr < 0.30)) AS rejected FROM l JOIN a USING (sample))"


@query(f"WITH {_CONSENSUS} SELECT sample, modality, CASE WHEN rejected THEN anchor ELSE off END AS offset_seconds, CASE WHEN rejected THEN 'low' ELSE label END AS confidence_label, CASE WHEN rejected THEN off END AS rejected_offset_seconds FROM f")
def consensus_fallback(spark, d):
    rows = _offsets(spark, d)
    none = rows.select("sample", "modality", "offset_seconds", F.lit(0.0).alias("score")).filter("false")
    return align.consensus(rows, ["sample"], none)


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    o, k = ad.table(spark, d, "orders"), F.col("o_orderkey") % 3
    rows = o.select(F.floor(F.col("o_orderkey") / 3).alias("sample"), F.when(k == 0, "ir").when(k == 1, "depth").otherwise("event").alias("modality"), F.round((F.col("o_totalprice") % 1000) / 100 - 4, 6).alias("offset_seconds"), F.round((F.col("o_totalprice") % 97) / 97, 6).alias("correlation"))
    return rows.withColumn("confidence_label", F.when(F.col("correlation") >= 0.8, "high").when(F.col("correlation") >= 0.3, "medium").otherwise("low"))


#: Every offset has three candidates: half of it, an eighth of it, and one far off with the best score.
_NEAR = (
    "cand AS (SELECT sample, modality, unnest([off / 2, off / 8, off + 40]) AS near, unnest([corr, 1 - corr, 2.0::DOUBLE]) AS score FROM f), "
    "best AS (SELECT c.*, row_number() OVER (PARTITION BY c.sample, c.modality ORDER BY score DESC, near) AS n FROM cand c JOIN f USING (sample, modality) WHERE rejected AND abs(near - anchor) <= CASE modality WHEN 'depth' THEN 3 ELSE 5 END)"
)


@query(f"WITH {_CONSENSUS}, {_NEAR} SELECT f.sample, f.modality, CASE WHEN rejected THEN coalesce(near, anchor) ELSE off END AS offset_seconds, CASE WHEN NOT rejected THEN label WHEN near IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence_label, CASE WHEN rejected THEN off END AS rejected_offset_seconds FROM f LEFT JOIN (SELECT * FROM best WHERE n = 1) b ON b.sample = f.sample AND b.modality = f.modality")
def consensus_candidates(spark, d):
    rows = _offsets(spark, d)
    c, off = F.col("correlation"), F.col("offset_seconds")
    three = [(off / 2, c), (off / 8, 1 - c), (off + 40, F.lit(2.0))]
    near = rows.select("sample", "modality", F.explode(F.array(*[F.struct(x.alias("offset_seconds"), s.alias("score")) for x, s in three])).alias("c")).select("sample", "modality", "c.*")
    return align.consensus(rows, ["sample"], near)


# --- intervals ---------------------------------------------------------------


def _segmented(spark: SparkSession, d: str, late: float = 0.0) -> DataFrame:
    rows = ad.recordings(spark, d)
    end = (F.col("end") + F.when(F.col("ord") % 3 == 0, late).otherwise(0.0)).alias("end")
    one = F.struct("ord", "label", "start", end, "confidence")
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max("end").alias("duration"))
    raw = F.transform("all", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence"), F.lit(None).cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("notes")))
    return lists.select("user_id", segments.clamped(raw, F.col("duration")).alias("segments"))


_CLAMP = "list_reduce(list_prepend({'e': 0.0::DOUBLE, 'out': []::STRUCT(label VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE)[], 'x': NULL::STRUCT(label VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE)}, list({'e': 0.0::DOUBLE, 'out': []::STRUCT(label VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE)[], 'x': {'label': label, 's': start::DOUBLE, 'e': late::DOUBLE, 'c': confidence::DOUBLE}} ORDER BY ord)), lambda acc, y: CASE WHEN least(y.x.e, limit_) > least(greatest(acc.e, y.x.s), limit_) THEN {'e': least(y.x.e, limit_), 'out': list_append(acc.out, {'label': y.x.label, 's': least(greatest(acc.e, y.x.s), limit_), 'e': least(y.x.e, limit_), 'c': y.x.c}), 'x': NULL::STRUCT(label VARCHAR, s DOUBLE, e DOUBLE, c DOUBLE)} ELSE acc END).out"


@query(
    f"WITH {RECORDINGS}, late AS (SELECT *, \"end\" + (CASE WHEN ord % 3 = 0 THEN 5 ELSE 0 END) AS late, max(\"end\") OVER (PARTITION BY user_id) AS limit_ FROM recordings), o AS (SELECT user_id, {_CLAMP} AS out FROM late GROUP BY user_id, limit_), u AS (SELECT user_id, unnest(out) AS x, generate_subscripts(out, 1) AS pos FROM o) "
    "SELECT 'u' || user_id || '_seg_' || lpad(pos::VARCHAR, greatest(3, length(pos::VARCHAR))::INT, '0') AS segment_id, x.label AS label, round(x.s, 3) AS start, round(x.e, 3) AS \"end\", x.c AS confidence FROM u"
)
def segment_clamp(spark, d):
    """Every third interval ends five hours late, into those after it."""
    rows = _segmented(spark, d, 5.0).withColumn("prefix", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return segments.numbered(rows, "prefix", "segments").select("segment_id", "label", "start", "end", "confidence")


_MERGE = "list_reduce(list([{'s': start, 'e': \"end\"}] ORDER BY ord), lambda acc, x: CASE WHEN acc[-1].e - acc[-1].s < 15 OR x[1].e - x[1].s < 15 THEN list_concat(acc[:-2], [{'s': acc[-1].s, 'e': x[1].e}]) ELSE list_concat(acc, x) END)"


@query(f"WITH {RECORDINGS}, m AS (SELECT user_id, {_MERGE} AS m FROM recordings WHERE \"end\" > start GROUP BY user_id), u AS (SELECT user_id, unnest(m) AS k, generate_subscripts(m, 1) AS n FROM m) SELECT user_id, n, k.s AS start, k.e AS \"end\" FROM u")
def segment_merge(spark, d):
    rows = _segmented(spark, d).select("user_id", segments.merged(F.col("segments")).alias("segments"))
    return rows.select("user_id", F.posexplode("segments").alias("pos", "s")).select("user_id", (F.col("pos") + 1).cast("long").alias("n"), "s.start", "s.end")


@query(f"WITH {RECORDINGS}, p AS (SELECT user_id, event_id, round((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 3600, 3) AS at FROM events), s AS (SELECT user_id, ord, start, \"end\" FROM recordings WHERE label = 'view') SELECT p.event_id, s.ord FROM p JOIN s ON p.user_id = s.user_id AND s.start <= p.at AND p.at < s.\"end\"")
def frame_in_segment(spark, d):
    from pyspark.sql import Window

    e = ad.table(spark, d, "events").withColumn("s", ad.seconds(F.col("ts")))
    points = e.select("user_id", "event_id", F.round((F.col("s") - F.min("s").over(Window.partitionBy("user_id"))) / 3600, 3).alias("at"))
    views = ad.recordings(spark, d).filter("label = 'view'").select("user_id", F.col("ord").cast("long").alias("ord"), "start", "end")
    return segments.points_in(points, views, "user_id", "at", 12.0).select("event_id", "ord")


@query("WITH m AS (SELECT l_orderkey, l_linenumber, round_even(greatest(l_extendedprice, 0) * 1000, 0)::BIGINT AS ms FROM lineitem) SELECT l_orderkey, l_linenumber, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM m")
def seconds_to_timestamp(spark, d):
    return ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.timestamp(F.col("l_extendedprice")).alias("stamp"))


# --- parsing, resume, files ---------------------------------------------------


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_from_prose(spark, d):
    e = ad.table(spark, d, "events")
    prose = F.concat(F.lit("```json\nHere it is: "), "props", F.lit(" as asked.\n```"))
    return e.select("event_id", F.from_json(text.json_object(prose), "k bigint")["k"].alias("k"))


#: Properties of events inside annotations whose caption is a text, a number, a list, an object, null or a placeholder.
_SHAPES = ['{"caption":"said ?","more":?}', '{"caption":7,"more":?}', '{"caption":["x"],"more":[[?]]}', '{"caption":{"a":"b"}}', '{"caption":null}', '{"caption":"' + resume.PLACEHOLDERS[0] + '","more":{"q":"' + resume.PLACEHOLDERS[2] + '"}}']
_SHAPED = (
    "raw AS (SELECT event_id, replace(replace(" + ad.quoted(_SHAPES) + "[event_id % 6 + 1], 'said ?', 'said ' || event_id), '?', props)::JSON AS raw FROM events), "
    "walk AS (SELECT event_id, t.type AS kind, t.atom::VARCHAR AS atom FROM raw, json_tree(raw.raw) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')), "
    f"sums AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE kind = 'VARCHAR') AS texts, count(*) FILTER (WHERE kind = 'VARCHAR' AND NOT list_contains({ad.quoted(resume.PLACEHOLDERS)}, trim(atom, '\"'))) AS real FROM walk GROUP BY 1)"
)


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("event_id") % 6 + 1).cast("int"))
    raw = F.replace(F.replace(shape, F.lit("said ?"), F.concat(F.lit("said "), F.col("event_id").cast("string"))), F.lit("?"), F.col("props"))
    return ad.table(spark, d, "events").select("event_id", variants.parsed(raw).alias("v"))


@query(f"WITH {_SHAPED} SELECT event_id, CASE WHEN json_type(raw, '$.caption') = 'VARCHAR' THEN raw ->> '$.caption' ELSE '' END AS caption FROM raw")
def typed_fields(spark, d):
    return _shaped(spark, d).select("event_id", variants.text_field(F.col("v"), "$.caption").alias("caption"))


@query(f"WITH {_SHAPED} SELECT event_id, coalesce(n, 0)::BIGINT AS n_leaves, coalesce(texts, 0)::BIGINT AS n_texts, coalesce(n > texts OR real > 0, false) AS complete FROM raw LEFT JOIN sums USING (event_id)")
def variant_leaves(spark, d):
    rows = _shaped(spark, d)
    sums = variants.leaves(rows, ["event_id"], "v").groupBy("event_id").agg(F.count("*").alias("n_leaves"), F.count_if(F.col("kind") == "STRING").alias("n_texts"))
    whole = variants.complete(rows, ["event_id"], "v", resume.PLACEHOLDERS)
    none = F.lit(0).cast("bigint")
    return whole.join(sums, "event_id", "left").select("event_id", F.coalesce("n_leaves", none).alias("n_leaves"), F.coalesce("n_texts", none).alias("n_texts"), "complete")


_DONE = "done AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_DONE} SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM done)")
def pending_jobs(spark, d):
    o = ad.table(spark, d, "orders")
    return resume.pending(o, o.filter("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'old' END AS version, CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders")
def resume_upsert(spark, d):
    o = ad.table(spark, d, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("version"), F.col("o_totalprice").alias("price"))
    new = o.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("new").alias("version"), F.round(F.col("o_totalprice") * 2, 2).alias("price"))
    return resume.upserted(old, new, ["o_orderkey"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'F') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS skipped, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_custkey END) AS manifests, sum(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END)::BIGINT AS calls FROM orders")
def work_estimate(spark, d):
    o = ad.table(spark, d, "orders")
    return resume.work_estimate(o, o.filter("o_orderstatus = 'F'"), ["o_orderkey"], "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(1))


#: A first run whose client fails for some manifests, leaves orders out, and gives blanks and placeholders; a second that fails for few.
_FIRST = "CASE WHEN o_custkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 < 2 THEN 'pending' ELSE 'complete' END"
_SECOND = "CASE WHEN first_state = 'complete' THEN 'complete' WHEN o_custkey % 25 = 0 THEN 'failed' ELSE 'complete' END"
_TRIED = "(CASE WHEN first_state = 'failed' THEN 3 ELSE 1 END + CASE WHEN first_state = 'complete' THEN 0 WHEN state = 'failed' THEN 3 ELSE 1 END)"


def _orders_client(turn: str, fails: int):
    """Answers a manifest's segments by their ids."""
    blank = resume.PLACEHOLDERS[0]

    def client(request: str) -> str:
        import json

        jobs = json.loads(request)
        if jobs[0]["custkey"] % fails == 0:
            raise RuntimeError("429 quota")
        told = {}
        for k in (int(j["segment_id"]) for j in jobs):
            if turn == "second" or k % 7:
                told[str(k)] = {"action": {"caption": f"{turn} {k}" if turn == "second" or k % 3 == 2 else " " if k % 3 else blank, "question": "", "answer": ""}}
        return json.dumps(told)

    return client


@query(f"WITH a AS (SELECT *, {_FIRST} AS first_state FROM orders), b AS (SELECT *, {_SECOND} AS state FROM a) SELECT o_orderkey::VARCHAR AS \"key\", first_state, state, {_TRIED}::INTEGER AS tries, CASE WHEN state = 'failed' THEN '429 quota' END AS error, CASE WHEN first_state = 'complete' THEN 'first ' || o_orderkey WHEN state = 'complete' THEN 'second ' || o_orderkey END AS caption FROM b")
def segment_resume(spark, d):
    """Orders as segments of their customer's manifest, run twice: what is not complete after the first run is asked again."""
    o = ad.table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("manifest"), F.col("o_orderkey").cast("string").alias("segment_id"), F.col("o_custkey").alias("custkey"))
    answers = f"map<string, map<string, {runs.QA}>>"
    nothing = spark.createDataFrame([], f"key string, segment_id string, annotations map<string, {runs.QA}>")
    run = lambda turn, fails, done: store.stored(runs.run_segments(jobs, models.asking(_orders_client(turn, fails), "manifest", F.to_json("jobs"), answers, "responses", 8, lambda _: None), done), f"segments-{turn}")
    first = run("first", 5, nothing)
    second = run("second", 25, first)
    caption = F.try_element_at(F.col("annotations"), F.lit("action"))["caption"]
    return second.join(first.select("key", F.col("state").alias("first_state")), "key").select("key", "first_state", "state", "tries", "error", caption.alias("caption"))


#: Some conversations have no picture; the first run's client fails at each stage for others.
_CASCADE = (
    "x AS (SELECT DISTINCT conv_id AS k FROM conversations), f AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'blocked' WHEN k % 7 = 0 THEN 'failed' ELSE 'complete' END AS h, k % 5 = 0 AS no_caption, k % 3 = 0 AS no_pairs FROM x), "
    "g AS (SELECT *, CASE WHEN h <> 'complete' THEN 'blocked' WHEN no_caption THEN 'failed' ELSE 'complete' END AS c FROM f), r AS (SELECT *, CASE WHEN c <> 'complete' THEN 'blocked' WHEN no_pairs THEN 'failed' ELSE 'complete' END AS q FROM g), "
    "seen AS (SELECT k, h, c, q, 'seen frames ' || k AS s FROM r), l AS (SELECT k, unnest(['hia', 'caption', 'qa_pairs']) AS stage, unnest([h, c, q]) AS first_state, unnest([s, 'heard media ' || k || ' ' || s, '[{\"question_type\":\"sound\",\"question\":\"what?\",\"answer\":\"heard media ' || k || ' ' || s || '\"}]']) AS answer FROM seen)"
)


def _listener(turn: str):
    """Answers each stage with what it was given."""

    def client(request: str) -> str:
        about = request.split("\n")[1:]
        k = int(about[0].split(" ")[-1] if len(about) < 2 else about[0].split(" ")[1]) if not about[0].startswith("heard") else int(about[0].split(" ")[2])
        stage = 2 if about[0].startswith("heard") else 1 if len(about) > 1 else 0
        if turn == "first" and k % (7, 5, 3)[stage] == 0:
            raise RuntimeError("overloaded")
        if stage < 2:
            return "```\n" + ("seen " if stage == 0 else "heard ") + " ".join(about) + "\n```"
        return 'So: [{"question_type":"sound","question":"what?","answer":"' + about[0] + '"}, 3]'

    return client


@query(f"WITH {_CASCADE} SELECT k AS conv_id, stage, first_state, CASE WHEN k % 11 = 0 THEN 'blocked' ELSE 'complete' END AS state, (CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN first_state = 'failed' THEN 3 ELSE 0 END)::INTEGER AS tries, md5(CASE WHEN k % 11 > 0 THEN answer END) AS answer_md5 FROM l")
def audio_cascade(spark, d):
    """Three stages over conversations, run twice; later stages are fed by earlier answers."""
    k = F.col("conv_id").cast("string")
    items = ad.table(spark, d, "conversations").select("conv_id").distinct()
    items = items.withColumn("frames", F.when(F.col("conv_id") % 11 > 0, F.concat(F.lit("frames "), k))).withColumn("media", F.concat(F.lit("media "), k))
    run = lambda turn, done: cascade.run(items, "conv_id", cascade.audio_stages(F.col("frames"), F.col("media")), _listener(turn), done, 8, lambda _: None)
    first = run("first", None)
    second = run("second", first)
    return second.join(first.select("conv_id", "stage", F.col("state").alias("first_state")), ["conv_id", "stage"]).select("conv_id", "stage", "first_state", "state", "tries", F.md5("answer").alias("answer_md5"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.doc_id % 2 END::BIGINT AS quality, coalesce(l.toxic, 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_coalesce(spark, d):
    null = F.lit(None).cast("bigint")
    own = ad.table(spark, d, "labels").select("doc_id", F.lit(0).alias("ord"), F.array(F.lit("quality"), F.lit("toxic")).alias("has"), F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))
    rest = ad.table(spark, d, "documents").select("doc_id", F.lit(1).alias("ord"), F.array(F.lit("quality")).alias("has"), (F.col("doc_id") % 2).alias("quality"), null.alias("toxic"))
    out = resume.coalesced(own.unionByName(rest), "doc_id", "ord", ["quality", "toxic"])
    docs = ad.table(spark, d, "documents").select("doc_id")
    return docs.join(out, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(0).cast("bigint")).alias("toxic"))


_SIDES = "sides AS (SELECT c_custkey // 2 AS pair, CASE WHEN c_custkey % 2 = 0 THEN 'day' ELSE 'night' END AS side, CASE WHEN c_acctbal > 0 THEN c_name END AS path FROM customer)"


@query(f"WITH {_SIDES} SELECT pair, coalesce(max(path) FILTER (WHERE side = 'night'), max(path) FILTER (WHERE side = 'day')) AS path FROM sides GROUP BY 1")
def prefer_night(spark, d):
    both = _pairs(spark, d)
    return both.select("pair", F.coalesce("night", "day").alias("path"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = ad.table(spark, d, "customer")
    rows = c.select(F.floor(F.col("c_custkey") / 2).alias("pair"), F.when(F.col("c_custkey") % 2 == 0, "day").otherwise("night").alias("side"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("path"))
    return rows.groupBy("pair").pivot("side", ["day", "night"]).agg(F.min("path"))


@query(f"WITH {_SIDES} SELECT pair, min(path) FILTER (WHERE side = 'day') AS day, min(path) FILTER (WHERE side = 'night') AS night FROM sides GROUP BY 1")
def pair_pivot(spark, d):
    return _pairs(spark, d)


# --- facts and captions --------------------------------------------------------

_FACT = (
    "CASE WHEN contains(category, 'audio') THEN CASE WHEN contains(category, 'chronological') THEN 'audio_event' ELSE 'sound' END WHEN contains(category, 'object_recognition') THEN 'object_presence' "
    "WHEN regexp_matches(category, 'spatial_reasoning|navigation') THEN 'spatial_relation' WHEN contains(category, 'counting') THEN 'count' WHEN regexp_matches(category, 'dynamic_recognition|scene_sequence') THEN 'motion' "
    "WHEN contains(category, 'action') THEN 'action' WHEN contains(category, 'light') THEN 'lighting' WHEN category = 'text_recognition' THEN 'object_presence' WHEN contains(category, 'non_common') THEN 'non_common' ELSE '?' END"
)


@query(f"WITH {QA} SELECT conv_id, turn, {_FACT} AS fact_type FROM qa")
def fact_type(spark, d):
    rows = ad.questions(spark, d)
    return rows.select("conv_id", "turn", facts.fact_type(F.col("category"), F.col("question"), F.col("answer"), F.lit("")).alias("fact_type"))


@query(f"WITH {EV}, k AS (SELECT sample_id, evidence_id, modality, {_FACT} AS fact_type, round((evidence_id % 10) / 10.0::DOUBLE, 1) AS c FROM evidence), o AS (SELECT *, fact_type IN ('scene', 'environment', 'object_presence', 'lighting') AS own FROM k), a AS (SELECT *, bool_or(own) OVER (PARTITION BY sample_id) AS any_ FROM o), s AS (SELECT *, c * 0.8::DOUBLE + 0.6::DOUBLE + (CASE WHEN own THEN 0.7 ELSE 0 END)::DOUBLE + (CASE WHEN fact_type IN ('scene', 'environment', 'lighting', 'object_presence', 'count') THEN 0.35 ELSE 0 END)::DOUBLE AS score FROM a WHERE own OR NOT any_), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, modality, fact_type ORDER BY evidence_id) AS n FROM s) WHERE n = 1) SELECT sample_id, rank, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, c DESC, modality, evidence_id) AS rank FROM u) WHERE rank <= 3")
def fact_topk(spark, d):
    rows = ad.evidence(spark, d)
    kind = facts.fact_type(F.col("category"), F.lit(""), F.lit(""), F.lit(""))
    told = rows.select("sample_id", F.col("evidence_id").alias("id"), "modality", kind.alias("fact_type"), F.lit("").alias("entity"), F.lit("").alias("attribute"), F.lit("").alias("value"), F.round((F.col("evidence_id") % 10) / 10, 1).alias("confidence"), F.lit(1.0).alias("reliability"), F.lit(0.0).alias("support"))
    return facts.top(told, "scene_overview", 3).select("sample_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("evidence_id"))


#: Questions and answers that meet the rules about texts, one by one; a question and an answer of the table follow them.
_WORDED = [
    ("Is it the sound,", "because"), ("Which texture has the audio,", "x"), ("What scraping,", "so"), ("Which shadow,", "x"), ("How many are there,", "some"), ("So", "it has 3 of them"), ("Where,", "x"),
    ("So, to the left,", "x"), ("What action,", "x"), ("So, grasp it,", "x"), ("At what frame,", "x"), ("So frame_12", "x"), ("So the frame", "x"), ("So is it", "yes"), ("Was it", "x"), ("So the kitchen", "x"),
    ("So the laptop", "x"), ("So they match", "x"), ("So uncommon", "x"), ("So", "x"),
]
_WORD_EDGE, _WORD_END = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"


def _typed_by_rules() -> str:
    """The rules on fact types as one CASE over lower-case columns section, q and said, and a."""
    any_of = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    tests = {
        "named": lambda _: "(starts_with(section, 'audio') OR contains(section, 'audio_'))",
        "section": lambda w: any_of("section", w),
        "said": lambda w: any_of("said", w),
        "cause": lambda w: any_of("said", w),
        "asked": lambda w: "(" + " OR ".join(f"starts_with(q, '{x}')" for x in w) + ")",
        "number": lambda _: f"regexp_matches(a, '{_WORD_EDGE}[0-9]+{_WORD_END}')",
        "alone": lambda w: f"regexp_matches(said, '{_WORD_EDGE}{w[0]}{_WORD_END}')",
        "yes_no": lambda _: f"lower({CLEAN.format('a')}) IN ('yes', 'no', 'true', 'false')",
    }
    cases = [" AND ".join(tests[t](w) for t, w in needed.items()) + f" THEN '{kind}'" for needed, kind in facts.TYPE_RULES]
    return "CASE WHEN " + " WHEN ".join(cases) + f" ELSE '{facts.OTHER_TYPE}' END"


_WORDED_SQL = "[" + ", ".join(f"{{'q': '{q}', 'a': '{a}'}}" for q, a in _WORDED) + f"][(conv_id * 7 + turn) % {len(_WORDED)} + 1]"


@query(
    f"WITH {QA}, w AS (SELECT conv_id, turn, {_WORDED_SQL} AS w, question, answer FROM qa), x AS (SELECT conv_id, turn, w.q || ' ' || question AS q0, CASE WHEN turn % 2 = 0 THEN w.a ELSE w.a || ' ' || answer END AS a FROM w), "
    "y AS (SELECT conv_id, turn, 'note' AS section, lower(trim(q0)) AS q, a, lower('note ' || q0 || ' ' || a || ' ') AS said FROM x) "
    f"SELECT conv_id, turn, {_typed_by_rules()} AS fact_type FROM y"
)
def fact_rules(spark, d):
    """Types by what texts say: the section's name tells nothing."""
    worded = F.element_at(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in _WORDED]), ((F.col("conv_id") * 7 + F.col("turn")) % len(_WORDED) + 1).cast("int"))
    rows = ad.questions(spark, d).withColumn("w", worded)
    rows = rows.select("conv_id", "turn", F.concat_ws(" ", "w.q", "question").alias("q"), F.when(F.col("turn") % 2 == 0, F.col("w.a")).otherwise(F.concat_ws(" ", "w.a", "answer")).alias("a"))
    return rows.select("conv_id", "turn", facts.fact_type(F.lit("note"), F.col("q"), F.col("a"), F.lit("")).alias("fact_type"))


_STRIPPED = "regexp_replace({0}, '^[ .,:;]+|[ .,:;]+$', '', 'g')"
_FACTS = (
    f"fc AS (SELECT sample_id, evidence_id AS id, modality, category AS section, question AS q, answer AS a, {_FACT} AS fact_type, support_score AS support, reliability FROM scored), "
    f"fr AS (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array({_STRIPPED.format('a')}, ' *[0-9]+\\. *'), lambda x: {_STRIPPED.format('x')}), lambda x: x <> '')[1], {_STRIPPED.format('a')}) AS frag, regexp_extract(q, '{_WORD_EDGE}([0-9]+){_WORD_END}', 2) AS number FROM fc), "
    f"named AS (SELECT *, CASE WHEN frag = '' THEN '' WHEN fact_type = 'temporal' OR (fact_type = 'spatial_relation' AND regexp_matches(lower(frag), '{'|'.join(facts.PLACES)}')) THEN q ELSE frag END AS entity, "
    f"CASE WHEN fact_type = 'spatial_relation' AND contains(lower(q), ' of the ') THEN 'relative_location' ELSE {case('fact_type', {k: chr(39) + v + chr(39) for k, v in facts.ATTRIBUTES.items()}, chr(39) + 'fact' + chr(39))} END AS attribute, "
    "CASE WHEN frag <> '' THEN frag WHEN fact_type = 'count' AND number <> '' THEN number ELSE q END AS value FROM fr), "
    "told AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, modality, section, fact_type, entity, attribute, value ORDER BY id) AS n FROM named) WHERE n = 1)"
)


@query(f"WITH {QAPAIRS}, {_FUSION}, {_FACTS} SELECT sample_id, id, modality, section, fact_type, attribute, md5(entity) AS entity_md5, md5(value) AS value_md5, round(support, 6) AS support, round(reliability, 6) AS reliability FROM told")
def fused_facts(spark, d):
    rows = fusion.fuse(ad.qa_evidence(spark, d)).facts
    return rows.select("sample_id", "id", "modality", "section", "fact_type", "attribute", F.md5("entity").alias("entity_md5"), F.md5("value").alias("value_md5"), six("support").alias("support"), six("reliability").alias("reliability"))


_OF_SECTION = "(VALUES " + ", ".join(f"('{n}', {ad.quoted(facts.SECTION_TYPES[n])}, {ad.quoted(facts.PREFERRED_TYPES[n])}, {facts.GRAPH_LIMITS[False].get(n, 0)})" for n in facts.SECTION_TYPES) + ") v(for_section, types, preferred, most)"
_RANKED = (
    f"each AS (SELECT told.*, for_section, most, list_contains(types, fact_type) AS own, list_contains(preferred, fact_type) AS wanted FROM told, {_OF_SECTION}), wide AS (SELECT *, bool_or(own) OVER (PARTITION BY sample_id, for_section) AS has FROM each), "
    f"rated AS (SELECT *, {facts.CONFIDENCE}::DOUBLE * 0.8::DOUBLE + reliability * 0.6::DOUBLE + support * 0.5::DOUBLE + (CASE WHEN own THEN 0.7 ELSE 0 END)::DOUBLE + (CASE WHEN wanted THEN 0.35 ELSE 0 END)::DOUBLE + (CASE WHEN for_section = 'cross_modal_details' AND contains({CLEAN.format('entity')}, ' ') THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM wide WHERE own OR NOT has), "
    "once AS (SELECT *, row_number() OVER (PARTITION BY sample_id, for_section, modality, fact_type, entity, attribute, value ORDER BY id) AS k FROM rated), ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, for_section ORDER BY round(score, 9) DESC, reliability DESC, modality, id) AS rank FROM once WHERE k = 1)"
)


@query(f"WITH {QAPAIRS}, {_FUSION}, {_FACTS}, {_RANKED} SELECT sample_id, for_section, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= most")
def scene_graph(spark, d):
    rows = fusion.fuse(ad.qa_evidence(spark, d)).scene_graph()
    return rows.select("sample_id", "for_section", F.col("rank").cast("long").alias("rank"), "id", six("score").alias("score"))


#: Every sample has a caption in all sections but one, by its number.
_CAPTIONED = "list_filter(" + ad.quoted(list(facts.SECTION_TYPES)) + ", lambda n: n <> " + ad.quoted(list(facts.SECTION_TYPES)) + "[sample_id % 6 + 1])"


@query(
    f"WITH {QAPAIRS}, {_FUSION}, {_FACTS}, {_RANKED}, best AS (SELECT * FROM ranked WHERE rank = 1 AND list_contains({_CAPTIONED}, for_section)), "
    "asked AS (SELECT *, CASE WHEN for_section = 'visible_objects_and_layout' AND entity <> '' AND value <> '' AND fact_type = 'spatial_relation' THEN 'Where is ' || trim(entity) || ' located?' "
    "WHEN for_section = 'visible_objects_and_layout' AND entity <> '' AND value <> '' AND fact_type = 'count' THEN 'How many ' || trim(entity) || ' are identified?' "
    f"ELSE {case('for_section', {k: chr(39) + v + chr(39) for k, v in fields.FACT_QUESTIONS.items()}, chr(39) * 2)} END AS question FROM best) "
    f"SELECT sample_id, for_section AS section, fact_type, md5({CLEAN.format('question')}) AS question_md5, md5({CLEAN.format('value')}) AS answer_md5 FROM asked"
)
def field_questions(spark, d):
    """Questions of sections that have captions, from the fused run's facts."""
    names = list(facts.SECTION_TYPES)
    out = fusion.fuse(ad.qa_evidence(spark, d))
    captions = out.facts.select("sample_id").distinct().select("sample_id", *[F.when(F.col("sample_id") % 6 != k, F.lit("A caption.")).otherwise("").alias(n) for k, n in enumerate(names)])
    rows = fusion.section_questions(captions, out.facts, out.reliability).filter("qa_source = 'semantic_fact'")
    return rows.select("sample_id", "section", "fact_type", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


_T0 = "regexp_replace(" + CLEAN.format("trim(answer, ' .,:;')") + ", '^([aA]|[aA][nN]|[tT][hH][eE]) +', '')"
_SEP = "t"
for _s in reversed(text.SEPARATORS):
    _SEP = f"CASE WHEN contains(t, '{_s}') THEN trim(string_split(t, '{_s}')[1]) ELSE ({_SEP}) END"
_TAIL = "|".join(text.TRAILING)


@query(
    f"WITH {QA}, a AS (SELECT conv_id, turn, {_T0} AS t FROM qa), b AS (SELECT *, trim(regexp_extract(t, '[^.!?]*[.!?]'), ' .!?,;') AS s, {_SEP} AS p FROM a), w AS (SELECT *, string_split(regexp_replace(trim(p), ' +', ' ', 'g'), ' ') AS w FROM b) "
    f"SELECT conv_id, turn, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '[.!?]') AND (s = '' OR len(string_split(s, ' ')) <= 8) THEN s ELSE trim(CASE WHEN len(w) <= 8 THEN array_to_string(w, ' ') ELSE regexp_replace(array_to_string(w[1:8], ' '), '(?i)( ({_TAIL}))+$', '') END, ' .,:;') END AS answer FROM w"
)
def trim_answer(spark, d):
    return ad.questions(spark, d).select("conv_id", "turn", text.trim_answer(F.col("answer")).alias("answer"))


@query("SELECT p_partkey, 'What is to the ' || (CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END) || ' of the ' || lower(p_brand) || '?' AS question, lower(p_type) AS answer FROM part")
def layout_qa(spark, d):
    p = ad.table(spark, d, "part")
    side = F.when(F.col("p_size") % 2 == 0, "left").otherwise("right")
    caption = F.concat(F.lit("Seen here. To the "), side, F.lit(" of the "), F.lower("p_brand"), F.lit(" sits a "), F.lower("p_type"), F.lit(", on a shelf."))
    question, answer = fields.caption_question("visible_objects_and_layout", caption)
    return p.select("p_partkey", question.alias("question"), answer.alias("answer"))


@query(f"WITH {EV}, f AS (SELECT sample_id, evidence_id, {_SENT.format('caption')}[1] AS s FROM evidence), firsts AS (SELECT sample_id, evidence_id, s, {TOKENS.format('s')} AS tokens FROM f WHERE s IS NOT NULL), r AS (SELECT sample_id, {_fold(0.55, 'evidence_id')} AS kept FROM firsts GROUP BY sample_id) SELECT sample_id, array_to_string(list_transform(kept[1:4], lambda x: x.evidence_id), ',') AS evidence_ids FROM r")
def final_caption(spark, d):
    rows = ad.evidence(spark, d).withColumn("s", F.get(text.sentences(F.col("caption")), F.lit(0))).filter("s is not null").withColumn("tokens", text.tokens(F.col("s")))
    lists = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "tokens"))).alias("all"))
    kept = selection.distinct_greedy(F.col("all"), 0.55, 4)
    return lists.select("sample_id", F.array_join(F.transform(kept, lambda x: x["evidence_id"].cast("string")), ",").alias("evidence_ids"))


@query(f"WITH {QA} SELECT conv_id, turn, trim(question) <> '' OR trim(answer) <> '' AS trial, trim(question) <> '' AND turn % 3 > 0 OR (trim(answer) <> '' AND turn % 3 > 0) AS complete FROM qa")
def complete_annotations(spark, d):
    """Texts of every third turn give way to placeholders, if they have any."""
    demo = lambda c, k: F.when((F.col("turn") % 3 == 0) & (F.trim(c) != ""), F.lit(resume.PLACEHOLDERS[k])).otherwise(F.col(c))
    one = F.struct(F.lit(" ").alias("caption"), demo("question", 1).alias("question"), demo("answer", 2).alias("answer"))
    rows = ad.questions(spark, d).select("conv_id", "turn", F.create_map(F.lit("counting"), one).alias("x"))
    return rows.select("conv_id", "turn", resume.complete(F.col("x"), trial=True).alias("trial"), resume.complete(F.col("x")).alias("complete"))


# --- exports -------------------------------------------------------------------

#: A fifth of the questions and answers numbered, a fifth with further questions, the rest as they are.
_UNITS = "un AS (SELECT conv_id, turn, category, CASE conv_id % 5 WHEN 0 THEN '1. ' || question || ' 2) and why?' WHEN 1 THEN question || ' And then? Why?' ELSE question END AS question, CASE conv_id % 5 WHEN 0 THEN '1. ' || answer || ' 2) so it is' ELSE answer END AS answer FROM qa)"
_MARKED = "string_split(regexp_replace(' ' || trim({0}), '[ \\t\\n\\r\\f][0-9]+[.)][ \\t\\n\\r\\f]+', chr(1), 'g'), chr(1))"
_TRIMMED = "list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x <> '')"


def _numbered_list(c: str) -> str:
    marked = _MARKED.format(c)
    return f"(CASE WHEN trim({c}) = '' THEN [] WHEN len({marked}) < 2 THEN [trim({c})] ELSE {_TRIMMED.format(f'{marked}[2:]')} END)"


def _several(c: str, parts: str) -> str:
    return f"(CASE WHEN trim({c}) = '' THEN [] WHEN len({_numbered_list(c)}) > 1 THEN {_numbered_list(c)} WHEN len({parts}) > 1 THEN {parts} ELSE [trim({c})] END)"


_ASKED = "list_transform(" + _TRIMMED.format("string_split(question, '?')") + ", lambda x: x || '?')"
_EXPORTED = (
    f"{_UNITS}, qs AS (SELECT *, {_several('question', _ASKED)} AS q FROM un), qas AS (SELECT *, CASE WHEN len(q) > 1 THEN {_several('answer', _SENT.format('trim(answer)'))} ELSE {_numbered_list('answer')} END AS a FROM qs), "
    "ex AS (SELECT *, unnest(range(1, greatest(len(q), len(a)) + 1)) AS pair_index FROM qas)"
)


def _unit_rows(spark: SparkSession, d: str) -> DataFrame:
    fifth, rows = F.col("conv_id") % 5, ad.questions(spark, d)
    modality = F.element_at(F.array(*map(F.lit, dims.REASONING_ORDER)), (F.col("turn") % 5 + 1).cast("int"))
    question = F.when(fifth == 0, F.concat(F.lit("1. "), "question", F.lit(" 2) and why?"))).when(fifth == 1, F.concat("question", F.lit(" And then? Why?"))).otherwise(F.col("question"))
    answer = F.when(fifth == 0, F.concat(F.lit("1. "), "answer", F.lit(" 2) so it is"))).otherwise(F.col("answer"))
    return rows.select(F.floor(F.col("conv_id") / 4).alias("sample_id"), "conv_id", "turn", modality.alias("modality"), F.col("category").alias("section"), question.alias("caption"), question.alias("question"), answer.alias("answer"))


@query(f"WITH {QA}, {_EXPORTED}, known(section, reasoning_group) AS (VALUES {_GROUP_ROWS}), g AS (SELECT un.conv_id // 4 AS sample_id, un.conv_id, un.turn, coalesce(reasoning_group, 'ungrouped') AS reasoning_group FROM un LEFT JOIN known ON section = category WHERE trim(un.question) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, reasoning_group ORDER BY conv_id, turn) - 1 AS source_unit_index FROM g) SELECT k.sample_id, reasoning_group, source_unit_index, pair_index, md5(coalesce(q[pair_index], '')) AS question_md5, md5(coalesce(a[pair_index], '')) AS answer_md5 FROM k JOIN ex USING (conv_id, turn)")
def grouped_export(spark, d):
    out = export.grouped_pairs(_unit_rows(spark, d), ["conv_id", "turn"])
    return out.select("sample_id", "reasoning_group", F.col("source_unit_index").cast("long").alias("source_unit_index"), F.col("pair_index").cast("long").alias("pair_index"), F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(f"WITH {QA}, {_EXPORTED}, known(section, reasoning_group) AS (VALUES {_GROUP_ROWS}), u AS (SELECT conv_id // 4 AS sample_id, {ad.quoted(dims.REASONING_ORDER)}[turn % 5 + 1] AS modality, category AS section FROM ex WHERE trim(question) <> ''), c AS (SELECT sample_id, coalesce(reasoning_group, 'ungrouped') AS reasoning_group, modality, count(*) AS n FROM u LEFT JOIN known USING (section) GROUP BY 1, 2, 3), grid AS (SELECT sample_id, g AS reasoning_group, m AS modality FROM (SELECT DISTINCT conv_id // 4 AS sample_id FROM un), (SELECT unnest({ad.quoted(dims.GROUPS)}) AS g), (SELECT unnest({ad.quoted(dims.REASONING_ORDER)}) AS m)) SELECT sample_id, reasoning_group, modality, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (sample_id, reasoning_group, modality)")
def export_cells(spark, d):
    units = _unit_rows(spark, d)
    counts = export.grouped_pairs(units, ["conv_id", "turn"]).groupBy("sample_id", "reasoning_group", "modality").agg(F.count("*").alias("n"))
    return export.every_cell(counts, units)


@query(f"WITH {QA}, {_EXPORTED} SELECT conv_id::VARCHAR AS segment_id, 'clip' || conv_id AS file_name, coalesce(l.quality::VARCHAR, '') AS task_label, pair_index, category AS section, md5(coalesce(q[pair_index], '')) AS question_md5 FROM ex LEFT JOIN labels l ON l.doc_id = ex.conv_id")
def segment_report_rows(spark, d):
    rows = _unit_rows(spark, d).withColumn("segment_id", F.col("conv_id"))
    meta = ad.table(spark, d, "labels").select(F.col("doc_id").alias("segment_id"), F.col("quality").cast("string").alias("task_label"))
    pairs = export.split_units(export.with_metadata(rows, meta, "segment_id", ["task_label"]), ["segment_id"])
    out = export.segment_rows(pairs.withColumn("file_name", F.concat(F.lit("clip"), F.col("segment_id").cast("string"))))
    return out.select(F.col("segment_id").cast("string").alias("segment_id"), "file_name", F.coalesce("task_label", F.lit("")).alias("task_label"), F.col("pair_index").cast("long").alias("pair_index"), "section", F.md5("question").alias("question_md5"))


@query(f"WITH {QA}, {_EXPORTED} SELECT conv_id // 4 AS sample_id, count(*) AS n_pairs FROM ex GROUP BY 1")
def pair_totals(spark, d):
    return runs.pair_totals(export.split_units(_unit_rows(spark, d), ["sample_id"]))


@query(f"WITH {QA}, {_UNITS} SELECT {ad.quoted(dims.REASONING_ORDER)}[turn % 5 + 1] AS modality, count(DISTINCT conv_id // 4) AS n_samples, count(*) AS n_units, round(count(*) / count(DISTINCT conv_id // 4), 3) AS units_per_sample FROM un GROUP BY 1")
def unit_counts(spark, d):
    return runs.unit_counts(_unit_rows(spark, d))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 10 = 0")
def every_nth_frame(spark, d):
    e = ad.table(spark, d, "events").withColumn("idx", F.col("event_id"))
    return runs.every_nth(e, F.lit(30.0), 3.0).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("WITH n AS (SELECT p_partkey, (p_size * 7)::BIGINT AS c FROM part), x AS (SELECT p_partkey, c, list_sort(list_distinct([least(c - 1, round_even((c - 1) * i / 4.0, 0)::BIGINT) for i in [0, 1, 2, 3, 4]])) AS f FROM n) SELECT p_partkey, array_to_string(f, ',') AS frames FROM x")
def frame_sampling(spark, d):
    p = ad.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7).cast("long").alias("c"))
    return p.select("p_partkey", F.array_join(F.transform(files.sampled_indices(F.col("c")), lambda x: x.cast("string")), ",").alias("frames"))


def _plain_score(section: str) -> str:
    """A section's score in SQL; sections without weights of their own have the least."""
    known = section in dims.ROUTES
    base = case("modality", {m: f"{w}::DOUBLE" for m, w in zip(dims.FUSION_ORDER, dims.ROUTE_WEIGHTS[section], strict=True)}, "0.3::DOUBLE") if known else "0.3::DOUBLE"
    hints = "|".join(dims.ROUTE_HINTS[section]) if known else ""
    bonus = f"(CASE WHEN regexp_matches(category, '^({hints})') THEN 0.35 WHEN regexp_matches(category, '{hints}') THEN 0.25 ELSE 0.0 END)::DOUBLE" if known else "0.0::DOUBLE"
    outlier = f"(CASE WHEN reliability < 0.5 AND support_score < {dims.MIN_SUPPORT} THEN 1.0 ELSE 0.0 END)::DOUBLE"
    return f"round({base} + reliability * 0.6::DOUBLE + support_score * 1.2::DOUBLE + {bonus} + least(0.45::DOUBLE, {_keywords(section)} * 0.08::DOUBLE) - {outlier}, 9)"


def _keywords(section: str) -> str:
    return f"len(list_intersect(tokens, {ad.quoted(dims.ROUTE_KEYWORDS[section])}))::DOUBLE" if section in dims.ROUTES else "0::DOUBLE"


_NAMED = {"visible_objects_and_layout": "spatial|count|object", "motion_and_event_cues": "dynamic|action|scene_sequence|event_scene"}


def _chosen(source: str, section: str, p: str) -> str:
    """CTEs that end in {p}rk(sample_id, evidence_id, rank): a section's sentences in order."""
    named = f" OR regexp_matches(category, '{_NAMED[section]}')" if section in _NAMED else ""
    gate = f"{_keywords(section)} > 0{named}" if section in dims.ROUTES else "true"
    heard = " AND sample_id IN (SELECT sample_id FROM evidence WHERE modality = 'audio')" if section == "audio_cues" else ""
    wanted = f"modality IN ({', '.join(repr(m) for m in narrative.PREFERRED[section])})" if section in narrative.PREFERRED else "true"
    return (
        f"{p}sc AS (SELECT sample_id, evidence_id, modality, tokens, {_plain_score(section)} AS score FROM {source} WHERE ({gate}){heard}), {p}fo AS (SELECT sample_id, {_fold(0.7, 'score DESC, evidence_id')} AS kept FROM {p}sc WHERE score > 0.45 GROUP BY sample_id), "
        f"{p}ids AS (SELECT sample_id, unnest(list_transform(kept, lambda x: x.evidence_id)) AS evidence_id, generate_subscripts(kept, 1) AS pos FROM {p}fo), {p}pref AS (SELECT i.*, {wanted} AS p FROM {p}ids i JOIN evidence USING (sample_id, evidence_id)), {p}used AS (SELECT *, bool_or(p) OVER (PARTITION BY sample_id) AS any_ FROM {p}pref), "
        f"{p}rk AS (SELECT sample_id, evidence_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rank FROM {p}used WHERE p OR NOT any_)"
    )


@query(f"WITH {EV}, plain AS (SELECT *, 1.0::DOUBLE AS reliability, 0.0::DOUBLE AS support_score FROM tok), {_chosen('plain', 'motion_and_event_cues', 'm')} SELECT sample_id, evidence_id, rank FROM mrk WHERE rank <= 2")
def select_sentences(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d)).withColumn("reliability", F.lit(1.0)).withColumn("support_score", F.lit(0.0))
    return narrative.selected_sentences(rows, "motion_and_event_cues", 2).select("sample_id", "evidence_id", F.col("rank").cast("long").alias("rank"))


def _ended(c: str) -> str:
    return f"regexp_replace({c}, '\\.+$', '') || '.'"


_AGREED = [
    f"CASE WHEN ({' OR '.join(f'(list_contains(m, {x!r}) AND list_contains(m, {y!r}))' for x, y in pairs)}) AND c{k}.caption IS NOT NULL THEN '{intro}' || {_ended(f'c{k}.caption')} END"
    for k, (_, pairs, intro) in enumerate(narrative.AGREEMENT)
]
_LINES = ", ".join(_chosen("weighed", section, f"s{k}") for k, (section, _, _) in enumerate(narrative.AGREEMENT))


@query(
    f"WITH {EV}, {_WORDS}, weighed AS (SELECT tok.*, reliability, 0.0::DOUBLE AS support_score FROM tok JOIN rel USING (sample_id, modality)), {_LINES}, {_chosen('weighed', 'cross_modal_details', 'x')}, "
    "reliable AS (SELECT sample_id, list(DISTINCT modality) FILTER (WHERE reliability >= 0.5) AS m FROM weighed GROUP BY 1), "
    + ", ".join(f"c{k} AS (SELECT sample_id, caption FROM s{k}rk JOIN evidence USING (sample_id, evidence_id) WHERE rank = 1)" for k in range(3))
    + f", rest AS (SELECT sample_id, string_agg({_ended('caption')}, ' ' ORDER BY rank) AS rest FROM xrk JOIN evidence USING (sample_id, evidence_id) WHERE rank <= 2 GROUP BY 1), "
    f"l AS (SELECT reliable.sample_id, list_filter([{', '.join(_AGREED)}], lambda x: x IS NOT NULL) AS lines, coalesce(rest, '') AS rest FROM reliable LEFT JOIN c0 USING (sample_id) LEFT JOIN c1 USING (sample_id) LEFT JOIN c2 USING (sample_id) LEFT JOIN rest USING (sample_id)) "
    "SELECT sample_id, length(d) AS n_chars, md5(d) AS details_md5 FROM (SELECT sample_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines[1:2], ' ') ELSE rest END AS d FROM l)"
)
def cross_modal_details(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d)).withColumn("support_score", F.lit(0.0)).withColumn("sentence", F.col("caption"))
    rows = rows.join(support.reliability(rows), ["sample_id", "modality"])
    return narrative.cross_modal_details(rows).select("sample_id", F.length("details").cast("long").alias("n_chars"), F.md5("details").alias("details_md5"))


#: Every section's evidence by route, near copies dropped twice; the first two or three of each.
_MOST = case("section", narrative.LIMITS[False], "2")


@query(
    f"WITH {EV}, r AS (SELECT sample_id, evidence_id, modality, tokens, {_routes()} AS o FROM tok), placed AS (SELECT sample_id, evidence_id, tokens, o[1].score AS score, CASE WHEN round(o[1].score - o[2].score, 9) < 0.02 THEN CASE modality WHEN 'audio' THEN 'audio_cues' WHEN 'event' THEN 'motion_and_event_cues' ELSE 'visible_objects_and_layout' END ELSE o[1].section END AS section FROM r WHERE o[1].score > 0.45), "
    f"one AS (SELECT sample_id, section, {_fold(0.7, 'score DESC, evidence_id')} AS kept FROM placed GROUP BY 1, 2), ids AS (SELECT sample_id, section, unnest(kept) AS k, generate_subscripts(kept, 1) AS pos FROM one), flat AS (SELECT sample_id, section, k.evidence_id AS evidence_id, k.tokens AS tokens, pos FROM ids), "
    f"two AS (SELECT sample_id, section, {_fold(0.65, 'pos')} AS kept FROM flat GROUP BY 1, 2), last AS (SELECT sample_id, section, unnest(list_transform(kept, lambda x: x.evidence_id)) AS evidence_id, generate_subscripts(kept, 1) AS pos FROM two) "
    f"SELECT sample_id, section, md5(string_agg({_ended('caption')}, ' ' ORDER BY pos)) AS caption_md5 FROM last JOIN evidence USING (sample_id, evidence_id) WHERE pos <= {_MOST} GROUP BY 1, 2"
)
def section_captions(spark, d):
    rows = ad.with_tokens(ad.evidence(spark, d)).withColumn("reliability", F.lit(1.0)).withColumn("support_score", F.lit(0.0)).withColumn("sentence", F.col("caption"))
    wide = narrative.section_captions(rows)
    long = wide.select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("caption")) for c in dims.ROUTES])).alias("s")).select("sample_id", "s.*")
    return long.filter("caption <> ''").select("sample_id", "section", F.md5("caption").alias("caption_md5"))


@query(
    f"WITH {QAPAIRS}, {_FUSION} SELECT sample_id::VARCHAR AS sample_key, outcome AS status, section, array_to_string(cat_sections, ',') AS sections, category, modality AS source_modality, coalesce(qa_index::VARCHAR, '') AS qa_index, round(raw, 3) AS fusion_score, round(support_score, 3) AS support_score, {_size('supporting')}::VARCHAR AS supporting_modality_count, supporting AS supporting_modalities, "
    "conflicting AS conflicting_modalities, reason AS selection_reason, gate AS reliability_gate, priority AS review_priority, array_to_string(reasons, ',') AS review_reasons, CASE WHEN support_score >= 0.45 THEN 'strong' WHEN support_score >= 0.12 THEN 'moderate' WHEN support_score >= 0.08 THEN 'weak' ELSE 'very_weak' END AS support_level, md5(question) AS question_md5 FROM fused WHERE outcome <> 'dropped' AND question <> '' AND answer <> ''"
)
def fused_report_rows(spark, d):
    """The report's rows with questions and answers of their own."""
    both = fusion.fuse(ad.qa_evidence(spark, d))

    def shaped(df: DataFrame) -> DataFrame:
        return df.filter("question <> '' and answer <> ''").select(
            F.col("sample_id").cast("string").alias("sample_key"), "section", "sections", "category", F.col("modality").alias("source_modality"), F.coalesce(F.col("qa_index").cast("string"), F.lit("")).alias("qa_index"), F.round("score", 3).alias("fusion_score"), F.round("support_score", 3).alias("support_score"), F.col("supporting_count").alias("supporting_modality_count"), F.col("supporting").alias("supporting_modalities"),
            F.col("conflicting").alias("conflicting_modalities"), F.col("reason").alias("selection_reason"), F.col("gate").alias("reliability_gate"), F.col("priority").alias("review_priority"), "review_reasons", F.col("explanation.support_level").alias("support_level"), F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"),
        )

    rows = export.fused_rows(shaped(both.selected), shaped(both.review))
    names = "sample_key status section sections category source_modality qa_index supporting_modality_count supporting_modalities conflicting_modalities selection_reason reliability_gate review_priority review_reasons support_level".split()
    return rows.select(*names, *[F.col(c).cast("double").alias(c) for c in ("fusion_score", "support_score")], F.md5("question").alias("question_md5"))


# --- samples -------------------------------------------------------------------


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, modality ORDER BY evidence_id DESC) AS n FROM evidence) SELECT sample_id, modality, evidence_id FROM r WHERE n = 1")
def group_samples(spark, d):
    return ev.keep_last(ad.evidence(spark, d), ["sample_id", "modality"], ["evidence_id"]).select("sample_id", "modality", "evidence_id")


_CATEGORY_ROWS = ", ".join(f"('{c}')" for c in dims.CATEGORY_NAMES)


@query(f"WITH {EV}, every(category) AS (VALUES {_CATEGORY_ROWS}), s AS (SELECT DISTINCT sample_id FROM evidence), one AS (SELECT sample_id, category, min(evidence_id) AS id FROM evidence GROUP BY 1, 2) SELECT s.sample_id, every.category, md5(coalesce(e.caption, '')) AS caption_md5 FROM s CROSS JOIN every LEFT JOIN one ON one.sample_id = s.sample_id AND one.category = every.category LEFT JOIN evidence e ON e.evidence_id = one.id")
def fill_categories(spark, d):
    rows = ad.evidence(spark, d)
    first = rows.groupBy("sample_id", "category").agg(F.min_by("caption", "evidence_id").alias("caption")).select("*", F.lit("").alias("question"), F.lit("").alias("answer"))
    grid = ev.fill_categories(first, rows, dims.category_table(spark), ["sample_id"])
    return grid.select("sample_id", "category", F.md5("caption").alias("caption_md5"))


@query(f"WITH {EV}, {_WORDS}, v AS (SELECT *, {case('modality', dims.DISPLAY_ORDER, '99')} AS r FROM rel WHERE modality IN ('rgb', 'ir', 'depth')), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY (CASE WHEN modality = 'rgb' THEN 0 ELSE 1 END), round(reliability, 9) DESC, r) AS n FROM v) SELECT sample_id, modality AS best_visual FROM o WHERE n = 1")
def best_visual_modality(spark, d):
    rel = support.reliability(ad.with_tokens(ad.evidence(spark, d)))
    return support.best_visual(rel).select("sample_id", "best_visual")


@query("SELECT p_partkey, CASE WHEN x IN ('', 'semantic task') THEN CASE WHEN y <> '' THEN y ELSE x END WHEN y IN ('', 'semantic task') OR x = y THEN x ELSE x || ' / ' || y END AS label FROM (SELECT p_partkey, lower(trim(CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Semantic Task' ELSE p_type END)) AS x, lower(trim(CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_type ELSE p_brand END)) AS y FROM part)")
def combined_labels(spark, d):
    n = F.col("p_size")
    a = F.when(n % 4 == 0, "").when(n % 4 == 1, "Semantic Task").otherwise(F.col("p_type"))
    b = F.when(n % 3 == 0, " ").when(n % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    return ad.table(spark, d, "part").select("p_partkey", segments.combined_labels(a, b).alias("label"))


@query(f"WITH {PAIRS}, {_RELATED}, {_WORDS} SELECT sample_id, modality, round(max(reliability), 3) AS reliability, count(*) AS n, count(*) FILTER (WHERE support_score >= {dims.SUPPORTING}) AS supported FROM supported JOIN rel USING (sample_id, modality) GROUP BY 1, 2")
def modality_reliability_max(spark, d):
    rows = tokenised(spark, d)
    scored = support.support(rows, matching.best_pairs(rows)).join(support.reliability(rows), ["sample_id", "modality"])
    return scored.groupBy("sample_id", "modality").agg(F.round(F.max("reliability"), 3).alias("reliability"), F.count("*").alias("n"), F.count_if(F.col("support_score") >= dims.SUPPORTING).alias("supported"))
