"""Cross-modal agreement within samples: one equi-join on the sample, then window maxima.

Tokens of a side are joined as arrays of hashes, so a pair costs one row; samples are small
and the join key spreads them, so nothing is broadcast but literal tables. Reliability
needs no join: one row a token holds the modalities that have it as a bit mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, text


def pairs(evidence: DataFrame) -> DataFrame:
    """Ordered pairs of different modalities of a sample: lexical, cosine, semantic and (fused) score of each.

    With a `vector` column (unit vectors), cosines count too, by the weights of the first side's category; without, the
    score is the Jaccard score of the tokens alone. Similarities are the same either way, so they are computed once for
    each two rows and the row is turned round after.
    """
    meant = "vector" in evidence.columns
    weight = F.lit(1.0)
    rows = evidence
    if meant:
        rows = dims.with_category(rows.select("sample_id", "evidence_id", "modality", "category", "tokens", "vector"))
        weight = F.col("lexical_weight")
    vector = F.col("vector").cast("array<double>") if meant else F.lit(None).cast("array<double>")
    rows = rows.select("sample_id", "evidence_id", "modality", weight.alias("weight"), text.token_keys(F.col("tokens")).alias("tokens"), vector.alias("vector"))
    names = ("evidence_id", "modality", "weight", "tokens", "vector")
    other = rows.select("sample_id", *[F.col(c).alias(f"other_{c}") for c in names])
    both = rows.join(other, "sample_id").filter("evidence_id < other_evidence_id and modality <> other_modality")
    cos = cosine(F.col("vector"), F.col("other_vector")) if meant else F.lit(None).cast("double")
    scored = both.select("sample_id", *names[:3], *[f"other_{c}" for c in names[:3]], text.jaccard(F.col("tokens"), F.col("other_tokens")).alias("lexical"), cos.alias("cosine"))
    scored = scored.withColumn("semantic", F.coalesce(semantic_score(F.col("cosine")), F.lit(0.0)))
    way = lambda a, b: F.struct(*[F.col(f"{p}{c}").alias(f"{q}{c}") for p, q in ((a, ""), (b, "other_")) for c in names[:3]])
    turned = scored.select("sample_id", "lexical", "cosine", "semantic", F.explode(F.array(way("", "other_"), way("other_", ""))).alias("p"))
    score = F.col("p.weight") * F.col("lexical") + (1 - F.col("p.weight")) * F.col("semantic") if meant else F.col("lexical")
    return turned.select("sample_id", "p.evidence_id", "p.modality", "p.other_evidence_id", "p.other_modality", score.alias("score"), "lexical", "cosine", "semantic")


def best_match(scored: DataFrame) -> DataFrame:
    """The best other of each evidence and modality; scores of 0 match nothing, the smaller id wins ties."""
    w = Window.partitionBy("evidence_id", "other_modality").orderBy(F.desc("score"), "other_evidence_id")
    return scored.filter("score > 0").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reliability(evidence: DataFrame) -> DataFrame:
    """sample_id, modality, reliability: overlap of a modality's words with the others', and how many shared words it has."""
    names = dims.FUSION_ORDER
    bit = dims.choose(F.col("modality"), {m: 1 << i for i, m in enumerate(names)}, 0)
    rows = evidence.select("sample_id", bit.alias("bit"), F.explode_outer(text.token_keys(F.col("tokens"))).alias("token"))
    masks = rows.groupBy("sample_id", "token").agg(F.bit_or("bit").alias("mask"))
    # a sample has few masks, whatever the number of its words, so the many sums below are of few rows
    masks = masks.groupBy("sample_id", "mask").agg(F.count("token").alias("words"))
    has = lambda m: F.col("mask").bitwiseAND(1 << names.index(m)) > 0
    n = lambda c: F.sum(F.when(c, F.col("words")).otherwise(0))
    two = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    several = F.bit_count("mask") >= 2
    sums = masks.groupBy("sample_id").agg(
        *[F.max(has(m)).alias(f"in_{m}") for m in names], *[n(has(m)).alias(f"n_{m}") for m in names], *[n(has(x) & has(y)).alias(f"n_{x}_{y}") for x, y in two],
        n(several).alias("anchors"), *[n(several & has(m)).alias(f"anchors_{m}") for m in names],
    )

    def jaccard(x: str, y: str) -> Column:
        both = F.col(f"n_{x}_{y}" if (x, y) in two else f"n_{y}_{x}")
        return F.when(F.col(f"n_{y}") > 0, F.when(F.col(f"n_{x}") > 0, both / (F.col(f"n_{x}") + F.col(f"n_{y}") - both)).otherwise(0.0))

    def scored(m: str) -> Column:
        each = F.array_compact(F.array(*[jaccard(m, o) for o in names if o != m]))
        overlap = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.size(each)).otherwise(0.0)
        cover = F.when(F.col("anchors") == 0, 1.0).otherwise(F.col(f"anchors_{m}") / F.col("anchors"))
        alone = ~F.reduce(F.array(*[F.col(f"in_{o}") for o in names if o != m]), F.lit(False), lambda a, b: a | b)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.15) + overlap * 2.5 + cover * 1.3))
        return F.when(F.col(f"in_{m}"), F.struct(F.lit(m).alias("modality"), F.when(alone, 1.0).otherwise(score).alias("reliability")))

    return sums.select("sample_id", F.explode(F.array_compact(F.array(*[scored(m) for m in names]))).alias("r")).select("sample_id", "r.*")


def _said(evidence: DataFrame) -> list[Column]:
    q, a = (F.coalesce(F.col(c), F.lit("")) if c in evidence.columns else F.lit("") for c in ("question", "answer"))
    return [q.alias("question"), F.concat_ws(" ", q, a).alias("said")]


#: In what two texts can contradict each other.
CLASHES = {"numeric": text.number_tokens, "direction": text.direction_tokens, "negation": text.polarity_tokens}


def relations(evidence: DataFrame, best: DataFrame) -> DataFrame:
    """How each best match supports its evidence: raw and rounded scores, relation, kinds of conflict, and what was matched.

    evidence: evidence_id, category, and question and answer if there are any.
    """
    rated = dims.with_category(evidence.select("evidence_id", "category", *_said(evidence)))
    rated = rated.select("evidence_id", "profile", "question", "said")
    answer = F.coalesce(F.col("answer"), F.lit("")) if "answer" in evidence.columns else F.lit("")
    other = evidence.select(F.col("evidence_id").alias("other_evidence_id"), F.col("category").alias("match_category"), answer.alias("match_answer"), *[c.alias(f"o_{n}") for n, c in zip(("question", "said"), _said(evidence), strict=True)])
    rows = best.join(rated, "evidence_id").join(other, "other_evidence_id")
    prof = F.broadcast(dims.profile_table(evidence.sparkSession).withColumnRenamed("modality", "other_modality"))  # a literal table
    rows = rows.join(prof, ["profile", "other_modality"], "left")
    clash = F.array_compact(F.array(*[F.when(text.conflict(f(F.col("said")), f(F.col("o_said"))), F.lit(k)) for k, f in CLASHES.items()]))
    # words are compared for close scores alone
    same = F.when(F.col("score") >= 0.7, (F.size(clash) > 0) & (text.jaccard(text.tokens(F.col("question")), text.tokens(F.col("o_question"))) >= 0.45))
    rows = rows.withColumn("_clash", F.coalesce(same, F.lit(False)))
    relation = F.when(F.col("_clash"), F.lit("conflict")).when(F.col("direct"), F.lit("direct_support")).when(F.col("complementary"), F.lit("complementary_support")).otherwise("weak_or_irrelevant")
    return rows.select(
        "sample_id", "evidence_id", "modality", "other_modality", "other_evidence_id", F.col("score").alias("raw"), F.round("score", 3).alias("score"), "lexical", "cosine", "semantic", relation.alias("relation"),
        F.when(F.col("_clash"), clash).otherwise(F.array().cast("array<string>")).alias("conflict_types"), "match_category", F.col("o_question").alias("match_question"), "match_answer",
    )


def support(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """Per evidence: lexical, semantic and support score, the modalities of each relation, best first, and the matches.

    match_answer is that of the best semantic match, else of the best lexical one. Scores are stored in maps by modality.
    """
    related = relations(evidence, best_match(scored))
    top = lambda name: F.coalesce(F.max(F.when(F.col("relation") == name, F.col("score"))), F.lit(0.0))

    def listed(name: str, least: float) -> Column:
        one = F.struct((-F.col("score")).alias("s"), dims.display_rank(F.col("other_modality")).alias("r"), F.col("other_modality").alias("m"))
        kept = F.collect_list(F.when((F.col("relation") == name) & (F.col("score") >= least), one))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["m"]), ",")

    fields = ["relation", "score", "lexical", "semantic", "match_category", "match_question", "match_answer", "conflict_types"]
    # of at most one row a modality
    out = related.groupBy("evidence_id").agg(
        F.greatest(top("direct_support"), 0.5 * top("complementary_support")).alias("support_score"),
        listed("direct_support", dims.SUPPORTING).alias("supporting"),
        listed("complementary_support", dims.SUPPORTING).alias("complementary"),
        listed("conflict", dims.MIN_SUPPORT).alias("conflicting"),
        listed("weak_or_irrelevant", dims.MIN_SUPPORT).alias("weak"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("other_modality", F.struct(*fields))))).alias("by_modality"),
    )
    first = lambda c: F.min_by("other_evidence_id", F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("far"), "other_evidence_id")))
    whole = scored.groupBy("evidence_id").agg(
        F.max("lexical").alias("lexical_score"), F.max("semantic").alias("semantic_score"), F.max_by("cosine", F.when(F.col("semantic") > 0, F.col("semantic"))).alias("cosine"),
        first("lexical").alias("lexical_match"), first("semantic").alias("semantic_match"),
    )
    out = evidence.select("sample_id", "evidence_id", "modality", "category").join(whole, "evidence_id", "left").join(out, "evidence_id", "left")
    none, scores = F.lit(""), ("lexical_score", "semantic_score", "cosine", "support_score")
    return out.select(
        "sample_id", "evidence_id", "modality", "category", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in scores],
        *[F.coalesce(c, none).alias(c) for c in ("supporting", "complementary", "conflicting", "weak")], "lexical_match", "semantic_match", "by_modality",
    )


def listed_count(names: Column) -> Column:
    """How many names a comma-joined list holds."""
    return F.when(names == "", 0).otherwise(F.size(F.split(names, ",")))


def explanation(rows: DataFrame) -> Column:
    """Why a row is supported. rows: as from support and gated."""
    best = F.array_sort(F.transform(F.map_entries("by_modality"), lambda e: F.struct((-e["value"]["score"]).alias("far"), dims.display_rank(e["key"]).alias("rank"), e["key"].alias("m"))))
    best = F.get(best, F.lit(0))
    from .selection import support_level

    counts = [listed_count(F.col(c)).alias(f"{c}_count") for c in ("supporting", "complementary", "conflicting")]
    return F.struct(
        F.col("gate"), F.col("profile").alias("modality_weight_profile"), support_level(F.col("support_score")).alias("support_level"),
        F.coalesce(best["m"], F.lit("")).alias("best_support_modality"), F.coalesce(-best["far"], F.lit(0.0)).alias("best_support_score"),
        F.substring_index("supporting", ",", 1).alias("best_direct_support_modality"), F.substring_index("complementary", ",", 1).alias("best_complementary_support_modality"),
        *counts, F.col("conflicting").alias("conflicting_modalities"), F.col("needs_lexical").alias("requires_lexical_support"),
        F.round("lexical_score", 3).alias("lexical_support_score"), F.round("semantic_score", 3).alias("semantic_support_score"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_score(cos: Column) -> Column:
    span = dims.COSINE_CEILING - dims.COSINE_FLOOR
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos - dims.COSINE_FLOOR) / span))


def modality_weight(profile: Column, modality: Column) -> Column:
    """Weight of a modality in a profile; 0.3 if unknown."""
    out = F.lit(0.3)
    for p, w in dims.PROFILE_WEIGHTS.items():
        for m, x in zip(dims.FUSION_ORDER, w, strict=True):
            out = F.when((profile == p) & (modality == m), F.lit(x)).otherwise(out)
    return out


def best_visual(reliabilities: DataFrame) -> DataFrame:
    """sample_id, best_visual: rgb if there is one, else the most reliable of ir and depth."""
    rank = F.struct((F.col("modality") == "rgb").alias("rgb"), F.round("reliability", 9).alias("r"), (-dims.display_rank(F.col("modality"))).alias("o"))
    return reliabilities.filter(F.col("modality").isin("rgb", "ir", "depth")).groupBy("sample_id").agg(F.max_by("modality", rank).alias("best_visual"))
