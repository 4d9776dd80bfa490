"""The fusion run as one plan: from modality results to fused, review and dropped rows, section captions and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import evidence as ev
from ..operators import facts as stated
from ..operators import fields, matching, narrative, reports, selection, support
from ..sources.store import stored

SEMANTIC_DUPLICATE = 0.9


@dataclass(frozen=True)
class Fused:
    """candidates: every evidence with score, gate, reasons and outcome (selected, review, dropped); sections: captions of each sample; facts: what its evidence states."""

    candidates: DataFrame
    sections: DataFrame
    reliability: DataFrame
    facts: DataFrame
    relaxed: bool = False

    @property
    def selected(self) -> DataFrame:
        return self._queue("selected")

    @property
    def review(self) -> DataFrame:
        """Rows for a reviewer, the best of each sample first."""
        from pyspark.sql import Window

        w = Window.partitionBy("sample_id").orderBy(F.round("score", 9).desc(), "evidence_id")
        return self._queue("review").withColumn("position", F.row_number().over(w))

    @property
    def dropped(self) -> DataFrame:
        return self._queue("dropped")

    def _queue(self, outcome: str) -> DataFrame:
        return self.candidates.filter(F.col("outcome") == outcome)

    def scene_graph(self) -> DataFrame:
        """The facts of each section's graph."""
        return stated.graph(self.facts, self.relaxed)

    def questions(self) -> DataFrame:
        """What each section of a sample asks, from its best fact, else from its caption."""
        return section_questions(self.sections, self.facts, self.reliability)

    def diagnostics(self) -> DataFrame:
        """dimension, value, n: outcomes, reasons for a drop, reasons for a review, and priorities."""
        rows = self.candidates
        one = reports.counts(rows.withColumn("drop_reason", F.when(F.col("outcome") == "dropped", F.col("drop_reason"))).withColumn("priority", F.when(F.col("outcome") == "review", F.col("priority"))), ["outcome", "drop_reason", "priority"]).filter("value is not null")
        why = rows.filter("outcome = 'review'").select(F.explode("review_reasons").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        return one.unionByName(why.select(F.lit("review_reason").alias("dimension"), "value", "n"))

    def modality_summary(self) -> DataFrame:
        return reports.modality_summary(self.candidates)


def judged(evidence: DataFrame, relaxed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every evidence with support, score, gate, review reasons and outcome; and the reliability of each sample's modalities.

    evidence: sample_id, evidence_id, modality, category, question, answer, caption, sentence, tokens, qa_index, and
    vector if there are embeddings. What is kept with a reason for review goes to review and takes no part in
    deduplication; the rest is deduplicated within the sample: equal texts, then tokens, then meaning.
    """
    reliable = support.reliability(evidence)
    scored = support.support(evidence, support.pairs(evidence) if "vector" in evidence.columns else matching.best_pairs(evidence)).join(reliable, ["sample_id", "modality"])
    said = evidence.select("evidence_id", "question", "answer", "qa_index", "tokens", *(["vector"] if "vector" in evidence.columns else []))
    has_qa = ((F.col("question") != "") & (F.col("answer") != "")).alias("has_qa")
    rows = selection.gated(scored.join(said, "evidence_id").select("*", has_qa), relaxed)
    matched = evidence.select(F.col("evidence_id").alias("match_id"), F.col("answer").alias("match_answer"))
    rows = rows.withColumn("match_id", F.coalesce("semantic_match", "lexical_match")).join(matched, "match_id", "left")
    n = {c: support.listed_count(F.col(c)) for c in ("supporting", "complementary", "conflicting", "weak")}
    why = selection.review_reasons(F.col("category"), F.col("question"), F.col("answer"), F.col("gate"), F.col("needs_lexical"), F.col("lexical_score"), F.col("semantic_score"), n["supporting"], n["complementary"], n["conflicting"], n["weak"], F.col("match_answer"))
    rows = rows.withColumn("review_reasons", F.when(F.col("keep"), why).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("priority", selection.review_priority(F.col("review_reasons"))).withColumn("supporting_count", n["supporting"])
    clean = rows.filter(F.col("keep") & (F.size("review_reasons") == 0))
    vector = ["vector"] if "vector" in evidence.columns else []
    items = clean.select("sample_id", F.col("evidence_id").alias("id"), F.round("score", 9).alias("score"), "question", "answer", "tokens", *vector)
    folded = selection.deduplicated(items, ["sample_id"], cosine_from=SEMANTIC_DUPLICATE if vector else None)
    folded = folded.select(F.col("id").alias("evidence_id"), F.col("outcome").alias("twin"), "duplicate_of")
    rows = rows.join(folded, "evidence_id", "left")
    twin = F.when(F.col("twin") != "kept", F.col("twin"))
    outcome = F.when(~F.col("keep") | twin.isNotNull(), F.lit("dropped")).when(F.size("review_reasons") > 0, F.lit("review")).otherwise("selected")
    drop = F.when(~F.col("keep"), F.col("reason")).otherwise(twin)
    return rows.withColumn("outcome", outcome).withColumn("drop_reason", drop).drop("twin", "tokens", "match_id", *vector), reliable


def section_questions(sections: DataFrame, told: DataFrame, reliable: DataFrame) -> DataFrame:
    """sample_id, section, caption, category, supporting, question, answer, qa_source, fact_type (null if from the caption).

    A section without a caption asks nothing. sections: a caption column a section; told: facts; reliable: as judged gives.
    """
    names = list(stated.SECTION_TYPES)
    best = stated.ranked(told, names).filter("rank = 1")
    fact = F.struct("fact_type", "entity", "value", F.col("source_answer").alias("answer"))
    wide = best.groupBy("sample_id").pivot("for_section", names).agg(F.first(fact))
    wide = wide.select("sample_id", *[F.col(n).alias(f"_{n}") for n in names])
    trust = reliable.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("modality", "reliability"))).alias("_trust"))  # a modality each
    rows = sections.join(wide, "sample_id", "left").join(trust, "sample_id", "left")

    def one(n: str):
        there = F.coalesce(n, F.lit(""))
        asked = fields.field_question(n, there, F.col(f"_{n}"))
        kind = F.when(asked["qa_source"] == "semantic_fact", F.col(f"_{n}.fact_type"))
        return F.struct(F.lit(n).alias("section"), there.alias("caption"), fields.primary_category(n, F.col("_trust")).alias("category"), *[asked[c].alias(c) for c in ("question", "answer", "qa_source")], kind.alias("fact_type"))

    out = rows.select("sample_id", fields.supporting(F.col("_trust")).alias("supporting"), F.explode(F.array(*map(one, names))).alias("q"))
    return out.select("sample_id", "supporting", "q.*")


def fuse(evidence: DataFrame, relaxed: bool = False) -> Fused:
    """All of it. evidence: as for judged. Evidence and what is judged of it are stored, as several steps read them."""
    evidence = stored(evidence, "evidence")
    rows, reliable = judged(evidence, relaxed)
    rows = stored(rows, "judged")
    text = evidence.select("evidence_id", "caption", "sentence", "tokens")
    asked = fields.evidence_question(F.col("section"), F.col("question"), F.col("answer"), F.col("caption"))
    full = rows.join(text.drop("tokens"), "evidence_id").withColumn("qa", asked).withColumn("explanation", support.explanation(rows))
    told = rows.select("sample_id", "evidence_id", "modality", "category", "question", "answer", "reliability", "support_score").join(text, "evidence_id")
    shown = rows.join(evidence.select("evidence_id", "caption"), "evidence_id")
    return Fused(full, narrative.section_captions(told, relaxed), reliable, stated.facts(shown), relaxed)


def fuse_results(results: DataFrame, relaxed: bool = False) -> Fused:
    """From rows of modality, pair_key and annotations, as result files hold them.

    Of several results of a sample and modality the last counts, by `position` in the file, or, without it, by
    pair_key. Evidence is numbered in the order of files, so that ties go to what stands first.
    """
    rows = ev.explode_annotations(ev.last_results(results))
    rank = dims.choose(F.col("modality"), {m: k for k, m in enumerate(dims.FUSION_ORDER)}, 9)
    place = [F.lpad(F.col(c).cast("string"), 9, "0") for c in ("annotation_ord", "qa_ord")]
    return fuse(rows.withColumn("evidence_id", F.concat_ws("|", "sample_id", rank.cast("string"), "modality", *place)), relaxed)
