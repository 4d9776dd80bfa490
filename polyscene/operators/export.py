"""Normalized units, grouped question-answer exports and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, text
from .evidence import confidence

# Columns of the two CSV reports, in order.
SEGMENT_COLUMNS = [
    "file_name", "task_label", "start_timestamp", "end_timestamp", "segment_confidence", "segment_id", "unit_index",
    "pair_index", "modality", "section", "evidence", "question", "answer", "timestamp", "confidence",
]
FUSED_COLUMNS = [
    "sample_key", "status", "row_index", "section", "primary_section", "sections", "category", "qa_source", "qa_index",
    "source_modality", "annotation_key", "fusion_score", "support_score", "lexical_support_score",
    "semantic_support_score", "semantic_support_raw_cosine", "supporting_modality_count", "supporting_modalities",
    "complementary_supporting_modality_count", "complementary_supporting_modalities", "conflicting_modality_count",
    "conflicting_modalities", "modality_reliability", "modality_weight_profile", "requires_lexical_support",
    "is_outlier", "selection_reason", "reliability_gate", "review_recommended", "review_priority", "review_reasons",
    "support_level", "best_support_modality", "best_support_score", "best_direct_support_modality",
    "best_complementary_support_modality", "best_match_modality", "best_match_category",
    "support_relations_by_modality", "question", "answer",
]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def visual_units(results: DataFrame) -> DataFrame:
    """One unit a section with a caption. results: modality, pair_key, annotations map."""
    rows = results.select("modality", "pair_key", F.explode("annotations").alias("section", "a"))
    fields = [_blank(F.col("a")[f]).alias(f) for f in ("caption", "question", "answer")]
    return _unit(rows.select("modality", "pair_key", "section", *fields, F.lit(None).cast("string").alias("timestamp")).filter(F.trim("caption") != ""))


def audio_units(results: DataFrame) -> DataFrame:
    """One unit a category with a caption, question or answer. results: pair_key, categories map."""
    rows = results.select(F.lit("audio").alias("modality"), "pair_key", F.explode("categories").alias("section", "a"))
    fields = [_blank(F.col("a")[f]).alias(f) for f in ("caption", "question", "answer")]
    rows = rows.select("modality", "pair_key", "section", *fields, F.col("a")["timestamp"].alias("timestamp"))
    return _unit(rows.filter((F.trim("caption") != "") | (F.trim("question") != "") | (F.trim("answer") != "")))


def _unit(rows: DataFrame) -> DataFrame:
    sample = text.reasoning_key(F.col("pair_key"))
    return rows.select(sample.alias("sample_id"), "*", confidence(F.col("modality"), F.concat_ws(" ", sample, "pair_key"), F.col("caption")).alias("confidence"))


def split_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row a question-answer pair of a unit, numbered from 1; units without pairs vanish."""
    pairs = text.exported_pairs(_blank(F.col("question")), _blank(F.col("answer")))
    other = [c for c in units.columns if c not in ("question", "answer")]
    rows = units.select(*other, F.posexplode(pairs).alias("pos", "p"))
    return rows.select(*other, F.col("p.question").alias("question"), F.col("p.answer").alias("answer"), (F.col("pos") + 1).alias("pair_index"))


def grouped_pairs(units: DataFrame, order: list[str]) -> DataFrame:
    """Pairs by reasoning group, with each unit's place in its sample's group from 0. units: sample_id, modality, section, caption, question, answer, and the columns of order."""
    known = F.broadcast(dims.group_table(units.sparkSession).withColumnRenamed("section", "_section"))  # a literal table
    rows = units.filter(F.trim("caption") != "").withColumn("_key", text.section_name(F.col("section"))).join(known, F.col("_key") == F.col("_section"), "left")
    rows = rows.withColumn("reasoning_group", F.coalesce("reasoning_group", F.lit("ungrouped")))
    place = F.row_number().over(Window.partitionBy("sample_id", "reasoning_group").orderBy(*order)) - 1
    return split_units(rows.withColumn("source_unit_index", place).drop("_key", "_section"), ["sample_id"])


def every_cell(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """counts (sample_id, reasoning_group, modality, n) with zeros for the cells that have none."""
    grid = samples.sparkSession.createDataFrame([(g, m) for g in dims.GROUPS for m in dims.REASONING_ORDER], "reasoning_group string, modality string")
    cells = samples.select("sample_id").distinct().withColumn("_k", F.lit(1)).join(F.broadcast(grid.withColumn("_k", F.lit(1))), "_k").drop("_k")  # 35 literal cells a sample
    return cells.join(counts, ["sample_id", "reasoning_group", "modality"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def with_metadata(rows: DataFrame, meta: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the fields of meta, those of meta first; a missing key column is the row's own."""
    given = meta.select(key, *[F.col(f).alias(f"_m_{f}") for f in fields])
    out = rows.join(given, key, "left")
    own = lambda f: F.coalesce(F.col(f"_m_{f}"), F.col(f)) if f in rows.columns else F.col(f"_m_{f}")
    return out.select(key, *[own(f).alias(f) for f in fields], *[c for c in rows.columns if c != key and c not in fields])


def segment_rows(pairs: DataFrame) -> DataFrame:
    """The columns of the segment report, blanks for absent ones."""
    have = set(pairs.columns)
    default = {"pair_index": F.lit(1), "unit_index": F.col("source_unit_index") if "source_unit_index" in have else F.lit(0), "evidence": F.col("caption") if "caption" in have else F.lit("")}
    return pairs.select(*[(F.col(c) if c in have else default.get(c, F.lit(""))).alias(c) for c in SEGMENT_COLUMNS])


def fused_rows(selected: DataFrame, review: DataFrame) -> DataFrame:
    """Selected and review rows with the columns of the fused report; arrays are joined, blanks for absent ones."""

    def shaped(df: DataFrame, status: str) -> DataFrame:
        kinds = dict(df.dtypes)
        cell = lambda c: F.array_join(c, ",") if kinds[c].startswith("array<string") else F.col(c).cast("string")
        out = df.select(*[(cell(c) if c in kinds else F.lit("")).alias(c) for c in FUSED_COLUMNS if c != "status"], F.lit(status).alias("status"))
        return out.select(*FUSED_COLUMNS)

    return shaped(selected, "selected").unionByName(shaped(review, "review"))
