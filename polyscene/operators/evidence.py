"""Evidence rows from nested modality results: explode, coerce, number and key them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, text


def last_results(results: DataFrame, key: str = "pair_key") -> DataFrame:
    """Of the results of one sample and modality the last: by position in the file if there is such a column, else by key."""
    order = F.struct("position", key) if "position" in results.columns else F.struct(key)
    rows = results.groupBy("modality", text.fusion_key(F.col(key)).alias("_sample")).agg(F.max_by(F.struct(*results.columns), order).alias("_last"))
    return rows.select("_last.*")


def explode_annotations(results: DataFrame, key: str = "pair_key", annotations: str = "annotations") -> DataFrame:
    """One row a numbered question of an annotation. results: modality, key, annotations map.

    Keeps annotations with a caption, question or answer; blank fields are ''.
    """
    rows = results.select("modality", F.col(key).alias("raw_key"), F.posexplode(F.map_entries(annotations)).alias("annotation_ord", "a"))
    field = lambda n: text.clean(F.coalesce(F.col("a.value")[n].cast("string"), F.lit("")))
    rows = rows.select("modality", "raw_key", "annotation_ord", F.col("a.key").alias("category"), field("caption").alias("caption"), field("question").alias("question"), field("answer").alias("answer"))
    rows = rows.filter("caption <> '' or question <> '' or answer <> ''")
    pairs = text.fused_pairs(F.col("question"), F.col("answer"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("number"), F.col("question"), F.col("answer")))
    rows = rows.withColumn("pairs", pairs).withColumn("pairs", F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(whole))
    rows = rows.select("modality", text.fusion_key(F.col("raw_key")).alias("sample_id"), "raw_key", "annotation_ord", "category", "caption", F.posexplode("pairs").alias("qa_ord", "p"))
    rows = rows.select("modality", "sample_id", "raw_key", "annotation_ord", "category", "caption", "qa_ord", F.col("p.number").alias("qa_index"), F.col("p.question").alias("question"), F.col("p.answer").alias("answer"))
    said = F.trim(F.concat_ws(" ", F.when(F.col("question") != "", F.col("question")), F.when(F.col("answer") != "", F.col("answer"))))
    rows = rows.withColumn("evidence", F.when(said != "", said).otherwise(F.col("caption")))
    return rows.withColumn("sentence", F.when(F.col("caption") != "", F.col("caption")).otherwise(F.col("evidence"))).withColumn("tokens", text.tokens(F.col("evidence")))


def confidence(modality: Column, where: Column, caption: Column) -> Column:
    """Base confidence of a modality, other values at night, less for uncertain depth captions."""
    base = dims.choose(modality, dims.CONFIDENCE, 0.5)
    for m, c in dims.NIGHT_CONFIDENCE.items():
        base = F.when(F.lower(where).contains("night") & (modality == m), F.lit(c)).otherwise(base)
    unsure = F.lower(caption).rlike("|".join(dims.UNCERTAIN_PHRASES))
    return F.when((modality == "depth") & unsure, F.lit(0.35)).otherwise(base)


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered_sections(rows: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """section: audio_ and the slug of the kind, with _n for the n-th of a sample from 2 on."""
    rows = rows.withColumn("_slug", F.concat(F.lit("audio_"), text.slug(F.col(kind))))
    n = F.row_number().over(Window.partitionBy(*keys, "_slug").orderBy(*order))
    return rows.withColumn("_n", n).withColumn("section", F.when(F.col("_n") > 1, F.concat_ws("_", "_slug", "_n")).otherwise(F.col("_slug"))).drop("_slug", "_n")


def fill_categories(rows: DataFrame, samples: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """Every sample with every category; missing captions, questions and answers are ''."""
    grid = samples.select(*keys).distinct().join(F.broadcast(categories.select("category")))  # a literal table of categories
    out = grid.join(rows, [*keys, "category"], "left")
    return out.select(*keys, "category", *[F.coalesce(c, F.lit("")).alias(c) for c in ("caption", "question", "answer")])


def merged_samples(units: DataFrame) -> DataFrame:
    """sample_id, source_keys (modality to its first raw key), units in modality order. units: sample_id, modality, raw_key, section, caption, ord."""
    rank = dims.choose(F.col("modality"), {m: i for i, m in enumerate(dims.REASONING_ORDER)}, 99)
    rows = units.withColumn("_rank", rank)
    keys = rows.groupBy("sample_id", "_rank", "modality").agg(F.min("raw_key").alias("key"))
    keys = keys.groupBy("sample_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "modality", "key"))), lambda x: F.struct(x["modality"], x["key"]))).alias("source_keys"))
    lists = rows.filter(F.trim("caption") != "").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "section", "ord", "modality", "caption"))).alias("units"))
    return keys.join(lists, "sample_id", "left").withColumn("units", F.coalesce("units", F.array().cast("array<struct<_rank:int,section:string,ord:bigint,modality:string,caption:string>>")))


#: Audio annotations that carry a caption alone.
CAPTION_ONLY = ["audio_hia", "audio_chronological_caption"]


def nested_audio(sections: Column) -> Column:
    """captions (of the caption-only sections) and categories (all others) of a flat map of audio sections."""
    return F.struct(
        F.map_filter(sections, lambda k, _: k.isin(CAPTION_ONLY)).alias("captions"),
        F.map_filter(sections, lambda k, _: ~k.isin(CAPTION_ONLY)).alias("categories"),
    )
