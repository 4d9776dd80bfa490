"""Counts over selected, review and dropped evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims


def counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of each dimension, in one pass of grouping sets."""
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    top = len(dimensions) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in enumerate(dimensions):
        own = F.col("g") == (2 ** len(dimensions) - 1 - 2 ** (top - k))
        name, value = F.when(own, F.lit(d)).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def fusion_counters(rows: DataFrame) -> DataFrame:
    """counter, value, n: the fifteen counters of a fusion run, selected, reviewed and dropped evidence apart.

    A row says which values of which counters it is of, those of its lists of sections and reasons among them, so that
    all counters share one scan and one aggregation; it adds once for a value that a list repeats. What is null counts
    as `unknown`. rows: outcome, section, sections, category, modality, outlier, reason, gate, review_reasons,
    priority, drop_reason.
    """
    one = lambda counter, value: F.array(F.struct(F.lit(counter).alias("counter"), F.coalesce(value.cast("string"), F.lit("unknown")).alias("value")))
    each = lambda counter, values: F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(counter).alias("counter"), F.coalesce(v, F.lit("unknown")).alias("value")))
    about = lambda prefix: [one(f"{prefix}section", F.col("section")), each(f"{prefix}multi_section", F.col("sections")), one(f"{prefix}category", F.col("category")), one(f"{prefix}modality", F.col("modality"))]
    flagged = F.when(F.size("review_reasons") > 0, F.lit("review_recommended")).otherwise("no_review_flag")
    selected = [*about(""), one("outlier", F.when(F.col("outlier"), "outlier").otherwise("not_outlier")), one("selection_reason", F.col("reason")), one("reliability_gate", F.col("gate")), one("review", flagged)]
    review = [*about("review_"), one("review_priority", F.col("priority")), each("review_reason", F.col("review_reasons"))]
    none = F.slice(one("", F.lit("")), 1, 0)
    said = F.when(F.col("outcome") == "selected", F.concat(*selected)).when(F.col("outcome") == "review", F.concat(*review)).when(F.col("outcome") == "dropped", one("dropped_reason", F.col("drop_reason"))).otherwise(none)
    return rows.select(F.explode(said).alias("c")).groupBy("c.counter", "c.value").agg(F.count("*").alias("n"))


def examples(rows: DataFrame, reason: str, order: str, most: int = 50) -> DataFrame:
    """The first rows of each reason."""
    w = Window.partitionBy(reason).orderBy(order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def modality_summary(rows: DataFrame) -> DataFrame:
    """Per modality: candidates, how many were selected, sent to review or dropped, means, and whether it needs a look.

    rows: modality, outcome (selected, review, dropped), support_score, lexical_score, supporting_count.
    """
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"{o}_count")
    out = rows.groupBy("modality").agg(F.count("*").alias("candidate_count"), n("selected"), n("review"), n("dropped"), F.avg("support_score").alias("s"), F.avg("lexical_score").alias("l"), F.avg("supporting_count").alias("c"))
    look = (F.round("s", 9) < dims.STRICT_SUPPORT) | (F.col("c") < 0.5)
    return out.select("modality", "candidate_count", "selected_count", "review_count", "dropped_count", F.round(F.round("s", 9), 3).alias("avg_support"), F.round(F.round("l", 9), 3).alias("avg_lexical"), F.round(F.round("c", 9), 3).alias("avg_supporting"), look.alias("needs_review"))


def grouped_by_section(rows: DataFrame, sections: str = "sections") -> DataFrame:
    """section, n of every section; unknown ones count as others."""
    one = rows.select(F.explode(sections).alias("section")).select(F.when(F.col("section").isin(dims.SECTIONS), F.col("section")).otherwise("others").alias("section"))
    every = rows.sparkSession.createDataFrame([(s,) for s in dims.SECTIONS], "section string")
    return every.join(one.groupBy("section").count(), "section", "left").select("section", F.coalesce("count", F.lit(0).cast("long")).alias("n"))


def reasoning_counts(units: DataFrame) -> DataFrame:
    """reasoning_group, modality, n for every group and modality. units: section, modality; a section may be in several groups."""
    spark = units.sparkSession
    known = F.broadcast(dims.group_table(spark))  # a literal table
    rows = units.join(known, "section", "left").select("modality", F.coalesce("reasoning_group", F.lit("ungrouped")).alias("reasoning_group")).groupBy("reasoning_group", "modality").count()
    grid = spark.createDataFrame([(g, m) for g in dims.GROUPS for m in dims.REASONING_ORDER], "reasoning_group string, modality string")
    return grid.join(rows, ["reasoning_group", "modality"], "left").select("reasoning_group", "modality", F.coalesce("count", F.lit(0).cast("long")).alias("n"))
