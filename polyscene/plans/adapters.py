"""The driver's tables in the shapes of the evidence model; each adapter as a DataFrame and as SQL.

Whole tables and whole texts are used. documents stand for captions of 20 rows a sample,
conversations for questions and answers, events for hourly traces and recordings,
embeddings for vectors, orders for jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, evidence_id, modality, category, caption."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.floor(F.col("doc_id") / 20).alias("sample_id"),
        F.col("doc_id").alias("evidence_id"),
        pick(dims.FUSION_ORDER, 5).alias("modality"),
        pick(dims.CATEGORY_NAMES, 33).alias("category"),
        text.clean(F.col("text")).alias("caption"),
        "source",
        "lang",
    )


def with_tokens(rows: DataFrame, column: str = "caption") -> DataFrame:
    return rows.withColumn("tokens", text.tokens(F.col(column)))


CLEAN = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
TOKENS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains(" + quoted(dims.STOPWORDS) + ", t))))"
EVIDENCE = (
    f"evidence AS (SELECT doc_id // 20 AS sample_id, doc_id AS evidence_id, {quoted(dims.FUSION_ORDER)}[doc_id % 5 + 1] AS modality, "
    f"{quoted(dims.CATEGORY_NAMES)}[doc_id % 33 + 1] AS category, {CLEAN.format('text')} AS caption, source, lang FROM documents), "
    f"tok AS (SELECT *, {TOKENS.format('caption')} AS tokens FROM evidence)"
)
JACCARD = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END)"
PAIRS = "pairs AS (SELECT a.sample_id, a.evidence_id, a.modality, b.evidence_id AS other_evidence_id, b.modality AS other_modality, " + JACCARD.format("a.tokens", "b.tokens") + " AS score FROM tok a JOIN tok b ON a.sample_id = b.sample_id AND a.modality <> b.modality)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer: user turns and the turn after each, if an assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next", F.lead("text").over(w))
    pick = F.element_at(F.array(*map(F.lit, dims.CATEGORY_NAMES)), (F.col("conv_id") % 33 + 1).cast("int"))
    return rows.filter("role = 'user'").select("conv_id", "turn", text.clean(F.col("text")).alias("question"), text.clean(F.coalesce(F.when(F.col("next_role") == "assistant", F.col("next")), F.lit(""))).alias("answer"), pick.alias("category"))


QUESTIONS = (
    "turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)), "
    f"qa AS (SELECT conv_id, turn, {CLEAN.format('text')} AS question, {CLEAN.format(chr(39).join(['coalesce(CASE WHEN next_role = ', 'assistant', ' THEN next END, ', '', ')']))} AS answer, {quoted(dims.CATEGORY_NAMES)}[conv_id % 33 + 1] AS category FROM turns WHERE role = 'user')"
)

def qa_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers as evidence of samples of four conversations; answers are cut to six words, to their first sentence, or not at all, by conversation."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    conv, turn, answer = F.col("conv_id"), F.col("turn"), F.col("answer")
    first = F.regexp_extract(answer, r"^[^.!?]*", 0)
    short = F.trim(F.when(conv % 3 == 0, F.array_join(F.slice(F.split(answer, " "), 1, 6), " ")).when(conv % 3 == 1, first).otherwise(answer))
    rows = questions(spark, sf_dir).withColumn("answer", short)
    rows = rows.select(F.floor(conv / 4).alias("sample_id"), (conv * 1000 + turn).alias("evidence_id"), pick(dims.FUSION_ORDER, conv + turn).alias("modality"), pick(dims.CATEGORY_NAMES, conv * 7 + turn).alias("category"), "question", "answer", F.when(conv % 2 == 0, turn).alias("qa_index"))
    return with_tokens(rows.withColumn("caption", F.col("question")).withColumn("sentence", F.col("question")).withColumn("_said", F.concat_ws(" ", "question", "answer")), "_said").drop("_said")


QA_EVIDENCE = (
    f"{QUESTIONS}, short AS (SELECT conv_id, turn, question, trim(CASE conv_id % 3 WHEN 0 THEN array_to_string(string_split(answer, ' ')[1:6], ' ') WHEN 1 THEN regexp_extract(answer, '^[^.!?]*') ELSE answer END) AS answer FROM qa), "
    f"evidence AS (SELECT conv_id // 4 AS sample_id, conv_id * 1000 + turn AS evidence_id, {quoted(dims.FUSION_ORDER)}[(conv_id + turn) % 5 + 1] AS modality, {quoted(dims.CATEGORY_NAMES)}[(conv_id * 7 + turn) % 33 + 1] AS category, question, answer, CASE WHEN conv_id % 2 = 0 THEN turn END AS qa_index FROM short), "
    f"tok AS (SELECT *, {TOKENS.format(chr(39).join(['question || ', ' ', ' || answer']))} AS tokens FROM evidence)"
)

#: The hour that traces count from.
START = "2024-01-01"


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time stamp as it is written, whatever the session's zone."""
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """modality (an event type), idx (hour), value: the summed value of the hour."""
    e = table(spark, sf_dir, "events")
    hour = F.floor((seconds(F.col("ts")) - seconds(F.lit(START).cast("timestamp_ntz"))) / 3600)
    return e.groupBy(F.col("event_type").alias("modality"), hour.alias("idx")).agg(F.round(F.sum("value"), 6).alias("value"))


TRACES = f"trace AS (SELECT event_type AS modality, floor((epoch(ts) - epoch(TIMESTAMP '{START}')) / 3600)::BIGINT AS idx, round(sum(value), 6) AS value FROM events GROUP BY 1, 2)"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ord, start, end, label: time between consecutive events of a user, in minutes from the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("at", seconds(F.col("ts")))
    e = e.withColumn("ord", F.row_number().over(w)).withColumn("next", F.lead("at").over(w)).withColumn("first", F.min("at").over(Window.partitionBy("user_id")))
    return e.filter("next is not null").select("user_id", "ord", F.round((F.col("at") - F.col("first")) / 3600, 3).alias("start"), F.round((F.col("next") - F.col("first")) / 3600, 3).alias("end"), F.col("event_type").alias("label"), F.round(F.abs("value") / (F.abs("value") + 1), 3).alias("confidence"))


RECORDINGS = (
    "gaps AS (SELECT *, epoch(ts) AS secs, row_number() OVER w AS ord, lead(epoch(ts)) OVER w AS next, min(epoch(ts)) OVER (PARTITION BY user_id) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "recordings AS (SELECT user_id, ord, round((secs - first) / 3600, 3) AS start, round((next - first) / 3600, 3) AS \"end\", event_type AS label, round(abs(value) / (abs(value) + 1), 3) AS confidence FROM gaps WHERE next IS NOT NULL)"
)
