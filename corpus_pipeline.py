"""A corpus through five training-data operators, each stage stored as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyscene.llm import bpe, decontam, pii, simhash, toxicity
from polyscene.llm.common import stored
from polyscene.llm.queries import table, vocabulary


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a verbatim window with a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with their number and digests of the ids and of the decoded text."""
    return bpe.tokenize(docs, vocabulary(), {"doc_id": F.col("doc_id")}, outputs=(*bpe.DIGESTS, "token_ids"))


STAGES = [
    ("toxicity", toxic_removed),
    ("near-duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal-data", redacted),
    ("encoding", encoded),
]

#: No SQL: the stages learn models, link fingerprints and encode text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
