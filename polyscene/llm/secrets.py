"""Secrets and who holds them, with built-in functions only.

Base patterns give assignments, access keys and hexadecimal keys. Further candidates
are long mixed tokens. For every candidate's hash the corpus is asked in how many
documents (repositories) and sources (owners) it stands: a value that stands in many
owners' documents is an example that people copied; one that a single owner holds and
that looks random is taken for live. Mixed tokens that look live are added as spans of
the kind `owned`; base spans always stay, with n_live and n_example telling them apart.

Counts go hash, owner, repository -> hash, owner -> hash, each summed in tasks first, so
a value that a third of all rows hold is spread over its repositories.

Defined results: a null text is empty; a null source is an owner of its own, like a
null doc_id a repository; rows that repeat a doc_id are searched each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored
from .pii import apart
from .spans import kinds_of, listed, matches

#: Fixed patterns, rewritten to be linear-time; the same leftmost non-overlapping matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: A further candidate: 20 characters or more of the alphabets that keys use.
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "owned"]
#: Owners, or repositories, from which on a value counts as a copied example.
OWNERS, REPOSITORIES = 3, 20
#: Different characters that a random-looking value has at least.
DIFFERENT = 10


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= 8),
        "access": matches(text, ACCESS, text.contains("AKIA")),
        "hex": matches(text, HEX),
    }


def _random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)


def _searched(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), repository.alias("repository"), owner.alias("owner"), text)
    found = rows.select("row", "doc_id", "repository", "owner", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], matches(F.col("text"), MIXED).alias("mixed"))
    base = kinds_of({k: F.col(k) for k in BASE}, BASE)

    def valued(spans: Column, rank: int, value=lambda h: h) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), value(x["hit"]).alias("value")))

    further = apart(F.filter("mixed", lambda x: _random(x["hit"])), F.col("base"))  # linear in the matches of a text
    values = F.concat(valued(F.col("assign"), 0, lambda h: F.regexp_extract(h, VALUE, 1)), valued(F.col("access"), 1), valued(F.col("hex"), 2), valued(further, len(BASE)))
    found = found.withColumn("base", base).withColumn("values", values)
    hashed = F.transform("values", lambda v: F.struct(v["start"].alias("start"), v["rank"].alias("rank"), v["end"].alias("end"), F.sha2(v["value"], 256).alias("hash"), _random(v["value"]).alias("random")))
    return stored(found.select("row", "doc_id", "repository", "owner", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], "base", hashed.alias("values")), "secrets")


def ownership(cand: DataFrame) -> DataFrame:
    """hash, owners, repositories: how many hold each value."""
    held = cand.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    found = _searched(docs, F.col(repository), F.col(owner))
    cand = found.filter(F.size("values") > 0).select("row", "repository", "owner", F.explode("values").alias("v")).select("row", "repository", "owner", "v.*")
    cand = stored(cand, "values")
    example = (F.col("owners") >= OWNERS) | (F.col("repositories") >= REPOSITORIES)
    live = F.col("random") & ~example
    span = F.struct("start", F.col("rank"), "end", F.lit("owned").alias("kind"))
    told = salted_join(cand, ownership(cand), "hash", "row").groupBy("row").agg(
        F.collect_set(F.when((F.col("rank") == len(BASE)) & live, span)).alias("more"),  # within one text
        F.count_if((F.col("rank") < len(BASE)) & live).alias("n_live"),
        F.count_if((F.col("rank") < len(BASE)) & example).alias("n_example"),
    )
    out = found.drop("values").join(told.hint("merge"), "row", "left")  # rows with candidates have no bound
    both = F.array_sort(F.concat("base", F.coalesce("more", F.filter("base", lambda x: F.lit(False)))))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
