"""Values of unknown shape as VARIANT: typed fields, and the leaves of a value whatever its depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def parsed(raw: Column) -> Column:
    """JSON text as a variant; null if it is none."""
    return F.try_parse_json(raw)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (JSON's null), or the name of another type; null without a value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_field(v: Column, path: str) -> Column:
    """The text at a path; '' where there is none, or a number, a truth value, a list or an object."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.coalesce(kind(at) == "STRING", F.lit(False)), F.try_variant_get(v, path, "string")).otherwise(F.lit(""))


def text_fields(v: Column, names: list[str], under: str = "$") -> Column:
    """A struct of texts of an object, as text_field gives them."""
    return F.struct(*[text_field(v, f"{under}.{n}").alias(n) for n in names])


def leaves(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, depth, kind, text: a row a value that is no object or list, anywhere in a variant column; JSON's nulls are left out.

    One pass a level of nesting, each stored, so the number of passes is the depth of the deepest value. Empty objects
    and lists have no leaves.
    """
    spark, depth = rows.sparkSession, 0
    node = rows.select(*key, F.col(column).alias("_node")).filter("_node is not null")
    out = None
    while True:
        met = stored(node.withColumn("_kind", kind(F.col("_node"))), "leaves")
        here = met.filter("_kind not in ('OBJECT', 'ARRAY', 'VOID')")
        here = here.select(*key, F.lit(depth).alias("depth"), F.col("_kind").alias("kind"), F.try_variant_get("_node", "$", "string").alias("text"))
        out = here if out is None else out.unionByName(here)
        inner = met.filter("_kind in ('OBJECT', 'ARRAY')").select(*key, "_node")
        if inner.isEmpty():
            return out
        each = spark.tvf.variant_explode(F.col("_node").outer()).select(F.col("value").alias("_child"))
        node, depth = inner.lateralJoin(each).select(*key, F.col("_child").alias("_node")), depth + 1


def complete(rows: DataFrame, key: list[str], column: str, placeholders: list[str], trial: bool = False) -> DataFrame:
    """key, complete: whether a variant holds a text or another value at any depth, and its texts aren't all placeholders.

    A trial takes placeholders too. key tells rows apart; rows without a value are not complete.
    """
    said = leaves(rows, key, column)
    word = F.when(F.col("kind") == "STRING", F.trim("text"))
    there = F.col("kind") != "STRING"
    sums = said.groupBy(*key).agg(
        F.count_if(F.coalesce(word != "", F.lit(False))).alias("_texts"),
        F.count_if(F.coalesce((word != "") & ~word.isin(placeholders), F.lit(False))).alias("_real"),
        F.count_if(there).alias("_others"),
    )
    some = (F.col("_texts") > 0) | (F.col("_others") > 0)
    whole = some if trial else some & ((F.col("_texts") == 0) | (F.col("_real") > 0))
    return rows.select(*key).join(sums.select(*key, whole.alias("complete")), key, "left").select(*key, F.coalesce("complete", F.lit(False)).alias("complete"))
