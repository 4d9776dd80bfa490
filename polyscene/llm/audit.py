"""What filters of documents do to one another, in every order that they can be applied in.

1. Each document gets a mask of the filters that its text fails, and a digest of the text. Documents are counted by
   digest, part, mask and labels before equal texts meet, so a text that fills a third of the table is a few rows a
   task; all rows of a text but those of its smallest id fail the filter against copies.
2. What is left are cells: how many documents of a part have a mask and labels. There are at most 128 a part (5
   filters, 2 labels), whatever the number of documents.
3. The cells are unpivoted against the steps of every order, a row a cell, order and step. A running bit-or over the
   steps before tells whether the cell's documents are gone by then; conditional sums give what a step keeps, removes
   and finds removed already; a window over a part's filter sums what the filter removes in all orders.

All of it is DataFrame functions. Defined results: a null text is empty; a null part is the empty string; a null doc_id
is smaller than none and has none smaller, so it neither makes nor is a copy; rows that repeat a doc_id count each, and
such rows of the smallest id of a text are no copies; of several label rows of a document one that says 1 is enough,
a null label says nothing; an empty table gives no rows; of other columns, whatever their names, none is read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filter against copies, which looks at the whole table.
COPY = "E"


def words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: too short, too repetitive, too many capitals, odd characters."""
    said = words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(said) < 100,
        "B": F.size(F.array_distinct(said)) * 100 < F.size(said) * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, filters: dict[str, Column], part: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, part, mask (bit k: the k-th filter fails), digest: a row a document. filters: failing conditions on column _text."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(filters.values())]
    return rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.sha2("_text", 256).alias("digest"))


def told(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: a row a labelled document."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic"))


def cells(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """part, mask, good, toxic, n: documents counted, with the bit of copies in their masks. rows: as from masked."""
    kind = ["digest", "part", "mask", "good", "toxic"]
    known = rows.join(told(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    ids = known.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    met = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    # a text's rows are as many as parts and labels by now
    original = F.when(F.col("first") == F.min("first").over(Window.partitionBy("digest")), F.col("at_first")).otherwise(0)
    split = met.withColumn("own", F.coalesce(original, F.lit(0)) + F.col("nameless"))
    both = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    split = split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(found: DataFrame, letters: str) -> DataFrame:
    """A row a part, filter_order and step with the counts of the audit. found: as from cells, bit k being the k-th letter."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = found.withColumn("filter_order", F.explode(orders))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)"))
    steps = steps.withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, there = F.col("failed") != 0, F.col("earlier") == 0
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(there & ~fails, "kept"),
        total(there & fails, "removed"),
        total(~there & fails, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(there & fails & F.col("good"), "good_lost"),
        total(there & fails & F.col("toxic"), "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """The audit of four filters of texts and the one against copies."""
    filters = text_filters(F.col("_text"))
    return interactions(cells(masked(docs, filters, part, text), labels, 1 << len(filters)), "".join(filters) + COPY)
