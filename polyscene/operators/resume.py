"""Incremental work: what is left, upserts of finished work, coalescing merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims

# Texts of placeholder annotations.
PLACEHOLDERS = ["Demo caption", "Demo question?", "Demo answer"]


def has_text(*fields: Column) -> Column:
    """Whether any field has a character that is not white space."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.trim(f.cast("string")) != "", F.lit(False))
    return out


def pending(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs without a finished row."""
    return jobs.join(done.select(*key), key, "left_anti")


def finished(done: DataFrame, trial: bool = False) -> DataFrame:
    """Rows whose annotations are complete; a row that holds blanks, placeholders or an error's nothing is not finished."""
    return done.filter(whole(done, "annotations", trial))


def with_state(rows: DataFrame, trial: bool = False) -> DataFrame:
    """rows with state: complete, else failed (with an error), else pending. rows: annotations, error."""
    state = F.when(whole(rows, "annotations", trial), "complete").when(F.col("error").isNotNull(), "failed")
    return rows.withColumn("state", state.otherwise("pending"))


def taken_up(done: DataFrame) -> DataFrame:
    """done with error and tries, which results of runs before had not: no error, one try."""
    for name, value in (("error", F.lit(None).cast("string")), ("tries", F.lit(1))):
        if name not in done.columns:
            done = done.withColumn(name, value)
    return done


def recorded(asked: DataFrame, jobs: DataFrame, done: DataFrame, key: str, trial: bool = False) -> DataFrame:
    """The rows of the jobs that were asked now, their tries of runs before added, those of done that were not, and each one's state.

    asked: key, the columns of done, error and tries (of this run); jobs: the keys that were asked. Which rows of done
    give way is read from jobs, so that asked, which may hold calls of a model, is in the plan once.
    """
    before, keys = taken_up(done), jobs.select(key)
    tried = before.groupBy(key).agg(F.sum("tries").alias("_before"))
    rows = asked.join(tried, key, "left")
    rows = rows.withColumn("tries", (F.coalesce("tries", F.lit(0)) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_before")
    return with_state(rows.unionByName(before.join(keys, key, "left_anti"), allowMissingColumns=True), trial)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks. Both have the same columns, each key once."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def coalesced(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For each key and field the first row's value that has the field; null values count, fields absent from `has` don't.

    rows: key, order, has (array of field names), fields.
    """
    picks = [F.min_by(f, F.when(F.array_contains("has", f), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*picks)


def work_estimate(jobs: DataFrame, done: DataFrame, key: list[str], manifest: str, calls: Column) -> DataFrame:
    """total, pending, skipped, manifests and model calls of the work left."""
    left = jobs.join(done.select(*key).withColumn("_done", F.lit(True)), key, "left")
    open_ = F.col("_done").isNull()
    return left.agg(F.count("*").alias("total"), F.count_if(open_).alias("pending"), F.count_if(~open_).alias("skipped"), F.countDistinct(F.when(open_, F.col(manifest))).alias("manifests"), F.sum(F.when(open_, calls).otherwise(0)).alias("calls"))


def leaves(annotations: Column) -> Column:
    """All trimmed texts of a map of category to caption, question and answer."""
    values = F.flatten(F.transform(F.map_values(annotations), lambda a: F.array(a["caption"], a["question"], a["answer"])))
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v != "", F.lit(False)))


def complete(annotations: Column, trial: bool = False) -> Column:
    """Whether annotations hold text that is not all placeholders; a trial run takes placeholders too."""
    said = F.coalesce(leaves(annotations), F.array().cast("array<string>"))
    real = F.lit(True) if trial else ~F.forall(said, lambda v: v.isin(PLACEHOLDERS))
    return (F.size(said) > 0) & real


def _below(c: Column, kind: T.DataType, texts: bool) -> Column:
    """The texts that stand anywhere in a value of that type, trimmed and not blank; or its other values that aren't null, as text."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        parts = [_below(c[f.name], f.dataType, texts) for f in kind.fields]
        return F.concat(none, *[F.coalesce(p, none) for p in parts])
    if isinstance(kind, (T.MapType, T.ArrayType)):
        values, inner = (F.map_values(c), kind.valueType) if isinstance(kind, T.MapType) else (c, kind.elementType)
        return F.coalesce(F.flatten(F.transform(values, lambda x: _below(x, inner, texts))), none)
    if isinstance(kind, T.StringType) != texts:
        return none
    value = F.trim(c) if texts else c.cast("string")
    return F.when(F.coalesce(value != "", F.lit(False)) if texts else c.isNotNull(), F.array(value)).otherwise(none)


def whole(rows: DataFrame, column: str, trial: bool = False) -> Column:
    """Whether a column of any nesting holds a text or another value, and its texts are not all placeholders; a trial takes placeholders too."""
    kind = rows.schema[column].dataType
    said, other = _below(F.col(column), kind, True), _below(F.col(column), kind, False)
    some = (F.size(said) > 0) | (F.size(other) > 0)
    return some if trial else some & ~((F.size(said) > 0) & F.forall(said, lambda v: v.isin(PLACEHOLDERS)))


def chosen_modalities(names: list[str] | None) -> list[str]:
    """Lower-case names, each once, in order; all of them for None or `all`; an error for an unknown or empty choice."""
    every = [m for m in dims.REASONING_ORDER]
    if names is None:
        return every
    clean = [n for n in (str(x).strip().lower() for x in names) if n]
    if "all" in clean:
        return every
    if not clean or any(n not in every for n in clean):
        raise ValueError(f"modalities are some of {', '.join(every)}")
    return list(dict.fromkeys(clean))


def by_manifest(jobs: DataFrame, manifest: str, order: str) -> DataFrame:
    """manifest, jobs: the jobs of each manifest in order, so that one call can serve them all."""
    fields = [c for c in jobs.columns if c != manifest]
    return jobs.groupBy(manifest).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("jobs"))  # within one recording


def response_of(responses: Column, segment_id: Column, job_key: Column, kind: str) -> Column:
    """A batch's answer for a segment, looked up by its id, then by its job's key, else an empty one."""
    return F.coalesce(F.try_element_at(responses, segment_id), F.try_element_at(responses, job_key), F.from_json(F.lit("{}"), kind))
