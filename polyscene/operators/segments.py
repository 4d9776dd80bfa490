"""Intervals of recordings: clamping, merging short ones, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SHORTEST = 15.0
SEGMENT = "struct<label:string,start:double,end:double,confidence:double,evidence:array<string>,notes:string>"


def clamped(raw: Column, duration: Column) -> Column:
    """Segments in order, none before the end of the one before or past the recording; empty ones go.

    raw: array of label, start, end, confidence, evidence, notes in the order of the list; null times default.
    """
    kind = f"array<{SEGMENT}>"
    zero = F.struct(F.lit(0.0).alias("end"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))
    limit = F.when(duration > 0, duration)

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        first = F.coalesce(x["start"], acc["end"])
        start = F.greatest(acc["end"], first)
        end = F.coalesce(x["end"], first)
        start, end = F.when(limit.isNotNull(), F.least(start, limit)).otherwise(start), F.when(limit.isNotNull(), F.least(end, limit)).otherwise(end)
        label = F.lower(F.trim(F.when(F.coalesce(x["label"], F.lit("")) != "", x["label"]).otherwise(F.concat(F.lit("task segment "), n))))
        one = F.struct(label.alias("label"), F.round(start, 3).alias("start"), F.round(end, 3).alias("end"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x["confidence"], F.lit(0.5)))).alias("confidence"), F.coalesce(x["evidence"], F.array().cast("array<string>")).alias("evidence"), F.trim(F.coalesce(x["notes"], F.lit(""))).alias("notes"))
        use = end > start
        return F.struct(F.when(use, end).otherwise(acc["end"]).alias("end"), n.alias("n"), F.when(use, F.concat(acc["out"], F.array(one).cast(kind))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(raw.cast(kind), zero, step, lambda acc: acc["out"])


def combined_labels(a: Column, b: Column) -> Column:
    """The labels joined by a slash; a general one gives way."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    general = ["", "semantic task"]
    return F.when(x.isin(general), F.when(y != "", y).otherwise(x)).when(y.isin(general) | (x == y), x).otherwise(F.concat(x, F.lit(" / "), y))


def joined_segments(a: Column, b: Column) -> Column:
    """One segment from a's start to b's end, its confidence weighted by duration."""
    da, db = F.greatest(F.lit(0.0), a["end"] - a["start"]), F.greatest(F.lit(0.0), b["end"] - b["start"])
    mean = F.when(da + db > 0, (a["confidence"] * da + b["confidence"] * db) / (da + db)).otherwise(F.least(a["confidence"], b["confidence"]))
    notes = F.array_join(F.array_distinct(F.filter(F.array(F.trim(a["notes"]), F.trim(b["notes"])), lambda s: s != "")), " ")
    return F.struct(combined_labels(a["label"], b["label"]).alias("label"), a["start"].alias("start"), b["end"].alias("end"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 3).alias("confidence"), F.array_distinct(F.concat(a["evidence"], b["evidence"])).alias("evidence"), notes.alias("notes"))


def merged(segments: Column, shortest: float = SHORTEST) -> Column:
    """No segment shorter than that unless it is alone: a short first one joins the next, others the one before."""
    kind = f"array<{SEGMENT}>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = (last["end"] - last["start"] < shortest) | (x["end"] - x["start"] < shortest)
        one = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined_segments(last, x)).cast(kind)).cast(kind)
        return F.when(F.size(acc) == 0, F.array(x).cast(kind)).when(short, one).otherwise(F.concat(acc, F.array(x)).cast(kind))

    return F.aggregate(segments.cast(kind), F.array().cast(kind), step)


# The one segment of a recording without usable ones.
WHOLE_LABEL, WHOLE_NOTES = "semantic task", "Fallback segment created because automatic task slicing did not return usable boundaries."


def normalized(raw: Column, duration: Column, modalities: Column, shortest: float = SHORTEST) -> Column:
    """Clamped and merged segments; without a usable one, one of the whole recording with all its modalities."""
    kind = f"array<{SEGMENT}>"
    own = F.transform(clamped(raw, duration), lambda s: s.withField("evidence", F.when(F.size(s["evidence"]) > 0, s["evidence"]).otherwise(modalities)))
    end = F.round(F.when(duration > 0, duration).otherwise(0.0), 3)
    whole = F.array(F.struct(F.lit(WHOLE_LABEL).alias("label"), F.lit(0.0).alias("start"), end.alias("end"), F.lit(0.0).alias("confidence"), modalities.alias("evidence"), F.lit(WHOLE_NOTES).alias("notes")))
    return F.when(F.size(own) > 0, merged(own.cast(kind), shortest)).otherwise(whole.cast(kind))


def manifests(samples: DataFrame) -> DataFrame:
    """samples with status and segments: `suggested` if a model gave segments without an error, else `fallback`.

    samples: prefix, duration, modalities, raw (array of segments, null without), error.
    """
    given = F.col("error").isNull() & (F.coalesce(F.size("raw"), F.lit(0)) > 0)
    none = F.array().cast(f"array<{SEGMENT}>")
    found = normalized(F.coalesce(F.when(F.col("error").isNull(), F.col("raw")), none), F.col("duration"), F.col("modalities"))
    return samples.withColumn("status", F.when(given, F.lit("suggested")).otherwise("fallback")).withColumn("segments", found).drop("raw")


def numbered(rows: DataFrame, prefix: str, segments: str) -> DataFrame:
    """One row a segment with its id and time stamps."""
    out = rows.select(*[c for c in rows.columns if c != segments], F.posexplode(segments).alias("pos", "s"))
    n = (F.col("pos") + 1).cast("string")
    seg = F.concat(F.col(prefix).cast("string"), F.lit("_seg_"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))
    return out.select("*", seg.alias("segment_id"), "s.label", "s.start", "s.end", "s.confidence", text.timestamp(F.col("s.start")).alias("start_timestamp"), text.timestamp(F.col("s.end")).alias("end_timestamp")).drop("pos", "s")


def points_in(points: DataFrame, intervals: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Rows of points with start <= at < end of the key's intervals.

    Intervals are cut into buckets of that width, so the join is on (key, bucket) and a
    recording with many points is spread over its buckets.
    """
    bucket = lambda c: F.floor(c / width)
    cut = intervals.filter("end > start").withColumn("_b", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    return points.withColumn("_b", bucket(F.col(at))).join(cut, [key, "_b"]).filter((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_b")


def payload(annotations: Column) -> Column:
    """A segment's fields and annotations as one record; absent annotations are an empty map."""
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("segment_id", "task_label", "start_timestamp", "end_timestamp")]
    times = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("start_seconds", "end_seconds")]
    none = F.from_json(F.lit("{}"), "map<string, struct<caption: string, question: string, answer: string>>")
    return F.struct(F.struct(*fields, *times).alias("segment"), F.coalesce(annotations, none).alias("annotations"))


def with_frames(jobs: DataFrame, frames: DataFrame, fps: float, width: float = 60.0) -> DataFrame:
    """jobs with the paths of their frames in order; jobs without a frame go. jobs: recording, segment_id, start, end; frames: recording, idx, path."""
    found = points_in(frames.withColumn("_at", F.col("idx") / fps), jobs.select("recording", "segment_id", "start", "end"), "recording", "_at", width)
    lists = found.groupBy("recording", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "path"))), lambda x: x["path"]).alias("frames"))  # within one segment
    return jobs.join(lists, ["recording", "segment_id"])
