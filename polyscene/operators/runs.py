"""The runs about model calls: which jobs there are, what comes back, and how much of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from . import resume

QA = "struct<caption: string, question: string, answer: string>"
TIMED = "struct<timestamp: string, caption: string, question: string, answer: string>"
# The ending of manifest files.
MANIFEST = "_task_segments.json"


def one_of(rows: DataFrame, order: list[str], index: int = 0) -> DataFrame:
    """The row at that place in order: what a trial run takes."""
    return rows.orderBy(*order).offset(index).limit(1)


def segment_jobs(manifests: DataFrame, dataset: str, trial: bool = False) -> DataFrame:
    """A job a segment that has an id. manifests: path, source_prefix, split_dir, side, source_files (map), segments (array of structs with segment_id).

    An absent prefix is the file's name without its ending, an absent folder that of the file, an absent side unknown;
    a job's key is the segment's path in the dataset. A trial takes the first job by path and place.
    """
    name = F.element_at(F.split("path", "/"), -1)
    blank = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    folder = F.coalesce(F.nullif(F.regexp_extract("path", "([^/]+)/[^/]*$", 1), F.lit("")), F.lit(""))
    rows = manifests.select("path", blank("source_prefix", F.regexp_replace(name, f"{MANIFEST}$", "")).alias("source_prefix"), blank("split_dir", folder).alias("split"), blank("side", F.lit("unknown")).alias("side"), F.coalesce("source_files", F.from_json(F.lit("{}"), "map<string,string>")).alias("source_files"), F.posexplode("segments").alias("pos", "segment"))
    rows = rows.filter(F.coalesce(F.col("segment.segment_id"), F.lit("")) != "").withColumn("split_dir", F.concat(F.lit(dataset.rstrip("/") + "/"), F.col("split")))
    out = rows.withColumn("key", F.concat_ws("/", "split_dir", "segment.segment_id")).drop("split")
    return (one_of(out, ["path", "pos"]) if trial else out).drop("pos")


def batched_audio(raw: Column) -> Column:
    """A batch's audio annotation (JSON text) as captions and categories.

    The two captions may be objects or plain texts; whatever is no object of a category goes; texts that are absent are ''.
    """
    said = lambda k: F.coalesce(F.get_json_object(raw, f"$.{k}.caption"), F.when(~F.coalesce(F.get_json_object(raw, f"$.{k}"), F.lit("")).rlike(r"^\s*[\[{]"), F.get_json_object(raw, f"$.{k}")))
    names = ["audio_hia", "audio_chronological_caption"]
    captions = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.trim(F.coalesce(said(n), F.lit(""))) for n in names])), lambda k, v: v != "")
    found = F.from_json(F.get_json_object(raw, "$.categories"), "map<string, string>")
    objects = F.map_filter(F.coalesce(found, F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")).startswith("{"))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def one(v: Column) -> Column:
        x = F.from_json(v, TIMED)
        return F.struct(x["timestamp"].alias("timestamp"), *[blank(x[c]).alias(c) for c in ("caption", "question", "answer")])

    return F.struct(captions.alias("captions"), F.transform_values(objects, lambda k, v: one(v)).alias("categories"))


def complete_fields(annotations: Column, category: Column, fallback: dict[str, str] | None = None) -> Column:
    """A category's caption, question and answer if all three are texts, else the fallback's, else blanks."""
    x = F.try_element_at(annotations, category)
    whole = x["caption"].isNotNull() & x["question"].isNotNull() & x["answer"].isNotNull()
    other = F.struct(*[F.lit((fallback or {}).get(c, "")).alias(c) for c in ("caption", "question", "answer")])
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(*[x[c].alias(c) for c in ("caption", "question", "answer")])).otherwise(other)


def annotated(pairs: DataFrame, responses: DataFrame, categories: list[str], fallback: dict[str, str] | None = None) -> DataFrame:
    """A modality's result rows: every pair with every category, from the model's responses or the fallback.

    pairs: pair_key and file columns; responses: pair_key, annotations (map to caption, question, answer).
    """
    rows = pairs.join(responses, "pair_key", "left").withColumn("annotations", F.coalesce("annotations", F.from_json(F.lit("{}"), f"map<string, {QA}>")))
    names = F.array(*map(F.lit, categories))
    full = F.map_from_arrays(names, F.transform(names, lambda c: complete_fields(F.col("annotations"), c, fallback)))
    return rows.withColumn("annotations", full)


def run_modality(modality: str, pairs: DataFrame, call: Callable[[DataFrame], DataFrame], categories: list[str], done: DataFrame | None = None, fallback: dict[str, str] | None = None, trial: bool = False) -> DataFrame:
    """One plan for each modality's run: pairs without complete annotations, asked of the model, completed, and joined with what was done.

    call: from pair rows to pair_key, annotations and, if it reports them, error and tries. The result has modality,
    pair_key, files, annotations, error, tries (of all runs) and state; a pair whose call failed, or gave blanks or
    placeholders, is asked again by the next run. Rows of done that are not asked again stay.
    """
    left = pairs if done is None else resume.pending(pairs, resume.finished(done, trial), ["pair_key"])
    asked = reported(call(left), "annotations")
    rows = annotated(left, asked, categories, fallback).withColumn("modality", F.lit(modality))
    rows = rows.withColumn("error", F.when(F.col("tries").isNull(), "no answer").otherwise(F.col("error")))
    return resume.recorded(rows, left, rows.sparkSession.createDataFrame([], rows.schema) if done is None else done, "pair_key", trial)


def reported(answers: DataFrame, column: str) -> DataFrame:
    """answers with error and tries; without word of them one try, and no error where there is an answer."""
    if "error" not in answers.columns:
        answers = answers.withColumn("error", F.when(F.col(column).isNull(), "no answer"))
    return answers if "tries" in answers.columns else answers.withColumn("tries", F.lit(1))


def run_segments(jobs: DataFrame, call: Callable[[DataFrame], DataFrame], done: DataFrame, order: str = "segment_id", trial: bool = False) -> DataFrame:
    """Segments without complete annotations, one call a manifest, each segment's answer by its id, then by its job's key; joined with what was done.

    jobs: key, manifest, segment_id; call: from manifest, jobs to manifest, responses (map from id to annotations) and,
    if it reports them, error and tries; done: key, segment_id, annotations, and what earlier runs recorded. The result
    has key, segment_id, annotations, error, tries and state; what failed or came back blank is asked again.
    """
    left = resume.pending(jobs, resume.finished(done, trial), ["key"])
    asked = reported(call(resume.by_manifest(left, "manifest", order)), "responses")
    rows = left.join(asked.select("manifest", "responses", "error", "tries"), "manifest", "left")
    kind = asked.schema["responses"].dataType.valueType.simpleString()
    own = resume.response_of(F.coalesce("responses", F.from_json(F.lit("{}"), f"map<string, {kind}>")), F.col("segment_id"), F.col("key"), kind)
    error = F.when(F.col("responses").isNull(), F.coalesce("error", F.lit("no answer")))
    return resume.recorded(rows.select("key", "segment_id", own.alias("annotations"), error.alias("error"), "tries"), left, done, "key", trial)


def video_pairs(files: DataFrame, kind: str) -> DataFrame:
    """pair, day, night: the first video of each side whose path holds `kind` anywhere. files: as from sources.files.media."""
    from ..sources.files import VIDEO, side_of

    rows = files.filter(F.col("extension").isin(VIDEO) & F.lower("path").contains(kind.lower())).withColumn("pair", text.pair_key(F.concat_ws("/", "folder", "stem"))).withColumn("side", side_of(F.col("stem")))
    return rows.groupBy("pair").pivot("side", ["day", "night"]).agg(F.min("path"))


def without_sound(pairs: DataFrame, audio: DataFrame) -> DataFrame:
    """Pairs that have no recording with sound."""
    return pairs.join(audio.select("pair"), "pair", "left_anti")


def cached(pairs: DataFrame, pair: str, side: str | None = None) -> DataFrame:
    """Cached frames of a pair by its key as written or normalised; of one side, if given."""
    key = text.pair_key(F.lit(pair))
    rows = pairs.filter((F.col("pair") == pair) | (F.col("pair") == key))
    return rows.filter(F.col("side") == side) if side else rows


def every_nth(frames: DataFrame, video_fps: Column, fps: float = 1.0) -> DataFrame:
    """Frames at every int(video_fps / fps)-th index. frames: idx."""
    return frames.filter(F.col("idx") % F.greatest(F.lit(1), (video_fps / F.lit(fps)).cast("int")) == 0)


def encoded_parts(files: DataFrame) -> DataFrame:
    """path, mime_type, data (base64) of the files that are there. files: path, content (as binaryFile reads it)."""
    from ..sources.files import mime_type

    return files.filter(F.col("content").isNotNull()).select("path", mime_type(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("mime_type"), F.base64("content").alias("data"))


def pair_totals(rows: DataFrame) -> DataFrame:
    """sample_id, n_pairs: question-answer pairs of each sample."""
    return rows.groupBy("sample_id").agg(F.count("*").alias("n_pairs"))


def unit_counts(units: DataFrame) -> DataFrame:
    """modality, n_samples, n_units, units_per_sample: how much each modality has to say."""
    out = units.groupBy("modality").agg(F.countDistinct("sample_id").alias("n_samples"), F.count("*").alias("n_units"))
    return out.withColumn("units_per_sample", F.round(F.col("n_units") / F.col("n_samples"), 3))


def map_totals(rows: DataFrame, sides: tuple[str, ...] = ("day", "night")) -> DataFrame:
    """Sizes of the lists of each side, summed. rows: a list column a side."""
    return rows.agg(*[F.coalesce(F.sum(F.greatest(F.size(s), F.lit(0))), F.lit(0)).cast("long").alias(f"{s}_total") for s in sides])


def prompt(title: str, fields: dict[str, Column], categories: list[str]) -> Column:
    """A request's text: what it is about, its fields as JSON, and the categories that are asked for."""
    about = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    return F.concat_ws("\n", F.lit(title), about, F.lit("Categories: " + ", ".join(categories)))


def categories_of(modality: str) -> list[str]:
    """The visual categories that a modality's run asks for."""
    names = dims.CATEGORY_NAMES
    if modality in ("event", "depth"):
        return [c for c in names if c.startswith(f"{modality}_")]
    return [c for c in names if not c.startswith(("event_", "depth_", "audio_"))]
