"""Readers of result, manifest and media files, and writers of reports.

Results are JSON objects keyed by sample; they are read as text and parsed as maps with a
declared schema, so a field of a wrong type becomes null instead of failing a job.
Media files are listed by path alone; their contents are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

FIELDS = "caption string, question string, answer string"
VISUAL = f"map<string, struct<night_file: string, day_file: string, annotations: map<string, struct<{FIELDS.replace(' string', ': string')}>>>>"
AUDIO = "map<string, struct<audio_file: string, day_rgb_file: string, night_rgb_file: string, annotations: struct<audio_hia: struct<caption: string>, audio_chronological_caption: struct<caption: string>, categories: map<string, struct<timestamp: string, caption: string, question: string, answer: string>>>>>"
MANIFEST = "source_prefix string, split_dir string, side string, status string, segment_source string, duration_seconds double, segments array<struct<segment_id: string, task_label: string, start_seconds: double, end_seconds: double, start_timestamp: string, end_timestamp: string, confidence: double, evidence_modalities: array<string>, notes: string>>"
ALIGNMENT = "pair_key string, side string, reference_duration_seconds double, alignments map<string, struct<offset_seconds: double, offset_frames: int, peak_correlation: double, confidence_label: string, duration_seconds: double, candidate_offsets: array<struct<offset_seconds: double, offset_frames: int, correlation: double, score: double, overlap_ratio: double>>>>"
VIDEO = ["mp4", "avi", "mov", "mkv", "webm"]
AUDIO_FILES = ["wav", "mp3", "m4a", "aac", "flac", "ogg"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def results(spark: SparkSession, path: str, kind: str = VISUAL, mode: str = "strict") -> DataFrame:
    """pair_key, ord and the fields of each sample of a JSON object file.

    strict: an absent or malformed file fails. lenient: an absent file is empty. resume: so is a malformed one.
    """
    if mode != "strict" and not exists(spark, path):
        parsed = spark.createDataFrame([], f"r {kind}")
    else:
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.from_json("value", kind).alias("r"))
        if mode != "resume":
            bad = F.raise_error(F.lit(f"no JSON object in {path}")).cast(kind)
            parsed = parsed.select(F.when(F.col("r").isNull(), bad).otherwise(F.col("r")).alias("r"))
        parsed = parsed.filter("r is not null")
    return parsed.select(F.posexplode(F.map_entries("r")).alias("ord", "e")).select(F.col("e.key").alias("pair_key"), "ord", "e.value.*")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row a segment of all *_task_segments.json below a folder; of equal ids the one in the last path."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_task_segments.json").json(folder)
    rows = rows.withColumn("path", F.input_file_name()).select("*", F.posexplode("segments").alias("pos", "s")).drop("segments")
    rows = rows.select(*[c for c in rows.columns if c not in ("pos", "s")], "pos", "s.*").filter("segment_id is not null")
    last = F.struct("path", "pos")
    best = rows.groupBy("segment_id").agg(F.max(last).alias("_k"))
    return rows.withColumn("_k", last).join(best, ["segment_id", "_k"]).drop("_k")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample and modality of an alignment list."""
    rows = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path)
    return rows.select("pair_key", "side", "reference_duration_seconds", F.explode("alignments").alias("modality", "a")).select("pair_key", "side", "reference_duration_seconds", "modality", "a.*")


def media(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, stem, extension of the files below a folder; only names are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"))


def side_of(stem: Column) -> Column:
    low = F.lower(stem)
    return F.when(low.contains("night"), F.lit("night")).when(low.contains("day"), F.lit("day")).otherwise("unknown")


def modality_sets(files: DataFrame, side: str) -> DataFrame:
    """One row a pair with a column a modality, from stems that end in _side_modality."""
    rows = files.filter(F.col("extension").isin(VIDEO)).withColumn("modality", F.regexp_extract(F.lower("stem"), f"_{side}_(rgb|event|depth|ir)$", 1)).filter("modality <> ''")
    key = F.regexp_replace(F.lower("stem"), f"_{side}_(rgb|event|depth|ir)$", "")
    return rows.groupBy("folder", key.alias("pair")).pivot("modality", ["rgb", "event", "depth", "ir"]).agg(F.min("path"))


def media_samples(files: DataFrame) -> DataFrame:
    """folder, prefix, side, videos by modality, audio, with_audio of the recordings below a folder."""
    low = F.lower("stem")
    kind = F.when(low.contains("with_audio"), F.lit("with_audio")).when(F.col("extension").isin(AUDIO_FILES), F.lit("audio")).when(F.col("extension").isin(VIDEO), F.lit("video"))
    prefix = F.regexp_replace(low, f"_(with_audio|{text.MODALITY})$", "")
    rows = files.withColumn("kind", kind).filter("kind is not null").withColumn("prefix", prefix).withColumn("modality", F.regexp_extract(low, f"_({text.MODALITY})$", 1))
    videos = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("kind") == "video", F.struct(F.when(F.col("modality") == "", F.lit("rgb")).otherwise(F.col("modality")).alias("m"), "path")))))
    one = lambda k: F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k)
    return rows.groupBy("folder", "prefix").agg(videos.alias("videos"), one("audio"), one("with_audio")).withColumn("side", side_of(F.col("prefix")))


def preferred_audio(files: DataFrame) -> DataFrame:
    """pair, path: one recording with sound a pair, the night one if there are both."""
    rows = files.filter(F.lower("stem").contains("with_audio")).withColumn("pair", text.pair_key(F.regexp_replace(F.lower("stem"), "_with_audio$", ""))).withColumn("side", side_of(F.col("stem")))
    both = rows.groupBy("pair").pivot("side", ["night", "day"]).agg(F.min("path"))
    return both.select("pair", F.coalesce("night", "day").alias("path")).filter("path is not null")


# MIME types by extension; others count as video/mp4.
MIME = {"mp4": "video/mp4", "avi": "video/x-msvideo", "mov": "video/quicktime", "mkv": "video/x-matroska", "webm": "video/webm", "wav": "audio/wav", "mp3": "audio/mpeg", "m4a": "audio/mp4", "flac": "audio/flac", "ogg": "audio/ogg", "aac": "audio/aac", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def mime_type(extension: Column) -> Column:
    out = F.lit("video/mp4")
    for k, v in MIME.items():
        out = F.when(F.lower(extension) == k, F.lit(v)).otherwise(out)
    return out


def frame_index(path: Column) -> Column:
    """The number after frame_ in a file name; null without."""
    return F.nullif(F.regexp_extract(path, r"frame_([0-9]+)", 1), F.lit("")).try_cast("int")


def cached_frames(files: DataFrame) -> DataFrame:
    """pair, side, frames (paths in order) of cached frames: pair/side/frame or pair_side_modality/frame."""
    nested = F.regexp_extract(F.lower("folder"), "/([^/]+)/(day|night)$", 1)
    flat = F.regexp_extract(F.lower("folder"), f"/([^/]+?)_(day|night)(?:_(?:{text.MODALITY}))?$", 1)
    side = F.coalesce(F.nullif(F.regexp_extract(F.lower("folder"), "/(day|night)$", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower("folder"), f"_(day|night)(?:_(?:{text.MODALITY}))?$", 1), F.lit("")))
    rows = files.filter(F.col("extension").isin("png", "jpg", "jpeg")).select(F.coalesce(F.nullif(nested, F.lit("")), F.nullif(flat, F.lit(""))).alias("pair"), side.alias("side"), frame_index(F.col("stem")).alias("n"), "path")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(-1)).alias("n"), "path"))), lambda x: x["path"])
    return rows.filter("pair is not null").groupBy("pair", "side").agg(ordered.alias("frames"))


def frame_folders(files: DataFrame, modality: str | None = None, side: str | None = None) -> DataFrame:
    """Names of the folders that hold frames, in order; of a modality and side, if given."""
    name = F.element_at(F.split("folder", "/"), -1)
    rows = files.filter(F.col("extension").isin("png", "jpg", "jpeg")).select(name.alias("name"), "folder").distinct()
    low = F.lower("name")
    if modality:
        rows = rows.filter(low.rlike(f"(^|_){modality}(_|$)"))
    if side:
        rows = rows.filter(low.contains(side))
    return rows.orderBy("name", "folder")


def rgb_recordings(files: DataFrame) -> DataFrame:
    """pair, side, path: the first RGB recording of each pair and side, those with sound apart."""
    low = F.lower("stem")
    rows = files.filter(F.col("extension").isin(VIDEO) & low.endswith("_rgb") & ~low.contains("with_audio")).select(text.pair_key(F.regexp_replace("path", r"(?i)_rgb(\.[^.]*)$", "$1")).alias("pair"), side_of(F.col("stem")).alias("side"), "path")
    return rows.groupBy("pair", "side").agg(F.min("path").alias("path"))


def without_audio(recordings: DataFrame, audio: DataFrame) -> DataFrame:
    """Pairs of recordings that no audio pair matches."""
    return recordings.select("pair").distinct().join(audio.select("pair"), "pair", "left_anti")


def sampled_indices(count: Column, most: int = 5) -> Column:
    """Evenly spread frame numbers from the first to the last, each once; none of an empty recording."""
    last = count - 1
    if most <= 1:
        picks = F.array(F.lit(0).cast("long"))
    else:
        picks = F.array_sort(F.array_distinct(F.array(*[F.least(last, F.bround(last * i / (most - 1)).cast("long")) for i in range(most)])))
    return F.when(count > 0, picks).otherwise(F.array().cast("array<bigint>"))


def write_rows(rows: DataFrame, path: str) -> None:
    """CSV with a header, one folder."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_nested(rows: DataFrame, key: str, path: str) -> None:
    """JSON lines, a row a key with its other columns as an object."""
    fields = [c for c in rows.columns if c != key]
    rows.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("items")).write.mode("overwrite").json(path)
