"""Dependent calls of a model: each stage's request is made of the item and of what stages before answered.

Every stage is a stored table of records, and is resumed alone. A record keeps the digest of its request, so an answer
counts as long as its request is the same: a stage that failed is asked again by the next run, and when its answer
changes, the stages that were fed by it are asked again too, others are not.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import stored
from . import models

RECORD = "request_md5 string, answer string, error string, tries int"


@dataclass(frozen=True)
class Stage:
    """request: from the answers before, by name, to the request's text, null if it can't be made; parsed: from what the
    model says to the answer, null if it is of no use; stand_in: what later stages get in place of an absent answer."""

    name: str
    request: Callable[[dict[str, Column]], Column]
    parsed: Callable[[Column], Column]
    stand_in: str | None = None


def plain(said: Column) -> Column:
    """The text without a fence, null if there is none."""
    return F.nullif(text.without_fence(said), F.lit(""))


def listed(said: Column) -> Column:
    """The JSON list of objects in the text, null if there is none or none of its items is an object."""
    found = F.from_json(text.json_list(said), "array<string>")
    objects = F.filter(found, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    return F.when(F.size(objects) > 0, F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))


def run(items: DataFrame, key: str, stages: list[Stage], client: Callable[[str], str], done: DataFrame | None = None, parallel: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, stage, request_md5, answer, error, tries, state of every item and stage.

    done: the records of a run before. state: complete; failed (the call gave an error or nothing of use; tries are of
    all runs with this request); blocked (a stage before has no answer and no stand-in). Requests read the items' columns.
    """
    kind = items.schema[key].dataType.simpleString()
    if done is None:
        done = items.sparkSession.createDataFrame([], f"{key} {kind}, stage string, {RECORD}")
    rows, records, names = items, [], []
    for stage in stages:
        want = rows.withColumn("_request", stage.request({n: F.col(f"_{n}") for n in names})).withColumn("request_md5", F.md5("_request"))
        old = done.filter(F.col("stage") == stage.name).select(key, "request_md5", "answer", "error", "tries")
        have = want.select(key, "_request", "request_md5").join(old, [key, "request_md5"], "left")
        open_ = F.col("answer").isNull() & F.col("_request").isNotNull()
        got = models.answered(have.filter(open_).select(F.col(key).alias("key"), F.col("_request").alias("request")), client, parallel, pause)
        got = got.select(F.col("key").alias(key), stage.parsed(F.col("answer")).alias("_new"), F.col("error").alias("_error"), F.col("tries").alias("_tries"))
        both = have.join(got, key, "left")
        error = F.when(F.col("answer").isNull() & F.col("_new").isNull() & F.col("_tries").isNotNull(), F.coalesce("_error", F.lit("nothing of use in the answer")))
        state = F.when(F.coalesce("answer", "_new").isNotNull(), "complete").when(F.col("_request").isNull(), "blocked").otherwise("failed")
        tries = (F.coalesce("tries", F.lit(0)) + F.coalesce("_tries", F.lit(0))).cast("int")
        record = both.select(key, F.lit(stage.name).alias("stage"), "request_md5", F.coalesce("answer", "_new").alias("answer"), error.alias("error"), tries.alias("tries"), state.alias("state"))
        kept = stored(record, f"stage-{stage.name}")
        records.append(kept)
        said = kept.select(key, F.coalesce("answer", F.lit(stage.stand_in).cast("string")).alias(f"_{stage.name}"))
        rows = rows.join(said, key, "left")
        names.append(stage.name)
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    return out


def audio_stages(frames: Column, media: Column, stand_ins: tuple[str | None, str | None] = (None, None)) -> list[Stage]:
    """What is seen, then what is heard and when, given that, then questions about it.

    frames and media: columns of the items that name what the calls are about; null: absent, so its stage is blocked.
    """
    ask = lambda title, *parts: F.concat(F.lit(title), *[p for x in parts for p in (F.lit("\n"), x)])
    return [
        Stage("hia", lambda _: ask("Say who interacts with what in these frames.", frames), plain, stand_ins[0]),
        Stage("caption", lambda a: ask("Tell with time stamps what this recording lets hear, given what is seen.", media, a["hia"]), plain, stand_ins[1]),
        Stage("qa_pairs", lambda a: ask("Ask and answer, as a JSON list of question_type, timestamp, context, question, answer.", a["caption"]), listed),
    ]


QA_PAIR = "array<struct<question_type: string, timestamp: string, context: string, question: string, answer: string>>"


def audio_annotations(records: DataFrame, key: str) -> DataFrame:
    """key, captions (audio_hia, audio_chronological_caption), categories (a section a pair, numbered from the second of a type on)."""
    answer = lambda s: F.max(F.when(F.col("stage") == s, F.col("answer")))
    rows = records.groupBy(key).agg(answer("hia").alias("audio_hia"), answer("caption").alias("audio_chronological_caption"), answer("qa_pairs").alias("qa"))
    pairs = F.coalesce(F.from_json("qa", QA_PAIR), F.array().cast(QA_PAIR))
    blank = lambda c: F.coalesce(c, F.lit(""))
    slugs = F.transform(pairs, lambda p: F.concat(F.lit("audio_"), text.slug(p["question_type"])))
    rows = rows.withColumn("pairs", pairs).withColumn("slugs", slugs)
    nth = lambda i: F.size(F.filter(F.slice("slugs", 1, i + 1), lambda s: s == F.get("slugs", i)))
    section = lambda i: F.when(nth(i) > 1, F.concat_ws("_", F.get("slugs", i), nth(i).cast("string"))).otherwise(F.get("slugs", i))
    one = lambda p, i: F.struct(section(i).alias("key"), F.struct(p["timestamp"].alias("timestamp"), blank(p["context"]).alias("caption"), blank(p["question"]).alias("question"), blank(p["answer"]).alias("answer")).alias("value"))
    names = ["audio_hia", "audio_chronological_caption"]
    captions = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[blank(F.col(n)) for n in names])), lambda _, v: F.trim(v) != "")
    return rows.select(key, captions.alias("captions"), F.map_from_entries(F.transform("pairs", one)).alias("categories"))
