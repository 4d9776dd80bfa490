"""Calls of outside models as Arrow-batched plan steps, with an injectable client.

The client is a picklable function from a request to a text. Parallel calls are bounded
by the number of partitions, and a call is tried again after a pause that grows, longer
for quota errors. Calls can be paced: time is cut into slots of `spacing` seconds, in each
of which one partition may begin a call, in turn, so that all tasks together keep to one
budget without talking to each other. Without a client (`offline`) every answer is the same text.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import shipped, stored

# Tries of a call, seconds of a pause times the try, and of one after a quota error; what tells quota errors.
TRIES, PAUSE, QUOTA_PAUSE = 3, 2.0, 30.0
QUOTA_WORDS = ("quota", "rate limit", "rate_limit", "429", "resource_exhausted")


def offline(_request: str) -> str:
    return '{"caption": "", "question": "", "answer": ""}'


def is_quota_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(QUOTA_WORDS))


def called(client: Callable[[str], str], request: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, tries used) of one request."""
    for k in range(1, tries + 1):
        try:
            return client(request), None, k
        except Exception as e:  # noqa: BLE001  whatever a client raises becomes a row
            if k == tries:
                return None, str(e), k
            sleep((QUOTA_PAUSE if any(w in str(e).lower() for w in QUOTA_WORDS) else PAUSE) * k)
    return None, "no tries", 0


def own_slot(now: float, last: int, turn: int, parallel: int, spacing: float) -> int:
    """The number of the next slot of a partition, by its turn, that begins now or later and after slot `last`."""
    first = max(math.ceil(now / spacing), last + 1)
    return first + (turn - first) % parallel


def answered(requests: DataFrame, client: Callable[[str], str] = offline, parallel: int = 3, pause: Callable[[float], None] = time.sleep, spacing: float = 0.0, clock: Callable[[], float] = time.time) -> DataFrame:
    """key, answer, error, tries of each row (key, request).

    At most `parallel` calls run at once. With spacing, calls, tries after errors included, begin that many seconds
    apart at least, over all partitions, as far as the machines' clocks agree.
    """

    def run(frames):
        last, turn = -1, TaskContext.get().partitionId() % parallel

        def paced(request: str) -> str:
            nonlocal last
            if spacing:
                now = clock()
                last = own_slot(now, last, turn, parallel, spacing)
                if last * spacing > now:
                    pause(last * spacing - now)
            return client(request)

        for f in frames:
            got = [called(paced, r, sleep=pause) for r in f["request"]]
            yield pd.DataFrame({"key": f["key"], "answer": [g[0] for g in got], "error": [g[1] for g in got], "tries": [g[2] for g in got]})

    shipped(requests.sparkSession)
    kind = requests.schema["key"].dataType.simpleString()
    return requests.select("key", "request").repartition(parallel, "key").mapInPandas(run, f"key {kind}, answer string, error string, tries int")


def asking(client: Callable[[str], str], key: str, request: Column, kind: str, name: str, parallel: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """A call for runs: from rows to key, `name` (the answer, JSON as `kind`; null if it isn't), error, tries.

    Answers are stored as text at once and parsed where they are read: calls have as many tasks as may run at once, whatever
    the number of rows, so what these tasks would hold for a shuffle grows without bound.
    """

    def call(rows: DataFrame) -> DataFrame:
        got = stored(answered(rows.select(F.col(key).alias("key"), request.alias("request")), client, parallel, pause), "answers")
        made = F.from_json("answer", kind)
        error = F.coalesce("error", F.when(made.isNull(), "not the JSON that was asked for"))
        return got.select(F.col("key").alias(key), made.alias(name), error.alias("error"), "tries")

    return call


def embedded(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], column: str = "text", name: str = "vector") -> DataFrame:
    """rows with unit vectors of a text column; the encoder is set up once a task."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames):
        for f in frames:
            v = np.asarray(encoder(f[column].fillna("").tolist()), float).reshape(len(f), -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield f.assign(**{name: list(np.divide(v, n, out=np.zeros_like(v), where=n > 0))})

    return rows.mapInPandas(run, f"{out}, `{name}` array<double>")
