"""Language identification by rank-order n-gram profiles.

Each learned language is the list of its most frequent character n-grams. A text
is compared to every list by the out-of-place distance: the sum, over the text's
own most frequent n-grams, of how far apart the two ranks are, with a fixed
largest value for n-grams that the list lacks.

Training counts the n-grams of all training rows, first within each task. Only the lists (PROFILE n-grams a language) reach the driver.

Defined results: a null text, or one without a letter, is `und` with score 0; so
is every text if no training row has a language. Equal counts rank in n-gram order,
in texts and in profiles; all n-grams of a text are ranked, and those that a profile
lacks count as far away as can be, so a text that has letters but no n-gram of any
profile gets the first language with score 0; equal distances go to the smaller
language name. Repeated rows count, and are predicted, each. A null doc_id counts as
a training row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_texts, ship, texts_of

#: n-grams in a profile and n-grams of a text that are ranked.
PROFILE = 400
#: Distinct n-grams held in a training task before they are handed on.
HELD = 300_000

_BITS = 20
#: Stands for a word's edge; no letter has this code point.
EDGE = 1
_ALPHA: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


def grams(text: bytes | None) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased words, as integers of 21 bits a character; EDGE stands for a word's edge."""
    c = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), "<u4").astype(np.int64)
    c = np.where(_letters()[c], c, EDGE)
    c = np.concatenate([[EDGE], c, [EDGE]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != EDGE) | (c[:-1] != EDGE)
    c = c[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != EDGE], two, three[c[1:-1] != EDGE]])


def spell(gram: int) -> str:
    """The n-gram as text, _ for a word's edge."""
    return "".join("_" if p == EDGE else chr(p) for k in (42, 21, 0) if (p := gram >> k & 0x1FFFFF))


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Table:
    """Integers to dense numbers; a slot holds one key, and keys without a slot stay outside."""

    def __init__(self):
        self.at = np.full(1 << _BITS, -1, np.int32)
        self.keys = np.full(1 << _BITS, -1, np.int64)
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        """Give free slots to new distinct keys."""
        s = _slots(keys)
        s, first = np.unique(s, return_index=True)
        free = self.at[s] < 0
        s, k = s[free], keys[first[free]]
        self.at[s] = np.arange(self.size, self.size + len(k))
        self.keys[s] = k
        self.size += len(k)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for keys outside."""
        s = _slots(keys)
        return np.where(self.keys[s] == keys, self.at[s], -1)


def _counted(batches):
    table, sums, rest = Table(), {}, {}

    def out():
        own = np.zeros(table.size, np.int64)
        used = np.flatnonzero(table.at >= 0)
        own[table.at[used]] = table.keys[used]
        for lang in sorted(sums):
            c, more = sums[lang][: table.size], rest.get(lang, {})
            i = np.flatnonzero(c)
            if len(i) or more:
                k = np.concatenate([own[i], np.fromiter(more, np.int64, len(more))])
                n = np.concatenate([c[i], np.fromiter(more.values(), np.int64, len(more))])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])
        table.__init__()
        sums.clear()
        rest.clear()

    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            keys = grams(t)
            number = table.find(keys)
            if (new := number < 0).any():
                table.add(np.unique(keys[new]))
                number = table.find(keys)
                over, n = np.unique(keys[number < 0], return_counts=True)
                into = rest.setdefault(lang, {})
                for k, m in zip(over.tolist(), n.tolist(), strict=True):
                    into[k] = into.get(k, 0) + m
            c = sums.setdefault(lang, np.zeros(1 << 16, np.int64))
            if len(c) < table.size:
                c = sums[lang] = np.concatenate([c, np.zeros(max(table.size - len(c), len(c)), np.int64)])
            c[: table.size] += np.bincount(number[number >= 0], minlength=table.size)
            if table.size + sum(map(len, rest.values())) > HELD or len(sums) * table.size > 64 * HELD:
                yield from out()
    yield from out()


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", where: Column | None = None) -> dict[str, list[int]]:
    """Each language's n-grams, most frequent first, from the rows that `where` keeps."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if where is None else where))
    counts = (
        rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_counted, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    got = counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= PROFILE)
    model: dict[str, list[int]] = {}
    for r in got.collect():
        model.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(model.items())}


def predictor(model: dict[str, list[int]]):
    """A function from texts to (languages, scores)."""
    langs, table = list(model), Table()
    outside: dict[int, int] = {}
    keys = np.unique(np.array([g for v in model.values() for g in v], np.int64))
    table.add(keys)
    for k in keys[table.find(keys) < 0].tolist():
        outside[k] = table.size + len(outside)
    size = table.size + len(outside)

    def numbers(k: np.ndarray) -> np.ndarray:
        n = table.find(k)
        if outside:
            for x, i in outside.items():
                n[k == x] = i
        return n

    # the last row is of n-grams that no profile holds
    ranks, known = np.full((size + 1, max(len(langs), 1)), PROFILE, np.int64), np.zeros((size + 1, max(len(langs), 1)), bool)
    for j, v in enumerate(model.values()):
        i = numbers(np.array(v, np.int64))
        ranks[i, j], known[i, j] = np.arange(len(v)), True

    def one(t: bytes | None):
        k = grams(t)
        if not langs or not len(k):
            return "und", 0.0
        own, count = np.unique(k, return_counts=True)
        at = numbers(own[np.argsort(-count, kind="stable")[:PROFILE]])
        at = np.where(at < 0, size, at)
        far = np.where(known[at], np.abs(ranks[at] - np.arange(len(at))[:, None]), PROFILE).sum(0)
        best = int(far.argmin())
        return langs[best], 1.0 - float(far[best]) / (PROFILE * len(at))

    def work(texts):
        got = [one(t) for t in texts]
        return [[g[0] for g in got], [min(1.0, max(0.0, g[1])) for g in got]]

    return work


def predict(docs: DataFrame, model: dict[str, list[int]], keep: dict[str, Column], text: str = "text") -> DataFrame:
    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())]
    return map_texts(docs, keep, fields, lambda: predictor(model), text)


def identify(docs: DataFrame) -> DataFrame:
    """Profiles learned from the training fold; predictions for all rows: doc_id, held_out, lang_pred, score."""
    model = fit(docs, where=~held_out())
    return predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
