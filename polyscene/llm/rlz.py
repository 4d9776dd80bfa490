"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

Windows of WINDOW words name their phrase by the least hash among the short word runs
inside (its anchor), so equal windows meet under one anchor wherever they stand, and
consecutive windows with one anchor form a phrase. The phrases of all documents, dealt
by anchor, are the indexed reference blocks. Parsing a document looks up its phrases,
left to right: a phrase that stands whole in an earlier document joins the factor before
it; where a factor begins or ends inside a phrase, the windows at that boundary are
looked up one by one. Runs of matched windows are the factors: the duplicate spans.

1. Tasks cut phrases, keep the earliest of equal ones and mark the rest at once, so a
   group of copies sends one row a task. One shuffle of phrases (about 1 in 5.5 words).
2. Phrases that share an anchor but not their words send their windows; this is a small
   second shuffle, with equal windows reduced in each task first.
3. Spans return to their documents, whose words they remove.

Hashes only route: an anchor and a phrase hash (128 bits), or an anchor and a window
hash, must agree for words to go.

Defined results: a null text has no words; documents of under WINDOW words keep all;
a null doc_id counts as larger than every other; rows that repeat a doc_id never
remove words from one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, stored, texts_of

WINDOW = 13
#: Words in the runs that anchors are chosen from.
RUN = 4
#: Phrases that a task reduces at once.
HELD = 1 << 19
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD + words[j : j + n]
    return mixed(h)


def phrases(words: list[bytes]):
    """Of a document: anchor, phrase hash, first window and number of windows of each phrase; the window hashes."""
    none = np.zeros(0, np.uint64)
    if len(words) < WINDOW:
        return none, none, none.astype(np.int64), none.astype(np.int64), none
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    short, window = runs(hashed, RUN), runs(hashed, WINDOW)
    best = (short & ~_PLACE) | np.arange(len(short), dtype=np.uint64)  # ties go to the left one
    width, wide = 1, WINDOW - RUN + 1
    while 2 * width <= wide:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(window)], best[wide - width : wide - width + len(window)])
    place = (best & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.concatenate([first, [len(place)]]))
    at = place[first]
    # The first and last window of a phrase, with their places about the anchor, hold all of its words.
    whole = mixed(window[first] * _ODD + window[first + many - 1] + (((at - first) << 5) | many).astype(np.uint64))
    return short[at], whole, first, many, window


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) & 0x7FFFFFFF


def _reduced(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pack: np.ndarray) -> pa.RecordBatch:
    """Rows with `sure` true where an equal (a, b) of an earlier document is among them; those get a key of their own."""
    order = np.lexsort([doc, b, a])
    a, b, doc, pack = a[order], b[order], doc[order], pack[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = doc[np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))]
    sure = doc > least
    again = ~head & ~sure & np.concatenate([[False], pack[1:] == pack[:-1]])  # the same row of a repeated document
    own = mixed(doc.view(np.uint64) * _ODD + pack.view(np.uint64))
    a = np.where(sure, own, a)
    b = np.where(sure, np.uint64(0), b)
    keep = ~again
    cols = [a.view(np.int64), b.view(np.int64), doc, pack, sure]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], ["a", "b", "doc", "pack", "sure"])


class _Held:
    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, a, b, doc: int, pack) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.parts.append((a, b, np.full(len(a), doc, np.int64), pack))
            self.n += len(a)
        if self.n >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            batch = _reduced(*(np.concatenate(x) for x in zip(*self.parts)))
            for i in range(0, batch.num_rows, 1 << 16):
                yield batch.slice(i, 1 << 16)
        self.parts, self.n = [], 0


def packed(key: int, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """31 bits of the text's hash, 28 of the first window, 4 of the number of windows."""
    return (np.int64(key) << 32) | (first << 4) | many


def _cut(batches):
    held = _Held()
    for batch in batches:
        for doc, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            a, b, first, many, _ = phrases(t.split())
            yield from held.add(a, b, doc, packed(text_key(t), first, many))
    yield from held.out()


def _asked(batches):
    """The windows of the phrases that are asked for."""
    held = _Held()
    for batch in batches:
        for doc, t, asked in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            if not asked or t is None:
                continue
            key, want = text_key(t), {p & 0xFFFFFFFF for p in asked if p >> 32 == text_key(t)}
            a, _, first, many, window = phrases(t.split())
            use = np.array([int(x) in want for x in (first << 4) | many], bool) if want else np.zeros(len(a), bool)
            a, first, many = a[use], first[use], many[use]
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            yield from held.add(np.repeat(a, many), window[at] if len(at) else window[:0], doc, packed(key, at, np.ones(len(at), np.int64)))
    yield from held.out()


_ROWS = "a bigint, b bigint, doc bigint, pack bigint, sure boolean"


def matched(docs: DataFrame) -> DataFrame:
    """doc, pack: runs of windows that also start in a document with a smaller id. docs: doc, text."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull()).mapInArrow(_cut, _ROWS).repartition("a")
    equal, anchor = Window.partitionBy("a", "b"), Window.partitionBy("a")
    rows = rows.withColumn("first", F.min("doc").over(equal))
    rows = rows.withColumn("mixed", F.min("b").over(anchor) != F.max("b").over(anchor))
    rows = rows.withColumn("found", F.col("sure") | (F.col("first") < F.col("doc")))
    rows = stored(rows.filter("found or mixed").select("doc", "pack", "found"), "phrases")
    ask = rows.filter("not found").groupBy("doc").agg(F.collect_list("pack").alias("asked"))  # within one document
    asked = by_document(docs).join(ask, "doc", "left").select("doc", "text", "asked")
    windows = asked.mapInArrow(_asked, _ROWS).repartition("a", "b")
    windows = windows.withColumn("first", F.min("doc").over(equal)).filter("sure or first < doc")
    return rows.filter("found").select("doc", "pack").union(windows.select("doc", "pack"))


def by_document(docs: DataFrame) -> DataFrame:
    return docs.repartition("doc")


def removed_mask(n: int, key: int, spans: list[int] | None) -> np.ndarray:
    """Which of n words a matched window covers."""
    diff = np.zeros(n + WINDOW + 1, np.int32)
    own = np.array([p & 0xFFFFFFFF for p in spans or () if p >> 32 == key], np.int64)
    if len(own):
        first, many = own >> 4, own & 15
        np.add.at(diff, first, 1)
        np.add.at(diff, first + many + WINDOW - 1, -1)
    return np.cumsum(diff)[:n] > 0


def parsed(docs: DataFrame, real: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with `real` the kept text instead), n_factors. docs: doc_id, text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.col("text").cast("string").alias("text"))
    spans = matched(own).groupBy("doc").agg(F.collect_list("pack").alias("spans"))  # within one document
    rows = by_document(own).join(spans, "doc", "left").select("doc", "text", "spans")
    last = "kept_text" if real else "kept_sha256"
    names = ["doc", "n_words", "n_removed", last, "n_factors"]

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in slices([len(t or b"") for t in texts]):
                out: list[list] = [[], [], [], []]
                for t, s in zip(texts[a:b], batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    words = (t or b"").split()
                    gone = removed_mask(len(words), text_key(t or b""), s)
                    kept = b" ".join(compress(words, ~gone)) if gone.any() else b" ".join(words)
                    out[0].append(len(words))
                    out[1].append(int(gone.sum()))
                    out[2].append(kept.decode() if real else hashlib.sha256(kept).hexdigest())
                    out[3].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names)

    out = rows.mapInArrow(run, f"doc bigint, n_words bigint, n_removed bigint, {last} string, n_factors bigint")
    return out.select(F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), *names[1:])


def substring_dedup(docs: DataFrame) -> DataFrame:
    return parsed(docs)
