"""Benchmark decontamination with word suffix arrays over the training documents.

A shard is a run of documents inside one task. Its suffix array holds, in word
order, every suffix that can begin a benchmark window: suffixes whose opening word
pairs occur in no benchmark item cannot match and are left out beforehand, which
changes no result. Every benchmark suffix, cut to its window, is binary-searched
in the array; the range found gives all places where it stands verbatim. From each
such place the longest verbatim match is found by a second binary search, of the
place's whole suffix in the suffix array of the benchmark's own text. Nothing is
shuffled, so groups of copies and common passages cost no more than other text.
Items are looked up a set of items a window, not an item a match, so a window that
many items and documents share costs the sum, not the product.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text (or one item);
a benchmark of several blocks is searched block after block in the same stage.

Defined results: null texts have no words; an item without words has no window; an
item with a null id counts its hits but is not among the items; rows that repeat an
item_id count as one item; repeated documents get the same result each; of tied
longest matches the item that comes first in the benchmark's suffix order is named.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, map_texts, slices

#: Words in a window.
WINDOW = 8
#: Benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: Document text in one shard.
SHARD_BYTES = 8 << 20
#: Items that make a document `contaminated` in op2's digest (a fixed value of the contract); removal goes by any match.
ITEMS = 2
_SLOTS = 1 << 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def _slot(a, b):
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)).astype(np.int64)


def item_sets(sets: list[set[int]]) -> tuple[list[frozenset[int]], np.ndarray]:
    """The different sets, and the number of each one's set."""
    number: dict[frozenset[int], int] = {}
    of = np.array([number.setdefault(frozenset(x), len(number)) for x in sets], np.int64)
    return list(number), of


def suffixes(flat: np.ndarray) -> np.ndarray:
    """The suffix array of the numbers, by prefix doubling."""
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
    order, k, n = np.argsort(rank, kind="stable"), 1, len(flat)
    while n and rank.max() < n:
        key = rank * (n + 1)
        key[: max(0, n - k)] += rank[k:]
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        k *= 2
    return order


def shared(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers a from i and b from j share, and whether a is greater where they part. 0 in a and -1 in b end both."""
    n, more, open_ = np.zeros(len(i), np.int64), np.zeros(len(i), bool), np.arange(len(i))
    while len(open_):
        x, y = a[np.minimum(i[open_] + n[open_], len(a) - 1)], b[np.minimum(j[open_] + n[open_], len(b) - 1)]
        same = (x == y) & (x > 0)
        more[open_[~same]] = x[~same] > y[~same]
        open_ = open_[same]
        n[open_] += 1
    return n, more


def longest_matches(ids: np.ndarray, at: np.ndarray, pat: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its longest verbatim match with an item, and where that starts in the block's text."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(pat.order), np.int64)
    best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:  # the longest match is met on the way to a suffix's place
        mid = (lo[open_] + hi[open_]) >> 1
        n, more = shared(ids, at[open_], pat.flat, pat.order[mid])
        longer = n > best[open_]
        best[open_[longer]], where[open_[longer]] = n[longer], pat.order[mid[longer]]
        lo[open_], hi[open_] = np.where(more, mid + 1, lo[open_]), np.where(more, hi[open_], mid)
    return best, where


class Patterns:
    """The distinct windows of one benchmark block, and where each stands in which item."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        every, base = [], 0
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            every.append(ids)
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[j : j + window]), []).append((number.get(name, -1), base + j))
            base += len(ids) + 1
        keys = sorted(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.rows = np.zeros((len(keys), window), np.int32)
        for r, k in enumerate(keys):
            self.rows[r, : len(k)] = k
        places = [found[k] for k in keys]
        self.least = int(self.lengths.min()) if keys else window
        self.sets, self.of = item_sets([{i for i, _ in x if i >= 0} for x in places])
        self.first = np.array([x[0][1] for x in places], np.int64)  # where a window stands in the text
        self.flat = np.array([w for ids in every for w in [*ids, -1]], np.int32)  # -1 ends an item
        self.order = suffixes(self.flat)
        self.ends = np.cumsum([len(ids) + 1 for ids in every])
        self.owner = np.array([number.get(name, -1) for name, _ in items], np.int64)
        self.pairs = np.zeros(_SLOTS, bool)
        for j in range(window - 1):
            use = self.lengths > j + 1
            self.pairs[_slot(self.rows[use, j], self.rows[use, j + 1])] = True


def _bound(index: np.ndarray, pat: Patterns, upper: bool) -> np.ndarray:
    """For each pattern the first row of the sorted index not below it; with `upper`, the first above all it begins."""
    lo, hi = np.zeros(len(pat.rows), np.int64), np.full(len(pat.rows), len(index), np.int64)
    cut = np.arange(pat.window)[None, :] < pat.lengths[:, None]
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        diff = np.where(cut, index[np.minimum(mid, len(index) - 1)] - pat.rows, 0)
        at = (diff != 0).argmax(1)
        sign = diff[np.arange(len(diff)), at]
        below = sign < 0 if not upper else sign <= 0
        lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def search(words: list[list[bytes]], pat: Patterns):
    """Per shard: hit mask by document, its item names, its longest match in words, and its maximal matches (start, length, item, place in the item)."""
    n = len(words)
    lens = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(np.concatenate([[0], lens + 1]))  # one empty place after each document
    ids = np.zeros(int(first[-1]) + pat.window, np.int32)
    get = pat.vocab.get
    for i, w in enumerate(words):
        if w:
            ids[first[i] : first[i] + lens[i]] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
    may = ids[: first[-1]] > 0
    if pat.least > 1:
        pair = pat.pairs[_slot(ids[:-1], ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
        for j in range(pat.least - 1):
            may &= pair[j : j + len(may)]
    at = np.flatnonzero(may)
    hit, names, longest, found = np.zeros(int(first[-1]) + 1, np.int32), [set() for _ in range(n)], np.zeros(n, np.int64), [[] for _ in range(n)]
    if len(at) and len(pat.rows):
        index = ids[at[:, None] + np.arange(pat.window)]
        order = np.lexsort(index.T[::-1])
        index, at = index[order], at[order]  # the shard's suffix array
        lo, hi = _bound(index, pat, False), _bound(index, pat, True)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        where = at[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]
        np.add.at(hit, where, 1)
        np.add.at(hit, where + pat.lengths[which], -1)
        doc = np.searchsorted(first, where, "right") - 1
        own = np.unique(doc * len(pat.sets) + pat.of[which])  # a document and a set of items once, however many matches
        own_doc, own_set = own // len(pat.sets), own % len(pat.sets)
        edges = np.searchsorted(own_doc, np.arange(n + 1))
        known: dict[bytes, set[str]] = {}
        for d in np.unique(own_doc).tolist():
            key = own_set[edges[d] : edges[d + 1]]
            if key.tobytes() not in known:
                known[key.tobytes()] = {pat.items[i] for k in key.tolist() for i in pat.sets[k]}
            names[d] = known[key.tobytes()]
        place = np.unique(where)
        far, to = longest_matches(ids, place, pat)
        whole, row = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)  # under a window's length, whole items alone count
        at = np.searchsorted(place, where)
        up = np.argsort(pat.lengths[which], kind="stable")
        whole[at[up]], row[at[up]] = pat.lengths[which[up]], which[up]
        short = far < pat.window
        far, to = np.where(short, whole, far), np.where(short, pat.first[row], to)
        doc = np.searchsorted(first, place, "right") - 1
        np.maximum.at(longest, doc, far)
        inner = np.zeros(len(place), bool)  # the rest of the match one place before
        inner[1:] = (place[1:] == place[:-1] + 1) & (doc[1:] == doc[:-1]) & (far[1:] == far[:-1] - 1)
        item = np.searchsorted(pat.ends, to, "right")
        starts = np.concatenate([[0], pat.ends[:-1]])
        for k in np.flatnonzero(~inner).tolist():
            d = int(doc[k])
            name = pat.items[pat.owner[item[k]]] if pat.owner[item[k]] >= 0 else None
            found[d].append((int(place[k] - first[d]), int(far[k]), name, int(to[k] - starts[item[k]])))
    mask = np.cumsum(hit) > 0
    return [mask[first[i] : first[i] + lens[i]] for i in range(n)], names, longest, found


def blocks_of(benchmark: DataFrame, item: str, text: str) -> list:
    """The benchmark as broadcast blocks; rows are dealt to as many blocks as the text needs."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n, out = -(-2 * total // BLOCK_BYTES), []  # twice as many as fit, as the deal is uneven
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        got = sorted({(r["i"], r["t"]) for r in own.collect()}, key=lambda x: (x[0] is not None, x))
        for a, b in slices([len(t) for _, t in got], BLOCK_BYTES):
            out.append(sc.broadcast(Patterns([(i, t.encode()) for i, t in got[a:b]])))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, keep: dict[str, Column], text: str = "text", item: str = "item_id", bench_text: str = "text", locate: bool = False) -> DataFrame:
    """Columns `keep`, then n_words, n_hit, n_items, items_sha256, contaminated, longest_match of each document.

    With `locate`, then matches: the maximal verbatim matches, as start and length in words, item and start in the item.
    """
    fields = [("n_words", "bigint", pa.int64()), ("n_hit", "bigint", pa.int64()), ("n_items", "bigint", pa.int64()), ("items_sha256", "string", pa.string()), ("contaminated", "boolean", pa.bool_()), ("longest_match", "bigint", pa.int64())]
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
    if locate:
        fields.append(("matches", "array<struct<start:bigint,length:bigint,item:string,item_start:bigint>>", pa.list_(one)))
    blocks = blocks_of(benchmark, item, bench_text)

    def make():
        def work(texts):
            words = [words_of(t) for t in texts]
            hit, names, longest, found = [np.zeros(len(w), bool) for w in words], [set() for _ in words], np.zeros(len(words), np.int64), [[] for _ in words]
            for b in blocks:
                h, s, far, m = search(words, b.value)
                hit = [x | y for x, y in zip(hit, h, strict=True)]
                names = [x | y for x, y in zip(names, s, strict=True)]
                longest = np.maximum(longest, far)
                found = [x + y for x, y in zip(found, m, strict=True)] if locate else found
            sizes = [len(x) for x in names]
            out = [[len(w) for w in words], [int(x.sum()) for x in hit], sizes, [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names], [x >= ITEMS for x in sizes], longest.tolist()]
            return [*out, [[dict(zip(("start", "length", "item", "item_start"), x)) for x in sorted(m, key=lambda x: x[:2])] for m in found]] if locate else out

        return work

    return map_texts(docs, keep, fields, make, text, SHARD_BYTES)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verbatim match of a benchmark window (or of a whole shorter item), with all their columns."""
    from .common import fresh

    names = fresh(docs, "_row")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(names[0]), F.col("text").alias("text"))
    out = scan(kept, benchmark, {names[0]: F.col(names[0])})
    return out.filter(F.col("longest_match") == 0).select(f"{names[0]}.*")
