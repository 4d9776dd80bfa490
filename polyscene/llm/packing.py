"""Documents packed into sequences: vector best-fit over three capacities.

1. Tasks turn texts into ids, a text's words looked up in a table of the words met so far, end them with the closing
   id, and cut what is longer than a sequence into pieces. Pieces are stored in the shared folder, each
   with its task and its number among the task's pieces of its length.
2. A piece's demands (tokens, one document, attention cost: tokens squared) follow from its length. So pieces are
   counted by length in Spark, and the counts, as many as a sequence has tokens at most, are packed on the driver:
   longest first, each into the open sequence whose residual capacities suit it best and suffice under every
   constraint, else into a new one. Sequences in the same state are one row with a multiplicity, so the work depends
   on the number of lengths, not of documents; the outcome is that of packing the pieces one by one.
   By `norm`, the best sequence has the least weighted norm of what would be left of its capacities; by `dot`, the
   least weighted dot product of its residual with the demands. Without a choice both are tried and the fewer
   sequences win (ties: norm).
3. A piece's rank among all of its length is its number in its task and the counts of the tasks before; the plan says
   for each run of ranks which sequences and places they get, and tasks look ranks up in it by binary search.

Defined results: a null text is empty, so it is the closing id alone; a text of only white space likewise; a special
token's string in a text is that token; rows that repeat a doc_id are packed each; ties go to the sequence opened
first, and equal lengths rank by task; an empty table gives no rows; other columns, whatever their names, are not read.
Very long texts are encoded CHUNK characters at a time; the ids of one text are held in memory. A vocabulary whose
tokenizer keeps white space encodes whole texts by the library.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import released, ship, slices, stored, texts_of

#: Bytes of a text that are split at once, and words from which on a task's table starts anew.
CHUNK, WORDS = 1 << 20, 1_000_000
#: What tokens, documents and attention cost count for when sequences are compared.
WEIGHTS = (1.0, 0.01, 0.01)
#: ASCII white space, which no token of the vocabulary crosses, and what stands between.
GAP, BETWEEN = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
#: Letters of ASCII and Latin-1, other characters of ASCII but digits and white space, and what is neither of these two.
LETTER, MARK, OTHER = r"A-Za-zÀ-ÖØ-öø-ÿ", r"[^\x20\x09-\x0D0-9A-Za-z\x80-\U0010FFFF]", r"\x80-¿×÷Ā-\U0010FFFF"
#: The tokenizer's own split ends where such letters, digits and marks meet, but for letters after an apostrophe.
#: What stands between white space and holds other characters is one word here.
WORD = re.compile(rf"[^\x20\x09-\x0D{OTHER}]*+[{OTHER}][^\x20\x09-\x0D]*|[{LETTER}]+|'[{LETTER}]+|[0-9]|{MARK}+")
#: How special tokens begin: texts that hold this are cut at white space alone.
SPECIAL = "<|"
#: Words that the tokenizer takes as one, and that its normal form leaves as they are but for capitals.
PLAIN = re.compile(rf"[{LETTER}]+|[0-9]|(?!'[A-Za-z]){MARK}+")


class Numbers(dict):
    """A number for each word, the next one for a new word."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """x with room for more values after those used."""
    return x if used + more <= len(x) else np.concatenate([x[:used], np.zeros(max(used, more), x.dtype)])


class WordIds:
    """Ids of texts through a table of words."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work over cores
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether the tokenizer drops white space and cuts words as WORD does; if not, it encodes whole texts itself.
        self.by_words = not ids(" \n") and ids("Àb 12,c'd") == [i for w in ("àb", "1", "2", ",", "c", "'d") for i in ids(w)]
        self.model, self.shown = self.tokenizer.model, {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of PLAIN words, one after the other, and how many each has: by the model, past normal form and split."""
        shown = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown) for w in map(str.lower, words)]
        got = list(map(self.model.tokenize, shown))
        return np.fromiter((t.id for tokens in got for t in tokens), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [g.ids for g in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def learn(self, fresh: list[str], known: int) -> None:
        """Ids of new words, whose numbers begin at known."""
        plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in fresh), bool, len(fresh))
        many, runs = np.zeros(len(fresh), np.int64), []
        for mine, encode in ((plain, self.plain), (~plain, self.apart)):
            ids, many[mine] = encode([fresh[k] for k in np.flatnonzero(mine)])
            runs.append(ids)
        # back into the order of numbers
        at, ends = np.where(plain, 0, len(runs[0])), np.cumsum(many)
        for mine in (plain, ~plain):
            at[mine] += np.cumsum(many[mine]) - many[mine]
        new = np.concatenate(runs)[np.repeat(at - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        used = int(self.ends[known])
        self.flat, self.ends = room(self.flat, used, len(new)), room(self.ends, known + 1, len(fresh))
        self.flat[used : used + len(new)] = new
        self.ends[known + 1 : known + 1 + len(fresh)] = used + ends

    def chunks(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            gap = GAP.search(text, at + CHUNK)
            end = gap.end() if gap else len(text)
            yield text[at:end]
            at = end

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_words:
            return [np.array(g.ids, np.uint32) for g in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        split = [(BETWEEN if SPECIAL in t else WORD).findall(t) for t in texts]
        if len(self.number) > WORDS:
            self.clear()
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.number) > known:
            self.learn(list(islice(self.number, known, None)), known)
        if not len(numbers):
            return [np.zeros(0, np.uint32) for _ in texts]
        starts = self.ends[numbers]
        many = self.ends[numbers + 1] - starts
        ends = np.cumsum(many)
        flat = self.flat[np.repeat(starts - (ends - many), many) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.cumsum([len(w) for w in split])]
        return np.split(flat, bounds[:-1])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        said = [t.decode() if t else "" for t in texts]
        if not self.by_words or all(len(t) <= CHUNK for t in said):
            return self.ids(said)
        return [np.concatenate([np.zeros(0, np.uint32), *(self.ids([c])[0] for c in self.chunks(t))]) for t in said]


_held: dict[str, WordIds] = {}


def word_ids(source: str) -> WordIds:
    """This worker's table, which its later tasks use as well."""
    if source not in _held:
        _held.clear()
        _held[source] = WordIds(source)
    return _held[source]


def pieces(docs: DataFrame, path: str, keep: dict[str, Column], most: int, closing: int, text: str, ids: bool) -> DataFrame:
    """Columns `keep`, piece, start, length, ids_crc32, task, nth, and the piece's token_ids if asked for."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    ship(docs.sparkSession)
    src = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text).cast("string").alias("_text"))
    n = len(keep)
    own = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType())]
    if ids:
        own.append(("token_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*src.schema.fields[:n], *(T.StructField(*x) for x in own)])

    def run(batches):
        work, task, met = word_ids(source), TaskContext.get().partitionId(), {}
        for batch in batches:
            column = batch.column(n)
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK):
                row, piece, start, length, crc, nth, held = [], [], [], [], [], [], []
                for i, got in enumerate(work.encode(texts_of(column.slice(a, b - a)))):
                    got = np.append(got, np.uint32(closing))
                    for k, at in enumerate(range(0, len(got), most)):
                        body = got[at : at + most]
                        row.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(body))
                        crc.append(zlib.crc32(body.astype("<u4").tobytes()))
                        nth.append(met.setdefault(len(body), 0))
                        met[len(body)] += 1
                        held.append(body)
                numbers = [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([task] * len(row), pa.int32()), (nth, pa.int64()))]
                if ids:
                    flat = pa.array(np.concatenate([np.zeros(0, np.uint32), *held]).astype(np.int32))
                    numbers.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in range(n)), *numbers], schema.names)
        released()

    return src.mapInArrow(run, schema)


class Open:
    """Open sequences: a row for those, numbered in a row, that have the same capacities left."""

    def __init__(self, capacity: np.ndarray):
        self.capacity, self.used = capacity, 0
        self.left = np.zeros((64, 3))
        self.first, self.many = np.zeros(64, np.int64), np.zeros(64, np.int64)

    def add(self, left: np.ndarray, first: int, many: int) -> None:
        if self.used == len(self.first):
            self.left = np.concatenate([self.left, np.zeros_like(self.left)])
            self.first, self.many = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.many))
        self.left[self.used], self.first[self.used], self.many[self.used] = left, first, many
        self.used += 1

    def best(self, demand: np.ndarray, weights: np.ndarray, by: str) -> int | None:
        """The row of the sequences that suit a piece best, of those that have room for it."""
        left = self.left[: self.used]
        fits = np.flatnonzero((left >= demand).all(axis=1) & (self.many[: self.used] > 0))
        if not len(fits):
            return None
        rest, size = left[fits] / self.capacity, demand / self.capacity
        score = ((rest - size) ** 2 @ weights) if by == "norm" else (rest * size) @ weights
        tied = fits[score == score.min()]
        return int(tied[np.argmin(self.first[tied])])

    def pruned(self, least: np.ndarray) -> None:
        """Forget sequences that have no room for the smallest piece."""
        keep = np.flatnonzero((self.left[: self.used] >= least).all(axis=1) & (self.many[: self.used] > 0))
        self.used = len(keep)
        for x in (self.left, self.first, self.many):
            x[: self.used] = x[keep]


#: A run of equal pieces: length, first rank, how many, how many a sequence, first sequence, place of the first there.
RUN = ("length", "rank", "n", "each", "sequence", "offset")


def planned(counts: dict[int, int], most_tokens: int, most_documents: int, most_cost: int, by: str, weights=WEIGHTS) -> tuple[int, list[tuple[int, ...]]]:
    """How many sequences there are, and the runs. counts: pieces by length."""
    capacity, weight = np.array([most_tokens, most_documents, most_cost], float), np.array(weights, float)
    demand = lambda length: np.array([length, 1, length * length], float)
    open_, runs, opened = Open(capacity), [], 0
    least = demand(min(counts, default=1))
    for length in sorted(counts, reverse=True):
        size, left, rank = demand(length), counts[length], 0
        if (size > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")

        def put(rest: np.ndarray, first: int, many: int) -> None:
            """As many pieces as there are, or as fit, into sequences with that rest; what is left of these is open."""
            nonlocal left, rank
            each = int((rest // size).min())
            for sequences, pieces_each in ((min(many, left // each), each), (1, left % each if left // each < many else 0)):
                if sequences and pieces_each:
                    runs.append((length, rank, sequences * pieces_each, pieces_each, first, int(capacity[0] - rest[0])))
                    open_.add(rest - size * pieces_each, first, sequences)
                    rank, left, first, many = rank + sequences * pieces_each, left - sequences * pieces_each, first + sequences, many - sequences
            if many:
                open_.add(rest, first, many)

        while left:
            k = open_.best(size, weight, by)
            if k is None:
                new = -(-left // int((capacity // size).min()))
                put(capacity, opened, new)
                opened += new
            else:
                many, open_.many[k] = int(open_.many[k]), 0
                put(open_.left[k].copy(), int(open_.first[k]), many)
        open_.pruned(least)
    return opened, runs


def placed(rows: DataFrame, runs: list[tuple[int, ...]], keep: int) -> DataFrame:
    """rows with sequence_id and offset instead of rank, the last column but those of ids. The runs are as many as lengths and states, not documents."""
    order = sorted(runs)
    plan = rows.sparkSession.sparkContext.broadcast({c: np.array([r[k] for r in order], np.int64) for k, c in enumerate(RUN)})
    names = [c for c in rows.columns if c != "rank"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        p = plan.value
        key = (p["length"] << 48) + p["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            turn = rank - p["rank"][at]
            sequence = p["sequence"][at] + turn // p["each"][at]
            offset = p["offset"][at] + turn % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], schema.names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, keep: dict[str, Column], most_tokens: int, most_documents: int | None = None, most_cost: int | None = None, closing: int = 1, by: str | None = None, ids: bool = False, text: str = "text") -> DataFrame:
    """Columns `keep`, piece, start, length, ids_crc32, sequence_id, offset, and token_ids if asked for.

    most_documents and most_cost bound a sequence's pieces and the sum of their squared lengths; without them they
    are as large as most_tokens implies.
    """
    documents, cost = most_documents or most_tokens, most_cost or most_tokens * most_tokens
    longest = min(most_tokens, math.isqrt(cost))
    names = [f"k{i}" for i in range(len(keep))]
    cut = stored(pieces(docs, path, keep, longest, closing, text, ids), "pieces", "zstd")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    found = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many as a sequence has tokens
    plans = [planned(found, most_tokens, documents, cost, x) for x in ([by] if by else ["norm", "dot"])]
    runs = min(plans, key=lambda p: p[0])[1]
    own = ["piece", "start", "length", "ids_crc32", *(["token_ids"] if ids else [])]
    # a key has rows of one task alone; the counts grow with the tasks, so they are not broadcast
    ranked = cut.join(starts.select("task", "length", "before").hint("shuffle_merge"), ["task", "length"])
    rows = placed(ranked.select(*names, *own, (F.col("before") + F.col("nth")).alias("rank")), runs, len(keep))
    return rows.select(*[F.col(x).alias(a) for x, a in zip(names, keep, strict=True)], *own, "sequence_id", "offset")


def sequences(packed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """sequence_id, token_ids, doc_ids, lengths: every sequence with its pieces in their places. packed: with token_ids."""
    one = F.struct("offset", F.col(doc_id).alias("doc_id"), "length", "token_ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"))  # no more than a sequence's tokens
    part = lambda c: F.transform("p", lambda x: x[c])
    return rows.select("sequence_id", F.flatten(part("token_ids")).alias("token_ids"), part("doc_id").alias("doc_ids"), part("length").alias("lengths"))


def pack_documents(docs: DataFrame, path: str, most: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: sequences of at most that many tokens, no other bound."""
    return pack(docs, path, {"doc_id": F.col("doc_id")}, most)
