"""Byte-level BPE through a distinct-word table, and decoding through an id-to-piece table.

1. Tasks split texts into words (the tokenizer's own split) once. Of each slice of texts
   (SLICE_TEXT bytes, or SLICE_WORDS different words) they keep the texts as numbers of
   its words, by position, packed by chunks of texts, and a row a different word: slice,
   number, word. Both are stored in the shared folder.
2. The word rows of all slices meet by word, and each distinct word of the corpus is
   encoded once, whatever their number; no table of words is broadcast. The ids are
   stored, packed by slice, and the words and their shuffle leave the disk.
3. The ids return to their slices, and meet the texts' numbers there: a join by slice and
   number, that is by the position of every word. Slices bound what a task holds.
4. Decoding joins ids to the id-to-piece table, which has a row an id, so it is bounded
   by the vocabulary, and is broadcast.

Defined results: a null text is empty; the special token's string in a text is that
token, as in the library; a text with a character that the two Unicode tables at
hand class differently is split by the library itself; repeated rows are encoded each;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import lzma
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, released, ship, slices, stored, stored_apart, texts_of

#: Bytes of text, and different words, from which on a slice ends.
SLICE_TEXT, SLICE_WORDS = 32 << 20, 500_000
#: Bytes of text whose numbers are packed into a row, and words whose ids are packed by slice at once.
CHUNK, PACK = 1 << 20, 1 << 18
#: Numbers from which on they are packed by lzma, and its settings for 32-bit words.
LONG, LZMA = 1 << 14, [{"id": lzma.FILTER_LZMA2, "preset": 1, "lc": 1, "lp": 2, "pb": 2}]
#: The split of byte-level pre-tokenizers in terms of the re module; where a character's class differs
#: between re and the library, odd_characters() finds it and the library splits the text.
SPLIT = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + k)
    return out


def odd_characters(source: str) -> str:
    """Characters of the basic plane that the library and the re module class differently."""
    from tokenizers import Tokenizer

    pre, own = Tokenizer.from_str(source).pre_tokenizer, re.compile(SPLIT)
    odd = []
    for start in range(0, 0x10000, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        for c in chars:
            s = f"a{c}1{c}! {c} x"
            if [o for _, o in pre.pre_tokenize_str(s)] != [m.span() for m in own.finditer(s)]:
                odd.append(c)
    return "".join(odd)


class Splitter:
    """Texts to words and special tokens, as the library splits them."""

    def __init__(self, source: str, odd: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.model = self.tokenizer.model
        self.own = re.compile(SPLIT)
        self.odd = re.compile(f"[{re.escape(odd)}\U00010000-\U0010ffff]")
        added = sorted((x["content"] for x in json.loads(source).get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.special = {x["content"]: x["id"] for x in json.loads(source).get("added_tokens", [])}

    def plain(self, text: str) -> list[str]:
        if self.odd.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.own.findall(text)

    def parts(self, text: str):
        """(is special, words or the special token)"""
        if self.added is None or not self.added.search(text):
            yield False, self.plain(text)
            return
        for k, x in enumerate(self.added.split(text)):
            if x:
                yield (True, x) if k % 2 else (False, self.plain(x))

    def encode(self, word: str) -> bytes:
        """One word's ids as little-endian 32-bit integers."""
        shown = word.encode().decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(got := self.model.tokenize(shown))}I", *[t.id for t in got])


def pieces_of(source: str) -> list[bytes]:
    """The bytes of each id."""
    from tokenizers import Tokenizer

    tok, back = Tokenizer.from_str(source), {c: b for b, c in byte_letters().items()}
    out = [b""] * (max(tok.get_vocab(True).values(), default=-1) + 1)
    for piece, k in tok.get_vocab(True).items():
        out[k] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def planes(numbers: list[int]) -> bytes:
    """Numbers as the number of bytes each takes, then all lowest bytes, all second ones and so on: small numbers shrink well."""
    x = np.array(numbers, "<u4")
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T[:wide]).tobytes()


def unplaned(body: bytes) -> np.ndarray:
    own = np.frombuffer(body, np.uint8, offset=1).reshape(body[0], -1)
    out = np.zeros((own.shape[1], 4), np.uint8)
    out[:, : body[0]] = own.T
    return out.view("<u4").ravel().astype(np.int64)


def packed(*runs) -> bytes:
    """Runs of numbers, compressed: long ones by lzma; short ones, of which there may be many, by zlib over byte planes."""
    if sum(map(len, runs)) < LONG:
        return b"\0" + zlib.compress(b"".join(struct.pack("<I", len(x)) + x for x in map(planes, runs)), 1)
    body = b"".join(struct.pack("<I", len(x)) + np.asarray(x).astype("<u4").tobytes() for x in runs)
    return b"\1" + lzma.compress(body, lzma.FORMAT_RAW, filters=LZMA)


def unpacked(body: bytes) -> list[np.ndarray]:
    long, at, out = body[0] == 1, 0, []
    body = lzma.decompress(body[1:], lzma.FORMAT_RAW, filters=LZMA) if long else zlib.decompress(body[1:])
    while at < len(body):
        many = struct.unpack_from("<I", body, at)[0] * (4 if long else 1)
        own = body[at + 4 : at + 4 + many]
        out.append(np.frombuffer(own, "<u4").astype(np.int64) if long else unplaned(own))
        at += 4 + many
    return out


class Pieces:
    """Numbered runs of values, looked up many at a time."""

    def __init__(self, runs: list[bytes], kind):
        self.lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // np.dtype(kind).itemsize
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(runs), kind)

    @classmethod
    def packed(cls, rows: list[tuple[bytes, bytes]]) -> Pieces:
        """From rows of numbers, and of lengths and ids, as encoded() packs them."""
        out, runs = cls([], "<u4"), [unpacked(r[1]) for r in rows]
        number = np.concatenate([np.zeros(0, np.int64), *(unplaned(b"\4" + r[0]) for r in rows)])
        many = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in runs)])
        out.flat = np.concatenate([np.zeros(0, "<u4"), *(r[1].astype("<u4") for r in runs)])
        order = np.argsort(number)
        out.lengths, out.starts = many[order], (np.cumsum(many) - many)[order]
        return out

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The runs of these numbers, one after the other."""
        n = self.lengths[numbers]
        at = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n)
        return self.flat[at + np.arange(len(at))]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    return pieces.of(ids).tobytes().decode("utf-8", "replace")


def cut(docs: DataFrame, keep: dict[str, Column], source: str, odd: str, text: str) -> DataFrame:
    """slice, number, word, special of each different word of a slice; slice, k0, k1..., body of each chunk of texts: arrays of the texts' values, and how many words each has and their numbers, packed. The other columns are null."""
    src = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text).cast("string").alias("_text"))
    n = len(keep)
    words = [T.StructField("slice", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("special", T.BooleanType())]
    schema = T.StructType([*words, *(T.StructField(x.name, T.ArrayType(x.dataType)) for x in src.schema.fields[:n]), T.StructField("body", T.BinaryType())])
    names, most_text, most_words = schema.names, SLICE_TEXT, SLICE_WORDS

    def run(batches):
        split, base, table, held, own = Splitter(source, odd), TaskContext.get().partitionId() << 32, {}, 0, None

        def listed():
            found = list(table)
            special = [isinstance(w, tuple) for w in found]
            cols = [pa.array([base] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([w[0] if s else w for w, s in zip(found, special)], pa.string()), pa.array(special, pa.bool_())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(found), pa.list_(t)) for t in own), pa.nulls(len(found), pa.binary())], names)

        for batch in batches:
            own = [batch.schema.field(i).type for i in range(n)]
            column = batch.column(n)
            for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), min(CHUNK, most_text)):
                numbers: list[int] = []
                ends = [0]
                for t in texts_of(column.slice(a, b - a)):
                    for special, got in split.parts((t or b"").decode()):
                        numbers += [table.setdefault((got,), len(table))] if special else [table.setdefault(w, len(table)) for w in got]
                    ends.append(len(numbers))
                    held += len(t or b"")
                cols = [pa.array([base], pa.int64()), *(pa.nulls(1, t) for t in (pa.int32(), pa.string(), pa.bool_()))]
                values = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(i).slice(a, b - a)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, *values, pa.array([packed(np.diff(ends), numbers)], pa.binary())], names)
                if held >= most_text or len(table) >= most_words:
                    yield listed()
                    base, held = base + 1, 0
                    table.clear()
        if table:
            yield listed()
        released()

    return src.mapInArrow(run, schema)


def encoded(words: DataFrame, source: str, odd: str) -> DataFrame:
    """slice, number, ids: each different word of all slices encoded once; a row holds many words' numbers, in order and by byte planes, and how many ids each has and the ids, packed. words: slice, number, word, special."""
    most = PACK

    def run(batches):
        split, word, ids = Splitter(source, odd), None, b""
        held, out = [], []

        def rows():
            at, number = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((number, at))
            cols = [], [], []
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                runs = [out[i] for i in own.tolist()]
                cols[0].append(int(at[own[0]]))
                cols[1].append(number[own].view(np.uint8).reshape(-1, 4).T.tobytes())
                cols[2].append(packed([len(x) // 4 for x in runs], np.frombuffer(b"".join(runs), "<u4")))
            kinds = pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["slice", "number", "ids"])

        for b in batches:
            for w, special in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (w, special) != word:
                    word = w, special
                    ids = struct.pack("<I", split.special[w]) if special else split.encode(w)
                out.append(ids)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype("<i4")))
            if len(out) >= most:
                yield rows()
                held, out = [], []
        if out:
            yield rows()

    met = words.repartition("word").sortWithinPartitions("word", "special")
    return met.mapInArrow(run, "slice bigint, number binary, ids binary")


#: What a text can be turned into.
OUTPUTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "token_ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def made(name: str, ids: list[np.ndarray], back: list[str]) -> pa.Array:
    if name == "n_tokens":
        return pa.array([len(x) for x in ids], pa.int64())
    if name == "ids_sha256":
        return pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
    if name == "decoded_sha256":
        return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
    if name == "decoded":
        return pa.array(back, pa.string())
    flat = pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)


def tokenize(docs: DataFrame, path: str, keep: dict[str, Column], text: str = "text", outputs: tuple[str, ...] = DIGESTS) -> DataFrame:
    """Columns `keep`, then those of `outputs`."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    odd, spark, n = odd_characters(source), docs.sparkSession, len(keep)
    ship(spark)
    pieces = spark.sparkContext.broadcast(pieces_of(source))
    rows = cut(docs, keep, source, odd, text)
    rows = rows.withColumn("kind", F.when(F.col("body").isNull(), "word").otherwise("text"))
    (words, place), (texts, _) = stored_apart(rows, "words", "kind", ("word", "text"), "zstd")
    kept = [f"k{i}" for i in range(n)]
    # stored, so that the words and their shuffle are off the disk before the texts' numbers are shuffled
    ids = stored(encoded(words.select("slice", "number", "word", "special"), source, odd), "ids", "zstd", cleanup=True)
    dropped(spark, place)
    texts = texts.select("slice", *kept, "body")
    every = ids.unionByName(texts, allowMissingColumns=True).select("slice", "number", "ids", *kept, "body")
    met = every.repartition("slice").sortWithinPartitions("slice", F.col("body").isNotNull())
    last = [T.StructField(x, OUTPUTS[x]) for x in outputs]
    schema = T.StructType([*(T.StructField(k, texts.schema[k].dataType.elementType) for k in kept), *last])

    def run(batches):
        piece = Pieces(pieces.value, np.uint8)
        now, held, table = None, [], None
        for batch in batches:
            at, body = batch.column(0).to_numpy(), batch.column(3 + n)
            text_ = np.array(body.is_valid())
            breaks = np.flatnonzero((at[1:] != at[:-1]) | (text_[1:] != text_[:-1])) + 1 if len(at) else []
            for a, b in zip([0, *breaks], [*breaks, len(at)]):
                if a == b:
                    continue
                if at[a] != now:
                    now, held, table = at[a], [], None
                if not text_[a]:
                    held += zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in (1, 2)), strict=True)
                    continue
                if table is None:
                    table, held = Pieces.packed(held), []
                for i in range(a, b):
                    many, own = unpacked(body[i].as_py())
                    got = [table.of(x) for x in np.split(own, np.cumsum(many)[:-1])]
                    back = [decode(x, piece) for x in got]
                    new = [made(x, got, back) for x in outputs]
                    yield pa.RecordBatch.from_arrays([*(batch.column(3 + k).slice(i, 1).flatten() for k in range(n)), *new], schema.names)
        released()

    out = met.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(a) for k, a in zip(kept, keep, strict=True)], *[F.col(x.name) for x in last])
