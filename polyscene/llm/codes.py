"""Vectors as short codes: a codebook for each part of a vector, learned in exact integers.

1. Tasks turn vectors into columnar blocks: component by component, the integers floor(1024 x) of up to BLOCK vectors,
   packed as bytes. The blocks are stored in the shared folder; every later pass reads them.
2. A round is one treeAggregate over the blocks: squared distances to the codebook accumulate dimension by dimension,
   np.add.at sums parts and counts into integer tensors, and a tree of tasks merges them, so that the driver meets FAN
   tensors at most. A tensor is as large as the codebooks, whatever the number of vectors.
3. A last pass writes every vector's code and error, and errors are summed by label before they meet their rows.

Distances, sums and divisions are of integers, so results don't depend on how rows are dealt or merged: in 32 bits
where a bound on the block shows that they fit, else in 64, else in Python's integers.

Defined results: vectors that are null, empty or hold null, NaN or infinite components are dropped, as are those whose
length isn't the commonest (of equally common ones the smallest). If the length isn't divisible by the number of
parts, the first parts are one component longer. Integers beyond +-2^62 count as that; an error or sum beyond a long
is null. Rows that repeat a vec_id are coded each; in the first codebook they go by their vectors, null ids last. Fewer
rows than entries make fewer entries. Of equally near entries the lowest index is taken. Null labels are one label.
Without vectors there are no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, salted_join, ship, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and tensors that one merge of the tree takes.
BLOCK, FAN = 2048, 64
#: Integers are held within this.
MOST = 1 << 62

Book = list[np.ndarray]  # a part's entries, by entry and position


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) in 64 bits."""
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def fitting(most: int) -> type:
    """The smallest kind of integer for values up to most."""
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vectors have components, all of them finite numbers, in the commonest number."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("many")).orderBy(F.desc("many"), "n").first()
    return rows.filter(F.size(x) == (sizes["n"] if sizes else 0))


def blocks(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """ids, labels, body: up to BLOCK vectors, component by component. rows: usable ones."""
    src = rows.select(F.col(vec_id).alias("ids"), F.col(label).alias("labels"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(src.schema["ids"].dataType)), T.StructField("labels", T.ArrayType(src.schema["labels"].dataType)), T.StructField("body", T.BinaryType())])
    most = BLOCK

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                b = batch.slice(at, most)
                x = whole(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                ends = pa.array([0, b.num_rows], pa.int32())
                cols = [pa.ListArray.from_arrays(ends, b.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], schema.names)
        released()

    return src.mapInArrow(run, schema)


def columns(body: bytes, dims: int) -> np.ndarray:
    """A block's integers, by dimension and vector."""
    return np.frombuffer(body, np.int64).reshape(dims, -1)


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end."""
    ends = np.cumsum([0, *(len(x) for x in np.array_split(np.arange(dims), parts))]).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each column of x, and its squared distance. x: by dimension and vector."""
    kind = fitting(len(x) * (largest(x) + largest(book)) ** 2)
    x, book = x.astype(kind), book.astype(kind)
    far = np.zeros((x.shape[1], len(book)), kind)
    for d in range(len(x)):
        off = x[d][:, None] - book[:, d][None, :]
        far += off * off
    at = np.argmin(far, axis=1)
    return at, far[np.arange(len(at)), at]


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, in Python's integers where 64 bits might not do."""
    return a + b if object not in (a.dtype, b.dtype) and largest(a) + largest(b) < 1 << 63 else a.astype(object) + b


Tensors = list[tuple[np.ndarray, np.ndarray]]


def tallied(held: Tensors | None, x: np.ndarray, books: Book, ends: list[tuple[int, int]]) -> Tensors:
    """Sums and counts of the parts of each entry, by part, with a block's."""
    out: Tensors = []
    for k, (a, b) in enumerate(ends):
        at, _ = nearest(x[a:b], books[k])
        kind = object if largest(x[a:b]) * x.shape[1] >= 1 << 63 else np.int64
        sums, counts = np.zeros(books[k].shape, kind), np.zeros(len(books[k]), np.int64)
        np.add.at(sums, at, x[a:b].T.astype(kind))
        np.add.at(counts, at, 1)
        out.append((sums, counts))
    return merged(held, out)


def merged(a: Tensors | None, b: Tensors | None) -> Tensors | None:
    if a is None or b is None:
        return b if a is None else a
    return [(added(s, t), added(m, n)) for (s, m), (t, n) in zip(a, b, strict=True)]


def moved(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries as the floors of their parts' means; those without parts stay."""
    used = counts > 0
    out = book.copy()
    out[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
    return out


def learned(stored_blocks: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> Book:
    """The codebooks after some rounds. first: the vectors of the first codebooks, in order, as integers."""
    sc, ends = stored_blocks.sparkSession.sparkContext, cuts(first.shape[1], parts)
    books: Book = [first[:, a:b] for a, b in ends]
    dims = first.shape[1]
    bodies = stored_blocks.select("body").rdd
    depth = max(2, math.ceil(math.log(max(2, bodies.getNumPartitions()), FAN)))
    for _ in range(rounds):
        sent = sc.broadcast(books)  # as large as the codebooks
        found = bodies.treeAggregate(None, lambda held, row: tallied(held, columns(row[0], dims), sent.value, ends), merged, depth)
        if found is not None:
            books = [moved(b, *t) for b, t in zip(books, found, strict=True)]
        sent.destroy()
    return books


def coded(stored_blocks: DataFrame, books: Book, ends: list[tuple[int, int]]) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    spark, kinds = stored_blocks.sparkSession, [stored_blocks.schema[c].dataType.elementType for c in ("ids", "labels")]
    schema = T.StructType([T.StructField("vec_id", kinds[0]), T.StructField("label", kinds[1]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    sent, dims = spark.sparkContext.broadcast(books), ends[-1][1]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = columns(batch.column(2)[i].as_py(), dims)
                got = [nearest(x[a:b], book) for (a, b), book in zip(ends, sent.value, strict=True)]
                hexes = np.stack([g[0] for g in got], 1).astype(np.uint8).tobytes().hex()
                wide = 2 * len(got)
                error = np.sum([g[1].astype(object) for g in got], axis=0).tolist()
                cols = [batch.column(c).slice(i, 1).flatten() for c in (0, 1)]
                codes = pa.array([hexes[k : k + wide] for k in range(0, len(hexes), wide)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, codes, pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], schema.names)
        released()

    return stored_blocks.mapInArrow(run, schema)


def digest(books: Book) -> str:
    """SHA-256 of the entries as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error: their error summed over equal labels. A label's rows are dealt over parts by their ids."""
    keyed = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("_label").agg(F.try_sum("error").alias("label_error"))
    return salted_join(keyed, sums, "_label", "vec_id", "left").select(*rows.columns, "label_error")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Book]:
    """vec_id, label, code (two hex digits a part), error of each usable vector; and the codebooks. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("an index takes two hex digits, so there are 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vector)
    first = rows.select(F.col(vec_id).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        kind = f"vec_id {vectors.schema[vec_id].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code string, error long"
        return spark.createDataFrame([], kind), []
    packed = stored(blocks(rows, vec_id, vector, label), "blocks", "zstd")
    start = whole(np.array([r["v"] for r in first], np.float64))
    books = learned(packed, start, parts, rounds)
    return coded(packed, books, cuts(start.shape[1], parts)), books


def compress_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress(vectors)
    out = with_label_errors(stored(rows, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
