"""Shared plumbing of the training-data operators.

Documents are rows of (doc_id, text, ...). Operators read only the columns they
name, so extra columns, whatever they are called, pass through or are ignored.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 4 << 20

#: A-Z to a-z; every ASCII byte that is not a letter or digit becomes a space.
#: On UTF-8 this splits like [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        opt = sc._jsc.sc().getCheckpointDir()
        path = opt.get() if opt.isDefined() else None
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='polyscene-')}"
        sc.setCheckpointDir(path)
    return path


#: Spark's setting that removes the shuffle files of a query once it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _written(df: DataFrame, name: str, compression: str | None, cleanup: bool, by: str | None = None) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if cleanup else before)
    try:
        df.write.parquet(path, compression=compression, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    released()
    return path


def stored(df: DataFrame, name: str, compression: str | None = None, cleanup: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    cleanup: the shuffle files of the write, which nothing reads again, go when it is over.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name, compression, cleanup))


def stored_apart(df: DataFrame, name: str, by: str, kinds: tuple[str, ...], compression: str | None = None) -> list[tuple[DataFrame, str]]:
    """As stored, in one pass: the rows of each of `kinds`, the values of column `by`, and the folder that holds them."""
    spark, out = df.sparkSession, []
    path = _written(df, name, compression, False, by)
    for kind in kinds:
        own = f"{path}/{by}={kind}"
        fs, p = _hadoop(spark, own)
        fs.mkdirs(p)  # of a kind without rows there is none
        out.append((spark.read.schema(df.drop(by).schema).parquet(own), own))
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stored folder that nothing reads again."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """The test fold: crc32 of the id as text leaves 2 on division by 4; a null id is in the training fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def texts_of(column: pa.Array) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def released() -> None:
    """Hand memory that a Python worker no longer uses back to the system, as workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(
    df: DataFrame,
    keep: dict[str, Column],
    fields: list[tuple[str, str, pa.DataType]],
    make: Callable[[], Callable[[list[bytes | None]], list]],
    text: str = "text",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Columns `keep`, then `fields` (name, SQL type, Arrow type) computed from whole texts in Arrow batches.

    make() runs once a task and returns a function from a list of UTF-8 texts
    (None for null) to one list or array a field.
    """
    ship(df.sparkSession)
    src = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(text).cast("string").alias("_text"))
    n, kinds = len(keep), [f[2] for f in fields]
    names = [f"k{i}" for i in range(n)] + [f"f{i}" for i in range(len(fields))]
    types = [x.dataType for x in src.schema.fields[:n]] + [T._parse_datatype_string(f[1]) for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            text = batch.column(n)
            for a, b in slices(pc.fill_null(pc.binary_length(text), 0).to_pylist(), most):
                new = [
                    x if isinstance(x, pa.Array) else pa.array(x, type=kind)
                    for x, kind in zip(work(texts_of(text.slice(a, b - a))), kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(n)] + new, names)
        del work
        released()

    out = src.mapInArrow(run, T.StructType([T.StructField(x, t) for x, t in zip(names, types, strict=True)]))
    return out.select(*[F.col(x).alias(a) for x, a in zip(names, [*keep, *(f[0] for f in fields)], strict=True)])


def salted_join(big: DataFrame, small: DataFrame, on: str, by: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """big joined with small (one row a key), the rows of a key dealt over parts by another column."""
    every = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return dealt.join(every, [on, "_part"], how).drop("_part")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df does not use."""
    used, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in used:
            x = f"_{x}"
        used.add(x.lower())
        out.append(x)
    return out
