"""Resumable work as a stream: each micro-batch of finished rows is merged into a table of Parquet versions.

This is an addition; the batch form is operators.resume. A version is a complete table;
the pointer is the highest version number, so a batch that is run again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.evidence import keep_last
from ..operators.resume import upserted


def version_path(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/v{n:08d}"


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The table of the last version before `below`, or None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    have = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    have = [n for n in have if below is None or n < below]
    return spark.read.parquet(version_path(path, max(have))) if have else None


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Starts a query that merges finished rows by key, later ones in `order` winning, until none are left."""

    def merge(batch: DataFrame, n: int) -> None:
        new, old = keep_last(batch, key, order), current(batch.sparkSession, path, n)
        (new if old is None else upserted(old, new, key)).write.mode("overwrite").parquet(version_path(path, n))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
