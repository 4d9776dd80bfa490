"""Tables that a plan writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """This package can be imported in Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}-core.zip")  # of the driver; Spark sends it on
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='polyscene-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read back: what made them, such as calls of a model, is not done again, and lost executors lose nothing."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)
