"""Session settings the library relies on, and where scratch data may live."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: they can be applied to a session that exists.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot sentence must be split even where the split costs one exchange more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sentence-level hashing serves the word-level joins too, so a chain from
    # records to sentence metrics moves the records once.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Larger Arrow batches do not pay off for narrow rows; this keeps the
    # memory of a Python worker flat whatever the partition holds.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # The same for wide rows: arrays and texts become Python objects many times their size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "2097152",
}

def tune(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings and hand its code to the workers."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Once per application: Python workers import this package by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="readtrace-code-"))
    archive = shutil.make_archive(str(folder / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small table is read in fewer pieces than there are.

    For scans only (asking a plan with a shuffle for its pieces would run it).
    A large table already has many more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    Only a local-mode session without ``spark.checkpoint.dir`` may fall back to
    a folder of this machine; on a cluster that would be lost with its host.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="readtrace-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def emptied(df: DataFrame, path: str) -> None:
    """Give back the space of a written table that nothing reads any more; an empty table of its schema stays."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
