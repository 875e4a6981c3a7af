"""Shared-folder tables and Arrow batch settings used by the operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

_stashed: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session within a bounded number of rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sampled(salt: int, share: float, *columns: str) -> Column:
    """True for this share of the rows, by a 64-bit hash of the columns: exact to 2^-53, so no share becomes none."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns, F.lit(salt)) < F.lit(int(share * 2.0**64) - 2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset it is a temporary one if Spark runs in one process; on a cluster that raises, as each machine
    would write a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and computes ``df`` once.

    Returns the re-read frame and its path, for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stashed:
        atexit.register(_sweep)
    _stashed.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def grown(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast, as its rows grow with the input.

    The optimizer would broadcast it below a size that it estimates from files, without what ``explode`` adds to them and
    with what their compression saves, and the driver would build the hash table.
    """
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stashed table that no plan reads any longer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _stashed[:] = [x for x in _stashed if x[1] != path]


def stashed() -> int:
    """How many tables are in the shared folder now, for :func:`discard_since`."""
    return len(_stashed)


def discard_since(mark: int, *keep: str) -> None:
    """Delete the tables stashed since then but for those at ``keep``, once no plan reads them any longer."""
    for spark, path in _stashed[mark:]:
        if path not in keep:
            discard(spark, path)


def _sweep() -> None:
    for spark, path in [*_stashed]:
        try:
            discard(spark, path)
        except Exception:  # the session has ended: its folder goes with the cluster's own cleaning
            return
