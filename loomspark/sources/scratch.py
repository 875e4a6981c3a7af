"""Tables in the folder that driver and executors share, to cut lineage and compute a frame once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def home(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if Spark runs in one process; on a cluster that raises, as each machine
    would write a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        root = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def sweep_later(spark: SparkSession, path: str) -> None:
    """The path is deleted when the process ends."""
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))


def stash(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below :func:`home` and read back."""
    spark = df.sparkSession
    path = f"{home(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sweep_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return
