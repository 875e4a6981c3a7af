"""Feature tables and reports on disk."""

from __future__ import annotations

import importlib.util
import io
import json
import math
import re
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.scalars import number
from loomspark.operators.learning import gru
from loomspark.sources import onnx


def strict(value: Any) -> Any:
    """``value`` with NaN and infinities as None, for JSON that every reader takes."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    return value


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON document as a text file, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(strict(value), allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def outside(name: str) -> str:
    """A stored column name as feature files have it: ``pow_0p3_1p0`` is ``pow_0.3_1.0``."""
    return re.sub(r"(?<=\d)p(?=\d)", ".", name)


def write_features(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet by domain; the CSV copy has the outside column names and its rows in the tables' order."""
    df.write.mode("overwrite").partitionBy(*(["domain"] if "domain" in df.columns else [])).parquet(f"{path}/parquet")
    if csv:
        order = [c for c in ("file_id", "grid", "t_end", "t_start") if c in df.columns]
        (df.orderBy(*order) if order else df).toDF(*map(outside, df.columns)).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parquet")


def stored(name: str) -> str:
    """A feature file's column name as the tables have it: ``pow_0.3_1.0`` is ``pow_0p3_1p0``."""
    return re.sub(r"(?<=\d)\.(?=\d)", "p", name)


def load_features(spark: SparkSession, path: str, required: Sequence[str] = ("file", "label")) -> DataFrame:
    """A feature table from CSV files with a header, with ``row_idx``, a number that grows along each file.

    All columns but ids and labels are numbers (what isn't one is missing), names are those of the tables.  Without a
    ``file`` column the ``file_id`` stands for it, or else the path; a missing required column raises.
    """
    raw = spark.read.option("header", True).csv(path)
    names = [stored(c) for c in raw.columns]
    rows = raw.toDF(*names).withColumn("row_idx", F.monotonically_increasing_id())
    if "file" not in names:
        rows = rows.withColumn("file", F.col("file_id") if "file_id" in names else F.col("_metadata.file_name"))
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the feature table has no column {missing}")
    words = {"file", "file_id", "rec", "domain", "grid", "label", "row_idx"}
    return rows.select(*(F.col(c) if c in words else number(F.col(c)).alias(c) for c in rows.columns))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file's bytes, through Spark's file systems."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def load_names(spark: SparkSession, path: str) -> list[str]:
    """Feature names from JSON: a list, or an object with a list under ``features`` or ``names``."""
    value = json.loads(read_bytes(spark, path))
    if isinstance(value, dict):
        value = value.get("features", value.get("names"))
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ValueError("there is no list of feature names")
    return value


def load_scaler(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, np.ndarray]:
    """``mean`` and ``scale`` from an array file, as many as there are names."""
    with np.load(io.BytesIO(read_bytes(spark, path))) as held:
        out = {k: np.asarray(held[k], float) for k in ("mean", "scale")}
    if any(v.shape != (len(names),) for v in out.values()):
        raise ValueError("the scaler does not fit the feature names")
    return out


def write_resampled(grid: DataFrame, path: str) -> None:
    """Resampled streams, a folder for each recording, rows in order of time."""
    grid.withColumn("recording_id", F.col("rec")).repartition("rec").sortWithinPartitions("rec", "s").write.mode("overwrite").partitionBy("recording_id").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """A table of any size as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_rows(rows: Sequence[dict[str, Any]], spark: SparkSession, path: str) -> None:
    """A small table (of settings and their scores, say) as JSON lines."""
    lines = [(json.dumps(strict(r), allow_nan=False, sort_keys=True),) for r in rows]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def packed(**named: np.ndarray) -> bytes:
    """Arrays by name as the bytes of one compressed array file."""
    held = io.BytesIO()
    np.savez_compressed(held, **named)
    return held.getvalue()


def export_sequence_model(
    test: DataFrame, weights: dict[str, np.ndarray], features: Sequence[str], path: str, ys: Sequence[str], key: str, head: int = 0, heat: float = 1.0, x: str = "x", rows: int = 32, profile: dict[str, Any] | None = None, limit: float = 0.02
) -> dict[str, Any]:
    """``model.onnx, features.json, scaler.npz, weights.npz, golden.npz`` and ``profile.json`` below ``path``; returns the profile.

    The golden rows are ``rows`` sequences of ``test``, the first by a hash of ``key``, with the model's probabilities.
    If the ONNX runtime is installed, the file is run on them: the profile's ``onnx_parity`` has the largest difference,
    and "warning" where that exceeds ``limit``.
    """
    spark = test.sparkSession
    taken = test.select(x, *ys).orderBy(F.xxhash64(key), key).limit(rows).collect()
    if not taken:
        raise ValueError("there are no sequences to check the model with")
    many = np.array([r[x] for r in taken], float)
    p = 1 / (1 + np.exp(-gru(many, weights)[:, head : head + 1] / heat))
    model = onnx.encode(weights, many.shape[1], head, heat)
    parity: dict[str, Any] = {"golden_rows": len(taken), "max_abs_diff": None, "warn_if_gt": limit, "status": "unknown"}
    if importlib.util.find_spec("onnxruntime"):
        gap = float(np.abs(onnx.run(model, many) - p).max())
        parity |= {"max_abs_diff": gap, "status": "ok" if gap < limit else "warning"}
    shape = {"seq_len": many.shape[1], "n_features": many.shape[2], "head_index": head, "calibration_temperature": heat, "onnx": {"input_name": "x", "output_name": "p", "output_is_probability": True, "static_batch": 1}}
    said = strict({"model_type": "gru"} | shape | (profile or {}) | {"onnx_parity": parity})
    golden = {"X": many.astype(np.float32), "p_out": p.astype(np.float32)} | {y: np.array([r[y] for r in taken], np.float32) for y in ys}
    files = {"model.onnx": model, "weights.npz": packed(**weights), "golden.npz": packed(**golden)}
    if "mean" in weights:
        files["scaler.npz"] = packed(mean=weights["mean"].astype(np.float32), scale=weights["scale"].astype(np.float32))
    for name, value in (("features.json", list(features)), ("profile.json", said)):
        files[name] = json.dumps(value, allow_nan=False, sort_keys=True).encode()
    for name, data in files.items():
        write_bytes(spark, data, f"{path}/{name}")
    return said
