"""From a folder of recordings to feature tables and their parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import resample as rs
from loomspark.operators import tables as tb
from loomspark.plans import sensors
from loomspark.sources import recordings as rec
from loomspark.sources import sinks
from loomspark.sources.scratch import stash


def table_of(spark: SparkSession, roots: str | Sequence[str], cfg: sensors.Settings = sensors.Settings()) -> tuple[DataFrame, DataFrame]:
    """The feature table of all recordings below the roots, and the parsed lines.  Recordings below ``nonflight`` are quiet."""
    parsed = stash(rec.parse_files(rec.discover(spark, roots)), "parsed")
    accel, baro, markers = rec.recordings(parsed)
    quiet = parsed.select("rec").distinct().where(rec.domain() == "nonflight")
    return sensors.feature_table(accel, baro, markers, cfg, quiet), parsed


def extract(spark: SparkSession, roots: str | Sequence[str], out: str, cfg: sensors.Settings = sensors.Settings(), scaled: bool = False, resampled: bool = False, csv: bool = True) -> dict[str, Any]:
    """Writes ``features_raw``, ``features_imputed``, ``params`` and, if wanted, ``features_scaled`` with ``scaler``, and ``resampled``, below ``out``; returns a report.

    The report has the numbers of windows, recordings and groups, the windows by label, the coverages, and the features
    that are missing most.
    """
    table, parsed = table_of(spark, roots, cfg)
    table = stash(table, "features")
    found = sensors.signal_features(table)
    sinks.write_features(table, f"{out}/features_raw", csv)
    full = stash(sensors.imputed(table), "imputed")
    sinks.write_features(full, f"{out}/features_imputed", csv)
    sinks.write_json(spark, asdict(cfg), f"{out}/params")
    if scaled:
        scaler = tb.fit_scaler(full, found)
        sinks.write_features(tb.scale(full, scaler, found), f"{out}/features_scaled", csv)
        sinks.write_json(spark, {r.feature: {"mean": r["mean"], "std": r["std"]} for r in scaler.collect()}, f"{out}/scaler")  # a row for each feature
    if resampled:
        accel, baro, _ = rec.recordings(parsed)
        sinks.write_resampled(rs.resample_columns(accel, sensors.AXES, 1 / cfg.accel_hz, cfg.hold, cfg.fill), f"{out}/resampled/accel")
        sinks.write_resampled(rs.resample_columns(baro, ["p"], 1 / cfg.baro_hz, cfg.hold, cfg.fill), f"{out}/resampled/baro")
    coverage = table.agg(*(f(c).alias(f"{n}_{c}") for c in ("accel_obs_coverage", "baro_obs_coverage") for n, f in (("mean", F.avg), ("min", F.min)))).first().asDict()
    report = {
        "windows": table.count(), "distinct": tb.distinct_counts(table, "file_id", "grid").first().asDict(),
        "labels": {r.label: r["count"] for r in table.groupBy("label").count().collect()}, "coverage": coverage,
        "missing": {r.feature: r.share for r in tb.missing_shares(table, found).collect()},
    }
    sinks.write_json(spark, report, f"{out}/report")
    return report
