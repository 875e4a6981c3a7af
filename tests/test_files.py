"""From files to feature tables to baselines, by the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.__main__ import main
from loomspark.sources import recordings as rec
from loomspark.sources import sinks


def recording(rng, start_ms, seconds, mark=None, csv=False):
    """Readings of 4 accelerations and 1 pressure a second, with a burst after the marker."""
    lines = ["timestamp,AX,ay,az,Baro,event"] if csv else ["mer data 1"]
    if mark is not None:
        lines.append(f"{start_ms + mark * 1000},,,,,Takeoff" if csv else f"Takeoff;{start_ms + mark * 1000}")
    for i in range(seconds * 4):
        t, burst = start_ms + i * 250, 5 if mark is not None and mark <= i / 4 <= mark + 30 else 0
        a = rng.normal(size=3) * (0.2 + burst) + (0, 0, 9.81)
        p = f"{1000 - burst + rng.normal() * 0.01:.4f}" if i % 4 == 0 else ""
        if csv:
            lines.append(f'{t},{a[0]:.4f},"{a[1]:.4f}",{a[2]:.4f},{p},')
        else:
            lines.append(f"{t}:{a[0]:.4f}:{a[1]:.4f}:{a[2]:.4f}")
            lines += [f"{t}:{p}"] * bool(p)
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("recordings"), np.random.default_rng(3)
    for k in range(9):
        quiet = k >= 6
        at = root / ("nonflight" if quiet else "flight")
        at.mkdir(exist_ok=True)
        csv = k % 3 == 1
        (at / f"r{k}.{'csv' if csv else 'txt'}").write_text(recording(rng, 1_700_000_000_000 + k * 10_000_000, 240, None if quiet else 100 + k, csv))
    (root / "flight" / "features_old.csv").write_text("x\n1\n")
    (root / "flight" / "odd.csv").write_text("a,b\n1700000000000:1000.5\n1700000001000:1000.6\n")
    return root


def test_csv_files_by_their_own_headers(spark, folder):
    parsed = rec.parse_files(rec.discover(spark, str(folder)))
    kinds = {(r.rec.rsplit("/", 1)[1], r.kind): r["count"] for r in parsed.groupBy("rec", "kind").count().collect()}
    assert kinds["r1.csv", "accel"] == kinds["r0.txt", "accel"] == 960 and kinds["r1.csv", "baro"] == kinds["r0.txt", "baro"] == 240
    assert kinds["r1.csv", "marker"] == kinds["r0.txt", "marker"] == 1 and ("r7.csv", "marker") not in kinds
    assert kinds["odd.csv", "baro"] == 2 and not any(name == "features_old.csv" for name, _ in kinds)
    lines = rec.discover(spark, str(folder)).where(F.col("rec").endswith("r1.csv")).orderBy("line").collect()
    assert len(lines) == 962 and lines[0].text.startswith("timestamp") and len({r.line for r in lines}) == 962


def test_large_files_are_read_in_blocks(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = [r.text for r in rec.discover(spark, str(folder / "flight")).where(F.col("rec").endswith("r0.txt")).orderBy("line").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        assert [r.text for r in rec.discover(spark, str(folder / "flight")).where(F.col("rec").endswith("r0.txt")).orderBy("line").collect()] == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_from_files_to_reports(spark, folder, tmp_path):
    flags = ["--accel_hz", "4", "--base", "20", "10", "--to", "20", "10", "--ld", "24", "12", "--scaled", "--resampled"]
    report = main(["features", str(folder / "flight"), str(folder / "nonflight"), str(tmp_path / "f"), *flags], spark)
    assert report["distinct"]["file_id"] == 9 and report["labels"]["NONFLIGHT"] > 0 and report["labels"]["TAKEOFF"] > 0
    assert report["windows"] == sum(report["labels"].values()) and report["coverage"]["mean_accel_obs_coverage"] > 0.9
    raw = sinks.read_features(spark, str(tmp_path / "f/features_raw"))
    assert raw.count() == report["windows"]
    loaded = sinks.load_features(spark, str(tmp_path / "f/features_imputed/csv"))
    assert set(raw.columns) <= set(loaded.columns) and loaded.count() == raw.count()
    assert abs(loaded.agg(F.sum("amag_mean")).first()[0] - raw.agg(F.sum("amag_mean")).first()[0]) < 1e-6
    scaled = sinks.read_features(spark, str(tmp_path / "f/features_scaled"))
    assert abs(scaled.agg(F.avg("amag_mean")).first()[0]) < 1e-9
    assert spark.read.option("header", True).csv(str(tmp_path / "f/resampled/accel")).select("recording_id").distinct().count() == 9
    rules = ["--folds", "2", "--least_hours", "0.01", "--hit_window", "60", "--budget", "100", "--candidates", "32"]
    more = ["--events", "TAKEOFF", "--seeds", "1", "2", "--draws", "2", "--suggest", "--space", '{"depth": [2, 3]}', "--weights", '[{"w_mid": 0.5, "w_far": 0.2}]', "--params", '{"trees": 4}']
    summary = main(["baseline", str(tmp_path / "f/features_imputed"), str(tmp_path / "b"), *rules, *more], spark)
    assert 0 <= summary["TAKEOFF"]["threshold"]["mean"] <= 1 and summary["TAKEOFF"]["test.pr_auc"]["mean"] > 0.3
    for seed in (1, 2):
        at = tmp_path / "b" / f"takeoff_seed{seed}"
        assert {p.name for p in at.iterdir()} == {"splits", "cv_candidates", "best_params", "dw_candidates", "best_dw", "threshold", "test_report", "model"}
        assert json.loads(spark.read.text(str(at / "best_params")).first().value)["depth"] in (2, 3)


def test_assets(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x", "y"]')
    (tmp_path / "b.json").write_text('{"names": ["x", "y"]}')
    np.savez(tmp_path / "s.npz", mean=np.zeros(2), scale=np.ones(2))
    names = sinks.load_names(spark, str(tmp_path / "a.json"))
    assert names == sinks.load_names(spark, str(tmp_path / "b.json")) == ["x", "y"]
    assert sinks.load_scaler(spark, str(tmp_path / "s.npz"), names)["scale"].tolist() == [1, 1]
    with pytest.raises(ValueError):
        sinks.load_scaler(spark, str(tmp_path / "s.npz"), ["x"])
    (tmp_path / "t.csv").write_text("file_id,label,a\nr,TAKEOFF,nan?\n")
    row = sinks.load_features(spark, str(tmp_path / "t.csv")).first()
    assert (row.file, row.a) == ("r", None)
    (tmp_path / "u.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        sinks.load_features(spark, str(tmp_path / "u.csv"))
