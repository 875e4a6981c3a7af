"""Reference windows: the scheduler's order, the coverage gate, scaling, and the file of arrays."""

import io
import json

import numpy as np
import pandas as pd
import pytest

from loomspark.__main__ import main
from loomspark.plans import golden, sensors
from loomspark.sources import sinks
from tests.test_sensors import expected, made  # noqa: F401

SLOTS = [("TO_EVENT", 20.0), ("LD_EVENT", 24.0), ("BASE", 25.0), ("TO_EVENT", 30.0), ("LD_EVENT", 36.0), ("TO_EVENT", 40.0)]
WIN = {g.name: g.win for g in golden.GRIDS}


@pytest.fixture(scope="module")
def names(made):  # noqa: F811
    return [sinks.outside(c) for c in sensors.signal_features(made[2])] + ["accel_coverage", "baro_coverage", "has_accel", "has_baro", "has_dyn", "has_spectral", "grid_id", "win_s", "hop_s", "dt_prev_end_s", "log_win_s", "log_dt_prev_end_s", "no_such"]


@pytest.fixture(scope="module")
def scaler(names):
    rng = np.random.default_rng(1)
    scale = rng.random(len(names)) + 0.5
    scale[3] = 1e-9
    return {"mean": rng.normal(size=len(names)), "scale": scale}


@pytest.fixture(scope="module")
def rows(spark, made, names, scaler):  # noqa: F811
    a, b = made[:2]
    return golden.features(spark.createDataFrame(a), spark.createDataFrame(b), names, scaler).orderBy("place").collect()


def test_order_and_features(rows, made, names):  # noqa: F811
    assert [(r.grid, r.t_end) for r in rows] == SLOTS
    assert [r.dt_prev_end_s for r in rows] == [0, 0, 0, 10, 12, 10]
    for r in rows:
        got = dict(zip(names, r.raw))
        want = expected(*made[:2], r.t_end - WIN[r.grid], r.t_end)
        wrong = {c: (got[sinks.outside(c)], x) for c, x in want.items() if not np.isclose(got[sinks.outside(c)], x, rtol=1e-5, atol=1e-7)}
        assert not wrong
        assert (got["accel_coverage"], got["baro_coverage"], got["has_accel"], got["has_spectral"], got["no_such"]) == (1, 1, 1, 1, None)
        assert (got["win_s"], got["log_win_s"], got["dt_prev_end_s"], got["log_dt_prev_end_s"]) == (WIN[r.grid], np.log1p(WIN[r.grid]), r.dt_prev_end_s, np.log1p(r.dt_prev_end_s))


def test_scaled(rows, names, scaler):
    for r in rows:
        for k, (x, z) in enumerate(zip(r.raw, r.scaled)):
            want = 0.0 if k == 3 or x is None else (x - scaler["mean"][k]) / scaler["scale"][k]
            assert np.isclose(z, want, rtol=1e-9, atol=1e-12), names[k]


def test_gate_limit_and_one_sensor(spark, made, names, scaler):  # noqa: F811
    a, b = made[:2]
    holes = a[(a.t - a.t.min() < 18) | (a.t - a.t.min() > 26)]
    got = golden.features(spark.createDataFrame(holes), spark.createDataFrame(b), names, scaler).orderBy("place").collect()
    share = lambda end, win: np.mean([(x < 360 or x > 520) for x in range(round((end - win) * 20), min(round(end * 20), 799) + 1)])
    assert [(r.grid, r.t_end) for r in got] == [(g, e) for g, e in SLOTS if share(e, WIN[g]) >= 0.8] and len(got) < len(SLOTS)
    few = golden.features(spark.createDataFrame(a), spark.createDataFrame(b), names, scaler, golden.Settings(windows=2)).orderBy("place").collect()
    assert [(r.grid, r.t_end) for r in few] == SLOTS[:2]
    alone = golden.features(spark.createDataFrame(a).limit(0), spark.createDataFrame(b), names, scaler).orderBy("place").collect()
    assert [(r.grid, r.t_end) for r in alone] == SLOTS and {r.raw[names.index("has_accel")] for r in alone} == {0.0} and alone[0].raw[names.index("amag_mean")] is None
    assert golden.features(spark.createDataFrame(a).limit(0), spark.createDataFrame(b).limit(0), names, scaler).count() == 0


def test_file(spark, made, names, scaler, rows, tmp_path):  # noqa: F811
    a, b = made[:2]
    lines = [(t, f"{round(t * 1e6)}:{x!r}:{y!r}:{z!r}") for t, x, y, z in zip(a.t, a.ax, a.ay, a.az)] + [(t, f"{round(t * 1e6)}:{p!r}") for t, p in zip(b.t, b.p)]
    (tmp_path / "r.txt").write_text("\n".join(x for _, x in sorted(lines, key=lambda v: v[0])).replace("np.float64(", "").replace(")", "") + "\n")
    (tmp_path / "model").mkdir()
    (tmp_path / "model/features.json").write_text(json.dumps({"features": names}))
    np.savez(tmp_path / "model/scaler.npz", **scaler)
    report = main(["golden", str(tmp_path / "r.txt"), str(tmp_path / "model"), str(tmp_path / "golden.npz"), "--windows", "5"], spark)
    assert report == {"windows": 5, "features": len(names), "grids": {"BASE": 1, "TO_EVENT": 2, "LD_EVENT": 2}}
    held = np.load(io.BytesIO((tmp_path / "golden.npz").read_bytes()))
    assert json.loads((tmp_path / "golden_feature_names.json").read_text()) == names
    assert len(held["raw_accel_t"]) == len(a) and len(held["raw_baro_p"]) == len(b) and held["raw_accel_t"][0] == 0
    assert held["window_t_end"].tolist() == [e for _, e in SLOTS[:5]] and held["window_dyn_n"].dtype == np.int32 and (held["window_dyn_n"] > 0).all()
    assert held["features_raw"].shape == (5 * len(names),) and np.isnan(held["features_raw"][len(names) - 1])
    want = pd.DataFrame([r.scaled for r in rows[:5]]).to_numpy()
    assert np.allclose(held["features_scaled"].reshape(5, -1), want, rtol=1e-3, atol=1e-3)
    (tmp_path / "short.txt").write_text("1700000000000:1:2:3\n1700000001000:1:2:3\n")
    with pytest.raises(ValueError):
        golden.write(spark, str(tmp_path / "short.txt"), str(tmp_path / "model"), str(tmp_path / "none.npz"))
