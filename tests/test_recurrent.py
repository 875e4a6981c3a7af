import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import learning as ln
from loomspark.operators import recurrent as rc
from loomspark.sources import onnx, sinks

SMALL = rc.Training(hidden=6, layers=2, head=5, dropout=0.0, epochs=6, patience=6, batch=16, rate=0.02, workers=2)


@pytest.mark.parametrize("focal", [None, (0.25, 2.0)])
def test_gradients(focal):
    rng = np.random.default_rng(1)
    cfg = rc.Training(hidden=3, layers=2, head=4, dropout=0.0, focal=focal)
    x, y = rng.normal(size=(5, 4, 2)), rng.integers(0, 2, (5, 2)).astype(float)
    w, pos, share = rc.start(2, 2, cfg), np.array([3.0, 1.5]), np.array([1.0, 0.25])
    value, g = rc.gradients(w, x, y, pos, share, cfg)
    assert value == pytest.approx(rc.loss(ln.gru(x, w), y, pos, share, focal)[0])
    v, got = rc.flat(w), rc.flat(g)
    for i in rng.choice(len(v), 40, replace=False):
        step = np.zeros_like(v)
        step[i] = 1e-5
        at = [rc.loss(ln.gru(x, rc.shaped(v + s, w)), y, pos, share, focal)[0] for s in (step, -step)]
        assert got[i] == pytest.approx((at[0] - at[1]) / 2e-5, abs=1e-7)


def made(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(5, 2, size=(n, 4, 3))
    x[0, 0, 0] = np.nan
    y = (x[:, -1, 0] > 7).astype(int)
    rows = pd.DataFrame({"id": range(n), "x": [[s.tolist() for s in q] for q in x], "y_takeoff": y, "y_landing": (x[:, -2, 1] > 7).astype(int), "is_nonflight": rng.random(n) < 0.2})
    return spark.createDataFrame(rows, "id long, x array<array<double>>, y_takeoff int, y_landing int, is_nonflight boolean")


def test_training_learns_and_repeats(spark):
    train, val = made(spark, 400, 1), made(spark, 150, 2)
    fit = lambda: rc.fit_gru(train, val, ["y_takeoff", "y_landing"], "id", cfg=SMALL)
    weights, history = fit()
    assert max(history) > 0.85
    np.testing.assert_allclose(fit()[1], history, rtol=1e-6)
    scored = ln.gru_scores(val, weights).select(F.col("p")[0].alias("p"), F.col("y_takeoff").alias("y")).cache()
    z, y = np.array([(np.log(r.p / (1 - r.p)), r.y) for r in scored.collect()]).T
    assert rc.fit_temperature(scored) == pytest.approx(ln.temperature(z, y), rel=1e-3)


def test_no_sequences(spark):
    none = made(spark, 3, 1).limit(0)
    with pytest.raises(ValueError):
        rc.fit_gru(none, none, ["y_takeoff", "y_landing"], "id", cfg=SMALL)
    assert rc.fit_temperature(spark.createDataFrame([], "p double, y int")) == 1.0


@pytest.mark.parametrize("layers,heat", [(1, 1.0), (2, 1.7)])
def test_export(spark, tmp_path, layers, heat):
    pytest.importorskip("onnxruntime")
    test = made(spark, 40, 3)
    cfg = rc.Training(hidden=6, layers=layers, head=5)
    weights = rc.start(3, 2, cfg) | rc.scaler(test)
    said = sinks.export_sequence_model(test, weights, ["a", "b", "c"], str(tmp_path / "m"), ["y_takeoff", "y_landing"], "id", head=1, heat=heat, profile={"threshold": float("nan"), "trigger_k": 2})
    assert said["onnx_parity"]["status"] == "ok" and said["onnx_parity"]["max_abs_diff"] < 1e-5
    stored = json.loads((tmp_path / "m" / "profile.json").read_text())
    assert stored["threshold"] is None and stored["trigger_k"] == 2 and stored["seq_len"] == 4
    golden, model = np.load(tmp_path / "m" / "golden.npz"), (tmp_path / "m" / "model.onnx").read_bytes()
    np.testing.assert_allclose(onnx.run(model, golden["X"]), golden["p_out"], atol=1e-5)
    assert len(golden["y_landing"]) == 32 and json.loads((tmp_path / "m" / "features.json").read_text()) == ["a", "b", "c"]
    assert set(np.load(tmp_path / "m" / "scaler.npz")) == {"mean", "scale"}
    with pytest.raises(ValueError):
        sinks.export_sequence_model(test.limit(0), weights, [], str(tmp_path / "n"), ["y_takeoff"], "id")
