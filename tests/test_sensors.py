"""The feature table of a made-up recording against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from loomspark.operators.features import BANDS, DYN_BANDS, spectrum
from loomspark.operators.windows import Grid
from loomspark.plans import sensors

GRIDS = (Grid("base", 0, 10.0, 10.0), Grid("to", 1, 12.0, 6.0))
T0 = 1_700_000_000.0


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    n = 800
    a = pd.DataFrame({"rec": "flight/x.txt", "t": T0 + (np.arange(n) + 0.3 * (np.arange(n) > 0)) / 20, "ax": rng.normal(size=n), "ay": rng.normal(size=n) + np.sin(np.arange(n) / 5), "az": 9.81 + rng.normal(size=n)})
    b = pd.DataFrame({"rec": "flight/x.txt", "t": T0 + np.arange(40.0), "p": 1000 - np.cumsum(rng.random(40))})
    marks = spark.createDataFrame([("flight/x.txt", "Takeoff", T0 + 12.0)], "rec string, name string, t double")
    cfg = sensors.Settings(grids=GRIDS)
    table = sensors.feature_table(spark.createDataFrame(a), spark.createDataFrame(b), marks, cfg)
    return a, b, table, table.toPandas().set_index(["grid", "k"])


def ewm(x, a):
    return pd.Series(x).ewm(alpha=a, adjust=False, ignore_na=True).mean().to_numpy()


def slope(y, x):
    return np.polyfit(x - x[0], y, 1)[0]


def last(x, hz, s, least):
    return x[-max(least, int(s * hz)) :]


def moments(x):
    sd = x.std()
    q = np.percentile(x, [25, 75])
    return {"mean": x.mean(), "std": sd, "min": x.min(), "max": x.max(), "median": np.median(x), "iqr": q[1] - q[0], "rms": np.sqrt((x**2).mean()), "range": np.ptp(x), "skew": ((x - x.mean()) ** 3).mean() / sd**3, "kurt": ((x - x.mean()) ** 4).mean() / sd**4 - 3}


def late(x, hz):
    n = len(x)
    return {
        "halfdiff": x[n // 2 :].mean() - x[: n // 2].mean(), "thirddiff": x[2 * n // 3 :].mean() - x[: n // 3].mean(), "recent_diff_25pct": x[int(n * 0.75) :].mean() - x[: int(n * 0.75)].mean(),
        "peakcount": float((abs(x - x.mean()) > 2 * x.std()).sum()), "ratio_recent_std": last(x, hz, 2, 3).std() / x.std(),
    } | {f"recent_{k}_{s}s": f(last(x, hz, s, m)) for s in (2, 3, 5) for k, m, f in (("std", 3, np.std), ("mean", 1, np.mean), ("max_abs", 1, lambda v: abs(v).max()), ("slope", 3, lambda v: slope(v, np.arange(len(v)) / hz)))}


def run(mask):
    best = now = 0
    for v in mask:
        now = now + 1 if v else 0
        best = max(best, now)
    return float(best)


def expected(a, b, ws, we):
    t = np.arange(len(a)) / 20
    axes = a[["ax", "ay", "az"]].to_numpy()
    mag = np.sqrt((axes**2).sum(1))
    alpha = lambda tau, hz: 2 / (1 + tau * hz)
    g = np.stack([ewm(c, alpha(0.6, 20)) for c in axes.T], 1)
    d = axes - g
    vert = (d * g).sum(1) / np.sqrt((g**2).sum(1))
    horiz = np.sqrt(np.maximum((d**2).sum(1) - vert**2, 0))
    dyn = mag - ewm(mag, alpha(2, 20))
    e10 = ewm(mag, alpha(10, 20))
    v10 = ewm((mag - e10) ** 2, alpha(10, 20))
    p = b.p.to_numpy()
    tb = np.arange(40.0)
    h = 44330 * (1 - (p / p[0]) ** (1 / 5.255))
    rate = np.concatenate([[np.nan], np.diff(h)])
    rate = pd.Series(rate).ewm(alpha=alpha(2, 1), adjust=False, ignore_na=True).mean().where(~np.isnan(rate)).to_numpy()
    p30 = ewm(p, alpha(30, 1))
    dp30 = np.diff(p30)
    dp30 = np.concatenate([dp30[:1], dp30])
    i, j = (t >= ws - 1e-9) & (t <= we + 1e-9), (tb >= ws) & (tb <= we)
    out = {}
    for name, x in [("ax", axes[i, 0]), ("ay", axes[i, 1]), ("az", axes[i, 2]), ("amag", mag[i])]:
        out |= {f"{name}_{k}": v for k, v in moments(x).items()}
    m, dy = mag[i], dyn[i]
    out |= {f"amag_{k}": v for k, v in late(m, 20).items() if k in ("halfdiff", "thirddiff", "recent_diff_25pct", "peakcount", "recent_slope_2s", "recent_slope_3s", "recent_std_2s", "recent_mean_2s", "recent_max_abs_2s", "ratio_recent_std")}
    jerk = np.diff(m) * 20
    out |= {"jerk_mean": abs(jerk).mean(), "jerk_std": jerk.std(), "jerk_rms": np.sqrt((jerk**2).mean()), "jerk_recent_std_2s": last(jerk, 20, 2, 3).std(), "jerk_recent_max_abs_2s": abs(last(jerk, 20, 2, 1)).max()}
    out |= {f"dyn_{k}": v for k, v in moments(dy).items() if k not in ("min", "median", "iqr")}
    out |= {f"dyn_{k}": v for k, v in late(dy, 20).items() if k in ("halfdiff", "thirddiff", "recent_diff_25pct", "peakcount", "recent_slope_2s", "recent_std_2s", "recent_max_abs_2s", "ratio_recent_std")}
    label = lambda bands, pre: [f"{pre}pow_{x:.1f}_{y:.1f}".replace(".", "p") for x, y in bands]
    s = spectrum(m, 20, BANDS)
    out |= dict(zip([*label(BANDS, ""), "amag_dominant_freq", "amag_spectral_centroid", "amag_spectral_bandwidth"], s))
    s2 = spectrum(dy, 20, DYN_BANDS)
    out |= dict(zip([*label(DYN_BANDS, "dyn_"), "dyn_dominant_freq", "dyn_spectral_centroid"], s2))
    out |= {"ground_vs_air_ratio": (s[4] + s[3]) / (s[0] + s[1] + 1e-9), "vibration_vs_static_ratio": s[3] / (s[0] + 1e-9), "amag_ratio_1_3__0p3_1": min(s[2] / s[1], 100), "dyn_ratio_2_5__0p5_2": min(s2[2] / s2[1], 100)}
    for name, x in [("avert", vert[i]), ("ahoriz", horiz[i])]:
        out |= {f"{name}_{k}": v for k, v in (moments(x) | late(x, 20)).items() if k in ("mean", "std", "rms", "peakcount", "recent_slope_2s", "recent_std_2s")}
    out["avert_to_ahoriz_ratio"] = min(out["avert_rms"] / out["ahoriz_rms"], 100)
    pw, v = p[j], rate[j]
    out |= {f"p_{k}": x for k, x in moments(pw).items() if k != "rms"}
    dp = np.diff(pw)
    dp = np.concatenate([dp[:1], dp])
    lp = late(pw, 1)
    out |= {"dpdt_mean": dp.mean(), "dpdt_std": dp.std(), "p_slope": slope(pw, tb[j]), "p_recent_diff_25pct": lp["recent_diff_25pct"], "p_recent_slope_3s": lp["recent_slope_3s"], "p_recent_slope_5s": lp["recent_slope_5s"], "p_recent_std_3s": lp["recent_std_3s"]}
    f = v[~np.isnan(v)]
    sg = np.where(abs(f) <= 0.05, 0, np.sign(f))
    lv = late(f, 1)
    out |= {"dhdt_mean": f.mean(), "dhdt_std": f.std(), "dhdt_maxabs": abs(f).max(), "plateau_frac": (abs(f) < 0.3).mean(), "dhdt_zcr_ps": float((sg[1:] * sg[:-1] < 0).sum()) / len(f), "runlen_climb_s": run(np.nan_to_num(v) > 0.2), "runlen_descent_s": run(np.nan_to_num(v) < -0.2)}
    out |= {f"dhdt_{k}": lv[k] for k in ("recent_mean_2s", "recent_mean_3s", "recent_slope_3s", "recent_std_3s", "recent_max_abs_2s")}
    e, q = e10[i], v10[i]
    n = len(e)
    out |= {"amag_ema10_mean": e.mean(), "amag_ema10_std": e.std(), "amag_ema10_range": np.ptp(e), "amag_ema10_thirddiff": e[2 * n // 3 :].mean() - e[: n // 3].mean(), "amag_emaVar10_mean": q.mean(), "amag_emaVar10_iqr": moments(q)["iqr"]}
    out |= {"p_ema30_mean": p30[j].mean(), "p_ema30_std": p30[j].std(), "p_ema30_slope": slope(p30[j], tb[j]), "p_ema30_dt1_mean": dp30[j].mean(), "p_ema30_dt1_std": dp30[j].std(), "p_ema30_dt1_posfrac": (dp30[j] > 0).mean()}
    return out


def test_there_are_142_features(made):
    assert len(sensors.signal_features(made[2])) == 142


@pytest.mark.parametrize("grid,k,ws,we", [("base", 0, 0, 10), ("base", 2, 20, 30), ("to", 1, 6, 18), ("to", 4, 24, 36)])
def test_features(made, grid, k, ws, we):
    a, b, _, got = made
    want = expected(a, b, ws, we)
    row = got.loc[(grid, k)]
    assert set(want) == set(sensors.signal_features(made[2]))
    wrong = {c: (row[c], x) for c, x in want.items() if not np.isclose(row[c], x, rtol=1e-5, atol=1e-7)}
    assert not wrong


def test_window_columns(made):
    got = made[3]
    assert set(got.index) == {("base", i) for i in range(3)} | {("to", i) for i in range(5)}
    row = got.loc[("base", 1)]
    assert (row.label, row.t_start - T0, row.t_end - T0, row.t_anchor - T0, row.dist_to_event, row.domain, row.file, row.dt_prev_end_s) == ("TAKEOFF", 10.0, 20.0, 20.0, 8.0, "flight", "x.txt", 10.0)
    assert got.loc[("base", 0)].label == "TAKEOFF" and np.isnan(got.loc[("base", 0)].dt_prev_end_s)
    assert (got.accel_obs_coverage == 1).all()


def test_imputed(made, spark):
    full = sensors.imputed(made[2])
    assert full.select("has_accel", "has_baro", "has_spectral", "has_dyn").distinct().collect() == [(1.0, 1.0, 1.0, 1.0)]
    a, b = made[0], made[1]
    marks = spark.createDataFrame([], "rec string, name string, t double")
    only = sensors.feature_table(spark.createDataFrame(a), spark.createDataFrame(b).limit(0), marks, sensors.Settings(grids=GRIDS), spark.createDataFrame([("flight/x.txt",)], "rec string"))
    rows = sensors.imputed(only).toPandas()
    assert len(rows) == 8 and set(rows.label) == {"NONFLIGHT"} and (rows.has_baro == 0).all() and (rows.p_mean == 0).all() and (rows.baro_coverage == 0).all()
