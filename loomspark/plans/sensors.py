"""From recordings to the table of window features: resample, derive, cut, gate, label, summarise, impute."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import ratio
from loomspark.operators import features as ft
from loomspark.operators import resample as rs
from loomspark.operators import tables as tb
from loomspark.operators import windows as wn
from loomspark.sources.scratch import stash

KEYS = ("rec", "grid", "grid_id", "k", "ws", "we")
AXES = ("ax", "ay", "az")
MOMENTS = ("mean", "std", "min", "max", "median", "iqr", "rms", "range", "skew", "kurt")
TREND = ("halfdiff", "thirddiff", "recent_diff_25pct")
LATE = {"recent_slope": "recent_slope_{}s", "recent_std": "recent_std_{}s", "recent_mean": "recent_mean_{}s", "recent_max_abs": "recent_max_abs_{}s", "ratio_recent_std": "ratio_recent_std"}
#: Features that tell a sensor group's presence.
GROUPS = {"accel": ["amag_mean"], "baro": ["p_mean"], "spectral": ["pow_0p0_0p3", "amag_dominant_freq"], "dyn": ["dyn_mean"]}


@dataclass(frozen=True)
class Settings:
    accel_hz: float = 20.0
    baro_hz: float = 1.0
    hold: float = rs.HOLD
    fill: bool = True
    coverage: float = 0.8
    grids: tuple[wn.Grid, ...] = wn.SENSOR_GRIDS
    zones: wn.Zones = field(default_factory=wn.Zones)
    rule: str = "anchor"
    where: str = "right"
    quiet_label: str = "NONFLIGHT"
    keep_quiet: float = 1.0
    seed: int = 42


def _late(c: str, name: str, hz: float, *wanted: tuple[str, float]) -> list[Column]:
    return [ft.feature(c, kind, hz, s).alias(f"{name}_{LATE[kind].format(f'{s:g}')}") for kind, s in wanted]


def _plain(c: str, name: str, *kinds: str) -> list[Column]:
    every = dict(zip(MOMENTS, ft.statistics(c, name))) | ft.shape(c, name)
    return [every[k] if k != "maxabs" else F.max(F.abs(F.col(c))).alias(f"{name}_maxabs") for k in kinds]


def accel_streams(accel: DataFrame, cfg: Settings) -> DataFrame:
    """Resampled axes with magnitude, its dynamic part, slow mean and variance, and the parts along and across gravity."""
    grid = rs.resample_columns(accel, AXES, 1 / cfg.accel_hz, cfg.hold, cfg.fill).withColumn("obs", rs.obs_all(*(F.col(f"obs_{c}") for c in AXES))).drop(*(f"obs_{c}" for c in AXES))
    hz = cfg.accel_hz
    grid = rs.magnitude(grid)
    g = rs.gravity_aligned(grid, hz)
    slow = rs.alpha(10.0, hz)
    g = rs.emas(g, [("amag", rs.alpha(2.0, hz), "__slow"), ("amag", slow, "amag_ema10")])
    g = g.withColumns({"dyn": F.col("amag") - F.col("__slow"), "__d2": F.pow(F.col("amag") - F.col("amag_ema10"), 2)})
    return rs.ema(g, "__d2", slow, "amag_emaVar10").drop("__slow", "__d2")


def baro_streams(baro: DataFrame, cfg: Settings) -> DataFrame:
    grid = rs.resample_columns(baro, ["p"], 1 / cfg.baro_hz, cfg.hold, cfg.fill).withColumnRenamed("obs_p", "obs")
    return rs.pressure_trend(rs.climb_rate(grid, cfg.baro_hz), cfg.baro_hz)


def accel_features(rows: DataFrame, hz: float) -> DataFrame:
    """Features of the windows' accelerations (``rows``: samples in windows); only samples with all three axes count."""
    rows = rows.where(" and ".join(f"{c} is not null" for c in AXES))
    x = ft.compact(rows, KEYS, [*AXES, "amag", "dyn", "avert", "ahoriz", "amag_ema10"])
    x = x.withColumn("jerk", (F.col("amag") - F.col("amag__before")) * hz).withColumns({"jerk__i": F.col("amag__i") - 1, "jerk__n": F.col("amag__n") - 1})
    out = [e for c in (*AXES, "amag") for e in _plain(c, c, *MOMENTS)]
    out += [ft.feature("amag", k).alias(f"amag_{k}") for k in (*TREND, "peakcount")]
    out += _late("amag", "amag", hz, ("recent_slope", 2), ("recent_slope", 3), ("recent_std", 2), ("recent_mean", 2), ("recent_max_abs", 2), ("ratio_recent_std", 2))
    out += [F.avg(F.abs("jerk")).alias("jerk_mean"), *_plain("jerk", "jerk", "std", "rms"), *_late("jerk", "jerk", hz, ("recent_std", 2), ("recent_max_abs", 2))]
    out += _plain("dyn", "dyn", "mean", "std", "rms", "max", "range", "skew", "kurt") + [ft.feature("dyn", k).alias(f"dyn_{k}") for k in (*TREND, "peakcount")]
    out += _late("dyn", "dyn", hz, ("recent_slope", 2), ("recent_std", 2), ("recent_max_abs", 2), ("ratio_recent_std", 2))
    for c in ("avert", "ahoriz"):
        out += _plain(c, c, "mean", "std", "rms") + [ft.feature(c, "peakcount").alias(f"{c}_peakcount")] + _late(c, c, hz, ("recent_slope", 2), ("recent_std", 2))
    out += _plain("amag_ema10", "amag_ema10", "mean", "std", "range") + [ft.feature("amag_ema10", "thirddiff").alias("amag_ema10_thirddiff")]
    out += _plain("amag_emaVar10", "amag_emaVar10", "mean", "iqr")
    table = x.groupBy(*KEYS).agg(F.count("amag").alias("__n"), *out)
    table = table.withColumn("avert_to_ahoriz_ratio", F.when(F.col("ahoriz_rms") > 1e-6, F.least(F.greatest(F.col("avert_rms") / F.col("ahoriz_rms"), F.lit(0.0)), F.lit(100.0))))
    spectra = ft.spectral(rows, KEYS, "amag", "", "amag", hz).join(ft.spectral(rows, KEYS, "dyn", "dyn_", "dyn", hz, ft.DYN_BANDS), list(KEYS), "full").drop("dyn_spectral_bandwidth")
    table = table.join(spectra, list(KEYS), "left")
    enough = F.col("__n") >= 16
    table = table.withColumns({c: F.when(enough, F.col(c)) for c in spectra.columns if c not in KEYS})
    band = lambda a: F.coalesce(F.col(a), F.lit(0.0))
    over = lambda a, b: F.when(enough & (a + b > 1e-9), a / (b + 1e-9))
    return table.withColumns({
        "ground_vs_air_ratio": over(band("pow_8p0_15p0") + band("pow_3p0_8p0"), band("pow_0p0_0p3") + band("pow_0p3_1p0")), "vibration_vs_static_ratio": over(band("pow_3p0_8p0"), band("pow_0p0_0p3")),
        "amag_ratio_1_3__0p3_1": ratio(F.col("pow_1p0_3p0"), F.col("pow_0p3_1p0")), "dyn_ratio_2_5__0p5_2": ratio(F.col("dyn_pow_2p0_5p0"), F.col("dyn_pow_0p5_2p0")),
    }).drop("__n")


def baro_features(rows: DataFrame, hz: float) -> DataFrame:
    """Features of the windows' pressures and climb rates."""
    x = ft.compact(rows, KEYS, ["p", "dhdt"]).withColumn("__origin", F.min("s").over(Window.partitionBy(*KEYS)))
    x = x.withColumn("dpdt", (F.col("p") - F.col("p__before")) * hz)
    first = F.max(F.when(F.col("p__i") == 1, F.col("dpdt")))  # the first difference counts twice
    n, total, square = F.count("dpdt") + 1, F.sum("dpdt") + first, F.sum(F.pow("dpdt", F.lit(2))) + first * first
    out = _plain("p", "p", "mean", "std", "min", "max", "median", "iqr", "range", "skew", "kurt")
    out += [(total / n).alias("dpdt_mean"), F.sqrt(F.greatest(square / n - F.pow(total / n, F.lit(2)), F.lit(0.0))).alias("dpdt_std"), ft.feature("p", "slope").alias("p_slope"), ft.feature("p", "recent_diff_25pct").alias("p_recent_diff_25pct")]
    out += _late("p", "p", hz, ("recent_slope", 3), ("recent_slope", 5), ("recent_std", 3))
    v = F.col("dhdt")
    track = F.array_sort(F.collect_list(F.struct("s", F.coalesce(v, F.lit(0.0)).alias("v"))))

    def run(up: bool) -> Column:
        start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))

        def step(m, x):
            now = F.when(x["v"] > 0.2 if up else x["v"] < -0.2, m["now"] + 1).otherwise(0)
            return F.struct(F.greatest(m["best"], now).alias("best"), now.alias("now"))

        return F.aggregate(track, start, step, lambda m: m["best"] / hz)

    rate = _plain("dhdt", "dhdt", "mean", "std", "maxabs") + [
        F.avg((F.abs(v) < 0.3).cast("double")).alias("plateau_frac"), ft.feature("dhdt", "zcr_ps", hz, dead=0.05).alias("dhdt_zcr_ps"),
        run(True).alias("runlen_climb_s"), run(False).alias("runlen_descent_s"),
    ]
    rate += _late("dhdt", "dhdt", hz, ("recent_mean", 2), ("recent_mean", 3), ("recent_slope", 3), ("recent_std", 3), ("recent_max_abs", 2))
    out += _plain("p_ema30", "p_ema30", "mean", "std")
    t = F.when(F.col("p_ema30").isNotNull(), F.col("s") - F.col("__origin"))
    out += [F.when((F.count("p_ema30") >= 2) & (F.stddev_pop(t) > 0), F.regr_slope("p_ema30", t)).alias("p_ema30_slope")]
    out += _plain("p_ema30_dt1", "p_ema30_dt1", "mean", "std") + [F.avg((F.col("p_ema30_dt1") > 0).cast("double")).alias("p_ema30_dt1_posfrac")]
    table = x.groupBy(*KEYS).agg(F.count("dhdt").alias("__n"), *out, *rate)
    names = [c for c in table.columns if c.startswith("dhdt_") or c in ("plateau_frac", "runlen_climb_s", "runlen_descent_s")]
    return table.withColumns({c: F.when(F.col("__n") >= 2, F.col(c)) for c in names}).drop("__n")


def feature_table(accel: DataFrame, baro: DataFrame, markers: DataFrame, cfg: Settings = Settings(), quiet: DataFrame | None = None) -> DataFrame:
    """One row for each window that passes the coverage gate: ids, times, label, distances, coverages and 142 features.

    ``accel`` (rec, t, ax, ay, az), ``baro`` (rec, t, p), ``markers`` (rec, name, t), in seconds; ``quiet`` names the
    recordings (rec) without events, which get the quiet label.  The gate and the label come before the features, so
    windows that go cost no statistics.
    """
    marks = wn.marker_times(markers)
    a0, b0 = rs.spans(accel.where("t is not null")), rs.spans(baro.where("t is not null"))
    both = a0.withColumn("sensor", F.lit("a")).unionByName(b0.withColumn("sensor", F.lit("b")))
    common = both.groupBy("rec").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))

    def shifted(stream: DataFrame, own: DataFrame) -> DataFrame:
        shift = own.join(common.select("rec", F.col("start").alias("c0")), "rec").select("rec", (F.col("start") - F.col("c0")).alias("__shift"))
        return stream.join(shift, "rec").withColumn("s", F.round(F.col("s") + F.col("__shift"), 6)).drop("__shift")

    # Streams are written once each; samples are dealt to windows as they are read, so no copies of them are written.
    a = wn.windowed(stash(shifted(accel_streams(accel, cfg), a0), "accel"), common, cfg.grids)
    b = wn.windowed(stash(shifted(baro_streams(baro, cfg), b0), "baro"), common, cfg.grids)

    seen = lambda rows, n: rows.groupBy(*KEYS).agg(F.count("*").alias(f"n_{n}"), F.avg(F.col("obs").cast("double")).alias(f"{n}_obs_coverage"))
    ends = common.select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    w = wn.hop_windows(ends, cfg.grids).join(seen(a, "accel"), list(KEYS), "left").join(seen(b, "baro"), list(KEYS), "left").fillna(0, ["n_accel", "n_baro", "accel_obs_coverage", "baro_obs_coverage"])
    w = w.where(wn.covered(F.col("accel_obs_coverage"), F.col("n_accel"), F.col("baro_obs_coverage"), F.col("n_baro"), cfg.coverage))
    w = w.join(marks, "rec", "left").join(common.select("rec", F.col("start").alias("__t0")), "rec")
    w = w.join((quiet if quiet is not None else marks.where("false")).select("rec", F.lit(True).alias("__quiet")), "rec", "left").withColumn("__quiet", F.coalesce("__quiet", F.lit(False)))
    start, end = F.col("ws") + F.col("__t0"), F.col("we") + F.col("__t0")
    at, center, to, ld = wn.anchor(start, end, cfg.where), (start + end) / 2, F.col("t_takeoff"), F.col("t_landing")
    label = wn.overlap_label(start, end, to, ld, cfg.zones) if cfg.rule == "overlap" else wn.anchor_label(at, center, to, ld, cfg.zones)
    w = w.withColumns({"label": F.when(F.col("__quiet"), cfg.quiet_label).otherwise(label), "t_start": start, "t_end": end, "t_center": center, "t_anchor": at}).where("label is not null")
    w = w.where(~F.col("__quiet") | (tb.draw("rec", "grid_id", "k", seed=cfg.seed) < cfg.keep_quiet))
    far = lambda t: F.when(~F.col("__quiet"), F.abs(F.col("t_anchor") - t))
    w = w.withColumns({"dist_to_takeoff": far(to), "dist_to_landing": far(ld)}).withColumn("dist_to_event", F.least("dist_to_takeoff", "dist_to_landing"))
    w = w.withColumn("domain", F.when(F.col("__quiet"), "nonflight").otherwise("flight"))
    grids = {g.grid_id: g for g in cfg.grids}
    pick = lambda get: F.element_at(F.create_map(*[x for i, g in grids.items() for x in (F.lit(i), F.lit(get(g)))]), F.col("grid_id"))
    w = w.withColumns({"win_s": pick(lambda g: g.win), "hop_s": pick(lambda g: g.hop)}).drop("__t0", "__quiet", "n_accel", "n_baro")

    w = stash(w, "windows")  # the gate is judged once
    keep = w.select(*KEYS)
    out = w.join(accel_features(a.join(keep, list(KEYS), "left_semi"), cfg.accel_hz), list(KEYS), "left").join(baro_features(b.join(keep, list(KEYS), "left_semi"), cfg.baro_hz), list(KEYS), "left")
    out = rs.end_gaps(out.drop("ws", "we"), "rec").withColumn("log_win_s", F.log1p("win_s"))
    return out.withColumns({"file": F.regexp_extract(F.col("rec").cast("string"), r"([^/]*)$", 1), "file_id": F.col("rec").cast("string")})


META = ("rec", "k", "domain", "file", "file_id", "grid", "grid_id", "win_s", "hop_s", "t_start", "t_end", "t_center", "t_anchor", "label", "t_takeoff", "t_landing", "dist_to_takeoff", "dist_to_landing", "dist_to_event", "accel_obs_coverage", "baro_obs_coverage", "dt_prev_end_s", "log_dt_prev_end_s", "log_win_s")


def signal_features(table: DataFrame) -> list[str]:
    """The 142 features of a table, in its order."""
    return [c for c in table.columns if c not in META]


def imputed(table: DataFrame) -> DataFrame:
    """The table with presence indicators and coverages, and 0 for what is missing."""
    found = signal_features(table)
    shares = {"accel": [c for c in found if c.startswith(("ax_", "ay_", "az_", "amag_"))], "baro": [c for c in found if c.startswith(("p_", "dhdt_"))]}
    return tb.missingness(table, [*found, "dt_prev_end_s", "log_dt_prev_end_s"], GROUPS, shares)
