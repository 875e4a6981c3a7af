"""Reference windows: what a live detector gets from a recording, with features raw and scaled, for tests of other implementations.

They differ from the feature table's windows: their order is the scheduler's, their ends are snapped to each sensor's
grid, coverages are shares of observed bins, and values are scaled by given means and scales, missing ones to 0.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import resample as rs
from loomspark.operators import windows as wn
from loomspark.plans import sensors
from loomspark.sources import recordings as rec
from loomspark.sources import sinks
from loomspark.sources.scratch import stash

#: The live detector's grids, in the order in which equal ends come.
GRIDS = (wn.Grid("BASE", 0, 25.0, 25.0), wn.Grid("TO_EVENT", 1, 20.0, 10.0), wn.Grid("LD_EVENT", 2, 24.0, 12.0))
#: Slots tried for each window wanted; samples an array holds for spectra at least; scale below which a feature is constant; seconds that snapping can move a window by, and tolerance of its bounds.
TRIES, SPECTRAL, TINY, SLACK, EPS = 4, 16, 1e-8, 1.0, 1e-9


@dataclass(frozen=True)
class Settings:
    accel_hz: float = 20.0
    baro_hz: float = 1.0
    coverage: float = 0.8
    grids: tuple[wn.Grid, ...] = GRIDS
    windows: int = 50

    def sensors(self) -> sensors.Settings:
        return sensors.Settings(accel_hz=self.accel_hz, baro_hz=self.baro_hz)


def slots(stops: DataFrame, cfg: Settings) -> DataFrame:
    """``rec, grid, grid_id, k, ws, we, seq``: the first slots that a scheduler polled each second gives, ``stops`` (rec, stop) being the last bins' times."""
    first = min(g.win for g in cfg.grids)
    last = first + F.floor(F.col("stop") + 1.0 - first)
    ends = stops.where(F.col("stop") + 1.0 >= first).select("rec", F.lit(0.0).alias("start"), (last + 1e-6).alias("stop"))
    return wn.scheduled(wn.hop_windows(ends, cfg.grids)).where(F.col("seq") < TRIES * cfg.windows)


def snapped(samples: DataFrame, windows: DataFrame, hz: float, cfg: Settings) -> DataFrame:
    """``samples`` (rec, s, …) once for each of the ``windows`` that holds them when its end is rounded to the sensor's grid.

    The numbers of the windows near a sample follow from its time, so the join is one of keys.
    """
    of_grid = F.array(*(F.struct(F.lit(g.grid_id).alias("grid_id"), F.lit(g.win).alias("win"), F.lit(g.hop).alias("hop")) for g in cfg.grids))
    rows = samples.withColumn("__g", F.explode(of_grid)).withColumns({"grid_id": F.col("__g.grid_id"), "__win": F.col("__g.win"), "__hop": F.col("__g.hop")})
    low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("s") - F.col("__win") - SLACK / hz) / F.col("__hop")))
    high = F.floor((F.col("s") + SLACK / hz) / F.col("__hop"))
    rows = rows.withColumn("k", F.explode(F.when(low <= high, F.sequence(low, high)))).join(windows.select(*sensors.KEYS), ["rec", "grid_id", "k"])
    end = F.bround(F.col("we") * hz, 0) / hz
    return rows.where((F.col("s") >= end - F.col("__win") - EPS) & (F.col("s") < end + EPS)).drop("__g", "__win", "__hop")


def windows(a: DataFrame, b: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows that pass the coverage gate, in order, ``cfg.windows`` a recording at most, and the samples of both sensors in them.

    ``a`` and ``b`` are resampled (rec, s, obs, …), on one time that is 0 at the first acceleration (the first pressure,
    without any).  ``dt_prev_end_s`` is 0 for a grid's first window.
    """
    stops = a.select("rec", "s").unionByName(b.select("rec", "s")).groupBy("rec").agg(F.max("s").alias("stop"))
    due = slots(stops, cfg)
    in_a, in_b = snapped(a, due, cfg.accel_hz, cfg), snapped(b, due, cfg.baro_hz, cfg)
    seen = lambda rows, name: rows.groupBy(*sensors.KEYS).agg(F.count("*").alias(f"n_{name}"), F.avg(F.col("obs").cast("double")).alias(f"{name}_coverage"))
    keys = list(sensors.KEYS)
    w = due.join(seen(in_a, "accel"), keys, "left").join(seen(in_b, "baro"), keys, "left").fillna(0, ["n_accel", "n_baro", "accel_coverage", "baro_coverage"])
    w = w.where(wn.covered(F.col("accel_coverage"), F.col("n_accel"), F.col("baro_coverage"), F.col("n_baro"), cfg.coverage))
    w = w.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy("seq")) - 1).where(F.col("place") < cfg.windows)
    before = F.lag("we").over(Window.partitionBy("rec", "grid_id").orderBy("seq"))
    return w.withColumn("dt_prev_end_s", F.coalesce(F.greatest(F.col("we") - before, F.lit(0.0)), F.lit(0.0))), in_a, in_b


def aligned(accel: DataFrame, baro: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Derived streams of both sensors on one time, 0 at the first acceleration (the first pressure, without any)."""
    one, two = rs.spans(accel.where("t is not null")), rs.spans(baro.where("t is not null"))
    zero = two.select("rec", F.col("start").alias("__b")).join(one.select("rec", F.col("start").alias("__a")), "rec", "full").select("rec", F.coalesce("__a", "__b").alias("__zero"))

    def shifted(stream: DataFrame, own: DataFrame) -> DataFrame:
        shift = own.join(zero, "rec").select("rec", (F.col("start") - F.col("__zero")).alias("__shift"))
        return stream.join(shift, "rec").withColumn("s", F.col("s") + F.col("__shift")).drop("__shift")

    return shifted(sensors.accel_streams(accel, cfg.sensors()), one), shifted(sensors.baro_streams(baro, cfg.sensors()), two)


def _scaled(c: str, mean: float, scale: float) -> Column:
    """The z-score; missing values count as the mean, features without a scale are 0."""
    if not np.isfinite(scale) or scale < TINY:
        return F.lit(0.0)
    z = (F.coalesce(F.col(c), F.lit(float(mean))) - float(mean)) / float(scale)
    return F.coalesce(F.when(F.abs(z) < float("inf"), z), F.lit(0.0))


def features(accel: DataFrame, baro: DataFrame, names: Sequence[str], scaler: dict[str, np.ndarray], cfg: Settings = Settings()) -> DataFrame:
    """The reference windows of all recordings: ``rec, place, grid, grid_id, t_end, win_s, hop_s, dt_prev_end_s, dyn_n, raw, scaled``.

    ``accel`` (rec, t, ax, ay, az) and ``baro`` (rec, t, p) are in seconds; ``raw`` and ``scaled`` are arrays in the
    order of ``names`` (outside names); a name that no window has is missing everywhere.
    """
    a, b = aligned(accel, baro, cfg)
    w, in_a, in_b = windows(stash(a, "accel"), stash(b, "baro"), cfg)
    w = stash(w, "windows")
    keys = list(sensors.KEYS)
    keep = w.select(*keys)
    in_a, in_b = in_a.join(keep, keys, "left_semi"), in_b.join(keep, keys, "left_semi")
    out = w.join(sensors.accel_features(in_a, cfg.accel_hz), keys, "left").join(sensors.baro_features(in_b, cfg.baro_hz), keys, "left")
    out = out.join(in_a.groupBy(*keys).agg(F.count("dyn").alias("dyn_n")), keys, "left").fillna(0, ["dyn_n"])
    of = {g.grid_id: g for g in cfg.grids}
    pick = lambda get: F.element_at(F.create_map(*[x for i, g in of.items() for x in (F.lit(i), F.lit(get(g)))]), F.col("grid_id"))
    flag = lambda condition: condition.cast("double")
    out = out.withColumns({
        "t_end": F.col("we"), "win_s": pick(lambda g: g.win), "hop_s": pick(lambda g: g.hop), "log_dt_prev_end_s": F.log1p("dt_prev_end_s"),
        "has_accel": flag(F.col("n_accel") > 0), "has_baro": flag(F.col("n_baro") > 0), "has_dyn": flag(F.col("dyn_n") > 0), "has_spectral": flag(F.col("n_accel") >= SPECTRAL),
    }).withColumn("log_win_s", F.log1p("win_s"))
    inside = [sinks.stored(n) for n in names]
    have = set(out.columns)
    out = out.withColumns({c: F.lit(None).cast("double") for c in inside if c not in have})
    out = out.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")) for c in inside if c not in ("grid_id", "win_s", "hop_s", "dt_prev_end_s")})
    raw = F.array(*(F.col(c).cast("double") for c in inside))
    scaled = F.array(*(_scaled(c, m, s) for c, m, s in zip(inside, scaler["mean"], scaler["scale"])))
    return out.select("rec", "place", "grid", "grid_id", "t_end", "win_s", "hop_s", "dt_prev_end_s", "dyn_n", raw.alias("raw"), scaled.alias("scaled"))


def write(spark: SparkSession, recording: str, model: str, out: str, cfg: Settings = Settings()) -> dict[str, Any]:
    """The reference arrays of one recording as ``out`` (.npz), and its feature names beside it; returns their sizes.

    ``model`` is a folder with ``features.json`` and ``scaler.npz``.  The file holds the recording's readings and
    ``cfg.windows`` windows, so they come to the driver; a recording without a window raises.
    """
    names = sinks.load_names(spark, f"{model}/features.json")
    scaler = sinks.load_scaler(spark, f"{model}/scaler.npz", names)
    parsed = stash(rec.parse_files(rec.discover(spark, recording)), "parsed")
    accel, baro, _ = rec.recordings(parsed)
    found = features(accel, baro, names, scaler, cfg).orderBy("place").collect()
    if not found:
        raise ValueError("no window passes the coverage gate: a longer recording is needed")
    if len({r.rec for r in found}) > 1:
        raise ValueError("reference arrays are those of one recording")
    table = lambda rows, *columns: rows.select(*columns).orderBy("t").toPandas().to_numpy(float).reshape(-1, len(columns)).T
    at, ax, ay, az = table(accel, "t", "ax", "ay", "az")
    bt, bp = table(baro, "t", "p")
    zero = (at if len(at) else bt)[0]
    column = lambda name, kind=np.float64: np.array([r[name] for r in found], kind)
    arrays = {
        "raw_accel_t": at - zero, "raw_accel_ax": ax, "raw_accel_ay": ay, "raw_accel_az": az, "raw_baro_t": bt - zero, "raw_baro_p": bp,
        "scheduler_origin_sec": np.zeros(1), "base_win_s": np.array([cfg.grids[0].win]), "base_hop_s": np.array([cfg.grids[0].hop]),
        "window_t_end": column("t_end"), "window_win_s": column("win_s"), "window_hop_s": column("hop_s"), "window_grid_id": column("grid_id"),
        "window_dt_prev_end_s": column("dt_prev_end_s"), "window_dyn_n": column("dyn_n", np.int32),
        "features_raw": column("raw").ravel(), "features_scaled": column("scaled").ravel(), "n_windows": np.array([len(found)], np.int32), "n_features": np.array([len(names)], np.int32),
    }
    sinks.write_bytes(spark, sinks.packed(**arrays), out)
    sinks.write_bytes(spark, json.dumps(names, indent=2).encode(), re.sub(r"(\.npz)?$", "_feature_names.json", out, count=1))
    return {"windows": len(found), "features": len(names), "grids": {g.name: sum(r.grid == g.name for r in found) for g in cfg.grids}}
