"""Window features: grouped statistics, order-sensitive trends, and spectra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequency bands in Hz of the magnitude and of its dynamic part.
BANDS = ((0.0, 0.3), (0.3, 1.0), (1.0, 3.0), (3.0, 8.0), (8.0, 15.0))
DYN_BANDS = ((0.0, 0.5), (0.5, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, 20.0))


def statistics(v: str, name: str) -> list[Column]:
    """Mean, std, min, max, median, iqr, rms, range, skew and excess kurtosis of a window's present values."""
    c = F.col(v)
    quart = lambda q: F.percentile(c, F.lit(q))
    return [
        F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
        quart(0.5).alias(f"{name}_median"), (quart(0.75) - quart(0.25)).alias(f"{name}_iqr"), F.sqrt(F.avg(c * c)).alias(f"{name}_rms"),
        (F.max(c) - F.min(c)).alias(f"{name}_range"),
        F.when((F.count(c) >= 3) & (F.stddev_pop(c) > 0), F.skewness(c)).alias(f"{name}_skew"),
        F.when((F.count(c) >= 4) & (F.stddev_pop(c) > 0), F.kurtosis(c)).alias(f"{name}_kurt"),
    ]


def compact(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "s") -> DataFrame:
    """``rows`` with, for each column, the place ``__i`` of its value among the window's ``__n`` present ones, their mean and std, and the value before.

    All columns share one sort by window and time, and sums are taken in that order.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in columns:
        out |= {
            f"{c}__i": F.when(F.col(c).isNotNull(), F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1), f"{c}__n": F.count(c).over(whole),
            f"{c}__mu": F.avg(c).over(whole), f"{c}__sd": F.stddev_pop(c).over(whole), f"{c}__before": F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    return rows.withColumns(out)


def shape(c: str, name: str) -> dict[str, Column]:
    """Skew and excess kurtosis of a compacted column, by its differences from the mean."""
    n, sd = F.count(c), F.max(f"{c}__sd")
    moment = lambda k: F.avg(F.pow(F.col(c) - F.col(f"{c}__mu"), F.lit(k))) / F.pow(sd, F.lit(k))
    return {"skew": F.when((n >= 3) & (sd > 0), moment(3.0)).alias(f"{name}_skew"), "kurt": F.when((n >= 4) & (sd > 0), moment(4.0) - 3).alias(f"{name}_kurt")}


def feature(c: str, kind: str, hz: float = 1.0, seconds: float = 2.0, time: str = "s", dead: float = 0.0) -> Column:
    """An order-sensitive feature of a compacted column: its missing values are left out before anything is counted."""
    y, i, n = F.col(c), F.col(f"{c}__i"), F.col(f"{c}__n")
    late = lambda least: i >= n - max(least, int(seconds * hz))  # noqa: E731  the last seconds as a number of values
    mean = lambda condition: F.avg(F.when(condition, y))
    gate = lambda least, value: F.when(F.max(n) >= least, value)
    last, recent = F.when(late(3), y), F.when(late(1), y)
    recent_std = F.when(F.count(last) >= 2, F.stddev_pop(last))
    if kind == "peakcount":
        return F.coalesce(F.sum((F.abs(y - F.col(f"{c}__mu")) > 2 * F.col(f"{c}__sd")).cast("double")), F.lit(0.0))
    if kind == "slope":
        t = F.when(y.isNotNull(), F.col(time) - F.col("__origin"))
        return F.when((F.count(y) >= 2) & (F.stddev_pop(t) > 0), F.regr_slope(y, t))
    if kind == "zcr_ps":
        sign = lambda x: F.when(x > dead, 1).when(x < -dead, -1).otherwise(0)
        return F.coalesce(F.sum((sign(y) * sign(F.col(f"{c}__before")) < 0).cast("int")), F.lit(0)) / (F.max(n) / hz)
    if kind == "halfdiff":
        return gate(4, mean(i >= F.floor(n / 2)) - mean(i < F.floor(n / 2)))
    if kind == "thirddiff":
        return gate(6, mean(i >= F.floor(2 * n / 3)) - mean(i < F.floor(n / 3)))
    if kind == "recent_diff_25pct":
        return gate(4, mean(i >= F.floor(n * 0.75)) - mean(i < F.floor(n * 0.75)))
    if kind == "recent_slope":
        return F.when(F.count(last) >= 3, F.regr_slope(last, (i - n) / hz))
    if kind == "recent_std":
        return recent_std
    if kind == "recent_mean":
        return F.avg(recent)
    if kind == "recent_max_abs":
        return F.max(F.abs(recent))
    if kind in ("ratio_recent_mean", "ratio_recent_rms"):
        of = F.avg if kind == "ratio_recent_mean" else lambda c: F.sqrt(F.avg(c * c))
        return F.when((F.max(n) >= 4) & (F.count(last) >= 2) & (F.abs(of(y)) >= 1e-6), F.least(F.greatest(of(last) / of(y), F.lit(0.0)), F.lit(100.0)))
    if kind == "ratio_recent_std":
        return F.when((F.max(n) >= 4) & (F.stddev_pop(y) >= 1e-6), F.least(recent_std / F.stddev_pop(y), F.lit(100.0)))
    raise ValueError(f"no feature {kind!r}")


def trends(rows: DataFrame, keys: Sequence[str], v: str, name: str, hz: float, time: str = "s", recent_s: Sequence[float] = (2.0, 3.0), dead: float = 0.0) -> DataFrame:
    """The order-sensitive features of one column; those of the last seconds are named by their length."""
    x = compact(rows.where(F.col(v).isNotNull()), keys, [v], time).withColumn("__origin", F.min(time).over(Window.partitionBy(*keys)))
    out = [feature(v, k, hz, time=time, dead=dead).alias(f"{name}_{k}") for k in ("peakcount", "slope", "zcr_ps", "halfdiff", "thirddiff", "recent_diff_25pct")]
    late = ("recent_slope", "recent_std", "recent_mean", "recent_max_abs", "ratio_recent_std")
    return x.groupBy(*keys).agg(*out, *(feature(v, k, hz, s, time).alias(f"{name}_{k}_{s:g}s") for s in recent_s for k in late))


def jerk(rows: DataFrame, keys: Sequence[str], v: str, hz: float, time: str = "s", recent_s: float = 2.0) -> DataFrame:
    """Mean magnitude, std and rms of the rate of change between consecutive present values, and of its last seconds."""
    w = Window.partitionBy(*keys)
    x = rows.where(F.col(v).isNotNull()).withColumn("__j", (F.col(v) - F.lag(v).over(w.orderBy(time))) * hz).where("__j is not null")
    x = x.withColumn("__late", F.row_number().over(w.orderBy(F.desc(time))) <= max(1, int(recent_s * hz)))
    j, late = F.col("__j"), F.when(F.col("__late"), F.col("__j"))
    return x.groupBy(*keys).agg(
        F.avg(F.abs(j)).alias("jerk_mean"), F.stddev_pop(j).alias("jerk_std"), F.sqrt(F.avg(j * j)).alias("jerk_rms"),
        F.when(F.count(late) >= 2, F.stddev_pop(late)).alias("jerk_recent_std_2s"), F.max(F.abs(late)).alias("jerk_recent_max_abs_2s"),
    )


def spectrum(x: np.ndarray, hz: float, bands: Sequence[tuple[float, float]]) -> list[float | None]:
    """Relative power of each band (8 values or more); dominant frequency, centroid and bandwidth above 0.1 Hz (16 or more)."""
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 8:
        return [None] * (len(bands) + 3)
    power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(n))) ** 2
    f = np.fft.rfftfreq(n, 1 / hz)
    total = power.sum()
    out: list[float | None] = [float(power[(f >= a) & (f < b)].sum() / total) if total > 0 else None for a, b in bands]
    high = f >= 0.1
    p, g = power[high], f[high]
    if n < 16 or not high.any() or p.sum() <= 0:
        return out + [None] * 3
    centre = float((g * p).sum() / p.sum())
    return [*out, float(g[p.argmax()]), centre, float(np.sqrt(((g - centre) ** 2 * p).sum() / p.sum()))]


def spectral(rows: DataFrame, keys: Sequence[str], v: str, prefix: str, name: str, hz: float, bands: Sequence[tuple[float, float]] = BANDS, time: str = "s") -> DataFrame:
    """Band powers and spectral shape of each window: one Arrow batch function, one transform for a window.

    A window's values travel as one array, so a group is a row and has a window's length at most.
    """
    label = lambda b: f"{b:.1f}".replace(".", "p")
    names = [f"{prefix}pow_{label(a)}_{label(b)}" for a, b in bands] + [f"{name}_dominant_freq", f"{name}_spectral_centroid", f"{name}_spectral_bandwidth"]
    packed = rows.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, v))), lambda p: p[v]).alias("__x"))

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def shape(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([spectrum(np.asarray(y, float), hz, bands) for y in x], columns=names, dtype=float)

    return packed.select(*keys, shape("__x").alias("__s")).select(*keys, *(F.nanvl(F.col(f"__s.`{n}`"), F.lit(None)).alias(n) for n in names))
