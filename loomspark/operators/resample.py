"""Causal resampling of irregular readings onto a grid, and recursive averages.

A recording's time starts at 0 with its first reading.  All work is keyed by recording; long recordings are cut into
chunks of time, so that one recording with most of the rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import altitude, present
from loomspark.operators.tables import quantiles
from loomspark.sources.scratch import stash

#: Readings stay valid for this many median steps; readings of a chunk (about), and of a block within it.
HOLD, CHUNK, BLOCK = 5.0, 8192, 64


def collapse(samples: DataFrame, *values: str) -> DataFrame:
    """Readings ``(rec, t, values…)`` of the same time are averaged first; rows without a time are dropped."""
    values = values or ("v",)
    rows = samples.select("rec", present(F.col("t")).alias("t"), *(present(F.col(v)).alias(v) for v in values))
    return rows.where("t is not null").groupBy("rec", "t").agg(*(F.avg(v).alias(v) for v in values))


def spans(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rec").agg(F.min("t").alias("start"), F.max("t").alias("stop"))


def zeroed(samples: DataFrame) -> DataFrame:
    """``s``, seconds since the recording's first reading, in place of ``t``."""
    return samples.join(spans(samples).select("rec", "start"), "rec").withColumn("s", F.col("t") - F.col("start")).drop("start", "t")


def median_step(samples: DataFrame) -> DataFrame:
    """``rec, step``: the median of the positive steps between readings; NULL with fewer than two."""
    w = Window.partitionBy("rec").orderBy("t")
    steps = samples.select("rec", (F.col("t") - F.lag("t").over(w)).alias("d"))
    found = quantiles(steps.where("d > 0"), "d", [0.5], "rec").select("rec", F.col("q")[0].alias("step"))
    return samples.select("rec").distinct().join(found, "rec", "left")


def resample_columns(samples: DataFrame, values: Sequence[str], step: float, hold: float = HOLD, fill: bool = True) -> DataFrame:
    """``rec, bin, s``, each value's bin means on the grid of ``step`` seconds from the first reading to the last, and ``obs_<value>``.

    An empty bin takes the last observed mean while the bin's time is at most ``hold`` median steps after the last
    reading of that value before it; NULL otherwise, or always without ``fill``.
    """
    rows = collapse(samples, *values)
    edges = spans(rows).select("rec", F.col("start").alias("__a"), F.ceil((F.col("stop") - F.col("start") + step / 2) / step).alias("__n"))
    z = rows.join(edges, "rec").withColumn("s", F.col("t") - F.col("__a")).withColumn("bin", F.least(F.floor(F.col("s") / step), F.col("__n") - 1))
    means = z.groupBy("rec", "bin").agg(*(F.avg(v).alias(v) for v in values), *(F.max(F.when(F.col(v).isNotNull(), F.col("s"))).alias(f"__at_{v}") for v in values))
    grid = edges.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("bin"))
    full = grid.join(means, ["rec", "bin"], "left").withColumns({f"obs_{v}": F.col(v).isNotNull() for v in values})
    time = F.col("bin") * F.lit(step)
    observed = [f"obs_{v}" for v in values]
    if not fill:
        return full.select("rec", "bin", time.alias("s"), *values, *observed)
    full = full.join(median_step(rows).select("rec", (hold * F.col("step")).alias("__limit")), "rec", "left")
    w = Window.partitionBy("rec").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda v: F.when(F.col(f"obs_{v}") | (time - F.last(f"__at_{v}", True).over(w) <= F.col("__limit")), F.last(v, True).over(w)).alias(v)
    return full.select("rec", "bin", time.alias("s"), *map(held, values), *observed)


def resample(samples: DataFrame, step: float, hold: float = HOLD, fill: bool = True) -> DataFrame:
    """``rec, bin, s, v, obs`` of one value; see :func:`resample_columns`."""
    return resample_columns(samples, ["v"], step, hold, fill).withColumnRenamed("obs_v", "obs")


def coverage(grid: DataFrame, *keys: str) -> DataFrame:
    """Share of observed bins."""
    return grid.groupBy(*keys).agg(F.avg(F.col("obs").cast("double")).alias("coverage"))


def alpha(tau: float, hz: float) -> float:
    return 2.0 / (1.0 + tau * hz)


def _ewm(x: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray]:
    """The average after each value if it starts at 0 before the first, and the weight left to another start.

    Blocks of present values are averaged at once by a triangular matrix, and only their ends are carried on one by one.
    """
    out, left = np.full(len(x), np.nan), np.ones(len(x))
    there = x == x
    v = x[there]
    if len(v):
        powers = (1 - a) ** np.arange(BLOCK + 1)
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        blocks = np.zeros((-(-len(v) // BLOCK), BLOCK))
        blocks.ravel()[: len(v)] = v
        local = blocks @ np.where(lag >= 0, a * powers[np.maximum(lag, 0)], 0.0).T
        starts, m = np.empty(len(blocks)), 0.0
        for k, end in enumerate(local[:, -1].tolist()):
            starts[k] = m
            m = end + powers[BLOCK] * m
        out[there] = (local + starts[:, None] * powers[1:]).ravel()[: len(v)]
    left[:] = (1 - a) ** np.cumsum(there)
    return out, left


def _field(name: str):
    return lambda row: row[name]


def _started(start: Column):
    return lambda local, left: F.when(~F.isnan(local), local + left * start)


def emas(rows: DataFrame, streams: Sequence[tuple[str, float, str]], key: str = "rec", time: str = "s", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the recursive average ``out`` of each stream ``(value, a, out)``, ``a`` weighing the new reading.

    The first reading starts an average; a missing one leaves it unchanged and has no result.  An average is an affine
    map of the one before, so each chunk of a recording is averaged from 0 by itself, and only the chunks' maps, a few
    numbers each, are composed along the recording.  A chunk lasts as long as ``chunk`` readings of the recording take on
    average.  No task holds more than a chunk's rows, or a recording's maps.
    """
    columns = [time, *(c for c in rows.columns if c not in (key, time))]
    lasts = rows.groupBy(F.col(key).alias("__key")).agg(F.min(time).alias("__t0"), F.greatest((F.max(time) - F.min(time)) / F.count("*") * chunk, F.lit(1e-9)).alias("__s"))
    rows = rows.join(lasts, F.col(key).eqNullSafe(F.col("__key")))
    packed = rows.groupBy(key, F.floor((F.col(time) - F.col("__t0")) / F.col("__s")).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__rows"))

    def maps(a: float):
        @F.pandas_udf("local array<double>, left array<double>, first double, last double, rest double")
        def run(x: pd.Series) -> pd.DataFrame:
            out = []
            for values in x:
                v = np.asarray(values, float)
                local, left = _ewm(v, a)
                there = np.flatnonzero(v == v)
                out.append((local, left, v[there[0]] if len(there) else None, local[there[-1]] if len(there) else None, left[-1]))
            return pd.DataFrame(out, columns=["local", "left", "first", "last", "rest"])

        return run

    for k, (value, a, _) in enumerate(streams):
        packed = packed.withColumn(f"__m{k}", maps(a)(F.transform("__rows", _field(value))))
    packed = stash(packed, "averages")
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda m, c: F.when(c["first"].isNull(), m).otherwise(F.coalesce(m, c["first"]) * c["rest"] + c["last"])
    short = lambda k: F.struct(*(F.col(f"__m{k}.{f}").alias(f) for f in ("first", "last", "rest")))
    heads = packed.select(key, "__chunk", *(short(k).alias(f"__h{k}") for k in range(len(streams))))
    heads = heads.withColumns({f"__h{k}": F.collect_list(f"__h{k}").over(before) for k in range(len(streams))})
    heads = heads.select(key, "__chunk", *(F.aggregate(f"__h{k}", F.lit(None).cast("double"), step).alias(f"__start{k}") for k in range(len(streams))))
    packed = packed.join(heads, [key, "__chunk"])
    for k in range(len(streams)):
        start = F.coalesce(f"__start{k}", F.col(f"__m{k}.first"))
        packed = packed.withColumn(f"__e{k}", F.zip_with(f"__m{k}.local", f"__m{k}.left", _started(start)))
    zipped = F.arrays_zip("__rows", *(f"__e{k}" for k in range(len(streams))))
    rows = packed.select(key, F.explode(zipped).alias("__z"))
    return rows.select(key, *(F.col(f"__z.__rows.{c}").alias(c) for c in columns), *(F.col(f"__z.__e{k}").alias(out) for k, (_, _, out) in enumerate(streams)))


def ema(rows: DataFrame, value: str, a: float, out: str, key: str = "rec", time: str = "s", chunk: int = CHUNK) -> DataFrame:
    """One recursive average; see :func:`emas`."""
    return emas(rows, [(value, a, out)], key, time, chunk)


def ema_variance(rows: DataFrame, value: str, a: float, out: str, key: str = "rec") -> DataFrame:
    """Recursive variance about the updated recursive mean, from 0."""
    with_mean = ema(rows, value, a, "__m", key).withColumn("__d2", F.pow(F.col(value) - F.col("__m"), 2))
    return ema(with_mean, "__d2", a, out, key).drop("__m", "__d2")


def ema_zscore(rows: DataFrame, value: str, a: float, out: str, key: str = "rec") -> DataFrame:
    both = ema(rows, value, a, "__mean", key).withColumn("__d2", F.pow(F.col(value) - F.col("__mean"), 2))
    both = ema(both, "__d2", a, "__var", key).drop("__d2")
    return both.withColumn(out, (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-6)).drop("__mean", "__var")


def magnitude(rows: DataFrame, axes: Sequence[str] = ("ax", "ay", "az"), out: str = "amag") -> DataFrame:
    return rows.withColumn(out, F.sqrt(sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0))))


def gravity_aligned(rows: DataFrame, hz: float, tau: float = 0.6) -> DataFrame:
    """``avert`` and ``ahoriz``: the part of the acceleration along gravity (its slow average), and across it."""
    rows = emas(rows, [(c, alpha(tau, hz), f"__g{c}") for c in ("ax", "ay", "az")])
    g = [F.col(f"__g{c}") for c in ("ax", "ay", "az")]
    d = [F.col(c) - x for c, x in zip(("ax", "ay", "az"), g)]
    norm = F.sqrt(sum((x * x for x in g), F.lit(0.0)))
    up = F.when(norm > 1e-8, sum((x * y for x, y in zip(d, g)), F.lit(0.0)) / norm)
    rows = rows.withColumn("avert", up)
    return rows.withColumn("ahoriz", F.sqrt(F.greatest(sum((x * x for x in d), F.lit(0.0)) - F.pow("avert", F.lit(2)), F.lit(0.0)))).drop("__gax", "__gay", "__gaz")


def dynamic(rows: DataFrame, hz: float, tau: float = 2.0) -> DataFrame:
    """``dyn``: the magnitude less its slow average."""
    return ema(rows, "amag", alpha(tau, hz), "__slow").withColumn("dyn", F.col("amag") - F.col("__slow")).drop("__slow")


def climb_rate(rows: DataFrame, hz: float, tau: float = 2.0) -> DataFrame:
    """``dhdt``: the averaged backward difference of the altitude above the first pressure ``p``; NULL next to a gap."""
    first = rows.where("p is not null").groupBy("rec").agg(F.min_by("p", "s").alias("__p0"))
    w = Window.partitionBy("rec").orderBy("s")
    h = rows.join(first, "rec", "left").withColumn("__h", altitude(F.col("p"), F.col("__p0")))
    h = h.withColumn("__d", (F.col("__h") - F.lag("__h").over(w)) * hz)
    return ema(h, "__d", alpha(tau, hz), "dhdt").drop("__p0", "__h", "__d")


def pressure_trend(rows: DataFrame, hz: float, tau: float = 30.0) -> DataFrame:
    """``p_ema30`` and its difference, the first row taking that of the second."""
    w = Window.partitionBy("rec").orderBy("s")
    got = ema(rows, "p", alpha(tau, hz), "p_ema30")
    x = F.col("p_ema30")
    step = F.when(F.lag(F.lit(1)).over(w).isNull(), F.lead(x).over(w) - x).otherwise(x - F.lag(x).over(w))
    return got.withColumn("p_ema30_dt1", step)


def end_gaps(windows: DataFrame, key: str = "file_id") -> DataFrame:
    """``dt_prev_end_s`` and its log: seconds since the end of the window before, by file and grid."""
    w = Window.partitionBy(key, "grid").orderBy("t_end", "t_start")
    gap = F.greatest(F.col("t_end") - F.lag("t_end").over(w), F.lit(0.0))
    return windows.withColumn("dt_prev_end_s", F.when(F.lag("t_end").over(w).isNotNull(), gap)).withColumn("log_dt_prev_end_s", F.log1p("dt_prev_end_s"))


def obs_all(*masks: Column) -> Column:
    """A reading of several axes is observed if all of them are."""
    out = masks[0]
    for m in masks[1:]:
        out = out & m
    return out
