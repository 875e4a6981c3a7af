"""Every registered query of the engine with its SQL.

The events table stands in for sensors: a user is a recording, its events are readings at the seconds of their
timestamps, a score is a fixed function of the value, and errors are the positive class.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import scalars
from loomspark.operators import events as ev
from loomspark.operators import features as ft
from loomspark.operators import learning as ln
from loomspark.operators import recurrent as rc
from loomspark.operators import resample as rs
from loomspark.operators import tables as tb
from loomspark.operators import windows as wn
from loomspark.sources import recordings as rec
from loomspark.sources import scratch
from loomspark.sources.scratch import stash
from loomspark.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "window_stats"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3600.0, 86400.0
STEP = 6 * HOUR
GRIDS = (wn.Grid("base", 0, 2 * DAY, 2 * DAY), wn.Grid("to", 1, 1.5 * DAY, 18 * HOUR), wn.Grid("ld", 2, 2 * DAY, DAY))
ZONES = wn.Zones(takeoff=(STEP, DAY), landing=(DAY, STEP), least_s=HOUR, margin=DAY / 2)
THRESHOLD, K, COOLDOWN, HIT = 0.55, 2, DAY, 2 * DAY
#: Weights of a new reading in the averages of 0.6, 2 and 30 seconds at one reading a second.
GRAVITY, SLOW, TREND = (repr(rs.alpha(tau, 1.0)) for tau in (0.6, 2.0, 30.0))
#: Readings an hour on average, as the rate of count-based features.
HZ = 1 / (7 * HOUR)

SIG = """sig AS (SELECT user_id AS rec, epoch_us(ts)::DOUBLE / 1e6 AS t, value AS v, event_type, event_id, round(value / (value + 50), 6) AS p,
  (event_type = 'error')::INT AS y FROM events),
z AS (SELECT *, t - min(t) OVER (PARTITION BY rec) AS s FROM sig),
spans AS (SELECT rec, max(s) AS span FROM z GROUP BY rec),
opens AS (SELECT rec, arg_min(event_type, t) AS first FROM sig GROUP BY rec)"""
WIN = """grids(grid, grid_id, win, hop) AS (VALUES ('base', 0, 172800::DOUBLE, 172800::DOUBLE), ('to', 1, 129600::DOUBLE, 64800::DOUBLE), ('ld', 2, 172800::DOUBLE, 86400::DOUBLE)),
w AS (SELECT rec, grid, grid_id, k, k * hop AS ws, k * hop + win AS we FROM (
  SELECT rec, grid, grid_id, win, hop, unnest(range(floor((span - win + 1e-9) / hop)::BIGINT + 1)) AS k FROM spans, grids WHERE span >= win - 1e-9)),
x AS (SELECT w.*, z.s, z.v, avg(z.v) OVER q AS mu, stddev_pop(z.v) OVER q AS sd, row_number() OVER (PARTITION BY w.rec, w.grid, w.k ORDER BY z.s) - 1 AS i, count(*) OVER q AS n,
  lag(z.v) OVER (PARTITION BY w.rec, w.grid, w.k ORDER BY z.s) AS before
  FROM w JOIN z ON z.rec = w.rec AND z.s BETWEEN ws AND we WINDOW q AS (PARTITION BY w.rec, w.grid, w.k))"""
QUIET = "h AS (SELECT rec, (max(t) - min(t)) / 3600 AS hours FROM sig JOIN opens USING (rec) WHERE first = 'signup' GROUP BY rec)"
CURVE = """by_p AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sig GROUP BY p),
curve AS (SELECT p, pos, n, sum(pos) OVER q AS tp, sum(n) OVER q AS seen, sum(pos) OVER () AS all_pos, sum(n) OVER () AS all_n FROM by_p WINDOW q AS (ORDER BY p DESC)),
pr AS (SELECT *, tp / seen AS pre, tp / all_pos AS re FROM curve)"""
TRIG = f"""r AS (SELECT rec, t, p, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM (SELECT rec, t, max(p) AS p FROM sig GROUP BY rec, t)),
m AS (SELECT rec, i, t, CASE WHEN p >= {THRESHOLD} THEN 1 ELSE 0 END AS run, (-1e300)::DOUBLE AS last, false AS fired FROM r WHERE i = 1
  UNION ALL
  SELECT r.rec, r.i, r.t,
    CASE WHEN r.t - m.last < {COOLDOWN} OR r.p < {THRESHOLD} OR m.run + 1 >= {K} THEN 0 ELSE m.run + 1 END,
    CASE WHEN r.t - m.last >= {COOLDOWN} AND r.p >= {THRESHOLD} AND m.run + 1 >= {K} THEN r.t ELSE m.last END,
    r.t - m.last >= {COOLDOWN} AND r.p >= {THRESHOLD} AND m.run + 1 >= {K}
  FROM m JOIN r ON r.rec = m.rec AND r.i = m.i + 1),
fired AS (SELECT rec, t FROM m WHERE fired)"""
SEG = """isl AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY t) AS row FROM sig),
isl2 AS (SELECT *, row - row_number() OVER (PARTITION BY rec ORDER BY t) AS island FROM isl WHERE y = 1),
takeoff AS (SELECT rec, min(t) AS mk FROM sig JOIN opens USING (rec) WHERE event_type = 'purchase' AND first <> 'click' GROUP BY rec),
seg0 AS (SELECT rec, island, min(row) - 1 AS start_idx, max(row) - 1 AS end_idx, coalesce(any_value(mk), min(t)) AS t_ref FROM isl2 LEFT JOIN takeoff USING (rec) GROUP BY rec, island),
seg AS (SELECT rec, start_idx, end_idx, t_ref, row_number() OVER (PARTITION BY rec ORDER BY start_idx) - 1 AS seg FROM seg0)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.round(F.col("value") / (F.col("value") + 50), 6)
    y = (F.col("event_type") == "error").cast("int")
    return rows.select(F.col("user_id").alias("rec"), scalars.seconds("ts").alias("t"), F.col("value").alias("v"), "event_type", "event_id", p.alias("p"), y.alias("y"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in every window that holds them."""
    s = signal(spark, sf_dir)
    return wn.windowed(rs.zeroed(s), rs.spans(s), GRIDS)


def opens(s: DataFrame) -> DataFrame:
    """``rec, first``: the type of each recording's first event."""
    return s.groupBy("rec").agg(F.min_by("event_type", "t").alias("first"))


def quiet(s: DataFrame) -> DataFrame:
    """The readings of recordings that count as being without events: those that begin with a signup."""
    return s.join(opens(s).where("first = 'signup'"), "rec", "left_semi")


def with_marker(s: DataFrame) -> DataFrame:
    """A marker, the first purchase, for the recordings that don't begin with a click."""
    marked = s.where("event_type = 'purchase'").join(opens(s).where("first <> 'click'"), "rec", "left_semi")
    return s.join(marked.groupBy("rec").agg(F.min("t").alias("mk")), "rec", "left")


def error_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.segments(with_marker(signal(spark, sf_dir)), F.col("y") == 1, F.col("mk"))


def fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.triggers(signal(spark, sf_dir), THRESHOLD, K, COOLDOWN)


# -- resampling and windows ---------------------------------------------------------------------------------------------
def resampled_sql(step: float) -> str:
    return f"""c AS (SELECT rec, t, avg(v) AS v FROM sig GROUP BY rec, t),
e AS (SELECT rec, min(t) AS a, ceil((max(t) - min(t) + {step / 2}::DOUBLE) / {step}::DOUBLE)::BIGINT AS n FROM c GROUP BY rec),
b AS (SELECT c.rec, least(floor((t - a) / {step}::DOUBLE)::BIGINT, n - 1) AS bin, avg(v) AS mean, max(t - a) AS heard FROM c JOIN e USING (rec) GROUP BY ALL),
g AS (SELECT rec, unnest(range(n)) AS bin FROM e),
st AS (SELECT rec, quantile_cont(d, 0.5) AS step FROM (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY t) AS d FROM c) WHERE d > 0 GROUP BY rec)"""


RESAMPLED = resampled_sql(STEP)


@query(f"""WITH {SIG}, {RESAMPLED}
SELECT g.rec, g.bin, round(CASE WHEN mean IS NOT NULL OR g.bin * {STEP}::DOUBLE - last_value(heard IGNORE NULLS) OVER q <= 5 * step THEN last_value(mean IGNORE NULLS) OVER q END, 6) AS v, mean IS NOT NULL AS obs
FROM g LEFT JOIN b USING (rec, bin) LEFT JOIN st USING (rec)
WINDOW q AS (PARTITION BY g.rec ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def resample_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resample(signal(spark, sf_dir), STEP).select("rec", "bin", *r6("v"), "obs")


@query(f"WITH {SIG}, {RESAMPLED} SELECT g.rec, round(avg((mean IS NOT NULL)::INT), 6) AS coverage FROM g LEFT JOIN b USING (rec, bin) GROUP BY g.rec")
def bin_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.coverage(rs.resample(signal(spark, sf_dir), STEP, fill=False), "rec").select("rec", *r6("coverage"))


@query(f"WITH {SIG}, {RESAMPLED} SELECT rec, round(step, 3) AS step FROM st")
def median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.median_step(rs.collapse(signal(spark, sf_dir))).select("rec", F.round("step", 3).alias("step"))


@query(f"WITH {SIG}, {WIN} SELECT rec, grid, grid_id, k, ws, we, row_number() OVER (PARTITION BY rec ORDER BY we, grid_id) - 1 AS seq FROM w")
def hop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = rs.spans(signal(spark, sf_dir)).select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    return wn.scheduled(wn.hop_windows(ends, GRIDS)).withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH {SIG}, {WIN}
SELECT rec, grid, k, count(*) AS n, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, min(v) AS v_min, max(v) AS v_max, round(quantile_cont(v, 0.5), 6) AS v_median,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS v_iqr, round(sqrt(avg(v * v)), 6) AS v_rms, round(max(v) - min(v), 6) AS v_range,
  round(CASE WHEN count(*) >= 3 AND any_value(sd) > 0 THEN avg(power(v - mu, 3)) / power(any_value(sd), 3) END, 6) AS v_skew,
  round(CASE WHEN count(*) >= 4 AND any_value(sd) > 0 THEN avg(power(v - mu, 4)) / power(any_value(sd), 4) - 3 END, 6) AS v_kurt
FROM x GROUP BY rec, grid, k HAVING count(*) >= 3""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placed(spark, sf_dir).groupBy("rec", "grid", "k").agg(F.count("v").alias("n"), *ft.statistics("v", "v")).where("n >= 3")
    rounded = [c for c in out.columns if c.startswith("v_") and c not in ("v_min", "v_max")]
    return out.select("rec", "grid", "k", "n", "v_min", "v_max", *r6(*rounded))


@query(f"""WITH {SIG}, {WIN},
s AS (SELECT *, CASE WHEN v > 40 THEN 1 WHEN v < -40 THEN -1 ELSE 0 END AS sg FROM x)
SELECT rec, grid, k, sum((abs(v - mu) > 2 * sd)::INT)::DOUBLE AS v_peakcount,
  round(CASE WHEN count(*) >= 2 AND stddev_pop(s) > 0 THEN regr_slope(v, s) * 86400 END, 6) AS v_slope_day,
  round(CASE WHEN max(n) >= 4 THEN avg(v) FILTER (WHERE i >= floor(n / 2)) - avg(v) FILTER (WHERE i < floor(n / 2)) END, 6) AS v_halfdiff,
  round(CASE WHEN max(n) >= 6 THEN avg(v) FILTER (WHERE i >= floor(2 * n / 3)) - avg(v) FILTER (WHERE i < floor(n / 3)) END, 6) AS v_thirddiff,
  round(CASE WHEN max(n) >= 4 THEN avg(v) FILTER (WHERE i >= floor(n * 0.75)) - avg(v) FILTER (WHERE i < floor(n * 0.75)) END, 6) AS v_recent_diff_25pct,
  round(CASE WHEN count(*) FILTER (WHERE i >= n - 3) >= 3 THEN regr_slope(v, i) FILTER (WHERE i >= n - 3) END, 6) AS recent_slope,
  round(CASE WHEN count(*) FILTER (WHERE i >= n - 3) >= 2 THEN stddev_pop(v) FILTER (WHERE i >= n - 3) END, 6) AS recent_std,
  round(avg(v) FILTER (WHERE i >= n - 3), 6) AS recent_mean, round(max(abs(v)) FILTER (WHERE i >= n - 3), 6) AS recent_max_abs,
  round(CASE WHEN max(n) >= 4 AND stddev_pop(v) >= 1e-6 THEN least(stddev_pop(v) FILTER (WHERE i >= n - 3) / stddev_pop(v), 100) END, 6) AS ratio_recent_std
FROM s GROUP BY rec, grid, k""")
def window_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.trends(placed(spark, sf_dir), ["rec", "grid", "k"], "v", "v", 1.0, recent_s=(3.0,))
    names = {f"v_{n}_3s": n for n in ("recent_slope", "recent_std", "recent_mean", "recent_max_abs", "ratio_recent_std")}
    out = out.withColumnsRenamed(names).withColumn("v_slope_day", F.col("v_slope") * DAY)
    return out.select("rec", "grid", "k", "v_peakcount", *r6("v_slope_day", "v_halfdiff", "v_thirddiff", "v_recent_diff_25pct", *names.values()))


@query(f"""WITH {SIG}, {WIN}, j AS (SELECT rec, grid, k, v - before AS j FROM x WHERE before IS NOT NULL)
SELECT rec, grid, k, round(avg(abs(j)), 6) AS jerk_mean, round(stddev_pop(j), 6) AS jerk_std, round(sqrt(avg(j * j)), 6) AS jerk_rms FROM j GROUP BY rec, grid, k""")
def window_jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.jerk(placed(spark, sf_dir), ["rec", "grid", "k"], "v", 1.0).select("rec", "grid", "k", *r6("jerk_mean", "jerk_std", "jerk_rms"))


BAND_SQL = ", ".join(f"CASE WHEN total > 0 THEN round(low_{i} / total, 6) END AS pow_{f'{a:.1f}'.replace('.', 'p')}_{f'{b:.1f}'.replace('.', 'p')}" for i, (a, b) in enumerate(ft.BANDS))


@query(f"""WITH {SIG}, {resampled_sql(HOUR)},
held AS (SELECT g.rec, g.bin * {HOUR}::DOUBLE AS s, CASE WHEN mean IS NOT NULL OR g.bin * {HOUR}::DOUBLE - last_value(heard IGNORE NULLS) OVER q <= 5 * step THEN last_value(mean IGNORE NULLS) OVER q END AS v
  FROM g LEFT JOIN b USING (rec, bin) LEFT JOIN st USING (rec) WINDOW q AS (PARTITION BY g.rec ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w AS (SELECT rec, k, k * {4 * DAY} AS ws FROM (SELECT rec, unnest(range(floor((span - {4 * DAY} + 1e-9) / {4 * DAY})::BIGINT + 1)) AS k FROM spans WHERE span >= {4 * DAY} - 1e-9)),
x AS (SELECT w.rec, k, v - avg(v) OVER (PARTITION BY w.rec, k) AS y, row_number() OVER (PARTITION BY w.rec, k ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY w.rec, k) AS n FROM w JOIN held ON held.rec = w.rec AND s BETWEEN ws AND ws + {4 * DAY} WHERE v IS NOT NULL),
y AS (SELECT rec, k, i, n, y * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS y FROM x WHERE n >= 8),
p AS (SELECT rec, k, n, f, f * 20.0::DOUBLE / n AS hz, sum(y * cos(2 * pi() * f * i / n)) ** 2 + sum(y * sin(2 * pi() * f * i / n)) ** 2 AS p FROM (SELECT *, unnest(range(n // 2 + 1)) AS f FROM y) GROUP BY ALL),
m AS (SELECT rec, k, max(n) AS n, sum(p) AS total, {", ".join(f"coalesce(sum(p) FILTER (WHERE hz >= {a} AND hz < {b}), 0) AS low_{i}" for i, (a, b) in enumerate(ft.BANDS))},
  arg_max(hz, p) FILTER (WHERE hz >= 0.1) AS dominant, sum(p) FILTER (WHERE hz >= 0.1) AS high, sum(hz * p) FILTER (WHERE hz >= 0.1) / sum(p) FILTER (WHERE hz >= 0.1) AS centre FROM p GROUP BY rec, k),
v AS (SELECT m.rec, m.k, sqrt(sum((hz - centre) ** 2 * p) / any_value(high)) AS width FROM m JOIN p ON p.rec = m.rec AND p.k = m.k WHERE hz >= 0.1 GROUP BY m.rec, m.k),
every AS (SELECT DISTINCT rec, k FROM x)
SELECT rec, 'base' AS grid, k, {BAND_SQL}, CASE WHEN n >= 16 AND high > 0 THEN round(dominant, 6) END AS v_dominant_freq, CASE WHEN n >= 16 AND high > 0 THEN round(centre, 6) END AS v_spectral_centroid,
  CASE WHEN n >= 16 AND high > 0 THEN round(width, 6) END AS v_spectral_bandwidth FROM every LEFT JOIN m USING (rec, k) LEFT JOIN v USING (rec, k)""")
def window_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = rs.resample(signal(spark, sf_dir), HOUR)
    grid = (wn.Grid("base", 0, 4 * DAY, 4 * DAY),)
    out = ft.spectral(wn.windowed(bins.select("rec", "s", "v"), rs.spans(signal(spark, sf_dir)), grid), ["rec", "grid", "k"], "v", "", "v", 20.0)
    return out.select("rec", "grid", "k", *r6(*out.columns[3:]))


@query(f"""WITH {SIG}, {WIN},
mk AS (SELECT rec, min(s) FILTER (WHERE event_type = 'purchase') AS tk, max(s) FILTER (WHERE event_type = 'signup') AS ld FROM z GROUP BY rec),
o AS (SELECT w.*, tk, ld, greatest(0, least(we, tk + 86400) - greatest(ws, tk - 21600)) AS o_t, greatest(0, least(we, ld + 21600) - greatest(ws, ld - 86400)) AS o_l,
  abs((ws + we) / 2 - tk) AS d_t, abs((ws + we) / 2 - ld) AS d_l, greatest(3600, 0.25 * (we - ws)) AS thr FROM w LEFT JOIN mk USING (rec)),
q AS (SELECT *, coalesce(tk IS NOT NULL AND o_t >= thr, false) AS c_t, coalesce(ld IS NOT NULL AND o_l >= thr, false) AS c_l,
  coalesce(we BETWEEN tk - 21600 AND tk + 86400, false) AS a_t, coalesce(we BETWEEN ld - 86400 AND ld + 21600, false) AS a_l FROM o)
SELECT rec, grid, k,
  CASE WHEN NOT c_t AND NOT c_l THEN 'OTHER' WHEN c_t AND (NOT c_l OR o_t > o_l OR (o_t = o_l AND d_t <= d_l)) THEN 'TAKEOFF' ELSE 'LANDING' END AS by_overlap,
  CASE WHEN NOT c_t AND NOT c_l THEN 'OTHER' WHEN c_t AND c_l AND d_t <= 43200 AND d_l <= 43200 THEN NULL WHEN c_t AND (NOT c_l OR o_t > o_l OR (o_t = o_l AND d_t <= d_l)) THEN 'TAKEOFF' ELSE 'LANDING' END AS by_overlap_drop,
  CASE WHEN NOT a_t AND NOT a_l THEN 'OTHER' WHEN a_t AND (NOT a_l OR abs(we - tk) <= abs(we - ld)) THEN 'TAKEOFF' ELSE 'LANDING' END AS by_anchor FROM q""")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    z = rs.zeroed(s)
    names = F.when(F.col("event_type") == "purchase", "Takeoff").when(F.col("event_type") == "signup", "Landing")
    pick = z.withColumn("name", names).where("name is not null").groupBy("rec", "name").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    marks = wn.marker_times(pick.select("rec", "name", F.when(F.col("name") == "Takeoff", F.col("a")).otherwise(F.col("b")).alias("t")))
    ends = rs.spans(s).select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    rows = wn.hop_windows(ends, GRIDS).join(marks, "rec", "left")
    ws, we, to, ld = (F.col(c) for c in ("ws", "we", "t_takeoff", "t_landing"))
    drop = wn.Zones(**{**ZONES.__dict__, "drop": True})
    return rows.select("rec", "grid", "k", wn.overlap_label(ws, we, to, ld, ZONES).alias("by_overlap"), wn.overlap_label(ws, we, to, ld, drop).alias("by_overlap_drop"), wn.anchor_label(we, (ws + we) / 2, to, ld, ZONES).alias("by_anchor"))


# -- recursive streams --------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {SIG},
r AS (SELECT rec, event_id, s, CASE WHEN event_id % 10 <> 3 THEN v END AS v, row_number() OVER (PARTITION BY rec ORDER BY s) AS i FROM z),
e AS (SELECT rec, event_id, i, v, v AS m, CASE WHEN v IS NOT NULL THEN 0::DOUBLE END AS q FROM r WHERE i = 1
  UNION ALL
  SELECT r.rec, r.event_id, r.i, r.v, CASE WHEN r.v IS NULL THEN m ELSE coalesce(0.2 * r.v + 0.8 * m, r.v) END,
    CASE WHEN r.v IS NULL THEN q ELSE coalesce(0.2 * power(r.v - coalesce(0.2 * r.v + 0.8 * m, r.v), 2) + 0.8 * q, 0) END
  FROM e JOIN r ON r.rec = e.rec AND r.i = e.i + 1)
SELECT rec, event_id, CASE WHEN v IS NOT NULL THEN round(m, 6) END AS ema, CASE WHEN v IS NOT NULL THEN round(q, 5) END AS var, CASE WHEN v IS NOT NULL THEN round((v - m) / sqrt(q + 1e-6), 5) END AS zscore FROM e""")
def recursive_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.zeroed(signal(spark, sf_dir)).select("rec", "event_id", "s", F.when(F.col("event_id") % 10 != 3, F.col("v")).alias("v"))
    rows = rs.ema_zscore(rs.ema_variance(rs.ema(rows, "v", 0.2, "ema"), "v", 0.2, "var"), "v", 0.2, "zscore")
    return rows.select("rec", "event_id", F.round("ema", 6).alias("ema"), F.round("var", 5).alias("var"), F.round("zscore", 5).alias("zscore"))


@query(f"""WITH RECURSIVE {SIG},
r AS (SELECT rec, event_id, s, v AS ax, (event_id % 7)::DOUBLE AS ay, 9.81::DOUBLE AS az, row_number() OVER (PARTITION BY rec ORDER BY s) AS i FROM z),
a AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS amag FROM r),
e AS (SELECT *, ax AS gx, ay AS gy, az AS gz, amag AS slow FROM a WHERE i = 1
  UNION ALL
  SELECT a.*, {GRAVITY}::DOUBLE * a.ax + (1 - {GRAVITY}::DOUBLE) * gx, {GRAVITY}::DOUBLE * a.ay + (1 - {GRAVITY}::DOUBLE) * gy, {GRAVITY}::DOUBLE * a.az + (1 - {GRAVITY}::DOUBLE) * gz, {SLOW}::DOUBLE * a.amag + (1 - {SLOW}::DOUBLE) * slow
  FROM e JOIN a ON a.rec = e.rec AND a.i = e.i + 1),
d AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS norm, (ax - gx) ** 2 + (ay - gy) ** 2 + (az - gz) ** 2 AS d2 FROM e),
u AS (SELECT *, CASE WHEN norm > 1e-8 THEN ((ax - gx) * gx + (ay - gy) * gy + (az - gz) * gz) / norm END AS avert FROM d)
SELECT rec, event_id, round(amag, 6) AS amag, round(amag - slow, 6) AS dyn, round(avert, 6) AS avert, round(sqrt(greatest(d2 - avert * avert, 0)), 4) AS ahoriz FROM u""")
def motion_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = rs.zeroed(signal(spark, sf_dir)).select("rec", "event_id", "s", F.col("v").alias("ax"), (F.col("event_id") % 7).cast("double").alias("ay"), F.lit(9.81).alias("az"))
    rows = rs.dynamic(rs.gravity_aligned(rs.magnitude(axes), 1.0), 1.0)
    return rows.select("rec", "event_id", *r6("amag", "dyn", "avert"), F.round("ahoriz", 4).alias("ahoriz"))


@query(f"""WITH RECURSIVE {SIG},
b AS (SELECT rec, event_id, s, 900 + v / 10 AS p, row_number() OVER (PARTITION BY rec ORDER BY s) AS i, first_value(900 + v / 10) OVER (PARTITION BY rec ORDER BY s) AS p0 FROM z),
h AS (SELECT *, 44330.0::DOUBLE * (1 - power(least(greatest(p / p0, 1e-6), 100.0), {1 / 5.255!r}::DOUBLE)) AS h FROM b),
d AS (SELECT *, h - lag(h) OVER (PARTITION BY rec ORDER BY i) AS d FROM h),
e AS (SELECT rec, event_id, i, p AS m, NULL::DOUBLE AS c FROM d WHERE i = 1
  UNION ALL
  SELECT d.rec, d.event_id, d.i, {TREND}::DOUBLE * d.p + (1 - {TREND}::DOUBLE) * m, coalesce({SLOW}::DOUBLE * d.d + (1 - {SLOW}::DOUBLE) * c, d.d) FROM e JOIN d ON d.rec = e.rec AND d.i = e.i + 1)
SELECT rec, event_id, round(c, 5) AS dhdt, round(m, 6) AS p_ema30, round(CASE WHEN i = 1 THEN lead(m) OVER q - m ELSE m - lag(m) OVER q END, 6) AS p_ema30_dt1 FROM e WINDOW q AS (PARTITION BY rec ORDER BY i)""")
def baro_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.zeroed(signal(spark, sf_dir)).select("rec", "event_id", "s", (900 + F.col("v") / 10).alias("p"))
    rows = rs.pressure_trend(rs.climb_rate(rows, 1.0), 1.0)
    return rows.select("rec", "event_id", F.round("dhdt", 5).alias("dhdt"), *r6("p_ema30", "p_ema30_dt1"))


@query(f"""WITH {SIG}, {WIN} SELECT rec, grid, k, CASE WHEN lag(we) OVER q IS NOT NULL THEN greatest(we - lag(we) OVER q, 0) END AS dt_prev_end_s, round(ln(1 + CASE WHEN lag(we) OVER q IS NOT NULL THEN greatest(we - lag(we) OVER q, 0) END), 6) AS log_dt_prev_end_s
FROM w WINDOW q AS (PARTITION BY rec, grid ORDER BY we, ws)""")
def window_end_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = rs.spans(signal(spark, sf_dir)).select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    rows = rs.end_gaps(wn.hop_windows(ends, GRIDS).withColumnsRenamed({"ws": "t_start", "we": "t_end"}), "rec")
    return rows.select("rec", "grid", "k", "dt_prev_end_s", *r6("log_dt_prev_end_s"))


# -- triggers and events ------------------------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {SIG}, {TRIG} SELECT rec, t FROM fired")
def trigger_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fired(spark, sf_dir)


@query(f"WITH {SIG}, {SEG} SELECT rec, start_idx, end_idx, t_ref, seg FROM seg")
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_segments(spark, sf_dir).select("rec", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), "t_ref", F.col("seg").cast("long").alias("seg"))


MATCHED = f"""d AS (SELECT seg.rec, seg, t_ref, fired.t, fired.t - t_ref AS d FROM seg LEFT JOIN fired USING (rec)),
matched AS (SELECT rec, seg, t_ref, arg_min(d, (abs(d), t)) AS delay_nearest, min(d) FILTER (WHERE d >= 0) AS delay_after, coalesce(max(abs(d) <= {HIT}), false) AS hit,
  coalesce(max(d >= 0 AND d <= {HIT}), false) AS hit_after, count(t) > 0 AS triggered FROM d GROUP BY rec, seg, t_ref)"""


@query(f"WITH RECURSIVE {SIG}, {TRIG}, {SEG}, {MATCHED} SELECT rec, seg, t_ref, round(delay_nearest, 3) AS delay_nearest, round(delay_after, 3) AS delay_after, hit, hit_after, triggered FROM matched")
def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.matches(error_segments(spark, sf_dir), fired(spark, sf_dir), HIT)
    return out.select("rec", F.col("seg").cast("long").alias("seg"), "t_ref", F.round("delay_nearest", 3).alias("delay_nearest"), F.round("delay_after", 3).alias("delay_after"), "hit", "hit_after", "triggered")


@query(f"""WITH RECURSIVE {SIG}, {TRIG}, {SEG}, {MATCHED}, h AS (SELECT *, CASE WHEN hit_after THEN delay_after END AS q FROM matched)
SELECT count(*) AS n_events, round(avg(hit::INT), 6) AS hit_rate, round(avg(hit_after::INT), 6) AS hit_after_rate, round(avg(q), 2) AS delay_mean, round(quantile_cont(q, 0.5), 2) AS delay_median,
  round(quantile_cont(q, 0.9), 2) AS delay_p90, round(quantile_cont(q, 0.95), 2) AS delay_p95, round(min(q), 2) AS delay_min, round(max(q), 2) AS delay_max FROM h""")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.rates(ev.matches(error_segments(spark, sf_dir), fired(spark, sf_dir), HIT))
    return out.select("n_events", *r6("hit_rate", "hit_after_rate"), *(F.round(c, 2).alias(c) for c in out.columns if c.startswith("delay")))


@query(f"""WITH {SIG}, {SEG},
c AS (SELECT *, sum((p < {THRESHOLD})::INT) OVER (PARTITION BY rec, island ORDER BY row) AS low FROM isl2),
c2 AS (SELECT *, sum((p >= {THRESHOLD})::INT) OVER (PARTITION BY rec, island, low ORDER BY row) AS streak FROM c),
f AS (SELECT rec, island, min(row) - 1 AS start_idx, min(t) FILTER (WHERE streak >= {K}) AS tf FROM c2 GROUP BY rec, island)
SELECT f.rec, f.start_idx, seg0.t_ref, round(tf - t_ref, 3) AS latency, coalesce(abs(tf - t_ref) <= {HIT}, false) AS hit FROM f JOIN seg0 USING (rec, island)""")
def event_in_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.in_segment(with_marker(signal(spark, sf_dir)), F.col("y") == 1, F.col("mk"), THRESHOLD, K, HIT)
    return out.select("rec", F.col("start_idx").cast("long").alias("start_idx"), "t_ref", F.round("latency", 3).alias("latency"), "hit")


@query(f"""WITH RECURSIVE {SIG}, {TRIG}, {QUIET}
SELECT (SELECT count(*) FROM fired SEMI JOIN h USING (rec)) AS n_triggers, round(sum(hours), 6) AS hours, round((SELECT count(*) FROM fired SEMI JOIN h USING (rec)) / sum(hours), 8) AS fp_per_hour FROM h""")
def false_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.per_hour(fired(spark, sf_dir), ev.hours(quiet(signal(spark, sf_dir))))
    return out.select("n_triggers", *r6("hours"), F.round("fp_per_hour", 8).alias("fp_per_hour"))


@query(f"""WITH RECURSIVE {SIG}, {TRIG}, {SEG}, {MATCHED},
u AS (SELECT draw, hit_after::INT AS h, ('0x' || substr(md5('42:' || draw || ':' || rec || ':' || seg), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u FROM matched, range(1, 201) AS r(draw)),
per AS (SELECT draw, sum(h * c) / nullif(sum(c), 0) AS r FROM (SELECT draw, h, {" + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in ev.poisson_steps())} AS c FROM u) GROUP BY draw)
SELECT round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM per""")
def hit_rate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bootstrap(ev.matches(error_segments(spark, sf_dir), fired(spark, sf_dir), HIT), 200).select(*r6("low", "high"))


# -- metrics and thresholds ---------------------------------------------------------------------------------------------
@query(f"WITH {SIG}, {CURVE} SELECT round(sum(pos / all_pos * pre), 6) AS pr_auc, round(sum((n - pos) * (tp - pos / 2)) / (max(all_pos) * (max(all_n) - max(all_pos))), 6) AS roc_auc FROM pr")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.average_precision(signal(spark, sf_dir)).select(*r6("pr_auc", "roc_auc"))


@query(f"""WITH {SIG}, c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM sig)
SELECT tp, fp, fn, tn, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall,
  round(5 * (tp / (tp + fp + 1e-12)) * (tp / (tp + fn + 1e-12)) / (4 * (tp / (tp + fp + 1e-12)) + tp / (tp + fn + 1e-12) + 1e-12), 6) AS fbeta FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(signal(spark, sf_dir), 0.5, 2.0).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "fbeta"))


@query(f"""WITH {SIG}, {CURVE}, f AS (SELECT p, lag(p) OVER (ORDER BY p) AS lower, 5 * pre * re / (4 * pre + re + 1e-10) AS f1, 5 * pre * re / greatest(4 * pre + re, 1e-12) AS f2 FROM pr),
whole AS (SELECT 0::DOUBLE AS p, 5 * avg(y) / (4 * avg(y) + 1) AS f FROM sig)
SELECT (SELECT p FROM f ORDER BY f1 DESC, p LIMIT 1) AS t_sum, (SELECT coalesce(lower, p) FROM f ORDER BY f2 DESC, coalesce(lower, p) LIMIT 1) AS t_before,
  (SELECT p FROM (SELECT p, f2 AS f FROM f UNION ALL SELECT * FROM whole) ORDER BY f DESC, p LIMIT 1) AS t_ends,
  (SELECT min(p) FROM pr WHERE re >= 0.8) AS t_recall, (SELECT max(p) FROM pr WHERE re >= 0.8) AS t_recall_best""")
def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    out = None
    for name, df in [*((f"t_{v}", ev.best_threshold(s, 2.0, v)) for v in ("sum", "before", "ends")), ("t_recall", ev.recall_threshold(s, 0.8)), ("t_recall_best", ev.recall_threshold(s, 0.8, True))]:
        df = df.select(F.col("threshold").alias(name))
        out = df if out is None else out.crossJoin(df)  # a row each
    return out


CUTS = ", ".join(str(i / 31) for i in range(32))


@query(f"""WITH {SIG}, q AS (SELECT unnest(quantile_cont(p, [{CUTS}])) AS t FROM sig UNION ALL SELECT i / 15 FROM range(16) AS r(i))
SELECT DISTINCT round(least(greatest(t, 0), 1), 9) AS threshold FROM q""")
def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.candidates(signal(spark, sf_dir), 32).select(F.round("threshold", 9).alias("threshold")).distinct()


@query(f"""WITH RECURSIVE {SIG}, {SEG}, {QUIET},
q AS (SELECT unnest(quantile_cont(p, [{CUTS}])) AS t FROM sig UNION ALL SELECT i / 15 FROM range(16) AS r(i)),
th AS (SELECT DISTINCT round(least(greatest(t, 0), 1), 9) AS th FROM q),
r AS (SELECT rec, t, p, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM (SELECT rec, t, max(p) AS p FROM sig GROUP BY rec, t)),
m AS (SELECT th, rec, i, t, CASE WHEN p >= th THEN 1 ELSE 0 END AS run, (-1e300)::DOUBLE AS last, false AS fired FROM r, th WHERE i = 1
  UNION ALL
  SELECT m.th, r.rec, r.i, r.t,
    CASE WHEN r.t - m.last < {COOLDOWN} OR r.p < m.th OR m.run + 1 >= {K} THEN 0 ELSE m.run + 1 END,
    CASE WHEN r.t - m.last >= {COOLDOWN} AND r.p >= m.th AND m.run + 1 >= {K} THEN r.t ELSE m.last END,
    r.t - m.last >= {COOLDOWN} AND r.p >= m.th AND m.run + 1 >= {K}
  FROM m JOIN r ON r.rec = m.rec AND r.i = m.i + 1),
wrong AS (SELECT th, count(*) AS n FROM m SEMI JOIN h USING (rec) WHERE fired GROUP BY th),
hits AS (SELECT th, count(DISTINCT (m.rec, seg)) AS hits FROM m JOIN seg ON seg.rec = m.rec AND m.t BETWEEN t_ref AND t_ref + {HIT} WHERE fired GROUP BY th),
per AS (SELECT th.th, coalesce(hits, 0) / (SELECT count(*) FROM seg) AS hit_after_rate, coalesce(n, 0) / (SELECT sum(hours) FROM h) AS fp_per_hour FROM th LEFT JOIN wrong USING (th) LEFT JOIN hits USING (th)),
best AS (SELECT arg_max(per, (round(hit_after_rate, 12), th)) AS b FROM per WHERE fp_per_hour <= 0.02)
SELECT coalesce(b.th, 1) AS threshold, round(b.hit_after_rate, 6) AS hit_after_rate, round(b.fp_per_hour, 8) AS fp_per_hour, b IS NULL AS fallback FROM best""")
def budget_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    options = ev.candidates(s, 32).select(F.round("threshold", 9).alias("threshold")).distinct()
    values = [r.threshold for r in options.collect()]  # 48 at most
    out = ev.budget_threshold(ev.sweep(s, values, K, COOLDOWN), options, ev.hours(quiet(s)), error_segments(spark, sf_dir), 0.02, HIT)
    return out.select("threshold", *r6("hit_after_rate"), F.round("fp_per_hour", 8).alias("fp_per_hour"), "fallback")


# -- feature tables -----------------------------------------------------------------------------------------------------
TAB = "tab AS (SELECT event_id, rec, t, y, p, event_type, CASE WHEN event_type <> 'view' THEN v END AS f1, CASE WHEN event_id % 3 > 0 THEN (event_id % 17)::DOUBLE END AS f2, 1::DOUBLE AS f3 FROM sig)"
FEATURES = ("f1", "f2", "f3")


def tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    f1, f2 = F.when(F.col("event_type") != "view", F.col("v")), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 17).cast("double"))
    return s.select("event_id", "rec", "t", "y", "p", "event_type", f1.alias("f1"), f2.alias("f2"), F.lit(1.0).alias("f3"))


@query(f"""WITH {SIG}, {TAB} SELECT event_id, (f1 IS NOT NULL)::DOUBLE AS has_a, (f2 IS NOT NULL)::DOUBLE AS has_b, round(((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT) / 2, 6) AS ab_coverage,
  coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, f3 FROM tab""")
def missing_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.missingness(tab(spark, sf_dir), FEATURES, {"a": ["f1"], "b": ["f2"]}, {"ab": ["f1", "f2"]})
    return out.select("event_id", "has_a", "has_b", *r6("ab_coverage"), *FEATURES)


@query(f"WITH {SIG}, {TAB} SELECT event_id, (f1 IS NULL)::INT AS m__f1, (f2 IS NULL)::INT AS m__f2 FROM tab")
def missing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.masks(tab(spark, sf_dir), FEATURES)
    return out.select("event_id", *(c for c in out.columns if c.startswith("m__")))


@query(f"""WITH {SIG}, {TAB}, u AS (UNPIVOT (SELECT event_type, f1, f2, f3 FROM tab) ON f1, f2, f3 INTO NAME feature VALUE x)
SELECT event_type, feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM u GROUP BY ALL""")
def scaler_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.fit_scaler(tab(spark, sf_dir), FEATURES, "event_type").where("mean is not null")
    return out.select("event_type", "feature", *r6("mean", "std"))


@query(f"""WITH {SIG}, {TAB}, a AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM tab)
SELECT event_id, round(coalesce((f1 - m1) / s1, 0), 6) AS f1, round(coalesce((f2 - m2) / s2, 0), 6) AS f2, 0::DOUBLE AS f3 FROM tab, a""")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tab(spark, sf_dir)
    return tb.scale(t, tb.fit_scaler(t, FEATURES), FEATURES, "mean", 1e-8).select("event_id", *r6(*FEATURES))


GROUPS = "gr AS (SELECT rec, round((max(t) - min(t)) / 3600, 6) AS hours, sum(y) AS positives, count(*) OVER () AS m FROM sig GROUP BY rec)"
PARTS = f"""{GROUPS}, parts AS (SELECT rec, CASE WHEN i < greatest(1, round_even(0.3 * m, 0)) THEN 'test' WHEN i < greatest(1, round_even(0.3 * m, 0)) + greatest(1, round_even(0.2 * m, 0)) THEN 'val' ELSE 'train' END AS part
  FROM (SELECT rec, m, row_number() OVER (ORDER BY hours DESC, rec) - 1 AS i FROM gr))"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).groupBy("rec").agg(F.round((F.max("t") - F.min("t")) / 3600, 6).alias("hours"), F.sum("y").alias("positives"))


@query(f"""WITH {SIG}, {TAB}, {PARTS}, a AS (SELECT quantile_cont(f1, 0.5) AS m1, quantile_cont(f2, 0.5) AS m2 FROM tab JOIN parts USING (rec) WHERE part = 'train')
SELECT event_id, round(coalesce(f1, m1), 6) AS f1, coalesce(f2, m2) AS f2 FROM tab, a""")
def median_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tab(spark, sf_dir)
    train = t.join(ln.split_groups(groups(spark, sf_dir)).where("part = 'train'"), "rec", "left_semi")
    return tb.impute(t, tb.fit_medians(train, tb.varying(t, FEATURES))).select("event_id", *r6("f1"), "f2")


@query(f"""WITH {SIG}, {TAB}, a AS (SELECT avg((f1 IS NULL)::INT) AS f1, avg((f2 IS NULL)::INT) AS f2, avg((f3 IS NULL)::INT) AS f3 FROM tab),
u AS (UNPIVOT a ON f1, f2, f3 INTO NAME feature VALUE share) SELECT feature, round(share, 6) AS share FROM u WHERE share > 0.05 ORDER BY share DESC LIMIT 10""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.missing_shares(tab(spark, sf_dir), FEATURES).select("feature", *r6("share"))


@query(f"WITH {SIG} SELECT count(DISTINCT rec) AS rec, count(DISTINCT event_type) AS event_type, count(DISTINCT p) AS p FROM sig")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.distinct_counts(signal(spark, sf_dir), "rec", "event_type", "p")


@query(f"WITH {SIG} SELECT event_type, count(v) AS n, round(quantile_cont(v, 0.1), 6) AS q10, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.99), 6) AS q99 FROM sig GROUP BY event_type")
def key_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tb.quantiles(signal(spark, sf_dir), "v", [0.1, 0.5, 0.99], "event_type")
    return out.select("event_type", "n", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q10", "q50", "q99"))))


@query(f"""WITH {SIG}, s AS (SELECT *, max((event_type = 'error' AND v > 100)::INT) OVER (PARTITION BY rec) = 0 AS q FROM z)
SELECT DISTINCT rec::VARCHAR AS stream_id, CASE WHEN q THEN rec::VARCHAR || '__nf' || lpad(floor(s / 604800)::BIGINT::VARCHAR, 4, '0') ELSE rec::VARCHAR END AS group_id FROM s""")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wn.streams(signal(spark, sf_dir), (F.col("event_type") == "error") & (F.col("v") > 100), 7 * DAY)
    return tb.groups_of(rows, "stream_id")


@query(f"WITH {SIG} SELECT event_type AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM sig GROUP BY event_type")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = signal(spark, sf_dir).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"WITH {SIG} SELECT round(least((count(*) - sum(y)) / sum(y), 3.5), 6) AS pos_weight FROM sig")
def positive_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.positive_weight(signal(spark, sf_dir), "y", 3.5).select(*r6("pos_weight"))


@query(f"""WITH {SIG}, mk AS (SELECT rec, min(s) AS tk FROM z WHERE event_type = 'purchase' GROUP BY rec),
q AS (SELECT event_id, y, CASE WHEN y = 0 THEN CASE WHEN coalesce(abs(s - tk), 1e9) <= 86400 THEN 1::DOUBLE WHEN coalesce(abs(s - tk), 1e9) <= 432000 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END END AS w FROM z LEFT JOIN mk USING (rec))
SELECT event_id, round(coalesce(w, greatest(sum(w) OVER () / greatest(sum(y) OVER (), 1), 1e-12)), 6) AS weight FROM q""")
def distance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rs.zeroed(signal(spark, sf_dir))
    marks = z.where("event_type = 'purchase'").groupBy("rec").agg(F.min("s").alias("tk"))
    rows = z.join(marks, "rec", "left").withColumn("dist", F.col("s") - F.col("tk"))
    return tb.distance_weights(rows, "y", "dist", DAY, 5 * DAY, 0.5, 0.1).select("event_id", *r6("weight"))


DRAW = "(('0x' || substr(md5('42:' || event_id), 1, 12))::BIGINT::DOUBLE / 281474976710656)"


@query(f"WITH {SIG}, n AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY {DRAW}, event_id) AS i, (SELECT 2 * sum(y) FROM sig) AS k FROM sig) SELECT event_id, y FROM n WHERE y = 1 OR i <= k")
def undersampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.undersample(signal(spark, sf_dir), "y", 2, "event_id").select("event_id", "y")


@query(f"WITH {SIG} SELECT event_id FROM sig WHERE {DRAW} < 0.3")
def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.keep(signal(spark, sf_dir), 0.3, "event_id").select("event_id")


@query(f"WITH {SIG} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY rec ORDER BY t, event_id) - 1 AS i FROM sig) WHERE i % 3 = 0")
def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.thin(signal(spark, sf_dir), 3, "rec", "t", "event_id").select("event_id")


@query(f"WITH {SIG} SELECT event_id, unnest(range(1, CASE WHEN y = 1 THEN 4 ELSE 2 END))::INT AS copy FROM sig")
def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.oversample(signal(spark, sf_dir), "y", 3).select("event_id", "copy")


# -- sequences, sessions, splits ----------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, g AS (SELECT *, t - lag(t) OVER q AS gap, row_number() OVER q - 1 AS i, lag(event_type, 2) OVER q AS lb, lag(t, 2) OVER q AS tl FROM sig WINDOW q AS (PARTITION BY rec ORDER BY t)),
l AS (SELECT rec, 2.5 * coalesce(quantile_cont(gap, 0.5), 60) AS lim FROM g GROUP BY rec),
r AS (SELECT *, max(gap) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS widest FROM g)
SELECT rec, i - 4 AS start, t AS t_detect, tl AS t_label, lb AS label FROM r JOIN l USING (rec) WHERE i >= 4 AND widest <= lim""")
def window_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir).select("rec", F.col("t").alias("t_detect"), F.col("t").alias("t_label"), F.col("event_type").alias("label"))
    return wn.sequences(rows, 5, 0, "rec").select("rec", F.col("start").cast("long").alias("start"), "t_detect", "t_label", "label")


@query(f"""WITH {SIG}, d AS (SELECT t - lag(t, 2) OVER (PARTITION BY rec ORDER BY t) AS d FROM sig) SELECT count(d) AS n, round(avg(d), 2) AS mean, round(quantile_cont(d, 0.5), 2) AS median,
  round(quantile_cont(d, 0.9), 2) AS p90, round(quantile_cont(d, 0.95), 2) AS p95, round(min(d), 2) AS min, round(max(d), 2) AS max FROM d""")
def timing_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rec").orderBy("t")
    out = ev.delays(signal(spark, sf_dir).select(F.col("t").alias("t_detect"), F.lag("t", 2).over(w).alias("t_label")))
    return out.select("n", *(F.round(c, 2).alias(c) for c in out.columns[1:]))


@query(f"WITH {SIG}, j AS (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY rec ORDER BY s) > 36000)::INT, 0) AS j FROM z) SELECT event_id, (sum(j) OVER (PARTITION BY rec ORDER BY s))::BIGINT AS session FROM j")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.sessions(rs.zeroed(signal(spark, sf_dir)), 10 * HOUR).select("event_id", "session")


@query(f"""WITH {SIG}, i AS (SELECT rec, v, row_number() OVER (PARTITION BY rec ORDER BY t) AS row FROM sig), f AS (SELECT rec, row - row_number() OVER (PARTITION BY rec ORDER BY row) AS island FROM i WHERE v > 50),
l AS (SELECT rec, max(n) / 2 AS seconds FROM (SELECT rec, island, count(*) AS n FROM f GROUP BY ALL) GROUP BY rec) SELECT DISTINCT sig.rec, coalesce(seconds, 0)::DOUBLE AS seconds FROM sig LEFT JOIN l USING (rec)""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.longest_run(signal(spark, sf_dir), F.col("v") > 50, ["t"], 2.0)


@query(f"""WITH {SIG}, c AS (SELECT rec, span, greatest(1, ceil(span / 604800))::BIGINT AS n FROM spans), i AS (SELECT *, unnest(range(n)) AS i FROM c)
SELECT rec, CASE WHEN n > 1 THEN printf('%s#chunk%04d', rec::VARCHAR, i) ELSE rec::VARCHAR END AS chunk, i * 604800::DOUBLE AS start, round(least(span, (i + 1) * 604800), 6) AS stop FROM i""")
def recording_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = rs.spans(signal(spark, sf_dir)).select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    return wn.chunks(ends, 7 * DAY).select("rec", "chunk", "start", *r6("stop"))


@query(f"""WITH {SIG}, s AS (SELECT *, max((event_type = 'error' AND v > 100)::INT) OVER (PARTITION BY rec) = 0 AS q FROM z)
SELECT event_id, rec::VARCHAR AS stream_id, q AS is_nonflight, CASE WHEN q THEN rec::VARCHAR || '__nf' || lpad(floor(s / 604800)::BIGINT::VARCHAR, 4, '0') ELSE rec::VARCHAR END AS group_id FROM s""")
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal(spark, sf_dir)
    return wn.streams(rows, (F.col("event_type") == "error") & (F.col("v") > 100), 7 * DAY).select("event_id", "stream_id", "is_nonflight", "group_id")


@query(f"WITH {SIG}, {PARTS} SELECT rec, part FROM parts")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.split_groups(groups(spark, sf_dir))


@query(f"""WITH {SIG}, {GROUPS}, i AS (SELECT rec, row_number() OVER (ORDER BY positives DESC, rec) - 1 AS i FROM gr)
SELECT rec, (CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END)::INT AS fold FROM i""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.fold_groups(groups(spark, sf_dir))


# -- models -------------------------------------------------------------------------------------------------------------
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return s.select("event_id", "rec", "y", "v", F.pmod("t", F.lit(DAY)).alias("hour"), (F.col("event_id") % 11).cast("double").alias("noise")).join(ln.fold_groups(groups(spark, sf_dir)), "rec")


@query()
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ("v", "hour", "noise")
    rows = samples(spark, sf_dir)
    model = ln.forest(rows.where("fold > 0"), x, trees=10, depth=4)
    return ln.score(model, rows.where("fold = 0")).select("event_id", "y", "p")


@query()
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ("v", "hour", "noise")
    rows = samples(spark, sf_dir)
    model = ln.boosted(rows.where("fold > 0"), x, trees=5, depth=3)
    return ln.score(model, rows.where("fold = 0")).select("event_id", "y", "p")


@query()
def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small sequence model fitted on part of the recordings, and its scores for the others."""
    rows = signal(spark, sf_dir).select("rec", F.col("t").alias("t_detect"), F.col("t").alias("t_label"), F.col("event_type").alias("label"), "v", (F.col("event_id") % 11).cast("double").alias("noise"))
    seqs = wn.sequences(rows, 4, 1, "rec", ["v", "noise"]).withColumns({"y_takeoff": (F.col("label") == "error").cast("int"), "y_landing": (F.col("label") == "signup").cast("int"), "quiet": F.lit(False), "key": F.concat_ws(":", "rec", "start")})
    seqs = stash(seqs.join(ln.split_groups(groups(spark, sf_dir)), "rec"), "sequences")
    cfg = rc.Training(hidden=8, layers=1, head=8, epochs=2, workers=4)
    weights, _ = rc.fit_gru(seqs.where("part = 'train'"), seqs.where("part = 'val'"), ["y_takeoff", "y_landing"], "key", "quiet", cfg=cfg)
    return ln.gru_scores(seqs.where("part = 'test'"), weights).select("rec", "start", "y_takeoff", "y_landing", F.col("p")[0].alias("p_takeoff"), F.col("p")[1].alias("p_landing"))


# -- ingest -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {SIG}, d AS (SELECT rec, s / 52000 * CASE rec % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END AS ts FROM z),
m AS (SELECT rec, quantile_cont(d, 0.5) AS step FROM (SELECT rec, ts - lag(ts) OVER (PARTITION BY rec ORDER BY ts) AS d FROM d) WHERE d > 0 GROUP BY rec)
SELECT rec, CASE WHEN 1 / step BETWEEN 0.5 AND 200 THEN 's' WHEN 1e3 / step BETWEEN 0.5 AND 200 THEN 'ms' WHEN 1e6 / step BETWEEN 0.5 AND 200 THEN 'us' WHEN 1e9 / step BETWEEN 0.5 AND 200 THEN 'ns' END AS unit FROM m""")
def time_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.element_at(F.array(*(F.lit(x) for x in (1.0, 1e3, 1e6, 1e9))), (F.col("rec") % 4 + 1).cast("int"))
    rows = rs.zeroed(signal(spark, sf_dir)).select("rec", F.lit("accel").alias("kind"), (F.col("s") / 52000 * scale).alias("ts"), "event_id")
    ordered = rows.select("rec", "kind", "ts", F.col("ts").alias("line"))
    return rec.units(ordered)


@query("""SELECT user_id AS rec, event_id AS line, CASE event_type WHEN 'purchase' THEN 'marker' WHEN 'view' THEN 'baro' ELSE 'accel' END AS kind, CASE event_type WHEN 'purchase' THEN 'Takeoff' END AS name,
  floor(epoch_us(ts) / 1000)::DOUBLE AS ts, CASE WHEN event_type <> 'purchase' THEN value END AS x, CASE event_type WHEN 'click' THEN event_id::DOUBLE END AS y, CASE event_type WHEN 'click' THEN 1.5::DOUBLE END AS z
FROM events WHERE event_type IN ('purchase', 'view', 'click')""")
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms, v, kind = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string"), F.col("value").cast("string"), F.col("event_type")
    line = F.when(kind == "purchase", F.concat(F.lit(" Takeoff;"), ms)).when(kind == "view", F.concat(ms, F.lit(":"), v)).when(kind == "click", F.concat(ms, F.lit(":"), v, F.lit(":"), F.col("event_id").cast("string"), F.lit(":1.5 ")))
    line = line.when(kind == "signup", F.concat(ms, F.lit(":1.0d"))).otherwise(F.lit("MER data 1:2"))
    return rec.parse_text(rows.select(F.col("user_id").alias("rec"), F.col("event_id").alias("line"), line.alias("text")))


def digits(c: str) -> int:
    """Digits of a feature that double precision gives: few of quotients by almost 0, half of roots of differences."""
    return 1 if c in ("ground_vs_air_ratio", "vibration_vs_static_ratio") else 3 if "ahoriz" in c else 5


def scaled_round(c: str, n: int) -> Column:
    """A double to n digits as DuckDB rounds it: the nearest whole number of the scaled value, halves away from zero."""
    return F.round(F.col(c) * 10.0**n) / 10.0**n


def _moments_sql(c: str, name: str, *kinds: str) -> list[str]:
    every = {
        "mean": f"avg({c})", "std": f"stddev_pop({c})", "min": f"min({c})", "max": f"max({c})", "median": f"quantile_cont({c}, 0.5)", "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
        "rms": f"sqrt(avg({c} * {c}))", "range": f"max({c}) - min({c})", "maxabs": f"max(abs({c}))",
        "skew": f"CASE WHEN count({c}) >= 3 AND any_value(sd_{c}) > 0 THEN avg(power({c} - mu_{c}, 3)) / power(any_value(sd_{c}), 3) END",
        "kurt": f"CASE WHEN count({c}) >= 4 AND any_value(sd_{c}) > 0 THEN avg(power({c} - mu_{c}, 4)) / power(any_value(sd_{c}), 4) - 3 END",
    }
    return [f"{every[k]} AS {name}_{k}" for k in kinds]


def _order_sql(c: str, name: str, hz: int, *kinds: str) -> list[str]:
    """Features that depend on a value's place i_<c> among the window's n_<c> present ones; a number after the kind is of seconds."""
    i, n = f"i_{c}", f"n_{c}"
    out = []
    for kind in kinds:
        base, _, sec = kind.rpartition("_") if kind.endswith("s") and kind[-2].isdigit() else (kind, "", "2s")
        last = lambda least: f"FILTER (WHERE {i} >= {n} - {max(least, int(sec[:-1]) * hz)})"  # noqa: B023, E731
        half = lambda a, b, least: f"CASE WHEN max({n}) >= {least} THEN avg({c}) FILTER (WHERE {i} >= {a}) - avg({c}) FILTER (WHERE {i} < {b}) END"  # noqa: B023, E731
        std = f"CASE WHEN count({c}) {last(3)} >= 2 THEN stddev_pop({c}) {last(3)} END"
        out.append({
            "halfdiff": half(f"floor({n} / 2)", f"floor({n} / 2)", 4), "thirddiff": half(f"floor(2 * {n} / 3)", f"floor({n} / 3)", 6), "recent_diff_25pct": half(f"floor({n} * 0.75)", f"floor({n} * 0.75)", 4),
            "peakcount": f"coalesce(sum((abs({c} - mu_{c}) > 2 * sd_{c})::INT), 0)::DOUBLE", "recent_slope": f"CASE WHEN count({c}) {last(3)} >= 3 THEN regr_slope({c}, ({i} - {n}) / {hz}) {last(3)} END",
            "recent_std": std, "recent_mean": f"avg({c}) {last(1)}", "recent_max_abs": f"max(abs({c})) {last(1)}",
            "ratio_recent_std": f"CASE WHEN max({n}) >= 4 AND stddev_pop({c}) >= 1e-6 THEN least(({std}) / stddev_pop({c}), 100) END",
        }[base] + f" AS {name}_{kind}")
    return out


def _placed_sql(*columns: str) -> str:
    return ", ".join(f"avg({c}) OVER q AS mu_{c}, stddev_pop({c}) OVER q AS sd_{c}, count({c}) OVER q AS n_{c}, count({c}) OVER (q ORDER BY s ROWS UNBOUNDED PRECEDING) - 1 AS i_{c}" for c in columns)


def _spectrum_sql(c: str, bands, at: str) -> str:
    """CTE ``f_<c>``: relative power of the bands, and the spectrum's shape above 0.1 Hz, of windows of 16 present values or more."""
    low = ", ".join(f"coalesce(sum(p) FILTER (WHERE hz >= {a} AND hz < {b}), 0) AS b{k}" for k, (a, b) in enumerate(bands))
    return f"""y_{c} AS (SELECT rec, grid, k, i_{c} AS i, n_{c} AS n, ({c} - mu_{c}) * (0.5 - 0.5 * cos(2 * pi() * i_{c} / (n_{c} - 1))) AS y FROM {at} WHERE n_{c} >= 16),
p_{c} AS (SELECT rec, grid, k, f, f * (1 / (n * 0.125::DOUBLE)) AS hz, sum(y * cos(2 * pi() * f * i / n)) ** 2 + sum(y * sin(2 * pi() * f * i / n)) ** 2 AS p FROM (SELECT *, unnest(range(n // 2 + 1)) AS f FROM y_{c}) GROUP BY ALL),
m_{c} AS (SELECT rec, grid, k, sum(p) AS total, {low}, arg_max(hz, p) FILTER (WHERE hz >= 0.1) AS dominant, sum(p) FILTER (WHERE hz >= 0.1) AS high, sum(hz * p) FILTER (WHERE hz >= 0.1) / sum(p) FILTER (WHERE hz >= 0.1) AS centre FROM p_{c} GROUP BY rec, grid, k),
f_{c} AS (SELECT m.*, sqrt((SELECT sum((p.hz - m.centre) ** 2 * p.p) FROM p_{c} p WHERE p.rec = m.rec AND p.grid = m.grid AND p.k = m.k AND p.hz >= 0.1) / high) AS width FROM m_{c} m)"""


def _average(new: str, old: str, tau: float, hz: float) -> str:
    a = rs.alpha(tau, hz)
    return f"{a!r}::DOUBLE * {new} + {1 - a!r}::DOUBLE * {old}"


def sensor_sql() -> str:
    """The feature table of :func:`sensor_features`."""
    ten = ("mean", "std", "min", "max", "median", "iqr", "rms", "range", "skew", "kurt")
    accel = [x for c in ("ax", "ay", "az", "amag") for x in _moments_sql(c, c, *ten)]
    accel += _order_sql("amag", "amag", 8, "halfdiff", "thirddiff", "recent_diff_25pct", "peakcount", "recent_slope_2s", "recent_slope_3s", "recent_std_2s", "recent_mean_2s", "recent_max_abs_2s", "ratio_recent_std")
    accel += ["avg(abs(jerk)) AS jerk_mean", *_moments_sql("jerk", "jerk", "std", "rms"), *_order_sql("jerk", "jerk", 8, "recent_std_2s", "recent_max_abs_2s")]
    accel += _moments_sql("dyn", "dyn", "mean", "std", "rms", "max", "range", "skew", "kurt") + _order_sql("dyn", "dyn", 8, "halfdiff", "thirddiff", "recent_diff_25pct", "peakcount", "recent_slope_2s", "recent_std_2s", "recent_max_abs_2s", "ratio_recent_std")
    for c in ("avert", "ahoriz"):
        accel += _moments_sql(c, c, "mean", "std", "rms") + _order_sql(c, c, 8, "peakcount", "recent_slope_2s", "recent_std_2s")
    accel += _moments_sql("e10", "amag_ema10", "mean", "std", "range") + _order_sql("e10", "amag_ema10", 8, "thirddiff") + _moments_sql("v10", "amag_emaVar10", "mean", "iqr")
    baro = _moments_sql("p", "p", "mean", "std", "min", "max", "median", "iqr", "range", "skew", "kurt")
    first = "max(dpdt) FILTER (WHERE i_p = 1)"
    baro += [f"(sum(dpdt) + {first}) / (count(dpdt) + 1) AS dpdt_mean", f"sqrt(greatest((sum(dpdt * dpdt) + {first} * {first}) / (count(dpdt) + 1) - power((sum(dpdt) + {first}) / (count(dpdt) + 1), 2), 0)) AS dpdt_std"]
    slope = lambda c: f"CASE WHEN count({c}) >= 2 THEN regr_slope({c}, s) END AS {'p_slope' if c == 'p' else 'p_ema30_slope'}"
    baro += [slope("p"), *_order_sql("p", "p", 4, "recent_diff_25pct", "recent_slope_3s", "recent_slope_5s", "recent_std_3s"), *_moments_sql("p30", "p_ema30", "mean", "std"), slope("p30")]
    baro += [*_moments_sql("dp30", "p_ema30_dt1", "mean", "std"), "avg((dp30 > 0)::INT) AS p_ema30_dt1_posfrac"]
    rate = _moments_sql("dhdt", "dhdt", "mean", "std", "maxabs") + _order_sql("dhdt", "dhdt", 4, "recent_mean_2s", "recent_mean_3s", "recent_slope_3s", "recent_std_3s", "recent_max_abs_2s")
    rate += ["avg((abs(dhdt) < 0.3)::INT) AS plateau_frac", "coalesce(sum((sg * before < 0)::INT), 0) / (max(n_dhdt) / 4) AS dhdt_zcr_ps"]
    names = lambda made: [x.rsplit(" AS ", 1)[1] for x in made]
    baro += [f"CASE WHEN count(dhdt) >= 2 THEN {x.rsplit(' AS ', 1)[0]} END AS {n}" for x, n in zip(rate, names(rate))]
    bands = lambda c, pre, of: [f"CASE WHEN f_{c}.total > 0 THEN f_{c}.b{k} / f_{c}.total END AS {pre}pow_{a:.1f}_{b:.1f}".replace(".0 ", "p0 ").replace(f"{a:.1f}_{b:.1f}", f"{a:.1f}_{b:.1f}".replace(".", "p")) for k, (a, b) in enumerate(of)]
    spectra = [*bands("amag", "", ft.BANDS), *bands("dyn", "dyn_", ft.DYN_BANDS)]
    spectra += [f"CASE WHEN f_{c}.high > 0 THEN f_{c}.{x} END AS {n}" for c, x, n in (("amag", "dominant", "amag_dominant_freq"), ("amag", "centre", "amag_spectral_centroid"), ("amag", "width", "amag_spectral_bandwidth"), ("dyn", "dominant", "dyn_dominant_freq"), ("dyn", "centre", "dyn_spectral_centroid"))]
    over = lambda a, b: f"CASE WHEN n_amag >= 16 AND {a} + {b} > 1e-9 THEN ({a}) / ({b} + 1e-9) END"
    part = lambda a, b: f"CASE WHEN {b} >= 1e-9 THEN least(greatest({a} / {b}, 0), 100) END"
    of = lambda c: f"coalesce({c}, 0)"
    more = [
        "CASE WHEN ahoriz_rms > 1e-6 THEN least(greatest(avert_rms / ahoriz_rms, 0), 100) END AS avert_to_ahoriz_ratio",
        over(f"{of('pow_8p0_15p0')} + {of('pow_3p0_8p0')}", f"{of('pow_0p0_0p3')} + {of('pow_0p3_1p0')}") + " AS ground_vs_air_ratio", over(of("pow_3p0_8p0"), of("pow_0p0_0p3")) + " AS vibration_vs_static_ratio",
        part("pow_1p0_3p0", "pow_0p3_1p0") + " AS amag_ratio_1_3__0p3_1", part("dyn_pow_2p0_5p0", "dyn_pow_0p5_2p0") + " AS dyn_ratio_2_5__0p5_2",
    ]
    runs = ["longest_up / 4 AS runlen_climb_s", "longest_down / 4 AS runlen_descent_s"]
    found = names(accel) + names(spectra) + names(more) + names(baro) + names(runs)
    share = lambda heads: "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in found if c.startswith(heads)) + f") / {sum(c.startswith(heads) for c in found)}"
    filled = [f"round(coalesce({c}, 0), {digits(c)}) AS {c}" for c in found]
    return f"""WITH RECURSIVE {SIG},
r AS (SELECT rec, t / 288000 AS t, avg(v * pi()) AS ax, avg((event_id % 7)::DOUBLE) AS ay, avg(9.75::DOUBLE) AS az, avg(900 + v * pi() / 31) AS p FROM sig GROUP BY rec, sig.t),
edge AS (SELECT rec, min(t) AS a, max(t) AS z FROM r GROUP BY rec),
ba AS (SELECT rec, least(floor((t - a) / 0.125::DOUBLE), ceil((z - a + 0.0625::DOUBLE) / 0.125::DOUBLE) - 1)::BIGINT AS bin, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az FROM r JOIN edge USING (rec) GROUP BY ALL),
bb AS (SELECT rec, least(floor((t - a) / 0.25::DOUBLE), ceil((z - a + 0.125::DOUBLE) / 0.25::DOUBLE) - 1)::BIGINT AS bin, avg(p) AS p FROM r JOIN edge USING (rec) GROUP BY ALL),
ga AS (SELECT g.rec, g.bin, ax, ay, az, sqrt(ax * ax + ay * ay + az * az) AS m FROM (SELECT rec, unnest(range(ceil((z - a + 0.0625::DOUBLE) / 0.125::DOUBLE)::BIGINT)) AS bin FROM edge) g LEFT JOIN ba ON ba.rec = g.rec AND ba.bin = g.bin),
gb AS (SELECT g.rec, g.bin, p FROM (SELECT rec, unnest(range(ceil((z - a + 0.125::DOUBLE) / 0.25::DOUBLE)::BIGINT)) AS bin FROM edge) g LEFT JOIN bb ON bb.rec = g.rec AND bb.bin = g.bin),
ea AS (SELECT rec, bin, ax, ay, az, m, ax AS gx, ay AS gy, az AS gz, m AS slow, m AS e10, 0::DOUBLE AS v10 FROM ga WHERE bin = 0
  UNION ALL
  SELECT g.rec, g.bin, g.ax, g.ay, g.az, g.m, {', '.join(f"coalesce({_average(f'g.a{x}', f'e.g{x}', 0.6, 8)}, e.g{x})" for x in 'xyz')}, coalesce({_average('g.m', 'e.slow', 2, 8)}, e.slow), coalesce({_average('g.m', 'e.e10', 10, 8)}, e.e10),
    coalesce({_average(f"power(g.m - ({_average('g.m', 'e.e10', 10, 8)}), 2)", 'e.v10', 10, 8)}, e.v10)
  FROM ea e JOIN ga g ON g.rec = e.rec AND g.bin = e.bin + 1),
na AS (SELECT *, bin * 0.125::DOUBLE AS s, m AS amag, m - slow AS dyn, ((ax - gx) * gx + (ay - gy) * gy + (az - gz) * gz) / sqrt(gx * gx + gy * gy + gz * gz) AS avert FROM ea),
la AS (SELECT *, sqrt(greatest((ax - gx) ** 2 + (ay - gy) ** 2 + (az - gz) ** 2 - avert ** 2, 0)) AS ahoriz FROM na),
hb AS (SELECT *, 44330.0::DOUBLE * (1 - power(least(greatest(p / first_value(p) OVER (PARTITION BY rec ORDER BY bin), 1e-6), 100.0), {1 / 5.255!r}::DOUBLE)) AS h FROM gb),
db AS (SELECT *, (h - lag(h) OVER (PARTITION BY rec ORDER BY bin)) * 4 AS d FROM hb),
eb AS (SELECT rec, bin, p, d, p AS p30, NULL::DOUBLE AS c FROM db WHERE bin = 0
  UNION ALL
  SELECT g.rec, g.bin, g.p, g.d, coalesce({_average('g.p', 'e.p30', 30, 4)}, e.p30), coalesce({_average('g.d', 'e.c', 2, 4)}, e.c, g.d) FROM eb e JOIN db g ON g.rec = e.rec AND g.bin = e.bin + 1),
ob AS (SELECT rec, bin, bin * 0.25::DOUBLE AS s, p, CASE WHEN d IS NOT NULL THEN c END AS dhdt, CASE WHEN p IS NOT NULL THEN p30 END AS p30 FROM eb),
lb AS (SELECT *, CASE WHEN bin = 0 THEN lead(p30) OVER q - p30 ELSE p30 - lag(p30) OVER q END AS dp30 FROM ob WINDOW q AS (PARTITION BY rec ORDER BY bin)),
grids(grid, grid_id, win, hop) AS (VALUES ('base', 0, 4::DOUBLE, 4::DOUBLE), ('to', 1, 6::DOUBLE, 3::DOUBLE)),
w AS (SELECT rec, grid, grid_id, win, hop, k, k * hop AS ws, k * hop + win AS we FROM (SELECT rec, grid, grid_id, win, hop, unnest(range(floor((z - a - win + 1e-9) / hop)::BIGINT + 1)) AS k FROM edge, grids WHERE z - a >= win - 1e-9)),
wa AS (SELECT w.rec, w.grid, w.k, la.* EXCLUDE (rec) FROM w JOIN la ON la.rec = w.rec AND s BETWEEN ws AND we),
wb AS (SELECT w.rec, w.grid, w.k, lb.* EXCLUDE (rec) FROM w JOIN lb ON lb.rec = w.rec AND s BETWEEN ws AND we),
kept AS (SELECT w.*, ca, cb FROM w JOIN (SELECT rec, grid, k, avg((m IS NOT NULL)::INT) AS ca FROM wa GROUP BY ALL) USING (rec, grid, k) JOIN (SELECT rec, grid, k, avg((p IS NOT NULL)::INT) AS cb FROM wb GROUP BY ALL) USING (rec, grid, k) WHERE ca >= 0.3 AND cb >= 0.3),
ja AS (SELECT *, (amag - lag(amag) OVER (PARTITION BY rec, grid, k ORDER BY s)) * 8 AS jerk FROM wa WHERE m IS NOT NULL),
xa AS (SELECT *, {_placed_sql('ax', 'ay', 'az', 'amag', 'jerk', 'dyn', 'avert', 'ahoriz', 'e10', 'v10')} FROM ja WINDOW q AS (PARTITION BY rec, grid, k)),
jb AS (SELECT *, (p - lag(p IGNORE NULLS) OVER o) * 4 AS dpdt, CASE WHEN dhdt > 0.05 THEN 1 WHEN dhdt < -0.05 THEN -1 WHEN dhdt IS NOT NULL THEN 0 END AS sg,
  sum((coalesce(dhdt, 0) <= 0.2)::INT) OVER o AS up, sum((coalesce(dhdt, 0) >= -0.2)::INT) OVER o AS down FROM wb WINDOW o AS (PARTITION BY rec, grid, k ORDER BY s)),
xb AS (SELECT *, lag(sg IGNORE NULLS) OVER (PARTITION BY rec, grid, k ORDER BY s) AS before, {_placed_sql('p', 'dhdt')} FROM jb WINDOW q AS (PARTITION BY rec, grid, k)),
ru AS (SELECT rec, grid, k, max(n) AS longest_up FROM (SELECT rec, grid, k, count(*) FILTER (WHERE coalesce(dhdt, 0) > 0.2) AS n FROM xb GROUP BY rec, grid, k, up) GROUP BY ALL),
rd AS (SELECT rec, grid, k, max(n) AS longest_down FROM (SELECT rec, grid, k, count(*) FILTER (WHERE coalesce(dhdt, 0) < -0.2) AS n FROM xb GROUP BY rec, grid, k, down) GROUP BY ALL),
fa AS (SELECT rec, grid, k, any_value(n_amag) AS n_amag, {', '.join(accel)} FROM xa GROUP BY rec, grid, k),
fb AS (SELECT rec, grid, k, count(dhdt) AS n_dhdt, {', '.join(baro)} FROM xb GROUP BY rec, grid, k),
{_spectrum_sql('amag', ft.BANDS, 'xa')}, {_spectrum_sql('dyn', ft.DYN_BANDS, 'xa')},
s0 AS (SELECT kept.rec AS rec, kept.grid AS grid, kept.k AS k, {', '.join(spectra)} FROM kept LEFT JOIN f_amag ON f_amag.rec = kept.rec AND f_amag.grid = kept.grid AND f_amag.k = kept.k LEFT JOIN f_dyn ON f_dyn.rec = kept.rec AND f_dyn.grid = kept.grid AND f_dyn.k = kept.k),
f0 AS (SELECT kept.*, a AS t0, ws + a AS t_start, we + a AS t_end, first = 'signup' AS quiet, mk, fa.* EXCLUDE (rec, grid, k), fb.* EXCLUDE (rec, grid, k), s0.* EXCLUDE (rec, grid, k),
    CASE WHEN n_dhdt >= 2 THEN longest_up END AS longest_up, CASE WHEN n_dhdt >= 2 THEN longest_down END AS longest_down
  FROM kept JOIN edge USING (rec) JOIN opens USING (rec) LEFT JOIN (SELECT rec, min(t / 288000) AS mk FROM sig WHERE event_type = 'purchase' GROUP BY rec) USING (rec)
  LEFT JOIN fa USING (rec, grid, k) LEFT JOIN fb USING (rec, grid, k) LEFT JOIN ru USING (rec, grid, k) LEFT JOIN rd USING (rec, grid, k) LEFT JOIN s0 USING (rec, grid, k)),
f1 AS (SELECT *, coalesce(greatest(t_end - lag(t_end) OVER (PARTITION BY rec, grid ORDER BY t_end), 0), 0) AS gap, CASE WHEN NOT quiet THEN abs(t_end - mk) END AS far, {', '.join(more + runs)} FROM f0)
SELECT rec, grid, grid_id, k, round(ca, 5) AS accel_obs_coverage, round(cb, 5) AS baro_obs_coverage, round(mk, 5) AS t_takeoff, NULL::DOUBLE AS t_landing,
  CASE WHEN quiet THEN 'NONFLIGHT' WHEN t_end BETWEEN mk - 1 AND mk + 3 THEN 'TAKEOFF' ELSE 'OTHER' END AS label, round(t_start, 5) AS t_start, round(t_end, 5) AS t_end, round((t_start + t_end) / 2, 5) AS t_center, round(t_end, 5) AS t_anchor,
  round(far, 5) AS dist_to_takeoff, NULL::DOUBLE AS dist_to_landing, round(far, 5) AS dist_to_event, CASE WHEN quiet THEN 'nonflight' ELSE 'flight' END AS domain, win AS win_s, hop AS hop_s,
  round(gap, 5) AS dt_prev_end_s, round(ln(1 + gap), 5) AS log_dt_prev_end_s, round(ln(1 + win), 5) AS log_win_s, rec::VARCHAR AS file, rec::VARCHAR AS file_id,
  (amag_mean IS NOT NULL)::INT::DOUBLE AS has_accel, (p_mean IS NOT NULL)::INT::DOUBLE AS has_baro, (pow_0p0_0p3 IS NOT NULL OR amag_dominant_freq IS NOT NULL)::INT::DOUBLE AS has_spectral, (dyn_mean IS NOT NULL)::INT::DOUBLE AS has_dyn,
  round({share(('ax_', 'ay_', 'az_', 'amag_'))}, 5) AS accel_coverage, round({share(('p_', 'dhdt_'))}, 5) AS baro_coverage, {', '.join(filled)} FROM f1"""


@query(sensor_sql())
def sensor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full feature table without filling, 80 hours of the events taken as a second of a sensor; features to 5 digits.

    Times pi, no value of ax and p is half of the last digit; those of ay may be, so rounding scales first, as in the SQL.
    """
    from loomspark.plans import sensors

    s = signal(spark, sf_dir).withColumn("t", F.col("t") / (80 * HOUR))
    accel = s.select("rec", "t", (F.col("v") * F.pi()).alias("ax"), (F.col("event_id") % 7).cast("double").alias("ay"), F.lit(9.75).alias("az"))
    marks = s.where("event_type = 'purchase'").groupBy("rec").agg(F.min("t").alias("t")).select("rec", F.lit("Takeoff").alias("name"), "t")
    cfg = sensors.Settings(accel_hz=8.0, baro_hz=4.0, fill=False, coverage=0.3, grids=(wn.Grid("base", 0, 4.0, 4.0), wn.Grid("to", 1, 6.0, 3.0)), zones=wn.Zones((1.0, 3.0), (3.0, 1.0)))
    table = sensors.feature_table(accel, s.select("rec", "t", (900 + F.col("v") * F.pi() / 31).alias("p")), marks, cfg, quiet(s).select("rec").distinct())
    found = sensors.signal_features(table)
    out = sensors.imputed(table)
    times = ("t_start", "t_end", "t_center", "t_anchor", "t_takeoff", "dist_to_takeoff", "dist_to_event", "accel_obs_coverage", "baro_obs_coverage", "log_dt_prev_end_s", "log_win_s", "dt_prev_end_s", "accel_coverage", "baro_coverage")
    return out.withColumns({c: scaled_round(c, digits(c)) for c in [*found, *times]})


def _bins_sql(name: str, where: str, step: float) -> str:
    """CTEs up to ``name`` (rec, s, obs): bins of the signal's rows, a second being an hour of them, on the recording's time."""
    return f"""{name}_c AS (SELECT DISTINCT rec, t / 3600 AS t FROM sig WHERE {where}), {name}_e AS (SELECT rec, min(t) AS a, ceil((max(t) - min(t) + {step / 2}::DOUBLE) / {step}::DOUBLE)::BIGINT AS n FROM {name}_c GROUP BY rec),
{name}_b AS (SELECT DISTINCT rec, least(floor((t - a) / {step}::DOUBLE)::BIGINT, n - 1) AS bin FROM {name}_c JOIN {name}_e USING (rec)),
{name}_g AS (SELECT rec, a, unnest(range(n)) AS bin FROM {name}_e),
{name} AS (SELECT g.rec, g.bin * {step}::DOUBLE + (a - zero) AS s, (b.bin IS NOT NULL)::INT AS obs FROM {name}_g g JOIN zero USING (rec) LEFT JOIN {name}_b b ON b.rec = g.rec AND b.bin = g.bin)"""


def _held_sql(name: str, step: float) -> str:
    end = f"round_even(we * {1 / step}::DOUBLE, 0) / {1 / step}::DOUBLE"
    return f"""{name}_in AS (SELECT seq, w.rec, count(*) AS n, avg(obs) AS share FROM due w JOIN {name} x ON x.rec = w.rec AND s >= {end} - win - 1e-9 AND s < {end} + 1e-9 GROUP BY seq, w.rec)"""


@query(f"""WITH {SIG}, zero AS (SELECT rec, coalesce(min(t / 3600) FILTER (WHERE event_type <> 'view'), min(t / 3600)) AS zero FROM sig GROUP BY rec),
{_bins_sql('one', "event_type <> 'view'", 5.0)}, {_bins_sql('two', "event_type = 'view'", 20.0)},
stop AS (SELECT rec, max(s) AS stop FROM (SELECT rec, s FROM one UNION ALL SELECT rec, s FROM two) GROUP BY rec),
grids(grid, grid_id, win, hop) AS (VALUES ('base', 0, 50::DOUBLE, 50::DOUBLE), ('to', 1, 40::DOUBLE, 20::DOUBLE), ('ld', 2, 48::DOUBLE, 24::DOUBLE)),
every AS (SELECT rec, grid, grid_id, win, k, k * hop + win AS we FROM (SELECT *, unnest(range(greatest(0, floor((40 + floor(stop + 1 - 40) + 1e-6 - win + 1e-9) / hop)::BIGINT + 1))) AS k FROM stop, grids WHERE stop + 1 >= 40)),
due AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY we, grid_id) - 1 AS seq FROM every) WHERE seq < 80),
{_held_sql('one', 5.0)}, {_held_sql('two', 20.0)},
kept AS (SELECT d.*, coalesce(a.n, 0) AS n_accel, coalesce(b.n, 0) AS n_baro, coalesce(a.share, 0) AS accel_coverage, coalesce(b.share, 0) AS baro_coverage FROM due d LEFT JOIN one_in a ON a.rec = d.rec AND a.seq = d.seq LEFT JOIN two_in b ON b.rec = d.rec AND b.seq = d.seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seq) - 1 AS place FROM kept WHERE (n_accel = 0 OR accel_coverage >= 0.2) AND (n_baro = 0 OR baro_coverage >= 0.2) AND n_accel + n_baro > 0)
SELECT rec, grid, we AS t_end, seq, place, n_accel, n_baro, round(accel_coverage, 6) AS accel_coverage, round(baro_coverage, 6) AS baro_coverage, coalesce(we - lag(we) OVER (PARTITION BY rec, grid ORDER BY seq), 0) AS dt_prev_end_s FROM placed WHERE place < 20""")
def reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live detector's windows, with the views as pressures and an hour of the events taken as a second."""
    from loomspark.plans import golden

    s = signal(spark, sf_dir).withColumn("t", F.col("t") / HOUR)
    one, two = s.where("event_type <> 'view'"), s.where("event_type = 'view'")
    zero = s.groupBy("rec").agg(F.coalesce(F.min(F.when(F.col("event_type") != "view", F.col("t"))), F.min("t")).alias("zero"))
    bins = lambda rows, step: rs.resample(rows, step, fill=False).join(rs.spans(rows), "rec").join(zero, "rec").withColumn("s", F.col("s") + (F.col("start") - F.col("zero")))
    cfg = golden.Settings(0.2, 0.05, 0.2, (wn.Grid("base", 0, 50.0, 50.0), wn.Grid("to", 1, 40.0, 20.0), wn.Grid("ld", 2, 48.0, 24.0)), 20)
    out = golden.windows(bins(one, 5.0), bins(two, 20.0), cfg)[0].withColumn("t_end", F.col("we"))
    return out.select("rec", "grid", "t_end", F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"), "n_accel", "n_baro", *r6("accel_coverage", "baro_coverage"), "dt_prev_end_s")


# -- columns, lines and markers -------------------------------------------------------------------------------------------
_SIZED = "v * power(10::DOUBLE, (event_id % 18)::DOUBLE)"


@query(f"""WITH {SIG}, b AS (SELECT *, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN v END AS x, CASE WHEN event_id % 5 <> 0 THEN v - 50 END AS to_s, CASE WHEN event_id % 7 <> 0 THEN 20 - v END AS ld_s, {_SIZED} AS large FROM sig)
SELECT event_id, x, CASE WHEN event_id % 3 = 0 THEN 'ms' WHEN large > 1e15 THEN 'ns' WHEN large > 1e12 THEN CASE WHEN large > 1.4e12 AND large < 2.5e12 THEN 'ms' ELSE 'ns' END
    WHEN large > 1e9 THEN CASE WHEN large > 1.4e9 AND large < 2e9 THEN 's' ELSE 'ms' END WHEN large > 1e6 THEN 'ms' ELSE 's' END AS unit,
  round(44330.0::DOUBLE * (1 - power(least(greatest((900 + v * pi()) / 1013.25, 1e-6), 100.0), {1 / 5.255!r}::DOUBLE)), 5) AS altitude, round_even(v / 7 * 1e6, 0) / 1e6 AS rounded,
  CASE WHEN v - 20 >= 1e-9 THEN round(least(greatest(x * pi() / (v - 20), 0), 100), 6) END AS ratio, v AS detected, v + 1 AS labelled,
  coalesce(abs(to_s), 1e9) AS far_event, coalesce(least(abs(to_s), abs(ld_s)), 1e9) AS far_min, coalesce(abs(to_s), 1e9) AS far_auto, coalesce(least(abs(to_s), abs(ld_s)), 1e9) AS far_two,
  x IS NULL AS is_least, (upper(event_type) = 'ERROR')::INT AS y, CASE event_id % 4 WHEN 0 THEN v WHEN 1 THEN (v::DECIMAL(20, 6)::VARCHAR || 'e1')::DOUBLE END AS number
FROM b""")
def scalar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column expressions: missing values, units by size, altitude, rounding, ratios, times and distances by what there is, numbers in texts."""
    from loomspark.plans import evaluate

    s, i = signal(spark, sf_dir), F.col("event_id")
    odd = F.when(i % 13 == 0, float("nan")).when(i % 17 == 0, float("-inf")).otherwise(F.col("v"))
    rows = s.withColumns({"x": scalars.present(odd), "odd": odd, "t_anchor": F.col("v") + 1, "t_end": F.col("v"), "large": F.when(i % 3 != 0, F.expr(_SIZED.replace("::DOUBLE", "")))})
    rows = rows.withColumns({"dist_to_takeoff": F.when(i % 5 != 0, F.col("v") - 50), "dist_to_landing": F.when(i % 7 != 0, 20 - F.col("v"))})
    one = rows.withColumn("dist_to_event", F.when(i % 5 == 0, float("nan")).otherwise(F.col("dist_to_takeoff")))
    said = F.when(i % 4 == 0, F.concat(F.lit(" "), F.col("v").cast("decimal(20,6)").cast("string"))).when(i % 4 == 1, F.concat(F.col("v").cast("decimal(20,6)").cast("string"), F.lit("e1"))).when(i % 4 == 2, "1.0d").otherwise("0x1F")
    both = one.select(
        "event_id", "x", scalars.unit_from_size(F.col("large")).alias("unit"), F.round(scalars.altitude(900 + F.col("v") * F.pi(), F.lit(1013.25)), 5).alias("altitude"), scalars.round6(F.col("v") / 7).alias("rounded"),
        F.round(scalars.ratio(F.col("x") * F.pi(), F.col("v") - 20), 6).alias("ratio"), scalars.detect_time(one).alias("detected"), scalars.label_time(one).alias("labelled"),
        scalars.distance(one, "event").alias("far_event"), scalars.distance(one, "min").alias("far_min"), scalars.distance(one).alias("far_auto"),
        (scalars.score_or_least(F.col("odd")) == float("-inf")).alias("is_least"), scalars.number(said).alias("number"),
    )
    two = evaluate.labelled(rows.withColumnRenamed("event_type", "label").withColumn("domain", F.lit("flight")), "ERROR").select("event_id", F.col("d").alias("far_two"), "y")
    return both.join(two, "event_id")


@query("""SELECT user_id AS rec, event_id AS line, kind, name, ts, x, y, z FROM (
  SELECT *, unnest(CASE user_id % 4 WHEN 0 THEN [{'kind': 'baro', 'name': NULL::VARCHAR, 'x': value, 'y': NULL::DOUBLE, 'z': NULL::DOUBLE}] WHEN 1 THEN [{'kind': 'accel', 'name': NULL, 'x': value, 'y': event_id::DOUBLE, 'z': NULL}]
    WHEN 3 THEN CASE WHEN event_type = 'view' THEN [{'kind': 'baro', 'name': NULL, 'x': value, 'y': NULL, 'z': NULL}] ELSE [{'kind': 'marker', 'name': event_type || ', said', 'x': NULL, 'y': NULL, 'z': NULL}] END END, recursive := true),
    floor(epoch_us(ts) / 1000)::DOUBLE AS at FROM events WHERE user_id % 4 <> 2 AND event_type <> 'error') AS q(event_id, was, user_id, event_type, value, props, kind, name, x, y, z, ts)""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV recordings, of four kinds of headers; one holds no stream, and errors are lines without a time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("rec", F.col("user_id"))
    head = F.element_at(F.array(*map(F.lit, ("Timestamp,Other,PRESSURE", "az,t,ax,AY", "x,y", "time,event,Baro"))), (F.col("rec") % 4 + 1).cast("int"))
    ms = F.when(F.col("event_type") == "error", "none").otherwise(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string"))
    v, kind = F.col("value").cast("string"), F.col("rec") % 4
    line = F.when(kind == 0, F.concat_ws(",", ms, F.lit("-"), v)).when(kind == 1, F.concat_ws(",", F.lit("?"), ms, v, F.col("event_id").cast("string"))).when(kind == 2, F.concat_ws(",", ms, v))
    line = line.otherwise(F.when(F.col("event_type") == "view", F.concat_ws(",", ms, F.lit(" "), v)).otherwise(F.concat(ms, F.lit(',"'), F.col("event_type"), F.lit(', said",'))))
    heads = rows.select("rec").distinct().select("rec", F.lit(-1).cast("long").alias("line"), head.alias("text"))
    return rec.parse_csv_lines(heads.unionByName(rows.select("rec", F.col("event_id").alias("line"), line.alias("text"))))


@query(f"""WITH {SIG}, mk AS (SELECT rec, event_type AS name, arg_max(t + CASE WHEN rec % 5 = 0 THEN 1e7 ELSE 0 END, event_id) AS t FROM sig WHERE event_type IN ('purchase', 'signup') GROUP BY rec, event_type),
e AS (SELECT rec, min(t) AS a, max(t) AS b FROM sig GROUP BY rec)
SELECT rec, name, t FROM (SELECT mk.*, max((t < a - 60 OR t > b + 60)::INT) OVER (PARTITION BY rec) AS void FROM mk JOIN e USING (rec)) WHERE void = 0""")
def marker_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last marker of a name, unless one of the recording lies outside its span."""
    s = signal(spark, sf_dir)
    marks = s.where("event_type in ('purchase', 'signup')").select("rec", F.col("event_type").alias("name"), (F.col("t") + F.when(F.col("rec") % 5 == 0, 1e7).otherwise(0.0)).alias("t"), F.col("event_id").alias("line"))
    return wn.valid_markers(marks, rs.spans(s))


@query(f"""WITH {SIG}, d AS (SELECT rec, event_id, CASE WHEN rec % 4 = 2 THEN 'marker' WHEN event_type = 'view' OR rec % 4 = 1 THEN 'baro' WHEN rec % 4 = 3 AND event_id % 9 <> 0 THEN 'marker' ELSE 'accel' END AS kind, CASE WHEN rec % 4 = 2 THEN t * 1e3 ELSE s / 52000 * CASE rec % 4 WHEN 0 THEN 1e0 ELSE 1e3 END END AS ts FROM z),
m AS (SELECT rec, kind, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS step, count(*) AS n, count(*) FILTER (WHERE d > 0) AS pos FROM (SELECT rec, kind, ts - lag(ts) OVER (PARTITION BY rec, kind ORDER BY ts) AS d FROM d WHERE kind <> 'marker') GROUP BY rec, kind),
u AS (SELECT rec, kind, CASE WHEN n < 10 OR pos < 5 THEN NULL WHEN 1 / step BETWEEN 0.5 AND 200 THEN 's' WHEN 1e3 / step BETWEEN 0.5 AND 200 THEN 'ms' WHEN 1e6 / step BETWEEN 0.5 AND 200 THEN 'us' WHEN 1e9 / step BETWEEN 0.5 AND 200 THEN 'ns' END AS unit FROM m),
l AS (SELECT rec, max(abs(ts)) AS large FROM d GROUP BY rec)
SELECT l.rec, coalesce((SELECT any_value(unit) FROM u WHERE u.rec = l.rec AND kind = 'accel'), (SELECT any_value(unit) FROM u WHERE u.rec = l.rec AND kind = 'baro'),
  CASE WHEN large > 1e15 THEN 'ns' WHEN large > 1e12 THEN CASE WHEN large > 1.4e12 AND large < 2.5e12 THEN 'ms' ELSE 'ns' END WHEN large > 1e9 THEN CASE WHEN large > 1.4e9 AND large < 2e9 THEN 's' ELSE 'ms' END WHEN large > 1e6 THEN 'ms' ELSE 's' END) AS unit FROM l""")
def unit_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by the rate of the accelerations, else of the pressures, else by size."""
    r, kind = F.col("rec") % 4, F.col("event_type")
    of = F.when(r == 2, "marker").when((kind == "view") | (r == 1), "baro").when((r == 3) & (F.col("event_id") % 9 != 0), "marker").otherwise("accel")
    z = rs.zeroed(signal(spark, sf_dir)).join(signal(spark, sf_dir).select("event_id", "t"), "event_id")
    ts = F.when(r == 2, F.col("t") * 1e3).otherwise(F.col("s") / 52000 * F.when(r == 0, 1.0).otherwise(1e3))
    return rec.units(z.select("rec", of.alias("kind"), ts.alias("ts"), F.col("t").alias("line")))


@query(f"WITH {SIG}, {PARTS} SELECT part, count(*) AS n, count(DISTINCT rec) AS recordings, sum(y)::BIGINT AS positives FROM sig JOIN parts USING (rec) GROUP BY part")
def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each part of a checked split."""
    s, parts = signal(spark, sf_dir), ln.split_groups(groups(spark, sf_dir))
    ln.check_split(parts, s)
    each = None
    for name in ("train", "val", "test"):
        own = parts.where(F.col("part") == name)
        if ln.leaks(own, parts.where(F.col("part") != name)):
            raise AssertionError("a recording is in two parts")
        one = s.join(own.select("rec"), "rec", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("rec").alias("recordings"), F.sum("y").alias("positives")).select(F.lit(name).alias("part"), "*")
        each = one if each is None else each.unionByName(one)
    return each


# -- streams --------------------------------------------------------------------------------------------------------------
def replayed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` makes of the signal as a stream: its files come one by one, in order of time, and a last row long after ends all recordings."""
    rows = signal(spark, sf_dir).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).select("rec", "ts", "v", "p")
    last = rows.agg(F.lit(-1).cast("long").alias("rec"), (F.max("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit(0.0).alias("v"), F.lit(0.0).alias("p"))
    cuts = tb.quantiles(rows.select(F.unix_micros("ts").cast("double").alias("u")), "u", [0.0, 0.4, 0.8, 1.0]).first().q
    root = f"{scratch.home(spark)}/stream-{uuid.uuid4().hex}"
    scratch.sweep_later(spark, root)
    at = F.unix_micros("ts").cast("double")
    for k, part in enumerate([rows.where(at.between(cuts[0], cuts[1])), *(rows.where((at > a) & (at <= b)) for a, b in zip(cuts[1:], cuts[2:])), last]):
        part.coalesce(1).write.mode("append").parquet(f"{root}/{k}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/[0-9]")
    query = operator(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stash(spark.read.parquet(f"{root}/out").where("rec >= 0"), "streamed")


@query(f"WITH RECURSIVE {SIG}, {TRIG} SELECT rec, t FROM fired")
def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, lambda s: stateful.triggers(s, THRESHOLD, K, COOLDOWN, "1 day", 400 * DAY))


@query(f"""WITH RECURSIVE {SIG}, r AS (SELECT rec, t, v, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM sig),
e AS (SELECT *, v AS m FROM r WHERE i = 1 UNION ALL SELECT r.*, 0.2::DOUBLE * r.v + 0.8::DOUBLE * m FROM e JOIN r ON r.rec = e.rec AND r.i = e.i + 1) SELECT rec, t, v, round(m, 6) AS m FROM e""")
def stream_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(spark, sf_dir, lambda s: stateful.ema(s, 0.2, "1 day", 400 * DAY)).select("rec", "t", "v", *r6("m"))


@query(f"""WITH {SIG}, {WIN}, f AS (SELECT rec, grid, k, count(*) AS n, avg(v) AS mean FROM x GROUP BY rec, grid, k)
SELECT w.rec, w.grid, w.grid_id, w.k, ws, we, coalesce(n, 0) AS n, round(mean, 6) AS mean, CASE WHEN w.k > 0 THEN hop END AS dt_prev_end FROM w JOIN grids USING (grid) LEFT JOIN f ON f.rec = w.rec AND f.grid = w.grid AND f.k = w.k""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replayed(spark, sf_dir, lambda s: stateful.windows(s, GRIDS, "1 day", 400 * DAY))
    return out.select("rec", "grid", "grid_id", "k", "ws", "we", "n", *r6("mean"), "dt_prev_end")
