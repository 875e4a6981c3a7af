"""Hopping windows from the start of each recording, their samples, labels and sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.tables import quantiles


@dataclass(frozen=True)
class Grid:
    """A window length and hop in seconds; ``grid_id`` orders grids of equal times."""

    name: str
    grid_id: int
    win: float
    hop: float


#: The grids of the sensor pipeline.
SENSOR_GRIDS = (Grid("base", 0, 10.0, 2.0), Grid("to", 1, 20.0, 10.0), Grid("ld", 2, 24.0, 12.0))


def hop_windows(spans: DataFrame, grids: Sequence[Grid]) -> DataFrame:
    """``rec, grid, grid_id, k, ws, we`` of every full window in ``spans`` (rec, start, stop); an exact fit counts.

    Recordings shorter than a grid's window have none of that grid.
    """

    def one(g: Grid) -> DataFrame:
        n = F.floor((F.col("stop") - F.col("start") - g.win + 1e-9) / g.hop)
        rows = spans.where(F.col("stop") - F.col("start") >= g.win - 1e-9).select("rec", "start", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
        ws = F.round(F.col("start") + F.col("k") * g.hop, 6)
        return rows.select("rec", F.lit(g.name).alias("grid"), F.lit(g.grid_id).alias("grid_id"), "k", ws.alias("ws"), F.round(ws + g.win, 6).alias("we"))

    return reduce(DataFrame.unionByName, map(one, grids)).dropDuplicates(["rec", "grid_id", "ws", "we"])


def scheduled(windows: DataFrame) -> DataFrame:
    """Windows in the order in which a live scheduler emits them: by end, then by grid; ``seq`` counts from 0."""
    return windows.withColumn("seq", F.row_number().over(Window.partitionBy("rec").orderBy("we", "grid_id")) - 1)


def chunks(spans: DataFrame, seconds: float) -> DataFrame:
    """Long recordings in pieces of at most ``seconds``, named by a suffix if there are several."""
    n = F.greatest(F.lit(1), F.ceil((F.col("stop") - F.col("start")) / seconds))
    rows = spans.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    name = F.when(F.col("n") > 1, F.format_string("%s#chunk%04d", F.col("rec").cast("string"), "i")).otherwise(F.col("rec").cast("string"))
    return rows.select("rec", name.alias("chunk"), (F.col("start") + F.col("i") * seconds).alias("start"), F.least("stop", F.col("start") + (F.col("i") + 1) * seconds).alias("stop"))


def windowed(samples: DataFrame, spans: DataFrame, grids: Sequence[Grid]) -> DataFrame:
    """``samples`` (rec, s, …) once for each window ``[ws, we]`` that holds them, with ``grid, grid_id, k, ws, we``.

    The band join as arithmetic: a sample's window numbers follow from its time, so the only join is that of the
    recordings' spans (start 0 of ``s``), and a sample gives win / hop + 1 rows at most.
    """
    ends = spans.select("rec", (F.col("stop") - F.col("start")).alias("__span"))
    rows = samples.join(ends, "rec")

    def one(g: Grid) -> DataFrame:
        last = F.floor((F.col("__span") - g.win + 1e-9) / g.hop)
        low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("s") - g.win) / g.hop) - 1)
        high = F.least(last, F.floor(F.col("s") / g.hop) + 1)
        out = rows.withColumns({"grid": F.lit(g.name), "grid_id": F.lit(g.grid_id), "k": F.explode(F.when(low <= high, F.sequence(low, high)))})
        ws = F.round(F.col("k") * g.hop, 6)
        return out.withColumns({"ws": ws, "we": F.round(ws + g.win, 6)}).where("s between ws and we").drop("__span")

    return reduce(DataFrame.unionByName, map(one, grids))


def covered(a: Column, n_a: Column, b: Column, n_b: Column, least: float = 0.8) -> Column:
    """Each sensor that is there must be observed in this share of bins; one must be there."""
    return ((n_a == 0) | (a >= least)) & ((n_b == 0) | (b >= least)) & (n_a + n_b > 0)


def anchor(ws: Column, we: Column, where: str = "right") -> Column:
    return we if where == "right" else (ws + we) / 2


@dataclass(frozen=True)
class Zones:
    """Seconds before and after the two markers that belong to them, and the rules of the labels."""

    takeoff: tuple[float, float] = (5.0, 60.0)
    landing: tuple[float, float] = (60.0, 10.0)
    least_s: float = 3.0
    least_share: float = 0.25
    margin: float = 8.0
    drop: bool = False
    mode: str = "all"


def _pick(in_to: Column, in_ld: Column, d_to: Column, d_ld: Column, to_wins: Column, z: Zones) -> Column:
    in_to, in_ld = F.coalesce(in_to, F.lit(False)), F.coalesce(in_ld, F.lit(False))
    in_to, in_ld = (F.lit(False) if z.mode == "ld" else in_to), (F.lit(False) if z.mode == "to" else in_ld)
    out = F.when(~in_to & ~in_ld, "OTHER")
    if z.drop:
        out = out.when(in_to & in_ld & (d_to <= z.margin) & (d_ld <= z.margin), F.lit(None).cast("string"))
    return out.when(in_to & (~in_ld | to_wins), "TAKEOFF").otherwise("LANDING")


def overlap_label(ws: Column, we: Column, to: Column, ld: Column, z: Zones = Zones()) -> Column:
    """The marker whose zone overlaps the window most; ties go to the nearer marker, then to TAKEOFF; NULL if ambiguous."""
    center, least = (ws + we) / 2, F.greatest(F.lit(z.least_s), z.least_share * F.greatest(we - ws, F.lit(1e-6)))
    over = lambda a, b: F.greatest(F.lit(0.0), F.least(we, b) - F.greatest(ws, a))
    o_to = F.when(to.isNotNull(), over(to - z.takeoff[0], to + z.takeoff[1]))
    o_ld = F.when(ld.isNotNull(), over(ld - z.landing[0], ld + z.landing[1]))
    d_to, d_ld = F.abs(center - to), F.abs(center - ld)
    return _pick(o_to >= least, o_ld >= least, d_to, d_ld, (o_to > o_ld) | ((o_to == o_ld) & (d_to <= d_ld)), z)


def anchor_label(at: Column, center: Column, to: Column, ld: Column, z: Zones = Zones()) -> Column:
    """The nearer of the markers in whose zone the anchor lies."""
    d_to, d_ld = F.abs(at - to), F.abs(at - ld)
    return _pick(at.between(to - z.takeoff[0], to + z.takeoff[1]), at.between(ld - z.landing[0], ld + z.landing[1]), F.abs(center - to), F.abs(center - ld), d_to <= d_ld, z)


def valid_markers(markers: DataFrame, spans: DataFrame, slack: float = 60.0) -> DataFrame:
    """Markers ``(rec, name, t, line)``: the last line of a name counts, and one outside the span voids the recording's."""
    last = markers.groupBy("rec", "name").agg(F.max_by("t", "line").alias("t"))
    out = last.join(spans, "rec").withColumn("bad", (F.col("t") < F.col("start") - slack) | (F.col("t") > F.col("stop") + slack))
    bad = out.groupBy("rec").agg(F.max("bad").alias("void"))
    return out.join(bad.where("not void"), "rec").select("rec", "name", "t")


def marker_times(markers: DataFrame, takeoff: str = "Takeoff", landing: str = "Landing") -> DataFrame:
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("t")))
    return markers.groupBy("rec").agg(pick(takeoff).alias("t_takeoff"), pick(landing).alias("t_landing"))


def sequences(windows: DataFrame, length: int, shift: int = 0, key: str = "group_id", features: Sequence[str] = (), factor: float = 2.5, fallback: float = 60.0) -> DataFrame:
    """Runs of ``length`` consecutive windows: ``key, start, t_detect, t_label, label, x`` (rows of features).

    If the windows have ``accel_coverage`` or ``baro_coverage``, the least of a run is returned too.

    Windows are ``(key, t_detect, t_label, label, …)`` and sorted by (t_detect, t_start, row_idx) as far as they have these.
    A run is left out if a time is missing or a gap is more than ``factor`` times the group's median gap.  The label is
    that of the row at ``length // 2 + shift``.
    """
    order = [F.col(c).asc_nulls_last() for c in ("t_detect", "t_start", "win_s", "hop_s", "row_idx") if c in windows.columns]
    w = Window.partitionBy(key).orderBy(*order)
    at = length // 2 + shift
    rows = windows.withColumns({"__n": F.row_number().over(w) - 1, "__gap": F.col("t_detect") - F.lag("t_detect").over(w)})
    middle = quantiles(rows, "__gap", [0.5], key).select(key, F.col("q")[0].alias("__middle"))
    limit = rows.select(key).distinct().join(middle, key, "left").select(key, (factor * F.coalesce("__middle", F.lit(fallback))).alias("__limit"))
    least = [c for c in ("accel_coverage", "baro_coverage") if c in windows.columns]
    run = w.rowsBetween(1 - length, 0)
    x = F.collect_list(F.array(*(F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in features))).over(run) if features else F.lit(None).cast("array<array<float>>")
    back = length - 1 - at
    rows = rows.withColumns({
        "__full": F.count("*").over(run), "__times": F.count("t_detect").over(run), "__widest": F.max("__gap").over(w.rowsBetween(2 - length, 0)) if length > 1 else F.lit(None).cast("double"),
        "__label": F.lag("label", back).over(w), "__t_label": F.lag("t_label", back).over(w), "x": x,
        **{c: F.min(c).over(run) for c in least},
    })
    rows = rows.join(limit, key).where((F.col("__full") == length) & (F.col("__times") == length) & (F.col("__widest").isNull() | (F.col("__widest") <= F.col("__limit"))))
    return rows.select(key, (F.col("__n") - length + 1).alias("start"), "t_detect", F.col("__t_label").alias("t_label"), F.col("__label").alias("label"), "x", *least)


def islands(rows: DataFrame, flag: Column, order: Sequence[str], key: str = "rec") -> DataFrame:
    """Runs of rows where ``flag`` holds: ``rows`` of them with ``island``, the same number for a run."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumns({"__i": F.row_number().over(w), "__f": F.coalesce(flag, F.lit(False))})
    return numbered.withColumn("island", F.col("__i") - F.sum(F.col("__f").cast("long")).over(w)).where("__f").drop("__f").withColumnRenamed("__i", "row")


def longest_run(rows: DataFrame, flag: Column, order: Sequence[str], hz: float, key: str = "rec") -> DataFrame:
    """``rec, seconds`` of the longest run; 0 without any."""
    runs = islands(rows, flag, order, key).groupBy(key, "island").agg(F.count("*").alias("n")).groupBy(key).agg((F.max("n") / hz).alias("seconds"))
    return rows.select(key).distinct().join(runs, key, "left").select(key, F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def sessions(rows: DataFrame, gap: float, key: str = "rec", time: str = "s") -> DataFrame:
    """``rows`` with ``session``, which counts up after every gap of more than ``gap`` seconds."""
    w = Window.partitionBy(key).orderBy(time)
    jump = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("__j", jump).withColumn("session", F.sum("__j").over(w)).drop("__j")


def streams(rows: DataFrame, is_event: Column, chunk: float | None = None) -> DataFrame:
    """``stream_id, is_nonflight, group_id``: a stream without any event row is quiet, and may be cut by time."""
    s = rows.withColumns({"stream_id": F.col("rec").cast("string"), "__e": is_event.cast("int")})
    facts = s.groupBy("stream_id").agg((F.max("__e") == 0).alias("is_nonflight"), F.min("t").alias("__t0"))
    s = s.join(facts, "stream_id").drop("__e")
    part = F.concat(F.col("stream_id"), F.lit("__nf"), F.lpad(F.floor((F.col("t") - F.col("__t0")) / (chunk or 1.0)).cast("string"), 4, "0"))
    group = F.when(F.col("is_nonflight"), part).otherwise(F.col("stream_id")) if chunk else F.col("stream_id")
    return s.withColumn("group_id", group).drop("__t0")
