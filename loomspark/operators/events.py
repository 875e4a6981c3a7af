"""Triggers from scores, event evaluation, ranking metrics and thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import score_or_least
from loomspark.operators.tables import quantiles
from loomspark.operators.windows import islands


def highest(scores: DataFrame, key: str = "rec") -> DataFrame:
    """``key, t, p``: one row for each time, the highest score; a missing one is lower than any."""
    return scores.groupBy(key, "t").agg(F.max(score_or_least(F.col("p"))).alias("p"))


class Trigger:
    """k scores in a row at or above the threshold fire; while cooling down, scores neither count nor fire."""

    def __init__(self, threshold: float, k: int = 1, cooldown: float = 60.0, run: int = 0, last: float = float("-inf")):
        self.threshold, self.k, self.cooldown, self.run, self.last = threshold, max(1, k), cooldown, run, last

    def step(self, t: float, p: float) -> bool:
        if t - self.last < self.cooldown or not p >= self.threshold:
            self.run = 0
            return False
        self.run += 1
        if self.run < self.k:
            return False
        self.run, self.last = 0, t
        return True


def sweep(scores: DataFrame, thresholds: Sequence[float], k: int, cooldown: float, key: str = "rec") -> DataFrame:
    """``threshold, key, t``: the triggers of every threshold, all state machines in one pass over the scores.

    A machine's next state depends on its last, so a recording's scores stream through one task in the order of time:
    what that holds is a batch of rows and, for each threshold, a run and a last trigger.  The machines step together.
    """
    values = np.array(sorted(set(map(float, thresholds))))
    rows = highest(scores, key).repartition(F.col(key)).sortWithinPartitions(key, "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = object()
        streak, last = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            found: list[tuple] = []
            for rec, t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if rec != now:
                    now, streak, last = rec, np.zeros(len(values), np.int64), np.full(len(values), float("-inf"))
                n = int(np.searchsorted(values, p, "right"))  # thresholds that the score reaches
                streak[n:] = 0
                if not n:
                    continue
                free = t - last[:n] >= cooldown
                streak[:n] = np.where(free, streak[:n] + 1, 0)
                fires = np.flatnonzero(streak[:n] >= max(1, k))
                if len(fires):
                    streak[fires], last[fires] = 0, t
                    found += [(x, rec, t) for x in values[fires].tolist()]
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.float64()), pa.array(columns[1], batch.column(0).type), pa.array(columns[2], pa.float64())], names=["threshold", key, "t"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "t", "p").mapInArrow(run, f"threshold double, `{key}` {kind}, t double")


def triggers(scores: DataFrame, threshold: float, k: int = 1, cooldown: float = 60.0, key: str = "rec") -> DataFrame:
    """``key, t`` of every trigger; see :func:`sweep`."""
    return sweep(scores, [threshold], k, cooldown, key).select(key, "t")


def hours(rows: DataFrame, key: str = "rec", time: str = "t") -> DataFrame:
    """``key, hours`` between the first and the last time."""
    return rows.groupBy(key).agg(F.when(F.count(time) >= 2, (F.max(time) - F.min(time)) / 3600).otherwise(0.0).alias("hours"))


def per_hour(fired: DataFrame, quiet: DataFrame, key: str = "rec") -> DataFrame:
    """``n_triggers, hours, fp_per_hour`` over quiet recordings; NULL without hours."""
    n = fired.join(quiet.select(key), key, "left_semi").agg(F.count("*").alias("n_triggers"))
    total = quiet.agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"))
    return n.crossJoin(total).withColumn("fp_per_hour", F.when(F.col("hours") > 0, F.col("n_triggers") / F.col("hours")))  # a row each


def segments(rows: DataFrame, positive: Column, marker: Column, order: Sequence[str] = ("t",), key: str = "rec") -> DataFrame:
    """Runs of positive rows: ``key, seg, start_idx, end_idx, t_ref`` (the median marker, else the first row's time)."""
    runs = islands(rows.withColumn("__m", marker), positive, order, key).groupBy(key, "island")
    out = runs.agg((F.min("row") - 1).alias("start_idx"), (F.max("row") - 1).alias("end_idx"), F.coalesce(F.percentile("__m", F.lit(0.5)), F.min_by("t", "row")).alias("t_ref"))
    return out.withColumn("seg", F.row_number().over(Window.partitionBy(key).orderBy("start_idx")) - 1).drop("island")


def matches(segs: DataFrame, fired: DataFrame, window: float, key: str = "rec") -> DataFrame:
    """Each segment's triggers: nearest delay, first at or after the event, first within the window around and after it.

    Events and triggers are put in one order of time, in which the last trigger up to an event and the first one from it
    on are found by running values: no pairs are made.
    """
    kind = dict(segs.dtypes)[key]
    both = segs.select(key, "seg", F.col("t_ref").alias("__t"), F.lit(None).cast("double").alias("__f"))
    both = both.unionByName(fired.select(F.col(key).cast(kind).alias(key), F.lit(None).cast(dict(segs.dtypes)["seg"]).alias("seg"), F.col("t").alias("__t"), F.col("t").alias("__f")))
    w = Window.partitionBy(key).orderBy("__t")
    up_to, onward = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    known = F.col("__t").isNotNull()
    near = both.withColumns({"__before": F.max("__f").over(up_to), "__after": F.min("__f").over(onward), "__any": F.max("__f").over(Window.partitionBy(key)).isNotNull()}).where("seg is not null")
    before, after = F.when(known, F.col("__before") - F.col("__t")), F.when(known, F.col("__after") - F.col("__t"))
    nearest = F.when(after.isNull() | (F.abs(before) <= after), before).otherwise(after)
    return near.select(
        key, "seg", F.col("__t").alias("t_ref"), nearest.alias("delay_nearest"), after.alias("delay_after"),
        F.coalesce(F.abs(nearest) <= window, F.lit(False)).alias("hit"), F.coalesce(after <= window, F.lit(False)).alias("hit_after"), F.col("__any").alias("triggered"),
    )


def rates(matched: DataFrame) -> DataFrame:
    """Hit rates over the segments with an event time, and the distribution of delays."""
    known = matched.where("t_ref is not null").withColumn("d", F.when(F.col("hit_after"), F.col("delay_after")))
    out = known.agg(F.count("*").alias("n_events"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.col("hit_after").cast("double")).alias("hit_after_rate"), F.avg("d").alias("delay_mean"), F.min("d").alias("delay_min"), F.max("d").alias("delay_max"))
    q = _one(quantiles(known, "d", [0.5, 0.9, 0.95]), "delay_median", "delay_p90", "delay_p95")
    return out.crossJoin(q).select("n_events", "hit_rate", "hit_after_rate", "delay_mean", "delay_median", "delay_p90", "delay_p95", "delay_min", "delay_max")  # a row each


def _one(found: DataFrame, *names: str) -> DataFrame:
    """Quantiles without keys as columns of one row, NULL if there was no value."""
    return found.agg(F.max("q").alias("q")).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)))


def in_segment(rows: DataFrame, positive: Column, marker: Column, threshold: float, k: int, window: float, key: str = "rec") -> DataFrame:
    """The baselines' rule: the first k scores in a row inside a segment, a hit if within the window of the event."""
    runs = islands(rows.withColumns({"__m": marker, "__high": score_or_least(F.col("p")) >= threshold}), positive, ("t",), key)
    w = Window.partitionBy(key, "island").orderBy("row")
    runs = runs.withColumn("__low", F.sum((~F.col("__high")).cast("long")).over(w))
    streak = Window.partitionBy(key, "island", "__low").orderBy("row")
    runs = runs.withColumn("__streak", F.sum(F.col("__high").cast("long")).over(streak))
    out = runs.groupBy(key, "island").agg(F.coalesce(F.percentile("__m", F.lit(0.5)), F.min_by("t", "row")).alias("t_ref"), F.min(F.when(F.col("__streak") >= max(1, k), F.col("t"))).alias("t_fired"), (F.min("row") - 1).alias("start_idx"))
    latency = F.col("t_fired") - F.col("t_ref")
    return out.select(key, "start_idx", "t_ref", latency.alias("latency"), F.coalesce(F.abs(latency) <= window, F.lit(False)).alias("hit"))


def curve(scored: DataFrame) -> DataFrame:
    """``p, tp, fp, precision, recall`` at every distinct score, highest first.

    Sums by score are made first; running sums go over score ranges: within 256 ranges in parallel, then over the ranges.
    """
    by = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    edges = by.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    by = by.crossJoin(F.broadcast(edges))  # one row
    by = by.withColumn("b", F.least(F.floor((F.col("p") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 256), F.lit(255))).fillna({"b": 0})
    totals = by.groupBy("b").agg(F.sum("pos").alias("b_pos"), F.sum("n").alias("b_n"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("b", F.coalesce(F.sum("b_pos").over(above), F.lit(0)).alias("pos0"), F.coalesce(F.sum("b_n").over(above), F.lit(0)).alias("n0"), F.sum("b_pos").over(Window.partitionBy()).alias("all_pos"), F.sum("b_n").over(Window.partitionBy()).alias("all_n"))
    w = Window.partitionBy("b").orderBy(F.desc("p"))
    out = by.join(F.broadcast(totals), "b").withColumns({"tp": F.sum("pos").over(w) + F.col("pos0"), "seen": F.sum("n").over(w) + F.col("n0")})
    return out.select("p", "pos", "n", "tp", (F.col("seen") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))).alias("recall"), "all_pos", "all_n")


def average_precision(scored: DataFrame) -> DataFrame:
    """``pr_auc``: the step sum of precision over recall; ``roc_auc``: the share of ordered pairs, ties one half."""
    c = curve(scored)
    neg = F.col("n") - F.col("pos")
    pairs = F.sum(neg * (F.col("tp") - F.col("pos") / 2))
    return c.agg(
        F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("precision")).alias("pr_auc"),
        (pairs / F.nullif(F.max("all_pos") * (F.max("all_n") - F.max("all_pos")), F.lit(0))).alias("roc_auc"),
    )


def confusion(scored: DataFrame, threshold: float, beta: float = 1.0) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, fbeta`` at a threshold."""
    high, pos = F.col("p") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = scored.agg(n(high & pos).alias("tp"), n(high & ~pos).alias("fp"), n(~F.coalesce(high, F.lit(False)) & pos).alias("fn"), n(~F.coalesce(high, F.lit(False)) & ~pos).alias("tn"))
    out = out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + 1e-12)})
    return out.withColumn("fbeta", fbeta(F.col("precision"), F.col("recall"), beta, F.lit(1e-12), add=True))


def fbeta(precision: Column, recall: Column, beta: float, tiny: Column, add: bool = False) -> Column:
    below = beta**2 * precision + recall
    return (1 + beta**2) * precision * recall / (below + tiny if add else F.greatest(below, tiny))


def best_threshold(scored: DataFrame, beta: float = 1.0, variant: str = "sum") -> DataFrame:
    """``threshold, fbeta`` of the best score to cut at, in the three models' ways.

    "sum": the denominator has 1e-10 added, the first (lowest) of the best scores wins.  "before": floored at 1e-12,
    and the score before the best one is returned.  "ends": 0 and 1 are candidates too, the lowest of the best wins.
    """
    c = curve(scored)
    value = fbeta(F.col("precision"), F.col("recall"), beta, F.lit(1e-10 if variant == "sum" else 1e-12), add=variant == "sum")
    c = c.select("p", F.coalesce(value, F.lit(0.0)).alias("fbeta"))
    if variant == "ends":
        whole = scored.agg(F.avg("y").alias("precision")).select(F.lit(0.0).alias("p"), fbeta(F.col("precision"), F.lit(1.0), beta, F.lit(1e-12)).alias("fbeta"))
        c = c.unionByName(whole)
    best = F.max_by(F.struct("p", "fbeta"), F.struct("fbeta", -F.col("p")))
    found = c.agg(best.alias("b")).select(F.col("b.p").alias("threshold"), F.col("b.fbeta").alias("fbeta"))
    if variant == "before":
        lower = scored.select("p").crossJoin(F.broadcast(found)).agg(F.max(F.when(F.col("p") < F.col("threshold"), F.col("p"))).alias("lower"))  # one row
        found = found.crossJoin(F.broadcast(lower)).select(F.coalesce("lower", "threshold").alias("threshold"), "fbeta")
    return found


def delays(rows: DataFrame, detect: str = "t_detect", label: str = "t_label") -> DataFrame:
    """``n, mean, median, p90, p95, min, max`` of the seconds from a sequence's label to its detection, where both are known."""
    rows = rows.select((F.col(detect) - F.col(label)).alias("d"))
    out = rows.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"))
    q = _one(quantiles(rows, "d", [0.5, 0.9, 0.95]), "median", "p90", "p95")
    return out.crossJoin(q).select("n", "mean", "median", "p90", "p95", "min", "max")  # a row each


def recall_threshold(scored: DataFrame, recall: float, corrected: bool = False) -> DataFrame:
    """The lowest score, as the original has it, or (corrected) the highest one that reaches the recall."""
    reached = curve(scored).where(F.col("recall") >= recall)
    return reached.agg((F.max("p") if corrected else F.min("p")).alias("threshold"))


def candidates(scored: DataFrame, size: int = 512, anchors: int = 16) -> DataFrame:
    """``threshold``: quantiles of the scores and evenly spaced anchors, between 0 and 1, distinct; none without scores."""
    size = min(4096, max(32, size))
    found = quantiles(scored, "p", [i / (size - 1) for i in range(size)])
    spaced = F.array(*(F.lit(i / (anchors - 1)) for i in range(anchors)))
    clipped = F.transform(F.concat("q", spaced), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return found.select(F.explode(F.array_distinct(clipped)).alias("threshold"))


def budget_threshold(fired: DataFrame, thresholds: DataFrame, quiet: DataFrame, segs: DataFrame, budget: float, window: float, key: str = "rec") -> DataFrame:
    """``threshold, hit_after_rate, fp_per_hour``: the most hits within the false-trigger budget, then the highest threshold; 1.0 if none."""
    total = quiet.agg(F.sum("hours").alias("h"))
    wrong = fired.join(quiet.select(key), key, "left_semi").groupBy("threshold").agg(F.count("*").alias("n"))
    per = thresholds.join(wrong, "threshold", "left").crossJoin(F.broadcast(total)).withColumn("fp_per_hour", F.when(F.col("h") > 0, F.coalesce("n", F.lit(0)) / F.col("h")))  # one row
    refs = segs.where("t_ref is not null").select(key, "seg", "t_ref")
    # Times are dealt to buckets of the window's length: an event meets the triggers of its own bucket and the next one.
    bucket = lambda t: F.floor(t / max(window, 1e-9))
    near = refs.withColumn("__b", F.explode(F.array(bucket(F.col("t_ref")), bucket(F.col("t_ref")) + 1)))
    hits = fired.withColumn("__b", bucket(F.col("t"))).join(near, [key, "__b"]).where((F.col("t") >= F.col("t_ref")) & (F.col("t") <= F.col("t_ref") + window))
    hits = hits.select("threshold", key, "seg").distinct().groupBy("threshold").agg(F.count("*").alias("hits"))
    n = refs.agg(F.count("*").alias("events"))
    per = per.join(hits, "threshold", "left").crossJoin(F.broadcast(n)).withColumn("hit_after_rate", F.coalesce("hits", F.lit(0)) / F.nullif(F.col("events"), F.lit(0)))
    ok = per.where(F.col("fp_per_hour") <= budget)
    best = F.max_by(F.struct("threshold", "hit_after_rate", "fp_per_hour"), F.struct(F.round("hit_after_rate", 12), "threshold"))
    return ok.agg(best.alias("b")).select(F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"), "b.hit_after_rate", "b.fp_per_hour", F.col("b").isNull().alias("fallback"))


def poisson_steps(most: int = 8) -> list[float]:
    """The cumulative probabilities of 0, 1, … events of a Poisson count of mean 1: a uniform draw's count is how many it reaches."""
    out, total, term = [], 0.0, exp(-1)
    for k in range(1, most + 1):
        total, term = total + term, term / k
        out.append(total)
    return out


def bootstrap(matched: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """``low, high``: the 2.5 and 97.5 percentiles of the hit rate over resamples, each event's count a Poisson draw by hash.

    Poisson counts need no sampling by position, so the events are never gathered.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("rec").cast("string"), F.col("seg").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    count = F.lit(0)
    for x in poisson_steps():
        count = count + (u >= x).cast("int")
    rows = matched.select("rec", "seg", F.col("hit_after").cast("int").alias("h"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("c", count)
    per = rows.groupBy("draw").agg((F.sum(F.col("h") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0))).alias("r"))
    return per.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))  # a rate for each draw
