"""Feature tables: missingness, scaling, weights and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import stash


def any_present(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in columns]).isNotNull().cast("double") if columns else F.lit(0.0)


def share_present(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / len(columns) if columns else F.lit(0.0)


def missingness(df: DataFrame, features: Sequence[str], groups: dict[str, Sequence[str]], shares: dict[str, Sequence[str]]) -> DataFrame:
    """``has_<group>`` and ``<group>_coverage`` indicators; then missing features become 0."""
    df = df.withColumns({f"has_{g}": any_present(cs) for g, cs in groups.items()} | {f"{g}_coverage": share_present(cs) for g, cs in shares.items()})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in features})


def masks(df: DataFrame, features: Sequence[str], which: str = "auto") -> DataFrame:
    """``m__<feature>``, 1 where missing: for none, all, or those features that are ever missing."""
    if which == "auto":
        row = df.agg(*(F.max(F.col(c).isNull()).alias(c) for c in features)).first()
        features = [c for c in features if row[c]]
    return df if which == "none" else df.withColumns({f"m__{c}": F.col(c).isNull().cast("int") for c in features})


def fit_scaler(df: DataFrame, features: Sequence[str], by: str | None = None, zero_missing: bool = False) -> DataFrame:
    """``[by,] feature, mean, std`` (population), missing values left out, or counted as 0."""
    value = F.coalesce("value", F.lit(0.0)) if zero_missing else F.col("value")
    long = df.unpivot([by] if by else [], list(features), "feature", "value").withColumn("value", value)
    return long.groupBy(*([by] if by else []), "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], missing: str = "keep", tiny: float = 1e-12) -> DataFrame:
    """z-scores by a scaler without groups (one row a feature, collected); constant features become 0.

    ``missing``: "keep" leaves NULLs, "mean" makes them 0.
    """
    fitted = {r.feature: r for r in scaler.collect()}

    def z(c: str) -> Column:
        r = fitted[c]
        if r["std"] is None or r["std"] < tiny:
            return F.when(F.col(c).isNotNull() | F.lit(missing == "mean"), F.lit(0.0))
        out = (F.col(c) - r["mean"]) / r["std"]
        return F.coalesce(out, F.lit(0.0)) if missing == "mean" else out

    return df.withColumns({c: z(c) for c in features})


def varying(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that are not constant."""
    row = df.agg(*(F.var_pop(c).alias(c) for c in features)).first()
    return [c for c in features if row[c]]


def quantiles(df: DataFrame, value: str, shares: Sequence[float], *keys: str) -> DataFrame:
    """``[keys,] n, q``: the exact quantiles of the present values of each key, interpolated, as an array in the order of ``shares``.

    Equal values are counted first.  The counts are dealt to ranges of key and value, so a key with most of the rows has
    many ranges, and a value's place is its place in its range, shifted by the sizes of the key's ranges before.  No
    task or buffer holds a key's values; keys without a present value have no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c")).persist()  # read twice: to choose the ranges, and to deal
    dealt = stash(counts.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()), "values")
    counts.unpersist()
    sizes = dealt.groupBy(*keys, "__range").agg(F.sum("__c").alias("__size"))  # a row for each range and key in it
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(Window.partitionBy(*keys)).alias("__n"))
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    up_to = F.sum("__c").over(Window.partitionBy("__range", *keys).orderBy("__v")) + F.col("__start")
    placed = dealt.join(starts, same).withColumn("__to", up_to).withColumn("__from", F.col("__to") - F.col("__c"))
    at = lambda i: F.lit(float(shares[i])) * (F.col("__n") - 1)
    inside = lambda place: F.max(F.when((place >= F.col("__from")) & (place < F.col("__to")), F.col("__v")))
    ends = [e for i in range(len(shares)) for e in (inside(F.floor(at(i))).alias(f"__l{i}"), inside(F.ceil(at(i))).alias(f"__h{i}"))]
    wanted = F.lit(False)
    for i in range(len(shares)):
        for place in (F.floor(at(i)), F.ceil(at(i))):
            wanted = wanted | ((place >= F.col("__from")) & (place < F.col("__to")))
    if len(shares) > 8:  # many shares: tell the places by a join of the wanted ones instead of an expression for each
        places = F.array_distinct(F.flatten(F.transform(F.array(*(F.lit(float(x)) for x in shares)), lambda x: F.array(F.floor(x * (F.col("__n") - 1)), F.ceil(x * (F.col("__n") - 1))))))
        few = placed.withColumn("__p", F.explode(F.filter(places, lambda x: (x >= F.col("__from")) & (x < F.col("__to")))))
        found = few.groupBy(*keys).agg(F.max("__n").alias("n"), F.map_from_entries(F.collect_list(F.struct("__p", "__v"))).alias("__m")).where("n is not null")
        mid = lambda x: x * (F.col("n") - 1)
        low, high = (lambda x: F.element_at("__m", F.floor(mid(x)))), (lambda x: F.element_at("__m", F.ceil(mid(x))))
        q = F.transform(F.array(*(F.lit(float(x)) for x in shares)), lambda x: low(x) + (high(x) - low(x)) * (mid(x) - F.floor(mid(x))))
        return found.select(*keys, "n", q.alias("q"))
    found = placed.where(wanted).groupBy(*keys).agg(F.max("__n").alias("n"), *ends).where("n is not null")
    between = lambda i: F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (F.lit(float(shares[i])) * (F.col("n") - 1) - F.floor(F.lit(float(shares[i])) * (F.col("n") - 1)))
    return found.select(*keys, "n", F.array(*(between(i) for i in range(len(shares)))).alias("q"))


def fit_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each feature, None without a present value; one number a feature comes to the driver."""
    if not features:
        return {}
    long = df.select(*(F.col(c).cast("double").alias(c) for c in features)).unpivot([], list(features), "feature", "value")
    found = {r.feature: r.q[0] for r in quantiles(long, "value", [0.5], "feature").collect()}
    return {c: found.get(c) for c in features}


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def missing_shares(df: DataFrame, features: Sequence[str], over: float = 0.05, top: int = 10) -> DataFrame:
    """The features with the largest shares of missing values."""
    long = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features)).unpivot([], list(features), "feature", "share")
    return long.where(F.col("share") > over).orderBy(F.desc("share"), "feature").limit(top)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many different present values each column has."""
    return df.agg(*(F.countDistinct(c).alias(c) for c in columns))


def groups_of(rows: DataFrame, key: str = "file", group: str = "group_id") -> DataFrame:
    """``key, group`` of every group that a key's rows are in, once."""
    return rows.select(key, group).distinct()


def positive_weight(df: DataFrame, y: str, cap: float | None = None) -> DataFrame:
    ratio = (F.count("*") - F.sum(y)) / F.nullif(F.sum(y), F.lit(0))
    return df.agg((F.least(ratio, F.lit(cap)) if cap else ratio).alias("pos_weight"))


def distance_weights(df: DataFrame, y: str, dist: str, near: float, mid: float, w_mid: float, w_far: float, w_near: float = 1.0, boost: float | None = None) -> DataFrame:
    """``weight``: negatives by distance from an event; positives share the negatives' total, or get a fixed boost."""
    d = F.coalesce(F.abs(F.col(dist)), F.lit(1e9))
    rows = df.withColumn("weight", F.when(F.col(y) == 0, F.when(d <= near, w_near).when(d <= mid, w_mid).otherwise(w_far)))
    if boost is not None:
        return rows.withColumn("weight", F.coalesce("weight", F.lit(float(boost))))
    total = rows.agg((F.greatest(F.sum("weight") / F.greatest(F.sum(F.col(y)), F.lit(1)), F.lit(1e-12))).alias("__pos"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce("weight", "__pos")).drop("__pos")  # one row


def positions(df: DataFrame, *order: Column, name: str = "__i") -> DataFrame:
    """``df`` with each row's place (from 0) in a total order, without a task that sees all rows.

    Rows are dealt to ranges of the order and written once, so that every later read finds the same ranges; places are
    counted within ranges and shifted by the sizes of the ranges before.
    """
    dealt = stash(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + F.col("__start")
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, place).drop("__range", "__start")


def draw(*keys: str | Column, seed: int = 42) -> Column:
    """A reproducible draw from 0 to 1 by the MD5 of the seed and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def keep(df: DataFrame, probability: float, *keys: str, seed: int = 42) -> DataFrame:
    """Each row with this probability."""
    return df.where(draw(*keys, seed=seed) < probability)


def undersample(df: DataFrame, y: str, per_positive: float, *keys: str, seed: int = 42) -> DataFrame:
    """All positives, and the ``per_positive`` times as many negatives of the smallest draws."""
    counts = df.agg(F.sum(y).alias("p"), F.count("*").alias("n")).first()
    p, n = counts.p or 0, counts.n - (counts.p or 0)
    k = int(min(n, per_positive * p))
    if not p or not n or per_positive <= 0 or k == n:
        return df
    negatives = df.where(F.col(y) == 0).withColumn("__u", draw(*keys, seed=seed))
    few = positions(negatives, F.col("__u"), *map(F.col, keys)).where(F.col("__i") < k)
    return df.where(F.col(y) == 1).unionByName(few.drop("__u", "__i"))


def thin(df: DataFrame, every: int, key: str, *order: str) -> DataFrame:
    """Every n-th row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") % every == 0).drop("__i")


def oversample(df: DataFrame, y: str, times: int) -> DataFrame:
    """Positives ``times`` times, ``copy`` numbering them."""
    return df.withColumn("copy", F.explode(F.when(F.col(y) == 1, F.sequence(F.lit(1), F.lit(max(1, times)))).otherwise(F.array(F.lit(1)))))
