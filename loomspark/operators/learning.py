"""Splits by recording, folds, and models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.tables import positions


def split_sizes(n: int, val: float, test: float) -> tuple[int, int]:
    """Validation and test recordings of n: at least one each from three on."""
    if n < 3:
        return (1 if n > 1 else 0), (1 if n > 0 else 0)
    n_test, n_val = max(1, round(test * n)), max(1, round(val * n))
    return min(n_val, n - n_test - 1), n_test


def split_groups(groups: DataFrame, val: float = 0.2, test: float = 0.3, key: str = "rec", rotate: int | None = None) -> DataFrame:
    """``rec, part`` (train, val, test): the longest recordings test first, ties by name; no recording is in two parts.

    With a seed to ``rotate`` by, recordings come by name instead, from a place on that the seed gives.  Quotas depend on
    the number of recordings alone; the ranking is a distributed sort, numbered range by range.
    """
    n = groups.count()
    n_val, n_test = split_sizes(n, val, test)
    ranked = positions(groups, F.desc("hours"), F.col(key)) if rotate is None else positions(groups, F.col(key))
    if rotate is not None and n:
        ranked = ranked.withColumn("__i", F.pmod(F.col("__i") - int(np.random.default_rng(rotate).integers(0, n)), F.lit(n)))
    part = F.when(F.col("__i") < n_test, "test").when(F.col("__i") < n_test + n_val, "val").otherwise("train")
    return ranked.select(key, part.alias("part"))


def fold_groups(groups: DataFrame, k: int = 5, key: str = "rec", weight: str = "positives") -> DataFrame:
    """``rec, fold``: recordings dealt to the folds in a snake by their positives, so folds are balanced."""
    ranked = positions(groups, F.desc(weight), F.col(key))
    turn, at = F.floor(F.col("__i") / k), F.col("__i") % k
    return ranked.select(key, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def leaks(a: DataFrame, b: DataFrame, key: str = "rec") -> bool:
    """Whether a group is on both sides."""
    return not a.select(key).intersect(b.select(key)).isEmpty()


def check_split(parts: DataFrame, rows: DataFrame, key: str = "rec", y: str = "y") -> None:
    """Raises if a group is in two parts, a part has no rows, or the training part lacks a class."""
    if not parts.groupBy(key).agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty():
        raise AssertionError("a recording is in two parts")
    counts = {r.part: (r.n, r.pos) for r in rows.join(parts, key).groupBy("part").agg(F.count("*").alias("n"), F.sum(y).alias("pos")).collect()}
    missing = [r.part for r in parts.select("part").distinct().collect() if r.part not in counts]
    if missing:
        raise AssertionError(f"the parts {missing} have no rows")
    n, pos = counts.get("train", (0, 0))
    if not 0 < (pos or 0) < n:
        raise AssertionError("the training part does not have both classes")


def forest(train: DataFrame, features: Sequence[str], trees: int = 50, depth: int = 6, seed: int = 42, weight: str | None = None):
    model = RandomForestClassifier(labelCol="y", featuresCol="__x", numTrees=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"), model]).fit(train)


def boosted(train: DataFrame, features: Sequence[str], trees: int = 50, depth: int = 4, step: float = 0.103, seed: int = 42, weight: str | None = None, held: str | None = None, tolerance: float = 0.01, rows: float = 1.0, columns: str = "all"):
    """Boosted trees; each sees a share of the ``rows`` and of the ``columns`` (as Spark names such shares).

    ``held`` is a boolean column: rows where it holds are not learned from, and no more trees are added once they no
    longer improve the loss on these rows by ``tolerance``.
    """
    more = ({"weightCol": weight} if weight else {}) | ({"validationIndicatorCol": held, "validationTol": tolerance} if held else {})
    model = GBTClassifier(labelCol="y", featuresCol="__x", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=rows, featureSubsetStrategy=columns, **more)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"), model]).fit(train)


def score(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of the positive class."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out.drop("__x", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: Sequence[str], fit, k: int = 5) -> DataFrame:
    """``rows`` (with ``fold``) scored by the model of the other folds; folds whose training rows have one class are left out."""
    out = None
    for f in range(k):
        train = rows.where(F.col("fold") != f)
        if train.select("y").distinct().count() < 2:
            continue
        part = score(fit(train, features), rows.where(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has training rows of both classes")
    return out


def scaled(x: np.ndarray, scaler: dict[str, np.ndarray]) -> np.ndarray:
    """``x`` by a scaler's ``mean`` and ``scale``; values that are then missing or infinite are 0."""
    z = (x - scaler["mean"]) / np.maximum(scaler["scale"], 1e-8)
    return np.where(np.isfinite(z), z, 0.0)


def gru(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of sequences ``(n, steps, features)``: stacked gated recurrent layers, then a rectified layer, then the outputs.

    If the weights hold a scaler (``mean, scale``), it is applied first.
    """
    if "mean" in weights:
        x = scaled(x, weights)
    sig = lambda v: 1 / (1 + np.exp(-v))
    layer = 0
    while f"w_ih_{layer}" in weights:
        w, u, b, c = (weights[f"{n}_{layer}"] for n in ("w_ih", "w_hh", "b_ih", "b_hh"))
        size = u.shape[1]
        h, outs = np.zeros((len(x), size)), []
        for t in range(x.shape[1]):
            i, r = x[:, t] @ w.T + b, h @ u.T + c
            reset, update = sig(i[:, :size] + r[:, :size]), sig(i[:, size : 2 * size] + r[:, size : 2 * size])
            new = np.tanh(i[:, 2 * size :] + reset * r[:, 2 * size :])
            h = (1 - update) * new + update * h
            outs.append(h)
        x = np.stack(outs, 1)
        layer += 1
    hidden = np.maximum(x[:, -1] @ weights["w_1"].T + weights["b_1"], 0)
    return hidden @ weights["w_2"].T + weights["b_2"]


def gru_scores(seqs: DataFrame, weights: dict[str, np.ndarray], x: str = "x", heat: float = 1.0) -> DataFrame:
    """``seqs`` with ``p``, an array of probabilities, one for each output."""
    sent = seqs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        z = gru(np.stack([np.stack(s).astype(float) for s in batch]), sent.value) / heat
        return pd.Series(list(1 / (1 + np.exp(-z))))

    return seqs.withColumn("p", run(x))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, sought by golden section between 0.05 and 20."""
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y * logits / t)
    low, high = np.log(0.05), np.log(20)
    for _ in range(60):
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))
