"""Training of the sequence model: data-parallel epochs over Spark partitions, and a temperature for its scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.events import average_precision
from loomspark.operators.learning import gru_scores, scaled
from loomspark.sources.scratch import stash

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Training:
    """Shape of the model, and how it is fitted: ``main`` and ``aux`` weigh the losses of the target output and the others."""

    hidden: int = 64
    layers: int = 2
    head: int = 64
    dropout: float = 0.3
    epochs: int = 50
    patience: int = 10
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 1.0
    target: int | None = 0
    main: float = 1.0
    aux: float = 0.25
    most_weight: float = 20.0
    focal: tuple[float, float] | None = None
    repeat_target: int = 1
    repeat_other: int = 1
    workers: int = 8
    seed: int = 42


def start(n_in: int, n_out: int, cfg: Training) -> Weights:
    """Uniform initial weights, within one over the root of the number of inputs."""
    rng = np.random.default_rng(cfg.seed)
    draw = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
    w: Weights = {}
    for k in range(cfg.layers):
        w |= {f"w_ih_{k}": draw(cfg.hidden, 3 * cfg.hidden, n_in if k == 0 else cfg.hidden), f"w_hh_{k}": draw(cfg.hidden, 3 * cfg.hidden, cfg.hidden)}
        w |= {f"b_ih_{k}": draw(cfg.hidden, 3 * cfg.hidden), f"b_hh_{k}": draw(cfg.hidden, 3 * cfg.hidden)}
    return w | {"w_1": draw(cfg.hidden, cfg.head, cfg.hidden), "b_1": draw(cfg.hidden, cfg.head), "w_2": draw(cfg.head, n_out, cfg.head), "b_2": draw(cfg.head, n_out)}


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * v))


def loss(z: np.ndarray, y: np.ndarray, positive: np.ndarray, share: np.ndarray, focal: tuple[float, float] | None) -> tuple[float, np.ndarray]:
    """Mean loss of logits and its derivative: log loss with weighted positives, or focal loss ``(alpha, gamma)``."""
    sign = 2 * y - 1
    right, bce = _sigmoid(sign * z), np.logaddexp(0, -sign * z)
    slope = -(1 - right) * sign
    if focal:
        alpha, gamma = focal
        easy = alpha * (1 - right) ** gamma
        value, slope = easy * bce, easy * (slope - gamma * right * sign * bce)
    else:
        weight = np.where(y > 0, positive, 1.0)
        value, slope = weight * bce, weight * slope
    return float((value * share).sum() / len(z)), slope * share / len(z)


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, positive: np.ndarray, share: np.ndarray, cfg: Training, rng: np.random.Generator | None = None) -> tuple[float, Weights]:
    """The loss on a batch of scaled sequences and its derivative by every weight; ``rng`` draws the dropout."""
    mask = lambda shape: 1.0 if rng is None or not cfg.dropout else (rng.random(shape) >= cfg.dropout) / (1 - cfg.dropout)
    n, steps, size = len(x), x.shape[1], cfg.hidden
    tape, masks, layer_in = [], [], x
    for k in range(cfg.layers):
        h, seen, outs = np.zeros((n, size)), [], []
        given = layer_in @ w[f"w_ih_{k}"].T + w[f"b_ih_{k}"]
        for t in range(steps):
            own = h @ w[f"w_hh_{k}"].T + w[f"b_hh_{k}"]
            reset, update = _sigmoid(given[:, t, :size] + own[:, :size]), _sigmoid(given[:, t, size : 2 * size] + own[:, size : 2 * size])
            new = np.tanh(given[:, t, 2 * size :] + reset * own[:, 2 * size :])
            seen.append((h, reset, update, new, own[:, 2 * size :]))
            h = (1 - update) * new + update * h
            outs.append(h)
        tape.append((layer_in, seen))
        out = np.stack(outs, 1)
        masks.append(mask(out.shape) if k + 1 < cfg.layers else 1.0)
        layer_in = out * masks[-1]
    m1 = mask((n, size))
    last = layer_in[:, -1] * m1
    bent = last @ w["w_1"].T + w["b_1"]
    m2 = mask(bent.shape)
    hidden = np.maximum(bent, 0) * m2
    value, dz = loss(hidden @ w["w_2"].T + w["b_2"], y, positive, share, cfg.focal)

    g: Weights = {"w_2": dz.T @ hidden, "b_2": dz.sum(0)}
    dbent = dz @ w["w_2"] * m2 * (bent > 0)
    g |= {"w_1": dbent.T @ last, "b_1": dbent.sum(0)}
    douts = np.zeros((n, steps, size))
    douts[:, -1] = dbent @ w["w_1"] * m1
    for k in reversed(range(cfg.layers)):
        layer_in, seen = tape[k]
        douts = douts * masks[k]
        dgiven, dw, db, dh = np.zeros((n, steps, 3 * size)), np.zeros_like(w[f"w_hh_{k}"]), np.zeros(3 * size), np.zeros((n, size))
        for t in reversed(range(steps)):
            before, reset, update, new, own = seen[t]
            dh = dh + douts[:, t]
            dnew = dh * (1 - update) * (1 - new**2)
            dgates = np.concatenate([dnew * own * reset * (1 - reset), dh * (before - new) * update * (1 - update)], 1)
            dgiven[:, t] = np.concatenate([dgates, dnew], 1)
            down = np.concatenate([dgates, dnew * reset], 1)
            dw, db = dw + down.T @ before, db + down.sum(0)
            dh = dh * update + down @ w[f"w_hh_{k}"]
        g |= {f"w_ih_{k}": np.einsum("nto,nti->oi", dgiven, layer_in), f"b_ih_{k}": dgiven.sum((0, 1)), f"w_hh_{k}": dw, f"b_hh_{k}": db}
        douts = dgiven @ w[f"w_ih_{k}"]
    return value, g


class Adam:
    """Adam with decoupled weight decay over a flat vector."""

    def __init__(self, w: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, cfg: Training):
        self.w, self.m, self.v, self.step, self.cfg = w.copy(), m.copy(), v.copy(), step, cfg

    def take(self, g: np.ndarray, rate: float) -> None:
        g = g * min(1.0, self.cfg.clip / (np.linalg.norm(g) + 1e-6))
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w = self.w * (1 - rate * self.cfg.decay) - rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def scaler(seqs: DataFrame, x: str = "x") -> Weights:
    """Mean and population deviation (1 where it is 0) of each feature over all steps, missing values as 0."""
    steps = seqs.select(F.explode(x).alias("s")).select(F.posexplode("s").alias("i", "v"))
    v = F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))
    rows = steps.groupBy("i").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("scale")).orderBy("i").collect()  # a row for each feature
    scale = np.array([r.scale for r in rows])
    return {"mean": np.array([r.mean for r in rows]), "scale": np.where(scale > 0, scale, 1.0)}


def _repeats(ys: Sequence[str], cfg: Training) -> Column:
    """How often a training row counts: positives of the target output, and of the others, may be repeated."""
    positive = [F.col(y) > 0 for y in ys]
    out = F.lit(1)
    for k, c in enumerate(positive):
        times = cfg.repeat_target if cfg.target in (None, k) else cfg.repeat_other
        out = F.greatest(out, F.when(c, F.lit(times)).otherwise(1))
    return out


def fit_gru(train: DataFrame, val: DataFrame, ys: Sequence[str], key: str, quiet: str = "is_nonflight", x: str = "x", cfg: Training = Training()) -> tuple[Weights, list[float]]:
    """Weights for :func:`gru_scores`, and the validation score after each epoch.

    The training rows are dealt by a hash of ``key`` (unique) among ``workers`` partitions.  In an epoch every partition
    goes through its rows in a fresh order with its own Adam steps, starting from the common weights; weights and moments
    are then averaged by numbers of rows, so what reaches the driver is the size of the model, whatever the input.  The
    rate falls by a cosine.  Fitting ends when ``patience`` epochs bring no better step-sum precision on the validation
    rows that are not ``quiet`` (for the target output, or the mean of all); the best weights are returned.
    """
    spark = train.sparkSession
    scale = scaler(train, x)
    counts = train.agg(F.count("*").alias("n"), *(F.sum(F.col(y)).alias(y) for y in ys)).first()
    if not counts.n:
        raise ValueError("there are no sequences to learn from")
    positive = np.array([min((counts.n - counts[y]) / max(counts[y], 1), cfg.most_weight) for y in ys])
    share = np.array([1 / len(ys) if cfg.target is None else cfg.main if k == cfg.target else cfg.aux for k in range(len(ys))])
    rows = train.select(F.xxhash64(key).alias("k"), x, F.array(*(F.col(y).cast("double") for y in ys)).alias("y"), F.explode(F.sequence(F.lit(1), _repeats(ys, cfg))).alias("copy"))
    rows = stash(rows.repartition(cfg.workers, "k", "copy").withColumn("worker", F.spark_partition_id()), "sequences")
    common = start(len(scale["mean"]), len(ys), cfg)
    w = flat(common)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    best, kept, history = 0.0, w, []
    flights = stash(val.where(~F.col(quiet)).select(x, *ys), "validation")

    for epoch in range(cfg.epochs):
        rate = cfg.rate * 0.5 * (1 + np.cos(np.pi * epoch / cfg.epochs))
        sent = spark.sparkContext.broadcast((w, m, v, step))

        def run(batches: Iterable[pa.RecordBatch], rate=rate, sent=sent, epoch=epoch) -> Iterator[pa.RecordBatch]:
            adam, n, rng = Adam(*sent.value, cfg), 0, None
            for batch in batches:
                many, right, worker = np.array(batch.column(0).to_pylist(), float), np.array(batch.column(1).to_pylist()), batch.column(2)
                many = scaled(many, scale)
                rng = rng or np.random.default_rng([cfg.seed, epoch, worker[0].as_py()])
                for at in range(0, len(many), cfg.batch):
                    _, g = gradients(shaped(adam.w, common), many[at : at + cfg.batch], right[at : at + cfg.batch], positive, share, cfg, rng)
                    adam.take(flat(g), rate)
                n += len(many)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(adam.w))), *(pa.array(n * a) for a in (adam.w, adam.m, adam.v)), pa.array(np.full(len(adam.w), n)), pa.array(np.full(len(adam.w), adam.step))], names=["i", "w", "m", "v", "n", "step"])

        order = F.xxhash64("k", "copy", F.lit(epoch))
        dealt = rows.repartition(cfg.workers, "worker").sortWithinPartitions("worker", order).select(x, "y", "worker")
        parts = dealt.mapInArrow(run, "i long, w double, m double, v double, n long, step long")
        got = parts.groupBy("i").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in "wmv"), F.max("step").alias("step")).orderBy("i").toArrow()  # a row for each weight
        w, m, v = (got[c].to_numpy() for c in "wmv")
        step = got["step"][0].as_py()
        sent.unpersist()
        p = stash(gru_scores(flights, shaped(w, common) | scale, x).select("p", *ys), "scores")
        each = [average_precision(p.select(F.col("p")[k].alias("p"), F.col(y).alias("y"))).first().pr_auc or 0.0 for k, y in enumerate(ys)]
        history.append(float(np.mean(each)) if cfg.target is None else float(each[cfg.target]))
        if history[-1] > best:
            best, kept = history[-1], w
        elif epoch - int(np.argmax(history)) >= cfg.patience:
            break
    return shaped(kept if best > 0 else w, common) | scale, history


def fit_temperature(scored: DataFrame, p: str = "p", y: str = "y", rounds: int = 6, points: int = 17) -> float:
    """The temperature of least log loss between 0.05 and 20; every round is one aggregation over all rows."""
    odds = F.greatest(F.least(F.col(p), F.lit(1 - 1e-12)), F.lit(1e-12))
    rows = scored.select(F.ln(odds / (1 - odds)).alias("z"), F.col(y).alias("y"))
    low, high = np.log(0.05), np.log(20.0)
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        at = [F.col("z") * float(np.exp(-t)) for t in grid]
        found = rows.agg(*(F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z).alias(f"l{k}") for k, z in enumerate(at))).first()
        if found.l0 is None:
            return 1.0
        k = int(np.argmin(list(found)))
        low, high = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    return float(np.exp((low + high) / 2))
