"""From a feature table to a fitted baseline and its report, and from scores to an event report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalars import distance, present
from loomspark.operators import events as ev
from loomspark.operators import learning as ln
from loomspark.operators import tables as tb
from loomspark.sources import sinks
from loomspark.sources.scratch import stash


@dataclass(frozen=True)
class Rules:
    """How a baseline is fitted and judged."""

    folds: int = 5
    val: float = 0.2
    test: float = 0.3
    per_positive: float = 8.0
    beta: float = 2.0
    k: int = 1
    hit_window: float = 10.0
    cooldown: float = 60.0
    near: float = 60.0
    mid: float = 300.0
    w_mid: float = 0.5
    w_far: float = 0.2
    budget: float = 0.05
    least_hours: float = 2.0
    candidates: int = 64
    seed: int = 42


def labelled(table: DataFrame, event: str) -> DataFrame:
    """``table`` with ``y``, ``t`` (when a window's result is known), ``quiet`` and ``d`` (seconds from an event)."""
    return table.withColumns({"y": (F.upper("label") == event).cast("int"), "t": F.col("t_end"), "quiet": F.col("domain") == "nonflight", "d": distance(table)})


def partition(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rec, part`` with flight and quiet recordings split apart, so that both kinds are in every part.

    Flights are taken by name, from a place on that the seed gives, and quiet recordings by length.
    """
    hours = ev.hours(rows).join(rows.groupBy("rec").agg(F.max("quiet").alias("quiet")), "rec")
    return ln.split_groups(hours.where("not quiet"), rules.val, rules.test, rotate=rules.seed).unionByName(ln.split_groups(hours.where("quiet"), rules.val, rules.test))


def fitter(rules: Rules, model: Callable = ln.forest, **how) -> Callable[[DataFrame, Sequence[str]], Any]:
    """Undersampled, distance-weighted fitting; medians are learned from the rows that are fitted."""

    def fit(train: DataFrame, features: Sequence[str]):
        few = tb.undersample(train, "y", rules.per_positive, "rec", "t", "grid", seed=rules.seed)
        weighted = tb.distance_weights(few, "y", "d", rules.near, rules.mid, rules.w_mid, rules.w_far)
        return model(weighted, features, seed=rules.seed, weight="weight", **how)

    return fit


def drawn(space: dict[str, Sequence[Any]], n: int, seed: int = 42, first: Sequence[dict[str, Any]] = ()) -> list[dict[str, Any]]:
    """``n`` different settings from a space of values, ``first`` ones before the drawn; all of them if there are no more."""
    rng, out, names = np.random.default_rng(seed), [dict(f) for f in first][:n], sorted(space)
    total = int(np.prod([len(space[k]) for k in names], dtype=float))
    seen = {tuple(repr(f.get(k)) for k in names) for f in out}
    for _ in range(64 * max(n, 1)):
        if len(out) >= n or len(seen) >= total:
            break
        one = {k: space[k][int(rng.integers(len(space[k])))] for k in names}
        mark = tuple(repr(one[k]) for k in names)
        if mark not in seen:
            seen.add(mark)
            out.append(one)
    return out


def _suggested(space: dict[str, Any], seen: Sequence[tuple[dict[str, Any], float]], rng: np.random.Generator, tries: int = 24) -> dict[str, Any]:
    """The likeliest of ``tries`` settings to be among the best of those ``seen``, by a Parzen estimator for each value.

    Values are taken from a list, or from an interval ``(low, high)`` or ``(low, high, "log")``.  The best tenth of what
    was seen makes one density of a value and the rest the other; settings are drawn from the first, and the one with the
    largest ratio of the two is suggested.
    """
    ranked = [one for one, _ in sorted(seen, key=lambda x: -x[1])]
    n = max(1, int(np.ceil(0.1 * len(ranked))))
    out = {}
    for name in sorted(space):
        good, bad = ([one[name] for one in part if name in one] for part in (ranked[:n], ranked[n:]))
        of = space[name]
        if isinstance(of, list):
            weigh = lambda part: np.array([1 + sum(repr(v) == repr(x) for x in part) for v in of], float)  # noqa: B023, E731
            a, b = (w / w.sum() for w in map(weigh, (good, bad)))
            drawn_at = rng.choice(len(of), tries, p=a)
            out[name] = of[int(drawn_at[np.argmax(a[drawn_at] / b[drawn_at])])]
            continue
        scale = np.log if len(of) > 2 and of[2] == "log" else np.asarray
        low, high = (float(scale(float(x))) for x in of[:2])
        centres = lambda part: np.append(scale(np.array(part, float)) if part else np.zeros(0), (low + high) / 2)  # noqa: B023, E731
        # The last centre stands for the whole interval; the others are narrower the more there are.
        width = lambda c: np.append(np.full(len(c) - 1, (high - low) / max(2.0, np.sqrt(len(c) * 8))), high - low)  # noqa: B023, E731
        density = lambda x, c: np.mean(np.exp(-0.5 * ((x[:, None] - c) / width(c)) ** 2) / width(c), 1)  # noqa: B023, E731
        a, b = centres(good), centres(bad)
        pick = rng.integers(len(a), size=tries)
        x = np.where(pick == len(a) - 1, rng.uniform(low, high, tries), np.clip(rng.normal(a[pick], np.maximum(width(a)[pick], 1e-12)), low, high))
        best = float(x[np.argmax(density(x, a) / density(x, b))]) if high > low else low
        out[name] = float(np.clip(np.exp(best) if scale is np.log else best, of[0], of[1]))
    return out


def parzen(space: dict[str, Any], objective: Callable[[dict[str, Any]], float], n: int, seed: int = 42, first: Sequence[dict[str, Any]] = (), startup: int = 10) -> list[tuple[dict[str, Any], float]]:
    """``n`` settings with their values of ``objective``, higher being better: ``first`` ones, then drawn ones up to ``startup``, then those that :func:`_suggested` gives."""
    rng, seen = np.random.default_rng(seed), []
    for k in range(n):
        one = dict(first[k]) if k < len(first) else _suggested(space, seen if k >= startup else [], rng)
        seen.append((one, float(objective(one))))
    return seen


def _judge(train: DataFrame, features: Sequence[str], one: dict[str, Any], rules: Rules, model: Callable, how: dict[str, Any]) -> dict[str, Any]:
    """A setting with its out-of-fold scores and threshold."""
    own = {f.name for f in fields(Rules)}
    ruled = replace(rules, **{k: v for k, v in one.items() if k in own})
    fit = fitter(ruled, model, **how | {k: v for k, v in one.items() if k not in own})
    held = stash(ln.out_of_fold(train, features, fit, rules.folds), "held")
    best = ev.best_threshold(held, ruled.beta, "ends").first()
    return dict(one) | ev.average_precision(held).first().asDict() | {"threshold": best.threshold, "fbeta": best.fbeta}


def search(train: DataFrame, features: Sequence[str], settings: Sequence[dict[str, Any]], rules: Rules = Rules(), model: Callable = ln.forest, **how) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """The best of ``settings`` and all of them with their out-of-fold scores, best first by ``pr_auc``, then ``roc_auc``.

    ``train`` has ``fold`` and what :func:`fitter` needs.  Names of a setting that are :class:`Rules` (weights of near and
    far negatives, say) change the rules, the others go to the model.
    """
    if not settings:
        raise ValueError("there are no settings to choose from")
    table = [_judge(train, features, one, rules, model, how) for one in settings]
    table.sort(key=lambda r: (-(r["pr_auc"] or 0.0), -(r["roc_auc"] or 0.0)))
    return {k: table[0][k] for k in settings[0]}, table


def tuned(train: DataFrame, features: Sequence[str], space: dict[str, Any], n: int, rules: Rules = Rules(), model: Callable = ln.forest, seed: int = 42, first: Sequence[dict[str, Any]] = (), **how) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Like :func:`search`, over ``n`` settings that :func:`parzen` suggests one after the other by their out-of-fold ``pr_auc``."""
    if n < 1:
        raise ValueError("there are no settings to choose from")
    table: list[dict[str, Any]] = []

    def objective(one: dict[str, Any]) -> float:
        table.append(_judge(train, features, one, rules, model, how))
        return table[-1]["pr_auc"] or 0.0

    parzen(space, objective, n, seed, first)
    table.sort(key=lambda r: (-(r["pr_auc"] or 0.0), -(r["roc_auc"] or 0.0)))
    return {k: table[0][k] for k in space}, table


def across(reports: Sequence[dict[str, Any]]) -> dict[str, Any]:
    """Mean and population deviation of every number that all reports (of several seeds, say) have, by its path."""
    flat = lambda v, at="": {k: x for n, w in v.items() for k, x in (flat(w, f"{at}{n}.") if isinstance(w, dict) else {f"{at}{n}": w}).items()}
    rows = [flat(r) for r in reports]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    names = [k for k in (rows[0] if rows else {}) if all(number(r.get(k)) for r in rows)]
    return {k: {"mean": float(np.mean([r[k] for r in rows])), "std": float(np.std([r[k] for r in rows]))} for k in names}


def event_report(scored: DataFrame, marker: str, threshold: float, rules: Rules) -> dict[str, Any]:
    """Trigger-level and segment-level results of scored windows ``(rec, t, p, y, quiet, <marker>)`` at a threshold."""
    flights, quiet = scored.where("not quiet"), scored.where("quiet")
    fired = stash(ev.triggers(scored, threshold, rules.k, rules.cooldown), "fired")
    segs = ev.segments(flights, F.col("y") == 1, F.col(marker))
    after = ev.rates(ev.matches(segs, fired, rules.hit_window)).first().asDict()
    inside = ev.in_segment(flights, F.col("y") == 1, F.col(marker), threshold, rules.k, rules.hit_window)
    segment = inside.agg(F.count("*").alias("n_segments"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.percentile("latency", F.lit(0.5)).alias("latency_median")).first().asDict()
    wrong = ev.per_hour(fired, ev.hours(quiet)).first().asDict()
    return {"triggers": after, "segments": segment, "quiet": wrong}


def budget_choice(scored: DataFrame, marker: str, rules: Rules) -> dict[str, Any]:
    """The threshold with the most hits within the false-trigger budget; by F-beta where quiet hours are too few."""
    quiet = ev.hours(scored.where("quiet"))
    total = quiet.agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("h")).first().h
    if total < rules.least_hours:
        best = ev.best_threshold(scored.where("not quiet"), rules.beta, "sum").first()
        return {"threshold": best.threshold, "fbeta": best.fbeta, "by": "fbeta"}
    options = ev.candidates(scored, rules.candidates)
    values = sorted(r.threshold for r in options.collect())  # at most candidates + 16
    segs = ev.segments(scored.where("not quiet"), F.col("y") == 1, F.col(marker))
    found = ev.budget_threshold(ev.sweep(scored, values, rules.k, rules.cooldown), options, quiet, segs, rules.budget, rules.hit_window).first().asDict()
    return found | {"by": "budget"}


def baseline(table: DataFrame, features: Sequence[str], event: str, marker: str, rules: Rules = Rules(), model: Callable = ln.forest, **how) -> tuple[Any, dict[str, Any]]:
    """A fitted model and its report: out-of-fold threshold on the training recordings, then the held-out ones.

    No recording is on both sides of a split or fold.  The report is a dict of numbers, for :func:`sinks.write_json`.
    """
    rows = labelled(table, event).withColumns({c: present(F.col(c)) for c in features})
    parts = partition(rows, rules)
    rows = rows.join(parts, "rec")
    train, test = rows.where("part <> 'test'"), rows.where("part = 'test'")
    ln.check_split(parts, rows.drop("part"))
    used = tb.varying(train, features)
    medians = tb.fit_medians(train, used)
    train, test = stash(tb.impute(train, medians), "train"), stash(tb.impute(test, medians), "test")
    positives = train.groupBy("rec").agg(F.sum("y").alias("positives"))
    fit = fitter(rules, model, **how)
    held = stash(ln.out_of_fold(train.join(ln.fold_groups(positives, rules.folds), "rec"), used, fit, rules.folds), "held")
    best = ev.best_threshold(held, rules.beta, "ends").first()
    final = fit(train, used)
    scored = stash(ln.score(final, test), "scored")
    report = {
        "event": event, "features": list(used), "threshold": best.threshold, "budget": budget_choice(held, marker, rules),
        "out_of_fold": ev.average_precision(held).first().asDict() | {"fbeta": best.fbeta},
        "test": ev.average_precision(scored).first().asDict() | ev.confusion(scored, best.threshold, rules.beta).first().asDict(),
        "events": event_report(scored, marker, best.threshold, rules), "parts": {r.part: r["count"] for r in parts.groupBy("part").count().collect()},
    }
    return final, report


def baselines(table: DataFrame, features: Sequence[str], events: dict[str, str], seeds: Sequence[int], out: str, rules: Rules = Rules(), model: Callable = ln.forest, space: dict[str, Sequence[Any]] | None = None, draws: int = 4, weights: Sequence[dict[str, Any]] = (), suggest: bool = False, **how) -> dict[str, Any]:
    """Baselines of every event (label to marker column) and seed, with their files below ``out``; returns the summary.

    For each: the split, settings drawn from ``space`` (or suggested, see :func:`tuned`) with their out-of-fold scores and the best of them, then
    ``weights`` of near and far negatives likewise, the threshold, and the report of the final fit on held-out recordings.
    The summary has means and deviations over the seeds by event.  Recordings to be tested take no part in a search.
    """
    spark, summary = table.sparkSession, {}
    for event, marker in events.items():
        reports = []
        for seed in seeds:
            ruled, chosen, at = replace(rules, seed=seed), dict(how), f"{out}/{event.lower()}_seed{seed}"
            rows = labelled(table, event).withColumns({c: present(F.col(c)) for c in features})
            parts = stash(partition(rows, ruled), "parts")
            sinks.write_table(parts, f"{at}/splits")
            if space or weights:
                train = rows.join(parts.where("part <> 'test'"), "rec")
                used = tb.varying(train, features)
                train = tb.impute(train, tb.fit_medians(train, used))
                positives = train.groupBy("rec").agg(F.sum("y").alias("positives"))
                train = stash(train.join(ln.fold_groups(positives, ruled.folds), "rec"), "search")
                if space:
                    best, ranked = tuned(train, used, space, draws, ruled, model, seed, **chosen) if suggest or any(isinstance(v, tuple) for v in space.values()) else search(train, used, drawn(space, draws, seed), ruled, model, **chosen)
                    chosen |= best
                    sinks.write_rows(ranked, spark, f"{at}/cv_candidates")
                    sinks.write_json(spark, best, f"{at}/best_params")
                own = {f.name for f in fields(Rules)}
                ruled, chosen = replace(ruled, **{k: v for k, v in chosen.items() if k in own}), {k: v for k, v in chosen.items() if k not in own}
                if weights:
                    best, ranked = search(train, used, weights, ruled, model, **chosen)
                    ruled = replace(ruled, **best)
                    sinks.write_rows(ranked, spark, f"{at}/dw_candidates")
                    sinks.write_json(spark, best, f"{at}/best_dw")
            final, report = baseline(table, features, event, marker, ruled, model, **chosen)
            sinks.write_json(spark, {"threshold": report["threshold"], "budget": report["budget"]}, f"{at}/threshold")
            sinks.write_json(spark, report, f"{at}/test_report")
            final.write().overwrite().save(f"{at}/model")
            reports.append({k: report[k] for k in ("threshold", "out_of_fold", "test", "events")})
        summary[event] = across(reports)
    sinks.write_json(spark, summary, f"{out}/summary")
    return summary
