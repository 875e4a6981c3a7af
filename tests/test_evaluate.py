import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import learning as ln
from loomspark.operators import tables as tb
from loomspark.plans import evaluate as e
from loomspark.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for rec in range(12):
        quiet = rec >= 8
        mark = None if quiet else 300.0
        for i in range(120):
            t = 10.0 * i
            y = not quiet and 290 <= t <= 360
            rows.append((f"r{rec:02d}", "base", t, "nonflight" if quiet else "flight", "TAKEOFF" if y else "OTHER", mark, None if quiet else abs(t - 300.0), float(rng.normal() + 4 * y), None if rng.random() < 0.1 else float(rng.normal()), 1.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rec", "grid", "t_end", "domain", "label", "t_takeoff", "dist_to_event", "a", "b", "c"]))


@pytest.mark.parametrize("model,how", [(ln.forest, {"trees": 8, "depth": 4}), (ln.boosted, {"trees": 4, "depth": 3})])
def test_baseline(spark, table, tmp_path, model, how):
    rules = e.Rules(folds=3, hit_window=120.0, least_hours=0.1, budget=5.0, candidates=32)
    final, report = e.baseline(table, ["a", "b", "c"], "TAKEOFF", "t_takeoff", rules, model, **how)
    assert report["features"] == ["a", "b"]
    assert report["parts"] == {"train": 6, "val": 3, "test": 3}
    assert report["test"]["pr_auc"] > 0.7 and 0 <= report["threshold"] <= 1
    assert report["events"]["triggers"]["n_events"] == 2 and report["budget"]["by"] == "budget"
    sinks.write_json(spark, report, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value)["event"] == "TAKEOFF"
    final.write().overwrite().save(str(tmp_path / "model"))


def test_few_quiet_hours_fall_back(table):
    rows = e.labelled(table, "TAKEOFF").withColumnRenamed("a", "p")
    assert e.budget_choice(rows, "t_takeoff", e.Rules(least_hours=1e9))["by"] == "fbeta"


def test_drawn_settings():
    space = {"trees": [4, 8], "depth": [2, 3, 4]}
    got = e.drawn(space, 4, first=[{"trees": 8, "depth": 3}])
    assert got[0] == {"trees": 8, "depth": 3} and len({tuple(sorted(g.items())) for g in got}) == 4
    assert got == e.drawn(space, 4, first=[{"trees": 8, "depth": 3}]) and len(e.drawn(space, 50)) == 6


def test_search(table):
    rows = e.labelled(table, "TAKEOFF").fillna(0.0, ["b"])
    positives = rows.groupBy("rec").agg({"y": "sum"}).withColumnRenamed("sum(y)", "positives")
    train = rows.join(ln.fold_groups(positives, 3), "rec")
    settings = [{"depth": 1, "w_far": 0.2}, {"depth": 3, "w_far": 1.0}]
    best, ranked = e.search(train, ["a", "b"], settings, e.Rules(folds=3), trees=4)
    assert best in settings and len(ranked) == 2 and ranked[0]["pr_auc"] >= ranked[1]["pr_auc"] > 0.3
    with pytest.raises(ValueError):
        e.search(train, ["a"], [])


def test_across():
    got = e.across([{"a": {"x": 1.0, "s": "q"}, "n": 2}, {"a": {"x": 3.0, "s": "q"}, "n": 2}])
    assert got == {"a.x": {"mean": 2.0, "std": 1.0}, "n": {"mean": 2.0, "std": 0.0}} and e.across([]) == {}


def test_positions(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id", "id % 10 as g")
    got = {r.id: r.place for r in tb.positions(rows, F.desc("g"), F.col("id"), name="place").collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [got[i] for i in want] == list(range(1000))
    assert tb.positions(rows.limit(0), F.col("id")).count() == 0


def test_suggested_settings_come_near_the_best():
    space = {"a": (0.0, 10.0), "b": (1e-4, 1.0, "log"), "c": ["x", "y", "z"], "d": [4]}
    value = lambda one: -((one["a"] - 7) ** 2) - (np.log10(one["b"]) + 2) ** 2 - (one["c"] != "y")
    best = lambda seen: max(v for _, v in seen)
    clever = [best(e.parzen(space, value, 60, seed)) for seed in range(10)]
    blind = [best(e.parzen(space, value, 60, seed, startup=60)) for seed in range(10)]
    assert np.mean(clever) > np.mean(blind) and np.median(clever) > -0.5
    seen = e.parzen(space, value, 30, 1, first=[{"a": 1.0, "b": 0.1, "c": "z", "d": 4}])
    assert seen[0][0] == {"a": 1.0, "b": 0.1, "c": "z", "d": 4} and seen == e.parzen(space, value, 30, 1, first=[seen[0][0]])
    assert all(0 <= one["a"] <= 10 and 1e-4 <= one["b"] <= 1 and one["c"] in space["c"] and one["d"] == 4 for one, _ in seen)
