import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import events as ev
from loomspark.operators import features as ft
from loomspark.operators import learning as ln
from loomspark.operators import resample as rs
from loomspark.operators import tables as tb
from loomspark.operators import windows as wn


def skipping(x, a):
    return pd.Series(x).ewm(alpha=a, adjust=False, ignore_na=True).mean().where(pd.Series(x).notna()).to_numpy()


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    data = []
    for rec in range(3):
        t = np.sort(rng.uniform(0, 500, 200))
        v = np.where(rng.random(200) < 0.2, np.nan, rng.normal(0, 3, 200))
        v[:5] = np.nan if rec == 1 else v[:5]
        data += [(rec, float(a), None if b != b else float(b)) for a, b in zip(t, v)]
    return spark.createDataFrame(data, "rec int, s double, v double"), data


@pytest.mark.parametrize("chunk", [7.0, 1e9])
def test_average_over_chunks(readings, chunk):
    df, data = readings
    got = rs.ema(df, "v", 0.3, "m", chunk=chunk).orderBy("rec", "s").toPandas()
    want = np.concatenate([skipping([b if b is not None else np.nan for r, _, b in data if r == rec], 0.3) for rec in range(3)])
    np.testing.assert_allclose(got.m.to_numpy(float), want, rtol=1e-12, atol=1e-12)


def test_average_is_causal(readings):
    df, _ = readings
    whole = rs.ema(df, "v", 0.3, "m", chunk=50.0).where("s < 200").orderBy("rec", "s").toPandas()
    head = rs.ema(df.where("s < 200"), "v", 0.3, "m", chunk=50.0).orderBy("rec", "s").toPandas()
    pd.testing.assert_frame_equal(whole, head)


def test_variance(readings):
    df, data = readings
    got = rs.ema_variance(df, "v", 0.3, "q").orderBy("rec", "s").toPandas()
    want = []
    for rec in range(3):
        m = q = None
        for r, _, x in data:
            if r != rec:
                continue
            if x is None:
                want.append(np.nan)
                continue
            m = x if m is None else 0.3 * x + 0.7 * m
            q = 0.0 if q is None else 0.3 * (x - m) ** 2 + 0.7 * q
            want.append(q)
    np.testing.assert_allclose(got.q.to_numpy(float), want, rtol=1e-9, atol=1e-12)


def test_gravity(spark):
    rows = spark.createDataFrame([(1, float(i), 0.0, 0.0, 9.81) for i in range(20)], "rec int, s double, ax double, ay double, az double")
    got = rs.gravity_aligned(rows, 1.0).toPandas()
    assert np.allclose(got.avert, 0) and np.allclose(got.ahoriz, 0)


def test_pressure_first_difference_is_repeated(spark):
    rows = spark.createDataFrame([(1, float(i), 1000.0 + i) for i in range(4)], "rec int, s double, p double")
    got = rs.pressure_trend(rows, 1.0).orderBy("s").toPandas()
    assert got.p_ema30_dt1[0] == got.p_ema30_dt1[1] and got.p_ema30_dt1.notna().all()


def test_resample_holds_and_lets_go(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in [(0.0, 1.0), (1.0, 2.0), (1.0, 4.0), (2.0, float("nan")), (3.0, 5.0), (20.0, 6.0)]], "rec int, t double, v double")
    got = {r.bin: r for r in rs.resample(rows, 1.0).collect()}
    assert (got[1].v, got[1].obs) == (3.0, True)  # equal times first become one reading
    assert (got[2].v, got[2].obs) == (3.0, False)
    assert got[8].v == 5.0 and got[9].v is None  # the median step is 1: five seconds after the last reading
    assert got[20].v == 6.0
    assert {r.bin: r.v for r in rs.resample(rows, 1.0, fill=False).collect()}[2] is None


def test_windows_are_closed_and_fit_exactly(spark):
    g = (wn.Grid("base", 0, 10.0, 5.0),)
    ends = spark.createDataFrame([(1, 0.0, 20.0), (2, 0.0, 9.0)], "rec int, start double, stop double")
    assert [(r.rec, r.ws, r.we) for r in wn.hop_windows(ends, g).orderBy("ws").collect()] == [(1, 0.0, 10.0), (1, 5.0, 15.0), (1, 10.0, 20.0)]
    samples = spark.createDataFrame([(1, float(i)) for i in range(21)], "rec int, s double")
    assert {r.k: r["count"] for r in wn.windowed(samples, ends, g).groupBy("k").count().collect()} == {0: 11, 1: 11, 2: 11}


def test_spectrum_matches_the_plain_transform():
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    got = ft.spectrum(x, 20.0, ft.BANDS)
    n = np.arange(40)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * n / 39)
    y = (x - x.mean()) * w
    power = np.array([abs(np.sum(y * np.exp(-2j * np.pi * k * n / 40))) ** 2 for k in range(21)])
    f = np.arange(21) * 0.5
    np.testing.assert_allclose(got[:5], [power[(f >= a) & (f < b)].sum() / power.sum() for a, b in ft.BANDS])
    assert got[5] == f[1:][power[1:].argmax()]
    assert ft.spectrum(x[:7], 20.0, ft.BANDS) == [None] * 8
    assert ft.spectrum(x[:12], 20.0, ft.BANDS)[5:] == [None] * 3


def plain_triggers(points, threshold, k, cooldown):
    best = {}
    for t, p in points:
        p = float("-inf") if p is None or p != p else p
        best[t] = max(p, best.get(t, float("-inf")))
    out, run, last = [], 0, float("-inf")
    for t in sorted(best):
        if t - last < cooldown:
            run = 0
        elif best[t] >= threshold:
            run += 1
            if run >= k:
                out.append(t)
                run, last = 0, t
        else:
            run = 0
    return out


@pytest.mark.parametrize("k,cooldown", [(1, 0.0), (1, 7.0), (2, 5.0), (3, 30.0)])
def test_triggers(spark, k, cooldown):
    rng = np.random.default_rng(k)
    points = [(r, float(t), None if u < 0.05 else float(u)) for r in range(4) for t, u in zip(rng.integers(0, 300, 250), rng.random(250))]
    df = spark.createDataFrame(points, "rec int, t double, p double")
    got = ev.triggers(df, 0.6, k, cooldown).collect()
    for r in range(4):
        assert sorted(x.t for x in got if x.rec == r) == plain_triggers([(t, p) for q, t, p in points if q == r], 0.6, k, cooldown)
    swept = ev.sweep(df, [0.6], k, cooldown).collect()
    assert {(x.rec, x.t) for x in swept} == {(x.rec, x.t) for x in got}


def test_triggers_of_a_long_recording_and_odd_keys(spark):
    """One recording with most of the scores, over many batches, and one without a name; several thresholds at once."""
    rng = np.random.default_rng(5)
    points = [("long", float(t), float(u)) for t, u in zip(range(30_000), rng.random(30_000))] + [(None, 1.0, 0.9), ("", 5.0, 1.0)]
    got = ev.sweep(spark.createDataFrame(points, "rec string, t double, p double"), [0.0, 0.9, 0.5], 3, 7.0).collect()
    for x in (0.0, 0.5, 0.9):
        assert sorted(r.t for r in got if r.rec == "long" and r.threshold == x) == plain_triggers([(t, p) for r, t, p in points if r == "long"], x, 3, 7.0)
    one = ev.triggers(spark.createDataFrame(points, "rec string, t double, p double"), 0.8).where("rec is null or rec = ''").collect()
    assert {(r.rec, r.t) for r in one} == {(None, 1.0), ("", 5.0)}


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.25, 0.9, 1.0], [i / 40 for i in range(41)]])
def test_quantiles_of_keys(spark, shares):
    rng = np.random.default_rng(6)
    values = {"hot": rng.normal(size=6000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]), "none": np.array([])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r.key: (r.n, r.q) for r in tb.quantiles(df, "v", shares, "key").collect()}
    assert set(got) == {"hot", "ties", "one", None} and got[None] == (2, pytest.approx([1 + s for s in shares]))
    for k in ("hot", "ties", "one"):
        assert got[k][0] == len(values[k]) and np.allclose(got[k][1], np.quantile(values[k], shares), rtol=0, atol=1e-12)
    whole = tb.quantiles(df.where("key = 'hot'"), "v", shares).collect()
    assert len(whole) == 1 and whole[0].q == got["hot"][1] and tb.quantiles(df.limit(0), "v", shares).count() == 0


def test_matches_as_by_all_pairs(spark):
    rng = np.random.default_rng(7)
    segs = [(r, i, float(t)) for r in range(5) for i, t in enumerate(rng.integers(0, 200, 12))] + [(1, 12, None)]
    fires = [(r, float(t)) for r in range(4) for t in rng.integers(0, 200, 9)]
    got = ev.matches(spark.createDataFrame(segs, "rec int, seg int, t_ref double"), spark.createDataFrame(fires, "rec int, t double"), 10.0).collect()
    assert len(got) == len(segs)
    for r in got:
        near = [t - r.t_ref for q, t in fires if q == r.rec] if r.t_ref is not None else []
        nearest = min(near, key=lambda d: (abs(d), d), default=None)
        after = min((d for d in near if d >= 0), default=None)
        assert (r.delay_nearest, r.delay_after, r.triggered) == (nearest, after, r.rec < 4)
        assert r.hit == (nearest is not None and abs(nearest) <= 10) and r.hit_after == (after is not None and after <= 10)


def test_streaming_equals_batch(spark, tmp_path):
    from loomspark.streaming import stateful

    rng = np.random.default_rng(9)
    schema = "rec int, ts timestamp, p double"
    rows = [(r, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(t))).to_pydatetime(), float(u)) for r in range(3) for t, u in zip(range(0, 200, 2), rng.random(100))]
    for i, (a, b) in enumerate([(0, 40), (40, 41), (41, 100)]):
        part = [x for r in range(3) for x in rows[r * 100 + a : r * 100 + b]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Scores wait for the watermark, which a later score of another recording moves.
    spark.createDataFrame([(99, pd.Timestamp("2024-03-01").to_pydatetime(), 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.triggers(stream, 0.6, 2, 10.0, late="1 hour").writeStream.format("memory").queryName("fired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.rec, r.t) for r in spark.table("fired").collect()}
    batch = spark.createDataFrame(rows, schema).select("rec", (F.unix_micros("ts") / 1e6).alias("t"), "p")
    assert got == {(r.rec, r.t) for r in ev.triggers(batch, 0.6, 2, 10.0).collect()}


def test_metrics_edge_cases(spark):
    same = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    r = ev.average_precision(same).first()
    assert (r.pr_auc, r.roc_auc) == (0.5, 0.5)
    none = spark.createDataFrame([(0.5, 0)], "p double, y int")
    assert ev.average_precision(none).first().roc_auc is None


def test_split_and_folds(spark):
    groups = spark.createDataFrame([(i, float(i), i % 4) for i in range(10)], "rec int, hours double, positives int")
    parts = {r.rec: r.part for r in ln.split_groups(groups).collect()}
    assert [sum(p == x for p in parts.values()) for x in ("train", "val", "test")] == [5, 2, 3]
    assert {r for r, p in parts.items() if p == "test"} == {7, 8, 9}
    folds = ln.fold_groups(groups, 3)
    assert folds.count() == 10 and not ln.leaks(folds.where("fold = 0"), folds.where("fold = 1"))
    assert ln.split_sizes(1, 0.2, 0.3) == (0, 1) and ln.split_sizes(0, 0.2, 0.3) == (0, 0)


def test_gru_and_temperature(spark):
    rng = np.random.default_rng(0)
    h, n = 3, 2
    weights = {"w_ih_0": rng.normal(size=(3 * h, n)), "w_hh_0": rng.normal(size=(3 * h, h)), "b_ih_0": rng.normal(size=3 * h), "b_hh_0": rng.normal(size=3 * h), "w_1": rng.normal(size=(4, h)), "b_1": np.zeros(4), "w_2": rng.normal(size=(2, 4)), "b_2": np.zeros(2)}
    x = rng.normal(size=(2, 5, n))
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "i int, x array<array<double>>")
    got = np.array([r.p for r in ln.gru_scores(df, weights).orderBy("i").collect()])
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-ln.gru(x, weights))))
    assert got.shape == (2, 2)
    z = rng.normal(size=4000) * 3
    y = rng.random(4000) < 1 / (1 + np.exp(-z / 2))
    assert abs(ln.temperature(z, y) - 2) < 0.3


def test_weights_and_samples(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0), float(i)) for i in range(50)], "id int, y int, d double")
    assert tb.undersample(df, "y", 2, "id").count() == 30
    assert tb.undersample(df.where("y = 0"), "y", 2, "id").count() == 40
    assert tb.oversample(df, "y", 3).count() == 70
    w = tb.distance_weights(df, "y", "d", 5, 20, 0.5, 0.1).toPandas()
    assert abs(w[w.y == 1].weight.sum() - w[w.y == 0].weight.sum()) < 1e-9
