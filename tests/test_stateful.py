import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import events as ev
from loomspark.operators import resample as rs
from loomspark.operators import windows as wn
from loomspark.streaming import stateful

SCHEMA = "rec int, ts timestamp, v double"
GRIDS = (wn.Grid("base", 0, 10.0, 10.0), wn.Grid("to", 1, 12.0, 6.0))


END = (99, dt.datetime(2024, 3, 1), 0.0)  # another recording, long after: the watermark passes all others


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = []
    for rec in range(3):
        t = np.cumsum(rng.integers(1, 5, 80)) / 2.0 + (40 if rec == 1 else 0) * (np.arange(80) > 50)
        rows += [(rec, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=float(x)), None if u < 0.1 else float(u)) for x, u in zip(t, rng.random(80))]
    path = str(tmp_path_factory.mktemp("stream"))
    late = {7, 33, 34, 90, 171, 200}  # come a batch later than their neighbours
    batches = [[i for rec in range(3) for i in range(rec * 80 + a, rec * 80 + b)] for a, b in [(0, 30), (30, 31), (31, 80)]]
    batches = [[i for i in b if i not in late] for b in batches] + [sorted(late)]
    for b in batches:
        spark.createDataFrame([rows[i] for i in b], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([END], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def streamed(spark, path, operator, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = spark.table(name).toPandas()
    return got[got.rec != 99], left


def test_windows_as_they_end(spark, made):
    """Late rows included, and with the last windows, which end as the recording is given up; then its state is gone."""
    rows, path = made
    got, left = streamed(spark, path, lambda s: stateful.windows(s, GRIDS, "1 hour"), "ended")
    batch = spark.createDataFrame(rows, SCHEMA).select("rec", (F.unix_micros("ts") / 1e6).alias("t"), "v")
    ends = rs.spans(batch)
    zero = ends.select("rec", F.lit(0.0).alias("start"), (F.col("stop") - F.col("start")).alias("stop"))
    inside = wn.windowed(rs.zeroed(batch), ends, GRIDS).groupBy("rec", "grid", "k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    want = wn.hop_windows(zero, GRIDS).join(inside, ["rec", "grid", "k"], "left").fillna(0, ["n"]).toPandas()
    key = lambda d: {(r.rec, r.grid, r.k): (r.ws, r.we, r.n, None if np.isnan(r["mean"]) else round(r["mean"], 9)) for _, r in d.iterrows()}
    assert key(got) == key(want) and len(got) == len(want) and left == 1
    for _, g in got.groupby("rec"):
        assert list(zip(g.we, g.grid_id)) == sorted(zip(g.we, g.grid_id))


def test_average_of_a_stream(spark, made):
    rows, path = made
    got, left = streamed(spark, path, lambda s: stateful.ema(s, 0.3, "1 hour"), "averaged")
    got = got.sort_values(["rec", "t"])
    batch = spark.createDataFrame(rows, SCHEMA).select("rec", (F.unix_micros("ts") / 1e6).alias("s"), "v")
    want = rs.ema(batch, "v", 0.3, "m", chunk=20).orderBy("rec", "s").toPandas()
    np.testing.assert_allclose(got.m.to_numpy(float), want.m.to_numpy(float), rtol=1e-12)
    assert left == 1


def test_triggers_of_a_stream_with_late_rows(spark, made):
    rows, path = made
    for k, cooldown in ((1, 10.0), (2, 5.0)):
        got, _ = streamed(spark, path, lambda s: stateful.triggers(s.withColumnRenamed("v", "p"), 0.5, k, cooldown, "1 hour"), f"fired{k}")
        batch = spark.createDataFrame(rows, SCHEMA).select("rec", (F.unix_micros("ts") / 1e6).alias("t"), F.col("v").alias("p"))
        want = ev.triggers(batch, 0.5, k, cooldown).collect()
        assert {(r.rec, r.t) for r in want} == set(zip(got.rec, got.t)) and len(want) == len(got) > 10


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    for rows in ([(1, at(0), 1.0), (1, at(500), 2.0)], [(1, at(505), 3.0)], [(1, at(10), 100.0), (1, at(510), 4.0)], [END]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got, _ = streamed(spark, str(tmp_path), lambda s: stateful.ema(s, 0.5, "30 seconds"), "dropped")
    assert sorted(got.v) == [1.0, 2.0, 3.0, 4.0] and got.sort_values("t").m.tolist() == [1.0, 1.5, 2.25, 3.125]
