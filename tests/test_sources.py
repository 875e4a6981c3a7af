import json

from pyspark.sql import functions as F

from loomspark.functions import scalars
from loomspark.sources import recordings as rec
from loomspark.sources import sinks

TEXT = """Takeoff;1700000001000
Takeoff;1700000002000
Landing;1700000009000
mer data 1
a;b
1;2;3

1700000000000:1:2:3
1700000000050:1:2
1700000000100:1.0d:2:3
1700000000150:1e0:2:-3.5
1700000000500:1013.25
"""


def lines(spark, text):
    return spark.createDataFrame([("r", text)], "rec string, value string").select("rec", F.posexplode(F.split("value", "\n")).alias("line", "text"))


def test_text_lines(spark):
    got = rec.parse_text(lines(spark, TEXT)).orderBy("line").collect()
    assert [(r.kind, r.name, r.ts) for r in got] == [
        ("marker", "Takeoff", 1700000001000.0), ("marker", "Takeoff", 1700000002000.0), ("marker", "Landing", 1700000009000.0),
        ("accel", None, 1700000000000.0), ("accel", None, 1700000000150.0), ("baro", None, 1700000000500.0),
    ]


def test_recordings_in_seconds(spark):
    accel, baro, marks = rec.recordings(rec.parse_text(lines(spark, TEXT)))
    assert sorted(r.t for r in accel.collect()) == [1700000000.0, 1700000000.15]
    assert baro.first().p == 1013.25
    assert {r["name"]: r.t for r in marks.collect()} == {"Takeoff": 1700000002.0, "Landing": 1700000009.0}


def test_one_bad_marker_voids_all(spark):
    assert rec.recordings(rec.parse_text(lines(spark, TEXT + "Landing;1700000999000\n")))[2].count() == 0


def test_csv(spark):
    rows = spark.createDataFrame([("r", "1", "2", "x", "3"), ("r", None, "2", "x", "3"), ("r", "2", "", "", "nan?")], "rec string, Time string, P string, Event string, other string")
    got = {(r.kind, r.ts) for r in rec.parse_csv(rows).collect()}
    assert got == {("marker", 1.0), ("baro", 1.0)}
    assert rec.parse_csv(rows.drop("P", "Event")) is None


def test_units(spark):
    sizes = [None, 5.0, 2e6, 1.5e9, 3e9, 1.5e12, 1e13, 2e15]
    df = spark.createDataFrame([(x,) for x in sizes], "x double")
    assert [r.u for r in df.select(scalars.unit_from_size(F.col("x")).alias("u")).collect()] == ["ms", "s", "ms", "s", "ms", "ms", "ns", "ns"]
    df = spark.createDataFrame([(0.05,), (2.0,), (50.0,), (5e4,), (1e12,)], "x double")
    assert [r.u for r in df.select(scalars.unit_from_step(F.col("x")).alias("u")).collect()] == ["s", "s", "ms", "us", None]  # 500 readings a second in ms look like seconds


def test_discover(spark, tmp_path):
    (tmp_path / "nonflight" / "deep").mkdir(parents=True)
    (tmp_path / "nonflight" / "deep" / "a.txt").write_text("1:2\r\n2:3")
    (tmp_path / "features_raw.csv").write_text("x")
    got = rec.discover(spark, str(tmp_path)).withColumn("domain", rec.domain()).collect()
    assert [(r.line, r.text, r.domain) for r in got] == [(0, "1:2", "nonflight"), (1, "2:3", "nonflight")]


def test_sinks(spark, tmp_path):
    sinks.write_json(spark, {"a": float("nan"), "b": [1.5, float("inf")]}, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"a": None, "b": [1.5, None]}
    df = spark.createDataFrame([("flight", 1.0)], "domain string, pow_0p3_1p0 double")
    sinks.write_features(df, str(tmp_path / "f"), csv=True)
    assert sinks.read_features(spark, str(tmp_path / "f")).first().pow_0p3_1p0 == 1.0
    assert spark.read.option("header", True).csv(str(tmp_path / "f/csv")).columns == ["domain", "pow_0.3_1.0"]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.present(F.lit(float("nan"))).alias("nan"), scalars.ratio(F.lit(1.0), F.lit(1e-10)).alias("tiny"), scalars.ratio(F.lit(500.0), F.lit(1.0)).alias("big"),
        scalars.round6(F.lit(0.0000005)).alias("even"), scalars.altitude(F.lit(1000.0), F.lit(1000.0)).alias("h"),
    ).first()
    assert (row.nan, row.tiny, row.big, row.even, row.h) == (None, None, 100.0, 0.0, 0.0)
