"""Every query with SQL gives the rows of that SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomspark.plans.catalog import FLAGSHIP, ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_it_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_halves_of_the_last_digit(spark, tmp_path):
    """Recordings whose mean or kurtosis is half of the fifth digit, or a hair from it, are rounded as the SQL rounds them."""
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT event_id + shift * 100000 AS event_id, ts, user_id, event_type, value FROM '/root/testdata/sf0.1/events.parquet' JOIN (VALUES (729, 5), (624, 6), (562, 5), (964, 1)) t(user_id, shift) USING (user_id)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = QUERIES["sensor_features"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["sensor_features"]).df()
    assert {3.15313, 2.34687} <= set(want.ay_mean) and {-1.21937, -0.94042} <= set(want.ay_kurt)
    assert rows(got) == rows(want)
