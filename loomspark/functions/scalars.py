"""Column expressions shared by the operators.  NULL is the only missing value: see :func:`present`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a second, and the sampling rates that count as plausible.
UNITS = (("s", 1.0), ("ms", 1e3), ("us", 1e6), ("ns", 1e9))
RATE = (0.5, 200.0)


def present(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def seconds(ts: str) -> Column:
    """A timestamp (with or without a zone; the session's zone is UTC) as seconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def number(text: Column) -> Column:
    """A number as a plain decimal or exponent form; suffixes and hexadecimal forms are no numbers."""
    plain = F.trim(text).rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")
    return F.when(plain, F.expr("1") * F.trim(text).try_cast("double"))


def unit_from_step(step: Column) -> Column:
    """The first unit in which a median step is a plausible sampling rate; NULL if there is none."""
    out = F.lit(None).cast("string")
    for name, scale in reversed(UNITS):
        rate = scale / step
        out = F.when((step > 0) & (rate >= RATE[0]) & (rate <= RATE[1]), name).otherwise(out)
    return out


def unit_from_size(largest: Column) -> Column:
    """A unit from the size of epoch times; milliseconds for none at all."""
    return (
        F.when(largest.isNull(), "ms")
        .when(largest > 1e15, "ns")
        .when(largest > 1e12, F.when((largest > 1.4e12) & (largest < 2.5e12), "ms").otherwise("ns"))
        .when(largest > 1e9, F.when((largest > 1.4e9) & (largest < 2e9), "s").otherwise("ms"))
        .when(largest > 1e6, "ms")
        .otherwise("s")
    )


def per_second(unit: Column) -> Column:
    out = F.lit(1.0)
    for name, scale in UNITS[1:]:
        out = F.when(unit == name, scale).otherwise(out)
    return out


def altitude(p: Column, p0: Column) -> Column:
    """Barometric altitude in metres above the level of pressure ``p0``."""
    return 44330.0 * (1 - F.pow(F.least(F.greatest(p / p0, F.lit(1e-6)), F.lit(100.0)), F.lit(1 / 5.255)))


def round6(c: Column) -> Column:
    """Six decimals, halves to even."""
    return F.bround(c * 1e6, 0) / 1e6


def ratio(a: Column, b: Column) -> Column:
    """a / b between 0 and 100; NULL if b is below 1e-9 or either is missing."""
    return F.when(b >= 1e-9, F.least(F.greatest(a / b, F.lit(0.0)), F.lit(100.0)))


def first_of(df: DataFrame, names: Sequence[str]) -> Column | None:
    """The first of these columns that the frame has."""
    return next((F.col(n) for n in names if n in df.columns), None)


def detect_time(df: DataFrame) -> Column | None:
    """When a window's result is known."""
    return first_of(df, ("t_end", "t_anchor", "t_center"))


def label_time(df: DataFrame) -> Column | None:
    """The time that a window's label refers to."""
    return first_of(df, ("t_anchor", "t_center"))


def distance(df: DataFrame, which: str = "auto") -> Column:
    """Seconds to an event; 1e9 where unknown.

    ``which``: "event" is the distance to the nearest event, "min" the least of those to a takeoff and a landing, and
    "auto" the first of the two that the frame has columns for.
    """
    if which not in ("auto", "event", "min"):
        raise ValueError(f"no distance {which!r}")
    c = first_of(df, ("dist_to_event",)) if which != "min" else None
    if c is None and which != "event":
        found = [F.abs(F.col(n)) for n in ("dist_to_takeoff", "dist_to_landing") if n in df.columns]
        c = F.least(*found) if len(found) > 1 else found[0] if found else None
    if c is None:
        c = F.lit(None).cast("double")
    return F.coalesce(F.abs(present(c)), F.lit(1e9))


def score_or_least(p: Column) -> Column:
    """A missing score is lower than any."""
    return F.coalesce(present(p), F.lit(float("-inf")))
