"""The trigger state machine, the recursive average and the window scheduler on streams.

A recording's rows wait in its state until the watermark has passed them, and are then taken in the order of time: rows
that come late, but before the watermark, change nothing about the results; later ones are dropped by Spark.  An
event-time timer wakes a recording when the watermark passes the first waiting row, and, ``idle`` after its last row,
removes its state.  So the state holds what came within the lateness, and recordings that have ended cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspark.operators.events import Trigger
from loomspark.operators.windows import Grid

#: Rows of a result frame.
ROWS = 10_000

Step = Callable[[tuple, tuple | None, list[tuple[float, float]], bool], tuple[tuple | None, Iterator[tuple]]]


def _timed(rows: DataFrame, value: str, late: str, idle: float, step: Step, result: str, memory: str) -> DataFrame:
    """Runs ``step(key, memory, rows in order, ended)`` by ``rec``; it returns the memory and rows of the result.

    ``memory`` declares the columns of the step's memory, None before the first row.
    """
    rows = rows.withWatermark("ts", late).select("rec", "ts", (F.unix_micros("ts") / 1e6).alias("t"), F.col(value).cast("double").alias("__v"))

    none = tuple([] if "array" in c else 0.0 if c.endswith("double") else 0 for c in memory.split(", "))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = None, []
        if state.exists:
            times, values, last, started, *kept = state.get
            waiting, held = list(zip(times, values)), tuple(kept) if started else None
        else:
            last = float("-inf")
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [(float(t), float("nan") if v is None else float(v)) for t, v in zip(pdf["t"], pdf["__v"])]
        mark = state.getCurrentWatermarkMs()
        due = sorted((r for r in waiting if r[0] * 1000 <= mark), key=lambda r: r[0])
        waiting = [r for r in waiting if r[0] * 1000 > mark]
        last = max([last, *(t for t, _ in due)])
        ended = not waiting and (last + idle) * 1000 <= mark
        held, out = step(key, held, due, ended)
        if ended:
            state.remove()
        else:
            state.update(([t for t, _ in waiting], [v for _, v in waiting], last, held is not None, *(none if held is None else held)))
            wake = min(t for t, _ in waiting) if waiting else last + idle
            state.setTimeoutTimestamp(max(mark + 1, ceil(wake * 1000)))
        names, part = [c.split(" ")[0] for c in result.split(", ")], []
        for row in out:
            part.append((key[0], *row))
            if len(part) == ROWS:
                yield pd.DataFrame(part, columns=["rec", *names])
                part = []
        yield pd.DataFrame(part, columns=["rec", *names]).astype({c.split(" ")[0]: float for c in result.split(", ") if c.endswith("double")})

    kind = dict(rows.dtypes)["rec"]
    return rows.groupBy("rec").applyInPandasWithState(run, f"rec {kind}, {result}", f"times array<double>, vals array<double>, last double, started boolean, {memory}", "append", GroupStateTimeout.EventTimeTimeout)


def triggers(scores: DataFrame, threshold: float, k: int = 1, cooldown: float = 60.0, late: str = "1 minute", idle: float = 3600.0) -> DataFrame:
    """``rec, t`` of every trigger of a stream ``(rec, ts, p)``; ``ts`` is a timestamp, t its seconds.

    Equal times are collapsed to the highest score, a missing one being lower than any.  The memory of a recording is its
    run and last trigger.
    """

    def step(key: tuple, held: tuple | None, rows: list[tuple[float, float]], ended: bool) -> tuple[tuple, Iterator[tuple]]:
        machine = Trigger(threshold, k, cooldown, *(held or (0, float("-inf"))))
        best: dict[float, float] = {}
        for t, p in rows:
            best[t] = max(best.get(t, float("-inf")), float("-inf") if p != p else p)
        fired = [(t,) for t, p in best.items() if machine.step(t, p)]
        return (machine.run, float(machine.last)), iter(fired)

    return _timed(scores, "p", late, idle, step, "t double", "run long, fired double")


def ema(samples: DataFrame, a: float, late: str = "1 minute", idle: float = 3600.0) -> DataFrame:
    """``rec, t, v, m``: the recursive average of a stream ``(rec, ts, v)``; missing readings have none and change nothing."""

    def step(key: tuple, held: tuple | None, rows: list[tuple[float, float]], ended: bool) -> tuple[tuple | None, Iterator[tuple]]:
        m, out = held[0] if held else float("nan"), []
        for t, v in rows:
            if v == v:
                m = v if m != m else a * v + (1 - a) * m
            out.append((t, v if v == v else None, m if v == v else None))
        return (m, 0.0), iter(out)

    return _timed(samples, "v", late, idle, step, "t double, v double, m double", "m double, unused double")


def windows(samples: DataFrame, grids: Sequence[Grid], late: str = "1 minute", idle: float = 3600.0) -> DataFrame:
    """``rec, grid, grid_id, k, ws, we, n, mean, dt_prev_end`` of every window of a stream ``(rec, ts, v)``, once it is over.

    Times count from the recording's first sample, as in the batch tables; a window is over when a later sample than its
    end comes, or the recording has ended, and windows that are over together come by end, then by grid.  ``dt_prev_end``
    is the time since the end of the same grid's window before.  The memory holds the samples of the longest window and
    the next window of each grid; the empty windows of a gap are made one by one.
    """
    longest = max(g.win for g in grids)

    def over(due: list[int], now: float, closed: bool) -> Iterator[tuple[float, int, int, int]]:
        """The windows that are over at a time, by end and grid, counted off."""
        while True:
            nexts = [(round(due[i] * g.hop, 6) + g.win, g.grid_id, due[i], i) for i, g in enumerate(grids)]
            nexts = [x for x in nexts if (x[0] <= now + 1e-9 if closed else x[0] < now)]
            if not nexts:
                return
            found = min(nexts)
            due[found[3]] += 1
            yield found

    def step(key: tuple, held: tuple | None, rows: list[tuple[float, float]], ended: bool) -> tuple[tuple | None, Iterator[tuple]]:
        if held is None and not rows:
            return None, iter(())
        t0, now, times, values, due = held or (rows[0][0], float("-inf"), [], [], [0] * len(grids))
        times, values, due = list(times), list(values), list(due)

        def made(found: tuple[float, int, int, int]) -> tuple:
            we, grid_id, k, i = found
            g, ws = grids[i], round(k * grids[i].hop, 6)
            inside = [x for u, x in zip(times, values) if ws <= u <= we and x == x]
            return g.name, grid_id, k, ws, we, len(inside), sum(inside) / len(inside) if inside else None, g.hop if k else None

        out: list[tuple] = []
        for t, v in rows:
            s = t - t0
            out += map(made, over(due, s, False))
            now = s
            times.append(s)
            values.append(v)
            first = next(j for j, u in enumerate(times) if u >= s - longest)
            del times[:first], values[:first]
        if ended:
            out += map(made, over(due, now, True))
        return (t0, now, times, values, due), iter(out)

    result = "grid string, grid_id int, k long, ws double, we double, n long, mean double, dt_prev_end double"
    return _timed(samples, "v", late, idle, step, result, "t0 double, now double, recent array<double>, recent_vals array<double>, due array<long>")
