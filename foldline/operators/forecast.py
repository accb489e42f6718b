"""Per-series forecasting (FCT-01/02, SRC-08) for many series at once.

Each series is one ``applyInPandas`` group (a daily series is bounded by its number of
days, not by the table size); the holdout split and error metric are DataFrame ops.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 7
HORIZON = 14
MIN_ROWS = 21
GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def daily_series(df: DataFrame, series: str, ts: Column, value: str, agg: str = "avg") -> DataFrame:
    """SRC-08: ``series, day, y`` — daily aggregate per series (parsed dates, sorted within series)."""
    fn = {"avg": F.avg, "sum": F.sum, "count": F.count}[agg]
    d = df.groupBy(F.col(series).alias("series"), F.to_date(ts).alias("day")).agg(fn(value).alias("y"))
    return d.repartition("series").sortWithinPartitions("series", "day")


def _errors(y: np.ndarray, smooth: np.ndarray, start: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and final states of the additive recursion for many candidates at once.

    ``smooth`` is (m, 3): alpha, beta, gamma; ``start`` is (m, 2 + period): level, trend, seasons. Errors are (m, n)."""
    a, b, g = smooth.T
    state = start.astype(float).copy()
    err = np.empty((len(state), len(y)))
    for t, v in enumerate(y):
        s = state[:, 2 + t % period]
        ahead = state[:, 0] + state[:, 1]
        err[:, t] = v - ahead - s
        level = a * (v - s) + (1 - a) * ahead
        state[:, 1] = b * (level - state[:, 0]) + (1 - b) * state[:, 1]
        state[:, 2 + t % period] = g * (v - level) + (1 - g) * s
        state[:, 0] = level
    return err, state


def _usual_start(y: np.ndarray, period: int) -> np.ndarray:
    level = y[:period].mean()
    trend = (y[period:2 * period].mean() - level) / period if len(y) >= 2 * period else 0.0
    return np.concatenate([[level, trend], y[:period] - level])


def _best_start(y: np.ndarray, smooth: np.ndarray, period: int) -> tuple[np.ndarray, float]:
    """The initial state with the least squared error for given smoothing, and that error: errors are linear in the state, so
    the recursion is run once on zeros and once per unit state, and a least-squares problem gives the best one."""
    k = 2 + period
    zero, _ = _errors(y, smooth[None], np.zeros((1, k)), period)
    unit, _ = _errors(y * 0, np.repeat(smooth[None], k, axis=0), np.eye(k), period)
    start, *_ = np.linalg.lstsq(unit.T, -zero[0], rcond=1e-10)
    err, _ = _errors(y, smooth[None], start[None], period)
    return start, float((err ** 2).sum())


def holt_winters_fit(y: np.ndarray, period: int = PERIOD, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """``(alpha beta gamma, initial state, squared error)``: the best point of a grid (all points together, usual initial state), then
    a compass search within [0, 1] with the best initial state at every point. Never worse than the grid."""
    grid = np.array(np.meshgrid(GRID, GRID, GRID)).reshape(3, -1).T
    start = _usual_start(y, period)
    err, _ = _errors(y, grid, np.repeat(start[None], len(grid), axis=0), period)
    sse = (err ** 2).sum(axis=1)
    best = grid[int(sse.argmin())]
    found, least = _best_start(y, best, period)
    if not least <= sse.min():
        found, least = start, float(sse.min())
    step = 0.2
    while step > tol:
        moved = False
        for i in range(3):
            for sign in (1, -1):
                trial = best.copy()
                trial[i] = min(1.0, max(0.0, trial[i] + sign * step))
                if trial[i] == best[i]:
                    continue
                s0, v = _best_start(y, trial, period)
                if v < least * (1 - 1e-12):
                    best, found, least, moved = trial, s0, v, True
        if not moved:
            step /= 2
    return best, found, least


def holt_winters_forecast(y: np.ndarray, smooth: np.ndarray, start: np.ndarray, period: int = PERIOD, horizon: int = HORIZON) -> np.ndarray:
    _, state = _errors(y, np.asarray(smooth, dtype=float)[None], np.asarray(start, dtype=float)[None], period)
    level, trend, season = state[0, 0], state[0, 1], state[0, 2:]
    return np.array([level + (h + 1) * trend + season[(len(y) + h) % period] for h in range(horizon)])


def holt_winters_holdout(series: DataFrame, horizon: int = HORIZON, period: int = PERIOD) -> DataFrame:
    """FCT-01: ``series, n, mae, alpha, beta, gamma, sse`` per series: fitted on all but the last ``horizon`` days, MAE on the rest.

    A series (its days) is one array; a task fits the series of a batch one after the other."""
    arrays = _arrays(series)

    def fit(batches):
        for pdf in batches:
            rows = []
            for name, y in zip(pdf["series"], pdf["y"]):
                y = np.asarray(y, dtype=float)
                if len(y) < max(MIN_ROWS, horizon + 2 * period):
                    rows.append((name, len(y), *[None] * 5))
                    continue
                smooth, start, sse = holt_winters_fit(y[:-horizon], period)
                ahead = holt_winters_forecast(y[:-horizon], smooth, start, period, horizon)
                rows.append((name, len(y), float(np.abs(y[-horizon:] - ahead).mean()), *map(float, smooth), sse))
            yield pd.DataFrame(rows, columns=["series", "n", "mae", "alpha", "beta", "gamma", "sse"])

    return arrays.mapInPandas(fit, "series string, n long, mae double, alpha double, beta double, gamma double, sse double")


def _arrays(series: DataFrame) -> DataFrame:
    """``series, y``: the values of a series in day order (as many as it has days)."""
    s = series.select(F.col("series").cast("string").alias("series"), "day", F.col("y").cast("double").alias("y"))
    g = s.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("day", "y"))).alias("v"))
    return g.select("series", F.transform("v", lambda x: x["y"]).alias("y"))


def holt_winters_fixed(series: DataFrame, alpha: float, beta: float, gamma: float, period: int = PERIOD) -> DataFrame:
    """``series, n, sse, level, trend``: the recursion with given smoothing from the usual initial state, in built-in functions."""
    d = _arrays(series).where(F.size("y") >= 2 * period)
    mean = lambda lo: F.aggregate(F.slice("y", lo + 1, period), F.lit(0.0), lambda a, v: a + v) / period
    d = d.withColumn("_l", mean(0)).withColumn("_t", (mean(period) - F.col("_l")) / period)
    first = F.struct(F.lit(0).alias("i"), F.col("_l").alias("level"), F.col("_t").alias("trend"),
                     F.transform(F.slice("y", 1, period), lambda v: v - F.col("_l")).alias("season"), F.lit(0.0).alias("sse"))

    def step(acc, v):
        at = acc["i"] % period
        s = F.element_at(acc["season"], at + 1)
        ahead = acc["level"] + acc["trend"]
        level = alpha * (v - s) + (1 - alpha) * ahead
        new = gamma * (v - level) + (1 - gamma) * s
        return F.struct((acc["i"] + 1).alias("i"), level.alias("level"),
                        (beta * (level - acc["level"]) + (1 - beta) * acc["trend"]).alias("trend"),
                        F.transform(acc["season"], lambda x, i: F.when(i == at, new).otherwise(x)).alias("season"),
                        (acc["sse"] + (v - ahead - s) * (v - ahead - s)).alias("sse"))

    out = d.withColumn("_s", F.aggregate("y", first, step))
    return out.select("series", F.size("y").cast("long").alias("n"), "_s.sse", "_s.level", "_s.trend")


def seasonal_naive_holdout(series: DataFrame, horizon: int = HORIZON, period: int = PERIOD,
                           keys: Sequence[str] = ("series",)) -> DataFrame:
    """FCT-02: last ``horizon`` rows per series held out; forecast = value one season before the cut
    at the same phase; ``series, n_test, mae``. Windows are per series (bounded by its length)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("day").desc())
    r = series.withColumn("_back", F.row_number().over(w))  # 1 = last day
    test = r.where(F.col("_back") <= horizon)
    # step h (1..horizon) from the cut uses the training value at back = horizon + period - ((h-1) % period)
    test = test.withColumn("_h", F.lit(horizon) - F.col("_back") + 1)
    test = test.withColumn("_src", F.lit(horizon + period) - ((F.col("_h") - 1) % period))
    src = r.select(*keys, F.col("_back").alias("_src"), F.col("y").alias("_fc"))
    j = test.join(src, keys + ["_src"], "left")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_test"),
                                F.avg(F.abs(F.col("y") - F.col("_fc"))).alias("mae"))
