"""Seasonal and trend decomposition of bucketed series by robust LOESS.

Rows are summed a bucket in Spark; what is left, a number a period, is smoothed in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.operators.quantiles import quoted
from tablework.operators.series import autocorrelation, buckets, dickey_fuller_auto, partial_autocorrelation, smoothed_level, trend

#: Periods of a season, by unit.
SEASONS = {"month": 12, "quarter": 4, "week": 52, "day": 7, "year": 1}
#: Neighbours that the seasonal smoothing takes, and rounds of smoothing within and between the robust weights.
SEASONAL, INNER, OUTER = 7, 2, 15


def loess(y: np.ndarray, size: int, at: np.ndarray, robust: np.ndarray | None = None) -> np.ndarray:
    """Locally linear smoothing of y, whose places are 0, 1, ..., at the places given, over size neighbours.

    NaN where no neighbour has any weight.
    """
    n = len(y)
    own = min(size, n)
    first = np.clip(at - (size + 1) // 2 + 1, 0, n - own)
    near = first[:, None] + np.arange(own)[None, :]
    reach = np.maximum(at - first, first + own - 1 - at).astype(float) + max(0, size - n) // 2
    gap = np.abs(near - at[:, None])
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.where(gap <= 0.001 * reach[:, None], 1.0, (1 - (gap / reach[:, None]) ** 3) ** 3)
        w[gap > 0.999 * reach[:, None]] = 0.0
        if robust is not None:
            w = w * robust[near]
        w = w / w.sum(1, keepdims=True)
        middle = (w * near).sum(1)
        spread = (w * (near - middle[:, None]) ** 2).sum(1)
        tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - middle) / spread, 0.0)
        w = w * (1 + tilt[:, None] * (near - middle[:, None]))
    return (w * y[near]).sum(1)


def _smooth(y: np.ndarray, size: int, robust: np.ndarray | None = None) -> np.ndarray:
    out = loess(y, size, np.arange(len(y)), robust)
    return np.where(np.isnan(out), y, out)


def _seasonal(y: np.ndarray, period: int, size: int, robust: np.ndarray) -> np.ndarray:
    """Each place of the season smoothed over its own periods and carried on by one at both ends: 2 seasons longer than y."""
    out = np.zeros(len(y) + 2 * period)
    for k in range(period):
        own, weight = y[k::period], robust[k::period]
        found = loess(own, size, np.arange(-1, len(own) + 1), weight)
        found[1:-1] = np.where(np.isnan(found[1:-1]), own, found[1:-1])
        found[0], found[-1] = (found[1] if math.isnan(found[0]) else found[0]), (found[-2] if math.isnan(found[-1]) else found[-1])
        out[k::period] = found
    return out


def _average(y: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(y, np.full(size, 1 / size), "valid")


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) of a series, robust against outliers."""
    trend_size = math.ceil(1.5 * period / (1 - 1.5 / SEASONAL))
    trend_size += trend_size % 2 == 0
    low_size = period + 1 + (period % 2)
    trend, seasonal, robust = np.zeros(len(y)), np.zeros(len(y)), np.ones(len(y))
    for outer in range(OUTER + 1):
        for _ in range(INNER):
            cycle = _seasonal(y - trend, period, SEASONAL, robust)
            low = _average(_average(_average(cycle, period), period), 3)
            seasonal = cycle[period:-period] - _smooth(low, low_size)
            trend = _smooth(y - seasonal, trend_size, robust)
        if outer < OUTER:
            off = np.abs(y - trend - seasonal)
            most = 6 * float(np.median(off))
            if most > 0:
                robust = np.where(off <= 0.001 * most, 1.0, np.where(off <= 0.999 * most, (1 - (off / most) ** 2) ** 2, 0.0))
            else:
                robust = np.ones(len(y))
    return trend, seasonal


def decompose(df: DataFrame, date: str, value: str, unit: str = "month", period: int | None = None) -> DataFrame:
    """(at, y, trend, seasonal, rest) of the sums a period.

    period: how many make a season (by unit, see SEASONS). Without two whole seasons, or seasons of one period, there are no
    rows. Rows without a date don't count; a period of null values sums to 0.
    """
    season = period or SEASONS[unit]
    b = buckets(df, date, value, unit).select("at", "i", F.col("y").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("i")
        y = table["y"].to_numpy()
        if season > 1 and len(y) >= max(4, 2 * season):
            trend, seasonal = stl(y, season)
            yield pa.RecordBatch.from_arrays([table["at"].combine_chunks(), pa.array(y), pa.array(trend), pa.array(seasonal), pa.array(y - trend - seasonal)], ["at", "y", "trend", "seasonal", "rest"])

    return b.coalesce(1).mapInArrow(run, f"at {dict(b.dtypes)['at']}, y double, trend double, seasonal double, rest double")


def strengths(df: DataFrame, date: str, value: str, unit: str = "month", period: int | None = None) -> DataFrame:
    """One row: trend_strength and seasonal_strength, from 0 to 1, and how many periods they are of; nulls without a decomposition.

    Either is the share of variance that goes when trend, or season, is taken from itself and the rest.
    """
    parts = decompose(df, date, value, unit, period)
    share = lambda c: F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.var_samp("rest"), F.var_samp(F.col(c) + F.col("rest"))), F.lit(0.0)))
    found = lambda c: F.when(F.count(F.lit(1)) > 0, share(c)).alias(f"{c}_strength")
    return parts.agg(found("trend"), found("seasonal"), F.count(F.lit(1)).alias("periods"))


def time_series(df: DataFrame, date: str, values: list[str], unit: str = "month", alpha: float = 0.3) -> DataFrame:
    """One row a column: column, periods, slope, r2 and direction of its sums a period, adf_p_value and stationary, the lags of
    significant autocorrelation and partial autocorrelation, trend_strength and seasonal_strength, and forecast (the smoothed
    level, which holds for all periods to come).

    What needs more periods than there are is null or empty; autocorrelations go up to 12 lags or half the periods.
    """

    def one(column: str) -> DataFrame:
        rows = df.select(F.col(quoted(date)).alias("at"), F.col(quoted(column)).alias("v"))
        line = trend(rows, "at", "v", unit).withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").when(F.col("slope") == 0, "flat"))
        lags = lambda found, name: found.agg(F.sort_array(F.collect_list(F.when(F.col("significant"), F.col("lag")))).alias(name))
        count = buckets(rows, "at", "v", unit).agg(F.count(F.lit(1)).alias("periods"))
        test = dickey_fuller_auto(rows, "at", "v", unit).select(F.col("p_value").alias("adf_p_value"), "stationary")
        parts = [line, test, lags(autocorrelation(rows, "at", "v", unit), "acf_lags"), lags(partial_autocorrelation(rows, "at", "v", unit), "pacf_lags"), strengths(rows, "at", "v", unit).drop("periods"), smoothed_level(rows, "at", "v", unit, alpha).withColumnRenamed("level", "forecast")]
        whole = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, count)  # one row each
        return whole.select(F.lit(column).alias("column"), "periods", "slope", "r2", "direction", "adf_p_value", "stationary", "acf_lags", "pacf_lags", "trend_strength", "seasonal_strength", "forecast")

    return reduce(lambda a, b: a.unionByName(b), map(one, values))
