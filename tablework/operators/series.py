"""Trend, autocorrelation and smoothing of bucketed series: rows are summed a bucket first, and only buckets are ordered."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.operators.inference import regression
from tablework.operators.models import sums

# MacKinnon's polynomials for the test's p with a constant, lowest power first, below and above the given statistic,
# and the statistics beyond which p is 0 or 1.
DICKEY_FULLER_P = {"below": (2.1659, 1.4412, 0.038269), "above": (1.7339, 0.93202, -0.12745, -0.010368), "meet": -1.61, "least": -18.83, "most": 2.74}
# MacKinnon's response surface for the test with a constant, by level: limit, 1 / n, 1 / n^2, 1 / n^3.
DICKEY_FULLER = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}


def buckets(df: DataFrame, date: str, value: str, unit: str = "month") -> DataFrame:
    """(at, i, y): sums a period that has rows, numbered from 0 in time."""
    rows = df.where(F.col(date).isNotNull()).groupBy(F.date_trunc(unit, F.col(date)).alias("at")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("y"))
    return rows.withColumn("i", F.row_number().over(Window.orderBy("at")) - 1)  # one row a period


def trend(df: DataFrame, date: str, value: str, unit: str = "month") -> DataFrame:
    """Slope a period, intercept and r2 of the sums against their number."""
    return buckets(df, date, value, unit).agg(F.regr_slope("y", "i").alias("slope"), F.regr_intercept("y", "i").alias("intercept"), F.regr_r2("y", "i").alias("r2"))


def autocorrelation(df: DataFrame, date: str, value: str, unit: str = "month", lags: int = 12) -> DataFrame:
    """(lag, acf, significant) up to lags or half the periods; significant: beyond 2 / sqrt(n)."""
    b = buckets(df, date, value, unit)
    one = b.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop("y") * F.count(F.lit(1))).alias("s"))
    d = b.crossJoin(F.broadcast(one)).select("i", "n", "s", (F.col("y") - F.col("m")).alias("d"))  # one row
    order = Window.orderBy("i")
    pairs = d.select("n", "s", *((F.col("d") * F.lag("d", k).over(order)).alias(f"p{k}") for k in range(1, lags + 1)))
    sums = pairs.agg(F.max("n").alias("n"), F.max("s").alias("s"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)))
    rows = sums.select("n", F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(f"p{k}", "s").alias("acf")) for k in range(1, lags + 1)))))
    return rows.where(F.col("lag") <= F.floor(F.col("n") / 2)).select("lag", "acf", (F.abs("acf") > 2 / F.sqrt("n")).alias("significant"))


def partial_autocorrelation(df: DataFrame, date: str, value: str, unit: str = "month", lags: int = 12) -> DataFrame:
    """(lag, pacf, significant), from the autocorrelations by Durbin and Levinson's recursion; at most lags numbers reach the driver."""
    found = {r["lag"]: r["acf"] for r in autocorrelation(df, date, value, unit, lags).collect()}
    n = buckets(df, date, value, unit).count()
    rho = [1.0] + [found[k] for k in sorted(found)]
    before: list[float] = []
    out = []
    for k in range(1, len(rho)):
        if rho[k] is None:
            break
        below = 1 - sum(p * rho[j + 1] for j, p in enumerate(before))
        last = (rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(before))) / below if below else 0.0
        before = [p - last * before[k - 2 - j] for j, p in enumerate(before)] + [last]
        out.append((k, float(last), bool(abs(last) > 2 / n**0.5)))
    return df.sparkSession.createDataFrame(out, "lag int, pacf double, significant boolean")


def smoothed_level(df: DataFrame, date: str, value: str, unit: str = "month", alpha: float = 0.3) -> DataFrame:
    """One row: the level of simple exponential smoothing after the last period, which is the forecast for those to come."""
    b = buckets(df, date, value, unit)
    last = b.agg((F.count(F.lit(1)) - 1).alias("_n"))
    weight = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("i")) * F.when(F.col("i") == 0, 1.0).otherwise(alpha)
    return b.crossJoin(F.broadcast(last)).agg(F.sum(weight * F.col("y")).alias("level"))  # one row


def dickey_fuller(df: DataFrame, date: str, value: str, unit: str = "month", lags: int = 0) -> DataFrame:
    """One row: statistic of the augmented Dickey-Fuller test with a constant, lags, n, critical values and stationary (at 5 %).

    Changes are regressed on the level before and on lags earlier changes. Without enough periods, or where changes follow
    the level exactly, statistic is null.
    """
    order = Window.orderBy("i")
    rows = buckets(df, date, value, unit).select("i", (F.col("y") - F.lag("y").over(order)).alias("change"), F.lag("y").over(order).alias("level"))
    earlier = [f"change_{k}" for k in range(1, lags + 1)]
    rows = rows.select("change", "level", *(F.lag("change", k).over(order).alias(c) for k, c in enumerate(earlier, 1)))
    found = regression(rows, "change", ["level", *earlier]).where("term = 'level'").select(F.col("t").alias("statistic"), "n")
    one = df.sparkSession.createDataFrame([(lags,)], "lags int").join(found, how="left")  # one row each
    at = [sum((F.lit(c) / F.pow(F.col("n"), F.lit(float(k))) for k, c in enumerate(row)), F.lit(0.0)).alias(f"critical_{round(100 * p)}") for p, row in DICKEY_FULLER.items()]
    return one.select("statistic", "lags", "n", *at).withColumn("stationary", F.col("statistic") < F.col("critical_5"))


def dickey_fuller_p(statistic: float) -> float:
    """MacKinnon's approximate p of the test with a constant."""
    fixed = DICKEY_FULLER_P
    if statistic > fixed["most"]:
        return 1.0
    if statistic < fixed["least"]:
        return 0.0
    at = sum(c * statistic**k for k, c in enumerate(fixed["below" if statistic <= fixed["meet"] else "above"]))
    return math.erfc(-at / math.sqrt(2)) / 2


def _centred(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """How many rows have all columns, and the products of these columns, centred, summed over those rows."""
    rows = rows.select(*names).dropna()
    one = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in names)).first()
    if not one[0]:
        return 0, np.zeros((len(names), len(names)))
    means = np.array(one[1:])
    array = rows.select(F.lit(0.0).alias("y"), F.array(*names).alias("x"))
    return one[0], sums(array, lambda x, _: ((x - means).T @ (x - means)).ravel(), len(names) ** 2).reshape(len(names), -1)


def dickey_fuller_auto(df: DataFrame, date: str, value: str, unit: str = "month") -> DataFrame:
    """One row: the augmented Dickey-Fuller test with a constant and the number of lags that Akaike's criterion chooses.

    Columns statistic, lags, n, p_value, stationary (p < 5 %). Up to 12 (periods / 100)^(1/4) lags are compared over the rows
    that have them all, from one matrix of products; the chosen model takes all rows it can. Of equal criteria the fewest lags
    count. Fewer than 5 periods or a constant series give nulls. Only periods are put in order, in one task.
    """
    spark, schema = df.sparkSession, "statistic double, lags int, n long, p_value double, stationary boolean"
    b = buckets(df, date, value, unit).select("i", F.col("y").cast("double").alias("y"))
    edge = b.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first()
    most = min(edge[0] // 2 - 2, math.ceil(12 * (edge[0] / 100) ** 0.25))
    none = spark.createDataFrame([(None, None, None, None, None)], schema)
    if most < 0 or edge[1] == edge[2]:
        return none
    order = Window.orderBy("i")
    rows = b.select("i", (F.col("y") - F.lag("y").over(order)).alias("change"), F.lag("y").over(order).alias("level"))
    rows = rows.select("change", "level", *(F.lag("change", k).over(order).alias(f"change_{k}") for k in range(1, most + 1)))
    names = lambda lags: ["change", "level", *(f"change_{k}" for k in range(1, lags + 1))]
    n, moments = _centred(rows, names(most))

    def left(gram: np.ndarray) -> float:
        return max(0.0, float(gram[0, 0] - gram[0, 1:] @ np.linalg.pinv(gram[1:, 1:], hermitian=True) @ gram[1:, 0]))

    def criterion(lags: int) -> float:
        rest = left(moments[: lags + 2, : lags + 2])
        return n * math.log(rest / n) + 2 * (lags + 2) if rest > 0 else -math.inf

    lags = min(range(most + 1), key=criterion)
    n, gram = _centred(rows, names(lags))
    free, rest = n - lags - 2, left(gram)
    if free <= 0 or rest <= 0:
        return none
    inverse = np.linalg.pinv(gram[1:, 1:], hermitian=True)
    statistic = float((inverse @ gram[1:, 0])[0] / math.sqrt(rest / free * inverse[0, 0]))
    p = dickey_fuller_p(statistic)
    return spark.createDataFrame([(statistic, lags, n, p, p < 0.05)], schema)
