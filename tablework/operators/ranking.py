"""Statistics of whole orders: Kendall's tau and tests for a normal distribution.

Rows are cut into ranges of their values, within which tasks order them apart from each other; what happens between ranges
follows from counts alone. No pair of rows is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions import distributions as D
from tablework.operators.quantiles import places, quoted

#: Ranges per column when pairs of values are counted, at most: the driver sees so many bounds, and Spark a count for each
#: pair of ranges.
MOST_RANGES = 2048
#: Pairs of values that a range should hold.
RANGE = 100_000
#: Without ties, up to so many rows get an exact p.
EXACT_ROWS = 33


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """The weight of pairs (product of both) of which the first has the larger y.

    One pass for each binary digit of the values' ranks: of two values the digit in which they first differ tells which is
    larger, and pairs that agree in all digits above it are neighbours in a stable sort by those digits.
    """
    rank = np.unique(y, return_inverse=True)[1]
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above = rank >> (bit + 1)
        order = np.argsort(above, kind="stable")
        one = (rank[order] >> bit & 1).astype(bool)
        w = weight[order]
        before = np.cumsum(np.where(one, w, 0))
        begins = np.flatnonzero(np.diff(above[order], prepend=-1))
        start = np.where(begins > 0, before[begins - 1], 0)
        within = before - np.repeat(start, np.diff(np.append(begins, len(w))))
        total += _product(w[~one], within[~one])
    return total


def _product(a: np.ndarray, b: np.ndarray) -> int:
    """The exact sum of products of whole numbers, in halves that 64 bits hold."""
    high, low = b >> 20, b & ((1 << 20) - 1)
    return (int((a * high).sum()) << 20) + int((a * low).sum())


def _part(value: Column, bounds: list[float]) -> Column:
    """Number of a value's range. A value that is itself a bound, as frequent ones are, has a range of its own."""
    array = F.array(*map(F.lit, bounds)).cast("array<double>")
    return 2 * F.size(F.filter(array, lambda b: b < value)) + F.array_contains(array, value).cast("int")


def _inverted(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row: the inversions of cells (x, y, n) within each group by, all together; groups are ranges, ordered within their tasks.

    Odd ranges hold one value, so nothing is out of order there; a frequent value never gets into a task as a whole.
    """

    def run(table: pa.Table) -> pa.Table:
        x, y, n = (table[c].to_numpy() for c in ("x", "y", "n"))
        order = np.lexsort((y, x))  # of equal x the smaller y comes first, so that they don't count
        return pa.table({"found": pa.array([str(inversions(y[order], n[order]))])})

    several = cells.where(" and ".join(f"{c} % 2 = 0" for c in by))
    return several.groupBy(*by).applyInArrow(run, "found string").agg(F.coalesce(F.sum(F.col("found").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))


def kendall(df: DataFrame, a: str, b: str, ranges: int | None = None) -> DataFrame:
    """One row: tau-b of two columns, n and two-sided p; tau and p are null where a column is constant or there are no rows.

    Rows with a null or NaN in either column are left out. p is exact without ties up to 33 rows or where at most one pair
    is out of order, else by the normal limit with ties. Equal rows are counted first. Discordant pairs are those in different ranges of both
    columns, which a table of counts tells, and those that share a range of either column, which tasks count by sorting;
    pairs that share both are counted twice by that, so they are taken off once. Bounds of ranges are sought when called.
    """
    x, y = (F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")) for c in (a, b))
    rows = df.select(x.alias("x"), y.alias("y")).dropna()
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    if ranges is None:
        ranges = min(MOST_RANGES, max(1, math.ceil(rows.count() / RANGE)))
    bounds = [sorted(set(q)) for q in rows.approxQuantile(["x", "y"], [i / ranges for i in range(1, ranges)], 0.25 / ranges)] if ranges > 1 else [[], []]
    cells = cells.select("x", "y", "n", _part(F.col("x"), bounds[0]).alias("p"), _part(F.col("y"), bounds[1]).alias("q"))
    # the count of rows further left and up, for each pair of ranges: two running sums over a table of ranges
    grid = cells.groupBy("p", "q").agg(F.sum("n").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(2 * len(bounds[0]) + 1)))
    whole = grid.select("q").distinct().select("q", every.alias("p")).join(grid, ["p", "q"], "left").select("p", "q", F.coalesce("n", F.lit(0)).alias("n"))
    left = whole.withColumn("left", F.sum("n").over(Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    both = left.withColumn("over", F.sum("left").over(Window.partitionBy("p").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)))
    apart = both.agg(F.coalesce(F.sum(F.col("n").cast("decimal(19,0)") * F.coalesce("over", F.lit(0)).cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias("apart"))
    one_p, one_q, one_both = (_inverted(cells.select("x", "y", "n", *by), by).toDF(name) for by, name in ((["p"], "own_p"), (["q"], "own_q"), (["p", "q"], "own_both")))

    def ties(by: str, name: str) -> DataFrame:
        t = F.col("t").cast("double")
        exact = F.col("t").cast("decimal(19,0)")
        each = cells.groupBy(by).agg(F.sum("n").alias("t"))
        return each.agg(F.coalesce(F.sum(exact * (exact - 1) / 2), F.lit(0)).cast("decimal(38,0)").alias(f"{name}t"), F.coalesce(F.sum(t * (t - 1) * (t - 2)), F.lit(0.0)).alias(f"{name}0"), F.coalesce(F.sum(t * (t - 1) * (2 * t + 5)), F.lit(0.0)).alias(f"{name}1"))

    exact = F.col("n").cast("decimal(19,0)")
    same = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(exact * (exact - 1) / 2), F.lit(0)).cast("decimal(38,0)").alias("both"))
    one = same
    for other in (apart, one_p, one_q, one_both, ties("x", "x"), ties("y", "y")):
        one = one.crossJoin(F.broadcast(other))  # one row each
    one = one.withColumn("discordant", F.col("apart") + F.col("own_p") + F.col("own_q") - F.col("own_both"))
    pairs = (exact * (exact - 1) / 2).cast("decimal(38,0)")
    excess = (pairs - F.col("xt") - F.col("yt") + F.col("both") - 2 * F.col("discordant")).cast("double")
    total = pairs.cast("double")
    tau = F.try_divide(F.try_divide(excess, F.sqrt(total - F.col("xt").cast("double"))), F.sqrt(total - F.col("yt").cast("double")))
    n = F.col("n").cast("double")
    m = n * (n - 1)
    spread = (m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18 + F.try_divide(2 * F.col("xt").cast("double") * F.col("yt").cast("double"), m) + F.coalesce(F.try_divide(F.col("x0") * F.col("y0"), 9 * m * (n - 2)), F.lit(0.0))
    untied = (F.col("xt") == 0) & (F.col("yt") == 0) & ((F.col("n") <= EXACT_ROWS) | (F.least(F.col("discordant"), pairs - F.col("discordant")) <= 1))
    few = F.udf(lambda d, k: None if d is None else D.kendall_exact(int(d), int(k)), "double")
    p = F.when(tau.isNull(), None).when(untied, few(F.when(untied, F.col("discordant")), "n")).otherwise(D.normal_p(F.try_divide(excess, F.sqrt(spread))))
    return one.select(F.when(tau.isNotNull(), F.greatest(F.least(tau, F.lit(1.0)), F.lit(-1.0))).alias("tau"), "n", p.alias("p_value"))


# Critical values of the Anderson-Darling statistic with estimated mean and deviation, by level in percent.
ANDERSON = {15.0: 0.576, 10.0: 0.656, 5.0: 0.787, 2.5: 0.918, 1.0: 1.092}


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """One row: the statistic of Anderson and Darling's test for a normal distribution, n, critical values and normal (at 5 %).

    Nulls and NaN are left out; statistic and normal are null below two values or where all are equal. Ranks come from ranges,
    and each distinct value counts for all its ranks at once.
    """
    x = F.nanvl(F.col(quoted(column)).cast("double"), F.lit(None).cast("double"))
    rows = df.select(x.alias("x")).dropna()
    spread = rows.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    each = places(rows, ["x"]).crossJoin(F.broadcast(spread))  # one row
    z = F.try_divide(F.col("v") - F.col("mean"), F.col("sd"))
    before, upto, n = (F.col(c).cast("double") for c in ("before", "upto", "n"))
    each = each.withColumn("upto", F.col("before") + F.col("times"))
    low = (upto * upto - before * before) * D.log_normal_tail(-z)
    high = ((n - before) * (n - before) - (n - upto) * (n - upto)) * D.log_normal_tail(z)
    one = each.agg(F.max("n").alias("n"), F.sum(low + high).alias("s"))
    size = F.col("n").cast("double")
    one = one.select((-size - F.try_divide("s", size)).alias("statistic"), F.coalesce("n", F.lit(0)).alias("n"))
    at = [F.round(F.lit(v) / (1 + F.try_divide(F.lit(4.0), F.col("n")) - F.try_divide(F.lit(25.0), F.col("n") * F.col("n"))), 3).alias(f"critical_{str(k).replace('.0', '').replace('.', '_')}") for k, v in ANDERSON.items()]
    return one.select("statistic", "n", *at).withColumn("normal", F.col("statistic") <= F.col("critical_5"))


#: Rows beyond which Shapiro and Wilk's p has no known distribution; a sample of so many is tested then.
SHAPIRO_ROWS = 5000

# Royston's polynomials, lowest power first: corrections of the two outermost weights, and mean and log
# deviation of the transformed statistic for small and larger samples.
OUTERMOST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)


def shapiro(values: np.ndarray) -> tuple[float | None, float | None]:
    """Shapiro and Wilk's W and its p by Royston's approximations; nulls below three values or where all are equal."""
    x, n = np.sort(values), len(values)
    if n < 3 or x[0] == x[-1]:
        return None, None
    poly = lambda c, at: float(sum(k * at**i for i, k in enumerate(c)))
    half = n // 2
    normal = NormalDist()
    # expected values of the upper half, the largest first; the lower half has the same with a minus
    m = np.array([normal.inv_cdf((n - i - 0.375) / (n + 0.25)) for i in range(half)])
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        total = 2 * float(m @ m)
        a = m.copy()
        fixed = [m[0] / math.sqrt(total) + poly(OUTERMOST, n**-0.5)]
        if n > 5:
            fixed.append(m[1] / math.sqrt(total) + poly(SECOND, n**-0.5))
        k = len(fixed)
        rest = (total - 2 * float(m[:k] @ m[:k])) / (1 - 2 * sum(f * f for f in fixed))
        a = m / math.sqrt(rest)
        a[:k] = fixed
    x = x - x.mean()
    w = min(1.0, float(a @ (x[::-1][:half] - x[:half])) ** 2 / float(x @ x))
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = poly(SMALL_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y, mean, spread = -math.log(gamma - y), poly(SMALL_MEAN, n), math.exp(poly(SMALL_SPREAD, n))
    else:
        mean, spread = poly(LARGE_MEAN, math.log(n)), math.exp(poly(LARGE_SPREAD, math.log(n)))
    return w, math.erfc((y - mean) / spread / math.sqrt(2)) / 2


def shapiro_wilk(df: DataFrame, column: str, most: int = SHAPIRO_ROWS) -> DataFrame:
    """One row: W, n, p and tested: how many rows W and p are of.

    Nulls and NaN are left out. The test is defined for up to 5,000 rows; of more, the most values whose hash is least are
    tested, the same ones each time. They are ordered in one task, as there are no more.
    """
    x = F.nanvl(F.col(quoted(column)).cast("double"), F.lit(None).cast("double"))
    rows = df.select(x.alias("x")).dropna()
    # equal values differ by their number among their like, so that hashes do too
    sample = rows.withColumn("k", F.xxhash64("x", F.monotonically_increasing_id())).orderBy("k").limit(most).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([np.zeros(0), *(b["x"].to_numpy() for b in batches)])
        w, p = shapiro(values)
        yield pa.RecordBatch.from_arrays([pa.array([w], pa.float64()), pa.array([p], pa.float64()), pa.array([len(values)], pa.int64())], ["statistic", "p_value", "tested"])

    found = sample.coalesce(1).mapInArrow(run, "statistic double, p_value double, tested long")
    return found.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).select("statistic", "p_value", "n", "tested")  # one row each


def kolmogorov_smirnov_normal(df: DataFrame, column: str, mean: float = 0.0, deviation: float = 1.0) -> DataFrame:
    """One row: the largest difference of a column's distribution function from a given normal one, n and p.

    Nulls and NaN are left out; statistic and p are null without values. Each distinct value is compared where the function
    steps, below and above. p is exact up to D.ONE_SAMPLE values.
    """
    each = places(df, [column])
    expected = D.normal_cdf((F.col("v") - mean) / deviation)
    below, above = F.col("before") / F.col("n"), (F.col("before") + F.col("times")) / F.col("n")
    one = each.agg(F.max(F.greatest(expected - below, above - expected)).alias("statistic"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return one.withColumn("p_value", D.p_value(lambda d, n: D.kolmogorov_one(d, int(n)), F.col("statistic"), F.col("n")))
