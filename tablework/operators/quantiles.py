"""Exact quantiles and codes of ordered values, without any task that sees all values of a column.

Values are counted first. The distinct ones are cut into ranges at approximate quantiles, of which the driver sees only the
bounds; sums of counts over the ranges and within each give every value's place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that are ordered apart from each other.
RANGES = 64


#: What a table's figures are called while they are joined to its rows: a name that no table has.
FIGURES = "\x01figures"


def quoted(column: str) -> str:
    """A column's name as expressions take it, whatever is in it."""
    return f"`{column.replace('`', '``')}`"


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN as null in the columns given, or all: it is a missing value, and would be larger than any number otherwise."""
    of = [c for c, t in df.dtypes if t in ("double", "float") and (columns is None or c in columns)]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), F.col(quoted(c))) for c in of}) if of else df


def _double(column: str) -> Column:
    """The column as a number; NaN is null."""
    x = F.col(quoted(column)).cast("double")
    return F.when(~F.isnan(x), x)


def _bounds(df: DataFrame, columns: list[str], ranges: int) -> list[list[float]]:
    numbers = df.select(*(_double(c).alias(f"c{k}") for k, c in enumerate(columns)))
    found = numbers.approxQuantile(numbers.columns, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return [sorted(set(x)) for x in found]


def places(df: DataFrame, columns: list[str], by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """(by, k, v, times, before, n) for each distinct value v of column number k: how many rows have it, are smaller, are there."""
    bounds = _bounds(df, columns, ranges)
    names = [f"g{i}" for i in range(len(by))]
    long = df.select(*(F.col(quoted(b)).alias(n) for b, n in zip(by, names, strict=True)), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _double(c).alias("v")) for k, c in enumerate(columns)))).alias("x"))
    counts = long.where("x.v is not null").groupBy(*names, "x.k", "x.v").agg(F.count(F.lit(1)).alias("times"))
    own = F.get(F.array(*(F.array(*map(F.lit, b)).cast("array<double>") for b in bounds)), F.col("k"))
    counts = counts.withColumn("part", F.size(F.filter(own, lambda b: b < F.col("v"))))
    sizes = counts.groupBy(*names, "k", "part").agg(F.sum("times").alias("size"))
    every = Window.partitionBy(*names, "k")
    # one row a range
    sizes = sizes.select(*(F.col(n).alias(f"h{n}") for n in names), F.col("k").alias("hk"), F.col("part").alias("hpart"), (F.sum("size").over(every.orderBy("part")) - F.col("size")).alias("ahead"), F.sum("size").over(every).alias("n"))
    on = [F.col("k") == F.col("hk"), F.col("part") == F.col("hpart"), *(F.col(n).eqNullSafe(F.col(f"h{n}")) for n in names)]
    within = F.sum("times").over(Window.partitionBy(*names, "k", "part").orderBy("v")) - F.col("times")
    counts = counts.withColumn("within", within)
    placed = counts.join(sizes if by else F.broadcast(sizes), on)  # without groups, at most ranges rows a column
    return placed.select(*names, "k", "v", "times", (F.col("ahead") + F.col("within")).alias("before"), "n")


def _picked(q: float) -> F.Column:
    """The quantile by linear interpolation between the two values around it; null without values."""
    at = F.lit(float(q)) * (F.col("n") - 1)
    holds = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("times")), F.col("v")))
    low, high = holds(F.floor(at)), holds(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


def quantiles(df: DataFrame, columns: list[str], at: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """One row with an array of quantiles for each column, named q0, q1, ...; nulls are left out."""
    one = places(df, columns, (), ranges).groupBy("k").agg(*(_picked(q).alias(f"p{i}") for i, q in enumerate(at)))
    whole = F.array(*(f"p{i}" for i in range(len(at))))
    none = F.array(*(F.lit(None).cast("double") for _ in at))
    return one.agg(*(F.coalesce(F.max(F.when(F.col("k") == k, whole)), none).alias(f"q{k}") for k in range(len(columns))))


def group_quantiles(df: DataFrame, column: str, by: list[str], at: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """(by, q): an array of quantiles for each group; groups without any value are missing."""
    one = places(df, [column], by, ranges).groupBy(*(f"g{i}" for i in range(len(by)))).agg(F.array(*(_picked(q) for q in at)).alias("q"))
    return one.select(*(F.col(f"g{i}").alias(b) for i, b in enumerate(by)), "q")


def ranked(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """(value, times, rank): each distinct value, how often it occurs, and the average rank of its rows."""
    return places(df, [column], (), ranges).select(F.col("v").alias("value"), "times", (F.col("before") + (F.col("times") + 1) / 2).alias("rank"))


def running(df: DataFrame, value: str, amount: str, ranges: int = RANGES) -> DataFrame:
    """df with sum: of amount over all rows up to each row's value. Values must be distinct."""
    (bounds,) = _bounds(df, [value], ranges)
    parts = df.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(value))))
    sizes = parts.groupBy("_part").agg(F.sum(amount).alias("_size"))
    sizes = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_ahead"))  # one row a range
    own = F.sum(amount).over(Window.partitionBy("_part").orderBy(value))
    return parts.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn("sum", F.col("_ahead") + F.col("_own")).drop("_part", "_own", "_ahead")


def codes(values: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """(column, code): distinct non-null values in the order of their text, from 0."""
    text = F.col(column).cast("string")
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    bounds = [r["b"] for r in distinct.select(text.alias("t")).select(F.xxhash64("t").alias("h"), "t").orderBy("h").limit(ranges * 16).orderBy("t").select(F.col("t").alias("b")).collect()]
    bounds = sorted({bounds[i] for i in range(len(bounds) // ranges, len(bounds), max(1, len(bounds) // ranges))}) if len(bounds) > ranges else []
    distinct = distinct.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b < text)))
    sizes = distinct.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_ahead"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(text)) - 1
    return distinct.withColumn("_own", own).join(F.broadcast(sizes), "_part").select(column, (F.col("_ahead") + F.col("_own")).cast("long").alias("code"))
