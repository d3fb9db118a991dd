"""The relations behind charts: what is drawn, already aggregated, filtered or sampled. Nothing is drawn here."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.inspection import kinds
from tablework.operators.profile import describe
from tablework.operators.quantiles import nan_to_null, quoted

#: Columns that a view of several takes if none are named, points of a sample, and lines of a grid at most.
PAIRWISE, PARALLEL, POINTS, GRID, BINS = 6, 10, 5000, 100, 30
_HOW = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}


def _named(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}; there are {', '.join(df.columns)}")


def _how(agg: str):
    if agg not in _HOW:
        raise ValueError(f"unknown aggregate {agg!r}; known: {', '.join(_HOW)}")
    return _HOW[agg]


def numeric_columns(df: DataFrame, most: int) -> list[str]:
    """The table's first number columns."""
    return [c for c, k in kinds(df).items() if k == "numeric"][:most]


def multi_bar(df: DataFrame, values: list[str], category: str, agg: str = "sum") -> DataFrame:
    """(category, values): several columns aggregated by one; rows without a category don't count."""
    _named(df, [*values, category])
    df = nan_to_null(df, values)
    return df.where(F.col(quoted(category)).isNotNull()).groupBy(quoted(category)).agg(*(_how(agg)(quoted(c)).alias(c) for c in values))


def multi_line(df: DataFrame, values: list[str], date: str, agg: str = "sum") -> DataFrame:
    """(period, values): several columns aggregated by month, as yyyy-MM; months without rows are not there. Texts that aren't dates don't count."""
    _named(df, [*values, date])
    df = nan_to_null(df, values)
    at = F.col(quoted(date)) if kinds(df)[date] == "datetime" else F.try_to_timestamp(F.col(quoted(date)).cast("string"))
    return df.select(F.date_format(at, "yyyy-MM").alias("period"), *map(quoted, values)).where("period is not null").groupBy("period").agg(*(_how(agg)(quoted(c)).alias(c) for c in values))


def complete_rows(df: DataFrame, columns: list[str] | None = None, most: int = PAIRWISE) -> DataFrame:
    """Rows that have all of several number columns: what pairwise plots and parallel coordinates show (PAIRWISE or PARALLEL columns by default)."""
    columns = columns or numeric_columns(df, most)
    _named(df, columns)
    whole = [F.col(quoted(c)).isNotNull() for c in columns]
    return nan_to_null(df.select(*map(quoted, columns))).where(reduce(and_, whole, F.lit(True)))


def map_points(df: DataFrame, lat: str, lon: str, value: str | None = None, color: str | None = None) -> DataFrame:
    """(lat, lon, value, color): rows whose coordinates read as numbers."""
    more = [c for c in (value, color) if c]
    _named(df, [lat, lon, *more])
    number = lambda c: F.nanvl(F.col(quoted(c)).try_cast("double"), F.lit(None).cast("double"))
    out = [number(lat).alias("lat"), number(lon).alias("lon")]
    out += [number(value).alias("value")] * bool(value) + ([F.col(quoted(color)).alias("color")] if color else [])
    return df.select(*out).where("lat is not null and lon is not null")


def map_locations(df: DataFrame, location: str, value: str | None = None) -> DataFrame:
    """(location, value): the sum of value, or the number of rows, by location; rows without a location don't count."""
    _named(df, [location, *([value] if value else [])])
    total: Column = F.sum(quoted(value)) if value else F.count(F.lit(1))
    return nan_to_null(df).where(F.col(quoted(location)).isNotNull()).groupBy(F.col(quoted(location)).alias("location")).agg(total.alias("value"))


def points_3d(df: DataFrame, x: str, y: str, z: str, color: str | None = None, most: int = POINTS) -> DataFrame:
    """(x, y, z, color): all rows, or if there are more than most, a sample of so many by hash, the same each time."""
    columns = [x, y, z, *([color] if color else [])]
    _named(df, columns)
    rows = df.select(*(F.col(quoted(c)).alias(n) for c, n in zip(columns, ("x", "y", "z", "color"), strict=False)))
    return rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(most)


def surface(df: DataFrame, x: str, y: str, z: str, most: int = GRID) -> DataFrame:
    """(x, y, z): the mean of z at each pair of x and y; more than most distinct x or y are an error, found when called."""
    _named(df, [x, y, z])
    if wrong := [c for c in (x, y, z) if kinds(df)[c] != "numeric"]:
        raise ValueError(f"{wrong} are not numbers")
    rows = nan_to_null(df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).alias("y"), F.col(quoted(z)).alias("z"))).dropna()
    size = tuple(rows.select(c).distinct().limit(most + 1).count() for c in ("x", "y"))
    if max(size) > most:
        raise ValueError(f"the grid has more than {most} lines")
    return rows.groupBy("x", "y").agg(F.avg("z").alias("z"))


def distributions(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column, bin, start, end, count): equal bins from least to largest of each number column, PAIRWISE of them by default.

    Bins hold their start, the last its end too; those without values aren't there, and a constant column has one bin. All
    columns are binned in one pass behind one for their ends.
    """
    columns = columns or numeric_columns(df, PAIRWISE)
    _named(df, columns)
    rows = nan_to_null(df.select(*(F.col(quoted(c)).cast("double").alias(f"c{k}") for k, c in enumerate(columns))))
    ends = rows.agg(*(f(f"c{k}").alias(f"{n}{k}") for k in range(len(columns)) for n, f in (("a", F.min), ("b", F.max))))
    width = lambda k: (F.col(f"b{k}") - F.col(f"a{k}")) / bins
    at = lambda k: F.least(F.coalesce(F.floor(F.try_divide(F.col(f"c{k}") - F.col(f"a{k}"), width(k))), F.lit(0)), F.lit(bins - 1)).cast("int")
    one = lambda k, c: F.struct(F.lit(c).alias("column"), F.when(F.col(f"c{k}").isNotNull(), at(k)).alias("bin"), F.col(f"a{k}").alias("a"), width(k).alias("w"))
    each = rows.crossJoin(F.broadcast(ends)).select(F.explode(F.array(*(one(k, c) for k, c in enumerate(columns)))).alias("x")).select("x.*")  # one row
    return each.where("bin is not null").groupBy("column", "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("start"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("end")).agg(F.count(F.lit(1)).alias("count"))


def boxes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, low, q25, q50, q75, high): quartiles and the furthest values within 1.5 times their distance of them."""
    columns = columns or numeric_columns(df, PAIRWISE)
    _named(df, columns)
    q = describe(df, columns).select("column", "q25", "q50", "q75")
    long = nan_to_null(df.select(*(F.col(quoted(c)).cast("double").alias(c) for c in columns))).unpivot([], [quoted(c) for c in columns], "column", "v").where("v is not null")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = long.join(F.broadcast(q), "column").where((F.col("v") >= F.col("q25") - reach) & (F.col("v") <= F.col("q75") + reach))  # a row a column
    return inside.groupBy("column").agg(F.min("v").alias("low"), F.any_value("q25").alias("q25"), F.any_value("q50").alias("q50"), F.any_value("q75").alias("q75"), F.max("v").alias("high"))
