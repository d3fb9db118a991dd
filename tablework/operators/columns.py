"""Column operators: each takes a DataFrame and returns one, lazily.

Operators that need whole-column figures (quantiles, moments) join a single row of them; operators on row order take the
columns that order the rows, and optionally a partition, without which all rows of a window meet in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.quantiles import FIGURES, codes, nan_to_null, quantiles, quoted


def _with_stats(df: DataFrame, use: Column, new: str, **stats: Column) -> DataFrame:
    """df with column new, made from a row of figures that use refers to as _of(name)."""
    one = df.agg(F.struct(*(c.alias(k) for k, c in stats.items())).alias(FIGURES))
    return df.crossJoin(F.broadcast(one)).withColumn(new, use).drop(FIGURES)  # one row


def _of(name: str) -> Column:
    return F.col(f"`{FIGURES}`.{name}")


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def _with_quantiles(df: DataFrame, use: Column, new: str, column: str, *at: float) -> DataFrame:
    one = quantiles(df, [column], at).withColumnRenamed("q0", FIGURES)
    return df.crossJoin(F.broadcast(one)).withColumn(new, use).drop(FIGURES)  # one row


def _q(k: int) -> Column:
    return F.get(F.col(f"`{FIGURES}`"), F.lit(k))


def clean_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trimmed, with the first letter of every run of letters in upper case, the others in lower case."""
    title = lambda c: F.array_join(F.transform(F.regexp_extract_all(F.trim(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")
    return df.withColumns({c: title(F.col(c)) for c in columns})


def cast_column(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Lenient: what can't be cast is null."""
    kinds = {"int": lambda c: c.try_cast("double").try_cast("long"), "float": lambda c: c.try_cast("double"), "str": lambda c: c.cast("string"), "datetime": lambda c: F.try_to_timestamp(c.cast("string"))}
    return df.withColumn(column, kinds[dtype](F.col(column)))


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    c, out = F.col(column), None
    for old, new in mapping.items():
        hit = c.eqNullSafe(F.lit(old))
        out = F.when(hit, F.lit(new)) if out is None else out.when(hit, F.lit(new))
    return df if out is None else df.withColumn(column, out.otherwise(c))


def formula(expression: str, columns: list[str]) -> Column:
    """Columns and numbers joined by + - * /, strictly from left to right; dividing by zero gives null."""
    tokens = [t.strip() for t in re.split(r"([+\-*/])", expression)]
    term = lambda t: F.col(t).cast("double") if t in columns else F.lit(float(t))
    out = term(tokens[0])
    for op, t in zip(tokens[1::2], tokens[2::2], strict=True):
        x = term(t)
        out = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}[op](out, x)
    return out


def add_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, formula(expression, df.columns))


def keep_frequent(df: DataFrame, source: str, name: str, threshold: int) -> DataFrame:
    """The value where it occurs at least threshold times, else "Other"."""
    counts = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, source, "left").withColumn(name, F.when(F.coalesce("_n", F.lit(0)) >= threshold, F.col(source)).otherwise("Other")).drop("_n")


def cap_outliers(df: DataFrame, column: str, method: str = "iqr", low: float = 0.25, high: float = 0.75) -> DataFrame:
    df = nan_to_null(df, [column])
    x = F.col(column)
    if method == "iqr":
        reach = 1.5 * (_q(1) - _q(0))
        return _with_quantiles(df, _clamp(x, _q(0) - reach, _q(1) + reach), column, column, low, high)
    reach = 3 * _of("s")
    return _with_stats(df, _clamp(x, _of("m") - reach, _of("m") + reach), column, m=F.avg(column), s=F.stddev_samp(column))


def winsorize(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    df = nan_to_null(df, [column])
    return _with_quantiles(df, _clamp(F.col(column), _q(0), _q(1)), column, column, low, high)


def normalize(df: DataFrame, column: str, method: str = "minmax", name: str | None = None) -> DataFrame:
    df = nan_to_null(df, [column])
    x, zero = F.col(column), F.when(F.col(column).isNotNull(), 0.0)
    if method == "minmax":
        return _with_stats(df, F.when(_of("b") > _of("a"), (x - _of("a")) / (_of("b") - _of("a"))).otherwise(zero), name or column, a=F.min(column), b=F.max(column))
    return _with_stats(df, F.when(_of("s") > 0, (x - _of("m")) / _of("s")).otherwise(zero), name or column, m=F.avg(column), s=F.stddev_samp(column))


def robust_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    df = nan_to_null(df, [column])
    x = F.col(column)
    scaled = F.when(_q(2) > _q(0), (x - _q(1)) / (_q(2) - _q(0))).otherwise(F.when(x.isNotNull(), 0.0))
    return _with_quantiles(df, scaled, name, column, 0.25, 0.5, 0.75)


def fill_nulls(df: DataFrame, column: str, strategy: str, order_by: list[str] | None = None, partition_by: list[str] | None = None, fill_zeros: bool = False) -> DataFrame:
    """mean, median, mode (ties: the smallest), ffill, bfill or drop; NaN counts as null, and so do zeros if fill_zeros."""
    df = nan_to_null(df, [column])
    if fill_zeros:
        df = df.withColumn(column, F.when(F.col(column) != 0, F.col(column)))
    if strategy == "drop":
        return df.where(F.col(column).isNotNull())
    if strategy in ("ffill", "bfill"):
        w = Window.partitionBy(*(partition_by or [])).orderBy(*(order_by or []))
        filled = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if strategy == "ffill" else F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return df.withColumn(column, filled)
    if strategy == "median":
        return _with_quantiles(df, F.coalesce(F.col(column), _q(0)), column, column, 0.5)
    if strategy == "mode":
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
        top = counts.agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("_t"))
        return df.crossJoin(F.broadcast(top)).withColumn(column, F.coalesce(column, F.col("_t.v"))).drop("_t")  # one row
    value = {"mean": F.avg(column)}[strategy]
    return _with_stats(df, F.coalesce(F.col(column), _of("v")), column, v=value)


def drop_duplicates(df: DataFrame, subset: list[str], order_by: list[str], keep: str = "first") -> DataFrame:
    """keep: first or last row of each key by order_by (nulls come first), or none of those that repeat; null keys are one key."""
    if keep == "none":
        # a key that occurs once has that row alone as its least
        rows = df.groupBy(*(F.col(quoted(c)).alias(f"key{i}") for i, c in enumerate(subset))).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*map(quoted, df.columns))).alias("row"))
        return rows.where("n = 1").select("row.*")
    # the row with the least or greatest order is found within tasks first, so a frequent key is no task's alone
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*map(quoted, df.columns)), F.struct(*map(quoted, order_by))).alias("row")
    return df.groupBy(*(F.col(quoted(c)).alias(f"key{i}") for i, c in enumerate(subset))).agg(row).select("row.*")


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values in order of their text, from 0; null stays null."""
    return df.join(codes(df, column).withColumnRenamed("code", name), column, "left")


def ordinal_encode(df: DataFrame, column: str, order: list, name: str, unknown: int = -1) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column)) - 1
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.when(at >= 0, at).otherwise(unknown)))


def binary_encode(df: DataFrame, column: str, name: str, value=None, threshold: float = 0) -> DataFrame:
    hit = F.col(column) == value if value is not None else F.col(column) > threshold
    return df.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int"))


def frequency_encode(df: DataFrame, column: str, name: str, share: bool = False) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
    if share:
        counts = counts.crossJoin(F.broadcast(df.agg(F.count(column).alias("_n")))).withColumn(name, F.col(name) / F.col("_n")).drop("_n")
    return df.join(counts, column, "left")


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def extract_regex(df: DataFrame, column: str, pattern: str, name: str, group: int = 0) -> DataFrame:
    return df.withColumn(name, F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, group)))


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str = "") -> DataFrame:
    """Back-references are written \\1."""
    return df.withColumn(column, F.regexp_replace(column, pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))))


def str_slice(df: DataFrame, column: str, name: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Python's slice of a text, negative bounds included."""
    n = F.length(column)
    at = lambda k: F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)
    first, last = at(start), n if end is None else at(end)
    return df.withColumn(name, F.substring(F.col(column), first + 1, F.greatest(last - first, F.lit(0))))


def split_column(df: DataFrame, column: str, delimiter: str = ",", names: list[str] | None = None, n_splits: int | None = None) -> DataFrame:
    """The parts of a text between delimiters as columns; parts that a text lacks are null.

    n_splits: cut so often at most, the last part holds the rest. names: of the parts, or column_1, column_2, ...; without
    names or n_splits, one pass finds the most parts that any text has.
    """
    pattern = re.escape(delimiter) if len(delimiter) == 1 else delimiter
    parts = F.split(F.col(quoted(column)), pattern, -1 if n_splits is None else n_splits + 1)
    if names is None:
        n = df.agg(F.max(F.size(parts))).first()[0] if n_splits is None else n_splits + 1
        names = [f"{column}_{i + 1}" for i in range(max(n or 0, 0))]
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def combine_columns(df: DataFrame, columns: list[str], name: str, delimiter: str = " ") -> DataFrame:
    return df.withColumn(name, F.concat_ws(delimiter, *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns)))


def date_diff(df: DataFrame, a: str, b: str, name: str, unit: str = "days") -> DataFrame:
    """a - b in whole days, or days / 30.44 or / 365.25 rounded half to even."""
    days = F.floor((F.col(a).cast("timestamp").cast("double") - F.col(b).cast("timestamp").cast("double")) / 86400)
    per = {"days": None, "months": 30.44, "years": 365.25}[unit]
    return df.withColumn(name, days if per is None else F.bround(days / per).cast("long"))


def date_parts(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.withColumns({f"{column}_year": F.year(c), f"{column}_month": F.month(c), f"{column}_day": F.dayofmonth(c), f"{column}_dayofweek": F.weekday(c)})


def rank_column(df: DataFrame, column: str, name: str, method: str = "dense", ascending: bool = True, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """dense, min, max, average or first (ties by order_by); the rank of null is null."""
    part = [F.col(c) for c in partition_by or []]
    key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    w = Window.partitionBy(*part).orderBy(key)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, column))
    rank = {"dense": F.dense_rank().over(w), "min": F.rank().over(w), "max": F.rank().over(w) + ties - 1, "average": F.rank().over(w) + (ties - 1) / 2, "first": F.row_number().over(Window.partitionBy(*part).orderBy(key, *(order_by or [])))}[method]
    return df.withColumn(name, F.when(F.col(column).isNotNull(), rank.cast("double")))


def top_n(df: DataFrame, column: str, n: int, order_by: list[str], keep: str = "top") -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last() if keep == "top" else F.col(column).asc_nulls_last(), *order_by).limit(n)


def shift(df: DataFrame, column: str, name: str, kind: str, order_by: list[str], partition_by: list[str] | None = None, periods: int = 1) -> DataFrame:
    """kind: lag, lead, diff, or pct_change (in percent, nulls filled with the last value before them)."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by)
    x = F.col(column)
    if kind == "pct_change":
        df = df.withColumn("_x", F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.lag("_x", periods).over(w)
        return df.withColumn(name, 100 * (F.try_divide(F.col("_x"), before) - 1)).drop("_x")
    out = {"lag": lambda: F.lag(x, periods).over(w), "lead": lambda: F.lead(x, periods).over(w), "diff": lambda: x - F.lag(x, periods).over(w)}[kind]()
    return df.withColumn(name, out)


#: Aggregates by name.
_AGGREGATES = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "nunique": F.count_distinct, "first": F.first, "last": F.last}


def rolling(df: DataFrame, column: str, name: str, window: int, agg: str, order_by: list[str], partition_by: list[str] | None = None, min_periods: int = 1) -> DataFrame:
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by).rowsBetween(1 - window, 0)
    value = F.percentile(column, F.lit(0.5)) if agg == "median" else _AGGREGATES[agg](column)
    return df.withColumn(name, F.when(F.count(column).over(w) >= min_periods, value.over(w)))


def cumulative(df: DataFrame, column: str, name: str, agg: str, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """sum, product, max or min so far; null where the row's own value is."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    f = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[agg]
    return df.withColumn(name, F.when(F.col(column).isNotNull(), f(column).over(w)))


def log_transform(df: DataFrame, column: str, name: str, method: str = "log1p") -> DataFrame:
    """At the edge of its range a logarithm is minus infinity, below it NaN; null stays null."""
    f, edge = {"log1p": (F.log1p, -1), "log2": (F.log2, 0), "log10": (F.log10, 0), "log": (F.ln, 0)}[method]
    x = F.col(column)
    return df.withColumn(name, F.when(x > edge, f(x)).when(x == edge, float("-inf")).when(x < edge, float("nan")))


def sqrt_transform(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sqrt(F.abs(column)))


def clip_values(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    x = F.col(column)
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    return df.withColumn(column, out)


def round_values(df: DataFrame, column: str, decimals: int = 2) -> DataFrame:
    return df.withColumn(column, F.bround(column, decimals))


def conditional_assign(df: DataFrame, name: str, rules: list[tuple[Column, object]], default=None) -> DataFrame:
    out = F
    for when, label in rules:
        out = out.when(when, F.lit(label))
    return df.withColumn(name, out.otherwise(F.lit(default)))


def bin_column(df: DataFrame, column: str, name: str, bins: int | list[float], labels: list[str] | None = None, right: bool = True) -> DataFrame:
    """Number of the bin a value falls into, from 0, or its label.

    bins: so many of equal width over [min, max], the lowest of which holds the minimum (with right=False the highest the
    maximum) and the middle one all of a constant column; or the edges of bins, beyond which is null. right: bins are (a, b],
    else [a, b). NaN counts as null.
    """
    n = bins if isinstance(bins, int) else len(bins) - 1
    if labels is not None and len(labels) != n:
        raise ValueError(f"{n} bins need as many labels")
    named = lambda k: k.cast("int") if labels is None else F.get(F.array(*map(F.lit, labels)), k.cast("int"))
    df = nan_to_null(df, [column])
    x = F.col(quoted(column))
    if not isinstance(bins, int):
        if sorted({*bins}) != list(bins) or n < 1:
            raise ValueError("edges must ascend")
        k = F.size(F.filter(F.array(*map(F.lit, bins)).cast("array<double>"), lambda e: (e < x) if right else (e <= x))) - 1
        return df.withColumn(name, F.when(x.isNotNull() & k.between(0, n - 1), named(k)))
    at = F.try_divide(x - _of("a"), (_of("b") - _of("a")) / n)
    k = F.coalesce(F.ceil(at) - 1 if right else F.floor(at), F.lit((n - 1) // 2))
    return _with_stats(df, F.when(x.isNotNull(), named(F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)))), name, a=F.min(x).cast("double"), b=F.max(x).cast("double"))


def qbin_column(df: DataFrame, column: str, name: str, q: int, labels: list[str] | None = None) -> DataFrame:
    """Number of the quantile bin (a, b], from 0, or its label; equal edges are one."""
    df = nan_to_null(df, [column])
    edges = F.array_sort(F.array_distinct(F.col(f"`{FIGURES}`")))
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    k = F.size(F.filter(inner, lambda e: e < F.col(column)))
    if labels is not None:
        k = F.get(F.array(*map(F.lit, labels)), k)
    return _with_quantiles(df, F.when(F.col(column).isNotNull(), k), name, column, *(i / q for i in range(q + 1)))


#: Rows of a block of the exponentially weighted mean.
EWM_BLOCK = 10_000


def ewm(df: DataFrame, column: str, name: str, span: int, order_by: list[str], partition_by: list[str]) -> DataFrame:
    """Exponentially weighted mean within partitions: each value counts 2 / (span + 1), the mean before it the rest.

    A null (or NaN) leaves the mean as it is and makes what was before it count less at the next value; before the first value
    the mean is null. Every step maps the mean y to a y + b, and such maps compose, so blocks of rows are worked out side by
    side: each block gives its map, the maps of a partition's blocks are chained, and blocks start from what comes out. Only
    the number of a row within its partition takes a sort of the partition, which Spark spills.
    """
    alpha = 2 / (span + 1)
    w = Window.partitionBy(*map(quoted, partition_by)).orderBy(*map(quoted, order_by))
    x = F.when(~F.isnan(F.col(quoted(column)).cast("double")), F.col(quoted(column)).cast("double"))
    rows = df.select(F.struct(*map(quoted, df.columns)).alias("row"), F.struct(*map(quoted, partition_by)).alias("part"), x.alias("x"), F.row_number().over(w).cast("long").alias("at"))
    rows = rows.withColumn("block", F.floor((F.col("at") - 1) / EWM_BLOCK))
    # the place of the value before each, so that a block knows how long what it starts from has waited
    before = F.last(F.when(F.col("x").isNotNull(), F.col("at")), True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("wait", F.col("at") - before)
    keep = F.pow(F.lit(1 - alpha), F.col("wait"))
    a = F.when(F.col("x").isNull(), 1.0).when(F.col("wait").isNull(), 0.0).otherwise(keep / (keep + alpha))
    b = F.when(F.col("x").isNull(), 0.0).when(F.col("wait").isNull(), F.col("x")).otherwise(alpha * F.col("x") / (keep + alpha))
    rows = rows.select("row", "part", "block", "at", a.alias("a"), b.alias("b"), (F.col("x").isNull() & F.col("wait").isNull()).alias("empty"))

    def composed(table):
        import numpy as np

        order = np.argsort(table["at"].to_numpy())
        a, b = table["a"].to_numpy()[order], table["b"].to_numpy()[order]
        return order, *_chained(a, b)

    def maps(key, table):
        import pyarrow as pa

        _, a, b = composed(table)
        return pa.table({"part": table["part"].slice(0, 1), "block": table["block"].slice(0, 1), "a": pa.array([a[-1]]), "b": pa.array([b[-1]])})

    def starts(key, table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table["block"].to_numpy())
        _, b = _chained(table["a"].to_numpy()[order], table["b"].to_numpy()[order])
        return pa.table({"part": table["part"].slice(0, 1).take(pa.array(np.zeros(len(b), np.int64))), "block": table["block"].take(pa.array(order)), "start": pa.array(np.append(0.0, b[:-1]))})

    of = lambda *fields: T.StructType([T.StructField(n, rows.schema[n].dataType if n in ("part", "row") else T.LongType() if n == "block" else T.DoubleType()) for n in fields])
    slim = rows.select("part", "block", "at", "a", "b")
    ends = slim.groupBy("part", "block").applyInArrow(maps, of("part", "block", "a", "b"))
    first = ends.groupBy("part").applyInArrow(starts, of("part", "block", "start"))
    joined = rows.join(first.withColumnsRenamed({"part": "p", "block": "k"}), F.col("part").eqNullSafe(F.col("p")) & (F.col("block") == F.col("k")))

    def finish(key, table):
        import numpy as np
        import pyarrow as pa

        order, a, b = composed(table)
        y = np.empty(len(a))
        y[order] = a * table["start"].to_numpy()[order] + b
        return pa.table({"row": table["row"], "y": pa.array(y, mask=table["empty"].to_numpy(zero_copy_only=False))})

    out = joined.select("part", "block", "row", "at", "a", "b", "empty", "start").groupBy("part", "block").applyInArrow(finish, of("row", "y"))
    return out.select("row.*", F.col("y").alias(name))


def _chained(a, b):
    """The maps y -> a y + b one after another, as one map for each place, by doubling how many are taken together."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b
