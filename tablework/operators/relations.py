"""Joins, unions, aggregation, reshaping and time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.columns import _AGGREGATES
from tablework.operators.quantiles import group_quantiles, quoted


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Single-key join in which null keys match; clashing columns of the right side get the suffix, as often as it takes, and its key goes."""
    names: dict[str, str] = {}
    for c in right.columns:
        n = c
        while n in left.columns or n in names.values() or n != c and n in right.columns:
            n += suffix
        names[c] = n
    r = right.select(*(F.col(quoted(c)).alias(f"_r_{k}") for k, c in enumerate(names)))
    key = F.col(f"_r_{list(names).index(right_on)}")
    lk = F.col(quoted(left_on))
    packed = left.select(F.struct(*map(quoted, left.columns)).alias("_l"), lk.alias("_k"))  # so that no name of left's can be one of these
    joined = packed.join(r, F.col("_k").eqNullSafe(key), {"outer": "full"}.get(how, how))
    own = [F.col(f"_l.{quoted(c)}").alias(c) for c in left.columns if c != left_on]
    return joined.select(F.coalesce("_k", key).alias(left_on), *own, *(F.col(f"_r_{k}").alias(n) for k, (c, n) in enumerate(names.items()) if c != right_on))


def unmatched_keys(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Distinct non-null keys of left that right lacks."""
    return left.select(F.col(left_on).alias("key")).where("key is not null").distinct().join(right.select(F.col(right_on).alias("key")), "key", "left_anti")


def concat_rows(frames: dict[str, DataFrame], fill_missing: bool = True, source: str | None = "__source") -> DataFrame:
    """UNION ALL by name; without fill_missing only the columns that all have."""
    common = reduce(lambda a, b: [c for c in a if c in b.columns], frames.values(), next(iter(frames.values())).columns)
    rows = [(d if fill_missing else d.select(*common)).withColumn(source, F.lit(n)) if source else (d if fill_missing else d.select(*common)) for n, d in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def aggregate(df: DataFrame, group_by: list[str], agg: dict[str, list[str]]) -> DataFrame:
    """{column: functions} as column_function; rows with a null key are dropped, sums of nothing are 0."""
    make = lambda c, f: (F.coalesce(F.sum(c), F.lit(0)) if f == "sum" else _AGGREGATES[f](c)).alias(f"{c}_{f}")
    kept = reduce(lambda a, k: a.where(F.col(k).isNotNull()), group_by, df)
    plain = [make(c, f) for c, fs in agg.items() for f in fs if f != "median"]
    out = kept.groupBy(*group_by).agg(*plain or [F.count(F.lit(1)).alias("_rows")])
    # exact medians by ranges of values, as a group's distinct values needn't fit into one task
    for c in (c for c, fs in agg.items() if "median" in fs):
        middle = group_quantiles(kept, c, group_by, (0.5,)).select(*group_by, F.get("q", F.lit(0)).alias(f"{c}_median"))
        out = out.join(middle, group_by, "left")
    return out.select(*group_by, *(f"{c}_{f}" for c, fs in agg.items() for f in fs))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (100 * F.col("count") / F.col("_n")).alias("pct"))


def pivot(df: DataFrame, index: list[str], column: str, values: list, value: Column, fill=None) -> DataFrame:
    """One column for each of values; naming them saves Spark a pass."""
    out = df.groupBy(*index).pivot(column, values).agg(value)
    return out if fill is None else out.na.fill(fill)


def melt(df: DataFrame, ids: list[str], values: list[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    return df.unpivot(ids, values, var_name, value_name)


def cross_tabulate(df: DataFrame, row: str, column: str, values: list, normalize: str | None = None) -> DataFrame:
    """Counts of each value of column by row; normalize: shares of each row (index), of each column (columns) or of all (all).

    Rows with a null in either column, or another value, don't count.
    """
    df = df.where(F.col(row).isNotNull() & F.col(column).isin(values))
    out = pivot(df, [row], column, values, F.count(F.lit(1)), 0)
    if normalize is None:
        return out
    whole = lambda parts: reduce(lambda a, b: a + b, parts)
    if normalize == "index":
        return out.select(row, *((F.col(f"`{v}`") / whole(F.col(f"`{w}`") for w in values)).alias(str(v)) for v in values))
    if normalize not in ("columns", "all"):
        raise ValueError(f"unknown normalize {normalize!r}")
    totals = df.agg(*(F.count(F.when(F.col(column) == v, 1)).alias(f"t{k}") for k, v in enumerate(values)))  # one row
    share = lambda k: F.col(f"t{k}") if normalize == "columns" else whole(F.col(f"t{j}") for j in range(len(values)))
    return out.crossJoin(F.broadcast(totals)).select(row, *(F.try_divide(F.col(f"`{v}`"), share(k)).alias(str(v)) for k, v in enumerate(values)))


#: Start of the bucket that a timestamp falls into, the step between buckets, and the label of a bucket from its start.
_BUCKETS = {
    "H": ("hour", "interval 1 hour", lambda s: s),
    "D": ("day", "interval 1 day", lambda s: s),
    "W": ("week", "interval 7 days", lambda s: s + F.expr("interval 6 days")),
    "M": ("month", "interval 1 month", lambda s: F.last_day(s).cast("timestamp")),
    "Q": ("quarter", "interval 3 months", lambda s: F.last_day(F.add_months(s, 2)).cast("timestamp")),
    "Y": ("year", "interval 1 year", lambda s: F.last_day(F.add_months(s, 11)).cast("timestamp")),
}


def resample(df: DataFrame, date: str, freq: str, value: str, aggs: list[str]) -> DataFrame:
    """One row a bucket from the first to the last, empty ones too: their sums and counts are 0, the rest null.

    W, M, Q and Y are labelled by their last day, D and H by their start.
    """
    unit, step, label = _BUCKETS[freq]
    rows = df.where(F.col(date).isNotNull()).groupBy(F.date_trunc(unit, F.col(date)).alias("_at")).agg(*(_AGGREGATES[a](value).alias(a) for a in aggs))
    ends = rows.agg(F.min("_at").alias("a"), F.max("_at").alias("b"))
    calendar = ends.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(step))).alias("_at"))
    fill = [F.coalesce(a, F.lit(0)).alias(a) if a in ("sum", "count") else F.col(a) for a in aggs]
    return calendar.join(rows, "_at", "left").select(label(F.col("_at")).alias("bucket"), *fill)


def resample_groups(df: DataFrame, date: str, freq: str, values: dict[str, list[str]], group_by: list[str]) -> DataFrame:
    """resample() of several columns ({column: functions}, as column_function) within groups, each from its own first bucket to its last."""
    unit, step, label = _BUCKETS[freq]
    names = {f"{c}_{a}": (c, a) for c, fs in values.items() for a in fs}
    rows = df.where(F.col(date).isNotNull()).groupBy(*group_by, F.date_trunc(unit, F.col(date)).alias("_at")).agg(*(_AGGREGATES[a](c).alias(n) for n, (c, a) in names.items()))
    ends = rows.groupBy(*group_by).agg(F.min("_at").alias("a"), F.max("_at").alias("b"))
    calendar = ends.select(*group_by, F.explode(F.sequence("a", "b", F.expr(step))).alias("_at"))
    r = rows.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group_by)), F.col("_at").alias("_b"), *names)
    on = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group_by)), F.col("_at") == F.col("_b"))
    fill = [F.coalesce(n, F.lit(0)).alias(n) if a in ("sum", "count") else F.col(n) for n, (_, a) in names.items()]
    return calendar.join(r, on, "left").select(*group_by, label(F.col("_at")).alias("bucket"), *fill)


def period_changes(df: DataFrame, date: str, metrics: list[str], unit: str, current: str, before: str, group_by: list[str]) -> DataFrame:
    """(group_by, metric, current, reference, delta, pct, direction): period_comparison() of several columns within groups."""
    at = F.date_trunc({"M": "month", "Q": "quarter", "Y": "year"}[unit], F.col(date))
    total = lambda c, p: F.sum(F.when(at == F.to_timestamp(F.lit(p)), F.col(c)))
    s = df.where(F.col(date).isNotNull()).groupBy(*group_by).agg(*(F.struct(F.lit(c).alias("metric"), total(c, current).alias("current"), total(c, before).alias("reference")).alias(f"m{k}") for k, c in enumerate(metrics)))
    s = s.select(*group_by, F.inline(F.array(*(f"m{k}" for k in range(len(metrics))))))
    delta = F.col("current") - F.col("reference")
    pct = F.when(F.col("reference") != 0, 100 * delta / F.abs("reference"))
    return s.select(*group_by, "metric", "current", "reference", delta.alias("delta"), pct.alias("pct"), F.when(pct.isNull(), "no_data").when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("direction"))


def period_comparison(df: DataFrame, date: str, value: str, unit: str, current: str, before: str) -> DataFrame:
    """Sums of two periods (starts as dates) with their difference and its share of the earlier one."""
    at = F.date_trunc({"M": "month", "Q": "quarter", "Y": "year"}[unit], F.col(date))
    total = lambda p: F.sum(F.when(at == F.to_timestamp(F.lit(p)), F.col(value)))
    s = df.agg(total(current).alias("current"), total(before).alias("reference"))
    delta = F.col("current") - F.col("reference")
    pct = F.when(F.col("reference") != 0, 100 * delta / F.abs("reference"))
    return s.select("current", "reference", delta.alias("delta"), pct.alias("pct"), F.when(pct.isNull(), "no_data").when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("direction"))


def cohort(df: DataFrame, cohort_column: str, date: str, value: str) -> DataFrame:
    """Sums by cohort and month, in long form: the months needn't be known beforehand."""
    return df.groupBy(cohort_column, F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(value).alias("total"))
