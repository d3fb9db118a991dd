"""What a table holds: inspection, search among columns, inferred kinds, imputation, alerts, comparison and small views.

Per-column figures come from one melted pass: values are counted a column and value, and only those counts are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators.columns import fill_nulls
from tablework.operators.profile import _skew, correlation
from tablework.operators.quantiles import nan_to_null, quantiles, quoted, running


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric, datetime or categorical for every column."""
    of = lambda t: "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "numeric" if isinstance(t, T.NumericType) else "categorical"
    return {f.name: of(f.dataType) for f in df.schema.fields}


def value_figures(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct, top, zeros, dates, numbers) of every column; top: rows of its most frequent value; dates and
    numbers: rows whose text reads as one; empty for an empty table."""
    df = nan_to_null(df)
    melted = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))).alias("x"))
    counts = melted.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    there, n, number = F.col("value").isNotNull(), F.col("n"), F.col("value").try_cast("double")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    return counts.groupBy("column").agg(
        F.sum("n").alias("rows"), total(~there).alias("nulls"), F.count("value").alias("distinct"), F.coalesce(F.max(F.when(there, n)), F.lit(0)).cast("long").alias("top"),
        total(number == 0).alias("zeros"), total(F.try_to_timestamp("value").isNotNull()).alias("dates"), total(number.isNotNull()).alias("numbers"))


def _described(df: DataFrame) -> DataFrame:
    types = F.create_map(*(F.lit(x) for c, t in df.dtypes for x in (c, t)))
    kind = F.create_map(*(F.lit(x) for c, k in kinds(df).items() for x in (c, k)))
    return value_figures(df).withColumn("dtype", F.element_at(types, F.col("column"))).withColumn("kind", F.element_at(kind, F.col("column"))).withColumn("null_pct", 100 * F.col("nulls") / F.col("rows"))


def inspect(df: DataFrame) -> DataFrame:
    """One row a column: column, dtype, kind, rows, nulls, null_pct, distinct."""
    return _described(df).select("column", "dtype", "kind", "rows", "nulls", F.round("null_pct", 2).alias("null_pct"), "distinct")


def search_columns(df: DataFrame, has_nulls: bool = False, has_zeros: bool = False, kind: str = "", name_contains: str = "", min_null_pct: float = 0.0) -> DataFrame:
    """(column, dtype, nulls, zeros) of the columns that meet all criteria; zeros are counted in numeric columns only."""
    of = kinds(df)
    # nulls and zeros are one aggregate; no value is shuffled
    count = lambda cond: F.count(F.when(cond, 1))
    zero = lambda c: count(F.col(quoted(c)) == 0) if of[c] == "numeric" else F.lit(0).cast("long")
    one = df.agg(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(of[c]).alias("kind"), F.count(F.lit(1)).alias("rows"), count(F.col(quoted(c)).isNull()).alias("nulls"), zero(c).alias("zeros")).alias(f"c{k}") for k, (c, t) in enumerate(df.dtypes)))
    out = one.select(F.inline(F.array(*(f"c{k}" for k in range(len(df.columns)))))).where("rows > 0").withColumn("null_pct", 100 * F.try_divide("nulls", "rows"))
    tests = [F.lit(True)]
    tests += [F.col("nulls") > 0] * has_nulls + [F.col("zeros") > 0] * has_zeros + [F.col("null_pct") >= min_null_pct] * (min_null_pct > 0)
    tests += [F.col("kind") == kind] * bool(kind) + [F.lower("column").contains(name_contains.lower())] * bool(name_contains)
    return out.where(reduce(lambda a, b: a & b, tests)).select("column", "dtype", "nulls", "zeros")


def detect_schema(df: DataFrame) -> DataFrame:
    """(column, dtype, inferred): what a column's values are, judged over all rows.

    Texts: datetime if all read as one, numeric if over 90 % do, id if all of more than 10 differ, category if under 5 % are
    distinct, else text. Whole numbers: category_encoded if under 5 % and at most 20 are distinct.
    """
    there = F.col("rows") - F.col("nulls")
    share = F.try_divide("distinct", F.greatest(there, F.lit(1)))
    text = F.when((there > 0) & (F.col("dates") == there), "datetime").when(F.col("numbers") > 0.9 * there, "numeric").when((F.col("distinct") == there) & (there > 10), "id").when(share < 0.05, "category").otherwise("text")
    whole = F.when((share < 0.05) & (F.col("distinct") <= 20), "category_encoded").otherwise("int")
    kind = F.when(F.col("kind") == "datetime", "datetime").when(F.col("dtype").isin("tinyint", "smallint", "int", "bigint"), whole).when(F.col("kind") == "numeric", "float").otherwise(text)
    return _described(df).select("column", "dtype", kind.alias("inferred"))


def sample_rows(df: DataFrame, n: int = 100, method: str = "random", order_by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """n rows: the first or last by order_by (head, tail), or random ones."""
    if method == "random":
        return df.orderBy(F.rand(seed)).limit(n)
    order = [F.col(c).desc() if method == "tail" else F.col(c).asc() for c in order_by]
    return df.orderBy(*order).limit(n)


def smart_impute(df: DataFrame, order_by: list[str], columns: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Nulls filled by median in numeric columns, by the value before in datetime ones, by the mode in others.

    Columns without a null stay as they are; one pass tells which have any.
    """
    columns = columns or df.columns
    nulls = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns)).first()
    strategy = {"numeric": "median", "datetime": "ffill", "categorical": "mode"}
    of = kinds(df)
    return reduce(lambda d, c: fill_nulls(d, c, strategy[of[c]], order_by, partition_by), (c for c in columns if nulls[c]), df)


def concat_columns(left: DataFrame, right: DataFrame, left_order: str, right_order: str, suffix: str = "_2") -> DataFrame:
    """Rows side by side, by their numbers in each order; the orders must be distinct numbers. Unequal row counts are an error."""
    if left.count() != right.count():
        raise ValueError("the tables have different numbers of rows")
    names = {c: c + suffix if c in left.columns else c for c in right.columns}
    numbered = lambda df, by: running(df.withColumn("_one", F.lit(1)), by, "_one").drop("_one")
    a = numbered(left, left_order)
    b = numbered(right, right_order).select("sum", *(F.col(c).alias(n) for c, n in names.items()))
    return a.join(b, "sum").drop("sum")


def transpose(df: DataFrame, header: str) -> DataFrame:
    """Rows become columns named by header; what were columns are the rows, named in key, as text. Spark bounds the rows (spark.sql.transposeMaxValues)."""
    texts = df.select(header, *(F.col(c).cast("string").alias(c) for c in df.columns if c != header))
    return texts.transpose(F.col(header))


def missing_matrix(df: DataFrame, order_by: list[str], rows: int = 300) -> DataFrame:
    """For a sample of rows, spread by hash, one flag a column: whether its value is missing."""
    taken = df.orderBy(F.md5(F.concat_ws(",", *(F.col(quoted(c)).cast("string") for c in order_by))), *map(quoted, order_by)).limit(rows)
    return taken.select(*order_by, *(F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in df.columns if c not in order_by))


def _outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column how many values lie beyond 1.5 times the quartiles' distance from them, as n0, n1, ..."""
    q = quantiles(df, columns, (0.25, 0.75))
    low = lambda k: 2.5 * F.get(f"q{k}", F.lit(0)) - 1.5 * F.get(f"q{k}", F.lit(1))
    high = lambda k: 2.5 * F.get(f"q{k}", F.lit(1)) - 1.5 * F.get(f"q{k}", F.lit(0))
    return df.crossJoin(F.broadcast(q)).agg(*(F.count(F.when((F.col(c) < low(k)) | (F.col(c) > high(k)), 1)).alias(f"n{k}") for k, c in enumerate(columns)))  # one row


def _repeated_rows(df: DataFrame) -> DataFrame:
    """One row: rows (n) and those that equal an earlier one (repeats)."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))


def alerts(df: DataFrame) -> DataFrame:
    """(column, type, severity, figure) by nine rules; figure: what a rule judges. column is null for the whole table."""
    of = kinds(df)
    numeric = [c for c, k in of.items() if k == "numeric"]
    f = _described(df)
    pct = lambda x, n: F.round(100 * F.try_divide(x, n), 1)
    row = lambda when, kind, severity, figure: F.when(when, F.struct("column", F.lit(kind).alias("type"), severity.alias("severity"), figure.cast("double").alias("figure")))
    warning, error = F.lit("warning"), F.lit("error")
    nulls, zeros = F.round("null_pct", 1), pct(F.col("zeros"), F.col("rows"))
    top = pct(F.col("top"), F.col("rows") - F.col("nulls"))
    text, number = F.col("kind") == "categorical", F.col("kind") == "numeric"
    rules = [
        row(F.col("distinct") <= 1, "CONSTANT", error, F.col("distinct")),
        row(nulls > 20, "HIGH NULLS", F.when(nulls > 50, error).otherwise(warning), nulls),
        row(number & (zeros > 50), "ZEROS", warning, zeros),
        row(text & (F.col("distinct") > F.greatest(F.lit(50.0), F.col("rows") * 0.5)), "HIGH CARDINALITY", warning, F.col("distinct")),
        row(text & (top > 90), "IMBALANCED", warning, top),
    ]
    found = [f.select(F.inline(F.array_compact(F.array(*rules))))]
    put = lambda column, when, kind, severity, figure: F.when(when, F.struct(F.lit(column).cast("string").alias("column"), F.lit(kind).alias("type"), severity.alias("severity"), figure.cast("double").alias("figure")))
    listed = lambda one, rules: one.select(F.inline(F.array_compact(F.array(*rules))))
    if numeric:
        skews = df.agg(*(F.round(_skew(c), 2).alias(f"s{k}") for k, c in enumerate(numeric)))
        found.append(listed(skews, [put(c, F.abs(f"s{k}") > 2, "SKEWED", warning, F.col(f"s{k}")) for k, c in enumerate(numeric)]))
        beyond = _outlier_counts(df, numeric).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))  # one row each
        found.append(listed(beyond, [put(c, pct(F.col(f"n{k}"), F.col("n")) > 10, "OUTLIERS", warning, pct(F.col(f"n{k}"), F.col("n"))) for k, c in enumerate(numeric)]))
    if len(numeric) > 1:
        near = correlation(df, numeric).where(F.abs(F.round("r", 3)) > 0.9)
        found.append(near.select(F.col("a").alias("column"), F.lit("HIGH CORR").alias("type"), warning.alias("severity"), F.round("r", 3).alias("figure")))
    share = pct(F.col("repeats"), F.col("n"))
    found.append(listed(_repeated_rows(df), [put(None, F.col("repeats") > 0, "DUPLICATES", F.when(share < 5, warning).otherwise(error), share)]))
    return reduce(lambda a, b: a.unionByName(b), found)


def eda(df: DataFrame) -> DataFrame:
    """One row: rows, columns, mean share of nulls, share of repeated rows, mean share of outliers, and the score 100 less the first, half the second and 0.3 of the third, all in percent."""
    df = nan_to_null(df).toDF(*(f"c{k}" for k in range(len(df.columns))))
    numeric = [c for c, k in kinds(df).items() if k == "numeric"]
    one = df.agg(F.count(F.lit(1)).alias("rows"), reduce(lambda a, b: a + b, (F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns)).alias("nulls")).crossJoin(F.broadcast(_repeated_rows(df)))  # one row each
    beyond: Column = F.lit(0)
    if numeric:
        one = one.crossJoin(F.broadcast(_outlier_counts(df, numeric)))  # one row
        beyond = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(len(numeric))))
    share = lambda x, n: F.coalesce(100 * F.try_divide(x, F.col("rows") * n), F.lit(0.0))
    one = one.select("rows", F.lit(len(df.columns)).alias("columns"), share(F.col("nulls"), len(df.columns)).alias("null_pct"), share(F.col("repeats"), 1).alias("duplicate_pct"), share(beyond, max(1, len(numeric))).alias("outlier_pct"))
    return one.withColumn("score", F.greatest(F.lit(0.0), F.round(100 - F.col("null_pct") - 0.5 * F.col("duplicate_pct") - 0.3 * F.col("outlier_pct"))))


def compare_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a column of either table: side (a, b or both), dtypes, nulls of each, and means with their change in percent where both are numeric."""
    da, db = dict(a.dtypes), dict(b.dtypes)
    number = [c for c in da if c in db and kinds(a)[c] == kinds(b)[c] == "numeric"]
    figures = lambda df, side: df.agg(*(x for k, c in enumerate(df.columns) for x in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"{side}n{k}"), (F.avg(c) if c in number else F.lit(None).cast("double")).alias(f"{side}m{k}"))))
    one = figures(a, "a").crossJoin(F.broadcast(figures(b, "b")))  # one row each
    at = lambda df, c, what, side: F.col(f"{side}{what}{df.columns.index(c)}") if c in df.columns else F.lit(None).cast("double" if what == "m" else "long")
    rows = []
    for c in dict.fromkeys([*a.columns, *b.columns]):
        x, y = at(a, c, "m", "a"), at(b, c, "m", "b")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit("both" if c in da and c in db else "a" if c in da else "b").alias("side"), F.lit(da.get(c)).cast("string").alias("dtype_a"), F.lit(db.get(c)).cast("string").alias("dtype_b"),
            at(a, c, "n", "a").alias("nulls_a"), at(b, c, "n", "b").alias("nulls_b"), x.alias("mean_a"), y.alias("mean_b"), (100 * F.try_divide(y - x, x)).alias("pct_change")))
    return one.select(F.inline(F.array(*rows)))


def profile_columns(df: DataFrame, top: int = 10) -> DataFrame:
    """One row a column: column, dtype, kind, rows, nulls, null_pct, distinct, unique_pct, mode, top_values and quality.

    Shares are in percent to one digit. mode and top_values ([{value, count}], the largest counts, ties by value) are of columns
    that are neither numbers nor dates, null for others. quality: 0.7 times the share of filled rows and 0.3 times unique_pct.
    """
    text = [c for c, k in kinds(df).items() if k == "categorical"]
    figures = _described(df)
    pct = lambda x: F.coalesce(F.round(100 * F.try_divide(x, F.col("rows")), 1), F.lit(0.0))
    figures = figures.select("column", "dtype", "kind", "rows", "nulls", pct(F.col("nulls")).alias("null_pct"), "distinct", pct(F.col("distinct")).alias("unique_pct"))
    schema = "column string, mode string, top_values array<struct<value:string,count:bigint>>"
    if text:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in text))).alias("x")).select("x.*").where("value is not null")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
        # each task hands on its own largest counts of a column alone
        order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
        first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        listed = first.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "count"))).alias("t"))
        tops = listed.select("column", F.get("t", F.lit(0))["value"].alias("mode"), F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("top_values"))
    else:
        tops = df.sparkSession.createDataFrame([], schema)
    return figures.join(F.broadcast(tops), "column", "left").withColumn("quality", 0.7 * (100 - F.col("null_pct")) + 0.3 * F.col("unique_pct"))  # a row a column


def load_summary(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, nulls, distinct, sample): what a table that was just read holds; sample: its first two rows' values as text."""
    first = df.limit(2).select(*(F.col(quoted(c)).cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)))
    gathered = first.agg(*(F.collect_list(F.coalesce(f"c{k}", F.lit("null"))).alias(f"c{k}") for k in range(len(df.columns))))  # two rows
    samples = gathered.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("sample")) for k, c in enumerate(df.columns)))))
    return inspect(df).select("column", "dtype", "rows", "nulls", "distinct").join(F.broadcast(samples), "column")  # a row a column
