"""Column profiles, data quality, correlation and test statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions import distributions as D
from tablework.operators.quantiles import FIGURES, nan_to_null, places, quantiles, quoted
from tablework.operators.ranking import kendall

NULL_LIKE = ["", "-", "N/A", "null", "None"]


def _skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)


def _kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, mean, std, min, quartiles, max, skew and excess kurtosis (adjusted; null below 3 and 4 values)."""
    df = nan_to_null(df.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns))))
    own = df.columns
    one = df.agg(*(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"), _skew(x).alias("skew"), _kurtosis(x).alias("kurtosis")).alias(x) for c, x in zip(columns, own, strict=True)))
    one = one.crossJoin(F.broadcast(quantiles(df, own, (0.25, 0.5, 0.75))))  # one row each
    rows = one.select(F.inline(F.array(*(F.struct(F.col(x).alias("s"), F.col(f"q{k}").alias("q")) for k, x in enumerate(own)))))
    return rows.select("s.column", "s.count", "s.mean", "s.std", "s.min", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "s.max", "s.skew", "s.kurtosis")


#: Shares at which extended figures take quantiles.
PERCENTILES = (5, 10, 25, 50, 75, 90, 95, 99)


def extended_stats(df: DataFrame, columns: list[str], percentiles: tuple[int, ...] = PERCENTILES, level: float = 0.95) -> DataFrame:
    """One row a column: count, mean, std, variance, min, max, range, cv (std by mean), mad (median distance from the median),
    skew, kurtosis, ci_lower and ci_upper (Student's interval of the mean at level), p_<percentile> for each, and shape.

    NaN counts as null; what needs more values than there are is null. shape: symmetric where skew is within 0.5, else
    right-skewed or left-skewed, highly beyond 1. Two rounds of quantiles over all columns together.
    """
    df = nan_to_null(df.select(*(F.col(quoted(c)).cast("double").alias(f"c{k}") for k, c in enumerate(columns))))
    own = df.columns
    middle = quantiles(df, own, (0.5,)).select(*(F.get(f"q{k}", F.lit(0)).alias(f"m{k}") for k in range(len(own))))
    apart = df.crossJoin(F.broadcast(middle)).select(*(F.abs(F.col(c) - F.col(f"m{k}")).alias(c) for k, c in enumerate(own)))
    mad = quantiles(apart, own, (0.5,)).select(*(F.get(f"q{k}", F.lit(0)).alias(f"d{k}") for k in range(len(own))))
    figures = lambda c, x: F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"), _skew(x).alias("skew"), _kurtosis(x).alias("kurtosis")).alias(x)
    one = df.agg(*(figures(c, x) for c, x in zip(columns, own, strict=True))).crossJoin(F.broadcast(quantiles(df, own, [p / 100 for p in percentiles]))).crossJoin(F.broadcast(mad))  # one row each
    rows = one.select(F.inline(F.array(*(F.struct(F.col(x).alias("s"), F.col(f"q{k}").alias("q"), F.col(f"d{k}").alias("mad")) for k, x in enumerate(own)))))
    reach = D.p_value(lambda n: D.student_quantile((1 + level) / 2, n - 1), F.when(F.col("s.count") > 1, F.col("s.count"))) * F.col("s.std") / F.sqrt("s.count")
    skew = F.col("s.skew")
    side = F.when(skew > 0, "right-skewed").otherwise("left-skewed")
    shape = F.when(F.abs(skew) <= 0.5, "symmetric").when(F.abs(skew) > 1, F.concat(F.lit("highly "), side)).otherwise(side)
    return rows.select(
        "s.column", "s.count", "s.mean", "s.std", "s.variance", "s.min", "s.max", (F.col("s.max") - F.col("s.min")).alias("range"), F.try_divide("s.std", F.abs("s.mean")).alias("cv"), "mad", "s.skew", "s.kurtosis",
        (F.col("s.mean") - reach).alias("ci_lower"), (F.col("s.mean") + reach).alias("ci_upper"), *(F.get("q", F.lit(i)).alias(f"p_{p}") for i, p in enumerate(percentiles)), shape.alias("shape"))


def scan_nulls_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: nulls, null-like texts and zeros."""
    kinds = dict(df.dtypes)
    count = lambda cond: F.count(F.when(cond, 1))
    text = lambda c: count(F.trim(c).isin(NULL_LIKE)) if kinds[c] == "string" else F.lit(0).cast("long")
    zero = lambda c: count(F.col(c) == 0) if kinds[c] != "string" else F.lit(0).cast("long")
    one = df.agg(*(F.struct(F.lit(c).alias("column"), count(F.col(c).isNull()).alias("nulls"), text(c).alias("null_like"), zero(c).alias("zeros")).alias(c) for c in columns))
    return one.select(F.inline(F.array(*map(F.col, columns))))


def check_outliers(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """One row a column (and method): limits and how many values lie beyond; two passes over all columns together.

    method: iqr (1.5 times the quartiles' distance), std (three deviations from the mean) or both, with a column method.
    """
    if method not in ("iqr", "std", "both"):
        raise ValueError(f"unknown method {method!r}")
    df = nan_to_null(df.select(*(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns))))
    own = df.columns
    limits = quantiles(df, own, (0.25, 0.75)).crossJoin(F.broadcast(df.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(own) for n, f in (("m", F.avg), ("s", F.stddev_samp))))))  # one row each
    edge = lambda k, i, j: 2.5 * F.get(f"q{k}", F.lit(i)) - 1.5 * F.get(f"q{k}", F.lit(j))
    sides = {"iqr": lambda k: (edge(k, 0, 1), edge(k, 1, 0)), "std": lambda k: (F.col(f"m{k}") - 3 * F.col(f"s{k}"), F.col(f"m{k}") + 3 * F.col(f"s{k}"))}
    each = [(k, c, kind, *sides[kind](k)) for k, c in enumerate(columns) for kind in (("iqr", "std") if method == "both" else (method,))]
    first = lambda x: F.any_value(x, True)
    found = [F.struct(F.lit(c).alias("column"), *([F.lit(kind).alias("method")] if method == "both" else []), first(low).alias("low"), first(high).alias("high"), F.count(F.when((F.col(f"c{k}") < low) | (F.col(f"c{k}") > high), 1)).alias("outliers")).alias(f"r{i}") for i, (k, c, kind, low, high) in enumerate(each)]
    return df.crossJoin(F.broadcast(limits)).agg(*found).select(F.inline(F.array(*(f"r{i}" for i in range(len(each))))))


def detect_anomalies(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    df = nan_to_null(df, [column])
    x = F.col(quoted(column))
    one = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).crossJoin(F.broadcast(quantiles(df, [column], (0.25, 0.75)))).select(F.struct("m", "s", "q0").alias(FIGURES))  # one row each
    f = lambda c: F.col(f"`{FIGURES}`.{c}")
    a, b = F.get(f("q0"), F.lit(0)), F.get(f("q0"), F.lit(1))
    iqr = ((x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a))).cast("int")
    z = (F.abs(x - f("m")) > threshold * f("s")).cast("int")
    flags = {f"{column}_iqr_flag": F.coalesce(iqr, F.lit(0)), f"{column}_zscore_flag": F.coalesce(z, F.lit(0))}
    out = df.crossJoin(F.broadcast(one)).withColumns(flags).drop(FIGURES)
    return out.withColumn("_anomaly_score", F.col(quoted(f"{column}_iqr_flag")) + F.col(quoted(f"{column}_zscore_flag")))


def validate(df: DataFrame, columns: list[str], max_null_pct: float = 5) -> DataFrame:
    """One row: errors, warnings, infos and the score max(0, 100 - 5 errors - 2 warnings - infos)."""
    kinds = dict(df.dtypes)
    total = F.count(F.lit(1))
    share = lambda c: F.coalesce(100 * F.try_divide(F.count(F.when(F.col(c).isNull(), 1)), total), F.lit(0.0))
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    errors = add([(share(c) > max_null_pct).cast("int") for c in columns])
    zeros = [(F.count(F.when(F.col(c) == 0, 1)) > 0).cast("int") for c in columns if kinds[c] not in ("string", "timestamp", "date", "boolean")]
    warnings = add([((share(c) > 0) & (share(c) <= max_null_pct)).cast("int") for c in columns] + zeros)
    repeats = df.groupBy(*columns).count().agg(F.coalesce((F.max("count") > 1).cast("int"), F.lit(0)).alias("infos"))
    one = df.agg(errors.alias("errors"), warnings.alias("warnings")).crossJoin(F.broadcast(repeats))
    return one.withColumn("score", F.greatest(F.lit(0), 100 - 5 * F.col("errors") - 2 * F.col("warnings") - F.col("infos")))


def _corr(a: str, b: str) -> Column:
    """Pearson's r over rows that have both; null where one is constant."""
    x, y = F.col(quoted(a)), F.col(quoted(b))
    spread = lambda x, y: F.stddev_pop(F.when(y.isNotNull(), x))
    return F.try_divide(F.covar_pop(x, y), spread(x, y) * spread(y, x))


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) of all pairs of columns: Pearson in one pass; Spearman as Pearson of average ranks over rows that have all
    columns; Kendall's tau-b pair by pair. NaN counts as null.

    For Spearman all columns are ranked together, from one set of bounds, and each column's ranks are joined once.
    """
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    if method == "kendall":
        every = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
        found = [kendall(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("tau").alias("r")) for a, b in every]
        return reduce(lambda x, y: x.unionByName(y), found)
    df = nan_to_null(df.select(*map(quoted, columns)))
    if method == "spearman":
        df = df.toDF(*(f"c{k}" for k in range(len(columns)))).dropna()
        ranks = places(df, df.columns).select("k", "v", (F.col("before") + (F.col("times") + 1) / 2).alias("rank"))
        for k in range(len(columns)):
            own = ranks.where(F.col("k") == k).select(F.col("v").alias(f"v{k}"), F.col("rank").alias(f"r{k}"))
            df = df.join(own, F.col(f"c{k}").cast("double") == F.col(f"v{k}")).drop(f"c{k}", f"v{k}")
        df = df.select(*(F.col(f"r{k}").alias(c) for k, c in enumerate(columns)))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))))


def t_test(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Pooled two-sample t statistic, degrees of freedom, Cohen's d and two-sided p."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    one = df.agg(*(f(pick(g)).alias(f"{n}{k}") for k, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    sd = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    d = F.try_divide(F.col("m1") - F.col("m2"), sd)
    t = F.try_divide(d, F.sqrt(F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    one = one.select(t.alias("statistic"), (F.col("n1") + F.col("n2") - 2).alias("df"), d.alias("cohens_d"))
    return one.withColumn("p_value", D.p_value(D.student, F.col("statistic"), F.col("df")))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F statistic, eta squared and p of the groups' means."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w"))
    one = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2))
    one = one.select(f.alias("statistic"), F.try_divide("between", F.col("between") + F.col("within")).alias("eta_squared"), d1.alias("d1"), d2.alias("d2"))
    return one.withColumn("p_value", D.p_value(D.fisher_f, F.col("statistic"), F.col("d1"), F.col("d2"))).drop("d1", "d2")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic of a contingency table (with Yates' correction if it is 2 by 2), degrees of freedom, Cramér's V and p."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()
    rows, cols = cells.groupBy(a).agg(F.sum("count").alias("r")), cells.groupBy(b).agg(F.sum("count").alias("c"))
    total = cells.agg(F.sum("count").alias("n"))
    kinds = rows.agg(F.count(F.lit(1)).alias("kr")).crossJoin(cols.agg(F.count(F.lit(1)).alias("kc")))
    # sum (o - e)^2 / e = n * (sum o^2 / (r c) - 1), so empty cells need no rows; of a 2 by 2 table all |o - e| are equal
    share = F.col("count") * F.col("count") / (F.col("r") * F.col("c"))
    one = cells.join(rows, a).join(cols, b).agg(F.sum(share).alias("s"), F.max(F.struct("count", "r", "c")).alias("cell")).crossJoin(total).crossJoin(kinds)
    plain = F.col("n") * (F.col("s") - 1)
    off = F.abs(F.col("cell.count") - F.col("cell.r") * F.col("cell.c") / F.col("n"))
    yates = plain * F.pow(F.coalesce(F.try_divide(F.greatest(off - 0.5, F.lit(0.0)), off), F.lit(0.0)), 2)
    statistic = F.when((F.col("kr") == 2) & (F.col("kc") == 2), yates).otherwise(plain)
    one = one.select(statistic.alias("statistic"), ((F.col("kr") - 1) * (F.col("kc") - 1)).alias("df"), F.sqrt(F.try_divide(statistic, F.col("n") * (F.least("kr", "kc") - 1))).alias("cramers_v"))
    return one.withColumn("p_value", D.p_value(D.chi_square, F.col("statistic"), F.col("df")))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def word_frequency(df: DataFrame, column: str) -> DataFrame:
    """Words in lower case, without what is neither a letter, a digit, an underscore nor white space."""
    bare = F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}_\s]", "")
    words = df.select(F.explode(F.split(bare, r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def rollup_totals(df: DataFrame, hierarchy: list[str], value: str) -> DataFrame:
    return df.rollup(*hierarchy).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("start")).agg(F.count(F.lit(1)).alias("count"))
