"""Test statistics from moments and average ranks; each is a few aggregations and returns one row."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions import distributions as D
from tablework.operators.profile import _corr, anova, chi_square, t_test
from tablework.operators.quantiles import group_quantiles, ranked, running
from tablework.operators.ranking import shapiro_wilk

def one_sample_t(df: DataFrame, value: str, mean: float) -> DataFrame:
    """t statistic of the mean against a given one, n - 1 and two-sided p."""
    n = F.count(value)
    one = df.agg(F.try_divide((F.avg(value) - mean) * F.sqrt(n), F.stddev_samp(value)).alias("statistic"), (n - 1).alias("df"))
    return one.withColumn("p_value", D.p_value(D.student, F.col("statistic"), F.col("df")))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """t statistic of a - b over rows that have both, degrees of freedom and two-sided p."""
    return one_sample_t(df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")), "d", 0.0)


def proportion_z(df: DataFrame, hit: Column, group: str, first, second) -> DataFrame:
    """Pooled two-sample z statistic of the shares of rows that hit, both shares and two-sided p."""
    side = lambda g: F.col(group) == g
    one = df.agg(*(F.count(F.when(side(g), 1)).alias(f"n{k}") for k, g in ((1, first), (2, second))), *(F.count(F.when(side(g) & hit, 1)).alias(f"h{k}") for k, g in ((1, first), (2, second))))
    p1, p2 = F.try_divide("h1", "n1"), F.try_divide("h2", "n2")
    pooled = F.try_divide(F.col("h1") + F.col("h2"), F.col("n1") + F.col("n2"))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    one = one.select(F.try_divide(p1 - p2, spread).alias("statistic"), p1.alias("share_1"), p2.alias("share_2"))
    return one.withColumn("p_value", D.p_value(D.normal, F.col("statistic")))


def proportion_z_one(df: DataFrame, hit: Column, share: float) -> DataFrame:
    """z statistic of the share of rows that hit (among those for which that is known) against a given one, the share and two-sided p."""
    one = df.agg(F.count(hit).alias("n"), F.avg(hit.cast("double")).alias("share"))
    z = F.try_divide(F.col("share") - share, F.sqrt(F.try_divide(F.lit(share * (1 - share)), F.col("n"))))
    return one.select(z.alias("statistic"), "share", D.normal_p(z).alias("p_value"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """ANOVA of the absolute differences from each group's median."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    middle = group_quantiles(rows, value, [group], (0.5,))
    return anova(rows.join(middle, group).select(group, F.abs(F.col(value) - F.get("q", F.lit(0))).alias("d")), "d", group).select("statistic", "p_value")


def _rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, n, r) with each group's sum of ranks, and one row with the sum of t^3 - t over ties."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("value"))
    ranks = ranked(rows, "value")
    cells = rows.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))  # a hot value is counted before it is joined
    sums = cells.join(ranks, "value").groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    t = F.col("times").cast("double")
    return sums, ranks.agg(F.sum(t * t * t - t).alias("ties"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """H statistic, corrected for ties, degrees of freedom and p."""
    sums, ties = _rank_sums(df, value, group)
    one = sums.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).crossJoin(F.broadcast(ties))  # one row each
    n = F.col("n")
    h = F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide("ties", n * n * n - n))
    one = one.select(h.alias("statistic"), (F.col("k") - 1).alias("df"))
    return one.withColumn("p_value", D.p_value(D.chi_square, F.col("statistic"), F.col("df")))


def mann_whitney(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """U of the first group, the rank-biserial correlation 1 - 2 U / (n1 n2) and two-sided p.

    p is exact where there are no ties and the smaller group has at most 8 values (and n1 n2 <= D.RANK_SUMS, beyond which the
    two agree), else by the normal limit with ties and continuity.
    """
    sums, ties = _rank_sums(df.where(F.col(group).isin(first, second)), value, group)
    pick = lambda c, g: F.max(F.when(F.col("group") == g, F.col(c))).cast("double")
    one = sums.agg(pick("n", first).alias("n1"), pick("n", second).alias("n2"), pick("r", first).alias("r1")).crossJoin(F.broadcast(ties))  # one row each
    u, both, n = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")
    spread = F.sqrt(both / 12 * (n + 1 - F.try_divide("ties", n * (n - 1))))
    z = F.try_divide(F.abs(u - both / 2) - 0.5, spread)
    few = (F.col("ties") == 0) & (F.least("n1", "n2") <= 8) & (both <= D.RANK_SUMS)
    exact = D.p_value(lambda u, a, b, few, z: D.rank_sum_exact(u, int(a), int(b)) if few else D.normal(z), u, F.col("n1"), F.col("n2"), few, F.greatest(z, F.lit(0.0)))
    return one.select(u.alias("statistic"), (1 - F.try_divide(2 * u, both)).alias("rank_biserial"), exact.alias("p_value"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """The smaller signed-rank sum of a - b, zero differences left out, and two-sided p.

    p is exact for up to 50 pairs without ties or zero differences, else by the normal limit with ties.
    """
    every = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    zeros = every.agg(F.count(F.when(F.col("d") == 0, 1)).alias("zeros"))
    rows = every.where("d <> 0").select(F.abs("d").alias("value"), (F.col("d") > 0).alias("up"))
    ranks = ranked(rows, "value")
    cells = rows.groupBy("up", "value").agg(F.count(F.lit(1)).alias("n")).join(ranks, "value")
    side = lambda up: F.coalesce(F.sum(F.when(F.col("up") == up, F.col("n") * F.col("rank"))), F.lit(0.0))
    t, n = F.col("times").cast("double"), F.col("n")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"), F.sum(t).alias("n"))
    one = cells.agg(F.least(side(True), side(False)).alias("statistic")).crossJoin(F.broadcast(ties)).crossJoin(F.broadcast(zeros))  # one row each
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    few = (F.col("ties") == 0) & (F.col("zeros") == 0) & (n <= D.SIGNED)
    z = F.try_divide(F.col("statistic") - n * (n + 1) / 4, spread)
    return one.select("statistic", D.p_value(lambda t, n, few, z: D.signed_rank_exact(t, int(n)) if few else D.normal(z), F.col("statistic"), n, few, z).alias("p_value"))


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first, second, method: str = "auto") -> DataFrame:
    """The largest difference of two groups' distribution functions, and its p; null where a group has no values.

    method: exact counts paths, limit takes the limit distribution, auto is exact for groups of up to D.PATHS values.
    """
    rows = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).select((F.col(group) == first).alias("one"), F.col(value).cast("double").alias("value"))
    places = ranked(rows, "value").select("value", (F.col("rank") + (F.col("times") - 1) / 2).alias("upto"))
    own = rows.groupBy("value").agg(F.count(F.when(F.col("one"), 1)).alias("a")).join(places, "value")
    counts = rows.agg(F.count(F.when(F.col("one"), 1)).alias("n1"), F.count(F.when(~F.col("one"), 1)).alias("n2"))
    summed = running(own.select("value", "upto", "a"), "value", "a")
    d = summed.crossJoin(F.broadcast(counts)).agg(F.max(F.abs(F.try_divide("sum", "n1") - F.try_divide(F.col("upto") - F.col("sum"), F.col("n2")))).alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    if method not in ("auto", "exact", "limit"):
        raise ValueError(f"unknown method {method!r}")

    def tail(d: float, a: float, b: float) -> float:
        few = method == "exact" or method == "auto" and max(a, b) <= D.PATHS
        return D.kolmogorov_exact(d, int(a), int(b)) if few else D.kolmogorov(d * (a * b / (a + b)) ** 0.5)

    return d.select("statistic", D.p_value(tail, F.col("statistic"), F.col("n1"), F.col("n2")).alias("p_value"))


def fisher(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Odds ratio and two-sided p of a 2 by 2 table of conditions; rows where either is null are left out."""
    n = lambda x, y: F.count(F.when(x & y, 1))
    one = df.where(a.isNotNull() & b.isNotNull()).agg(n(a, b).alias("a"), n(a, ~b).alias("b"), n(~a, b).alias("c"), n(~a, ~b).alias("d"))
    exact = F.udf(lambda *x: D.fisher_exact(*x), "double")
    return one.select(F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")).alias("odds_ratio"), exact("a", "b", "c", "d").alias("p_value"))


def regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares of y on several columns: one row a term with its coefficient, standard error, t and p, and r2, adjusted r2, F and n.

    Rows with a null in any column are left out. Spark gathers the moments in one pass; the driver solves for as many terms as
    there are columns.
    """
    columns = [y, *xs]
    rows = df.dropna(subset=columns).select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"c{k}").alias(f"m{k}") for k in range(len(columns))), *(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    n, k = one["n"], len(xs)
    spark, schema = df.sparkSession, "term string, coefficient double, std_error double, t double, p_value double, r2 double, adjusted_r2 double, f double, n long"
    if n <= k + 1:
        return spark.createDataFrame([], schema)
    v = np.array([[one[f"v{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) * n
    means = np.array([one[f"m{i}"] for i in range(k + 1)])
    inverse = np.linalg.pinv(v[1:, 1:])
    slopes = inverse @ v[1:, 0]
    rest = max(0.0, v[0, 0] - slopes @ v[1:, 0])
    sigma2 = rest / (n - k - 1)
    r2 = float(1 - rest / v[0, 0]) if v[0, 0] > 0 else None
    adjusted = None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k - 1)
    f = None if r2 is None or r2 >= 1 else r2 / k / ((1 - r2) / (n - k - 1))
    errors = np.sqrt(np.concatenate([[sigma2 * (1 / n + means[1:] @ inverse @ means[1:])], sigma2 * np.diag(inverse)]))
    terms = zip(["intercept", *xs], np.concatenate([[means[0] - slopes @ means[1:]], slopes]).tolist(), errors.tolist(), strict=True)
    out = []
    for term, b, error in terms:
        t = b / error if error else None
        out.append((term, b, error, t, None if t is None else D.student(t, n - k - 1), r2, adjusted, f, n))
    return spark.createDataFrame(out, schema)


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(term, vif): how much each column's coefficient varies more for being told by the other columns; null where they tell it fully.

    Rows with a null in any column are left out. Spark gathers the correlations in one pass; the driver inverts a matrix as
    large as there are columns.
    """
    rows = df.dropna(subset=columns).select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    k = len(columns)
    one = rows.agg(*(F.try_divide(F.covar_pop(f"c{i}", f"c{j}"), F.stddev_pop(f"c{i}") * F.stddev_pop(f"c{j}")).alias(f"r{i}_{j}") for i in range(k) for j in range(i))).first() if k > 1 else {}
    r = np.array([[1.0 if i == j else one[f"r{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], float)
    fine = np.isfinite(r).all() and np.linalg.matrix_rank(r) == k
    found = np.diag(np.linalg.inv(r)).tolist() if fine else [None] * k
    return df.sparkSession.createDataFrame(list(zip(columns, found, strict=True)), "term string, vif double")


#: Exponents beyond which transforms no longer fit into numbers.
WIDEST = 64.0


def _likeliest(df: DataFrame, x: Column, power, slope: Column, low: float, high: float) -> float:
    """The exponent k under which power(k) is likeliest normal, where slope is the sum of its log derivatives a unit of k - 1.

    Each pass tries 41 exponents in one aggregation and the next looks closer around the best; where that is the first or last,
    the next pass looks as far beyond it instead, up to WIDEST. Four passes around it give the exponent to about 1e-5. 0 without
    values or where they are all equal.
    """
    best, closer = 0.0, 0
    while closer < 4:
        tried = [low + (high - low) * i / 40 for i in range(41)]
        one = df.agg(slope.alias("s"), F.count(x).alias("n"), *(F.var_pop(power(k)).alias(f"v{i}") for i, k in enumerate(tried)))
        each = [F.struct(((k - 1) * F.col("s") - F.col("n") / 2 * F.ln(f"v{i}")).alias("likely"), F.lit(k).alias("k")) for i, k in enumerate(tried)]
        found = one.select(F.array_max(F.filter(F.array(*each), lambda e: e["likely"].isNotNull() & ~F.isnan(e["likely"]) & (F.abs(e["likely"]) < float("inf")))).alias("b")).first()["b"]
        if found is None:
            break
        best, width = found["k"], high - low
        if not closer and best in (tried[0], tried[-1]) and abs(best) < WIDEST:
            low, high = (best - width, best + width / 40) if best == tried[0] else (best - width / 40, best + width)
            continue
        closer += 1
        low, high = best - width / 40, best + width / 40
    return best


def box_cox(df: DataFrame, column: str, name: str, low: float = -2.0, high: float = 2.0) -> tuple[DataFrame, float]:
    """The Box-Cox transform with the likeliest exponent, and that exponent; values of 0 or less are an error."""
    x = F.col(column).cast("double")
    if (df.agg(F.min(x)).first()[0] or 1) <= 0:
        raise ValueError(f"{column!r} has values of 0 or less")
    power = lambda x, k: F.ln(x) if abs(k) < 1e-9 else (F.pow(x, F.lit(k)) - 1) / k
    # the likeliest exponent is the same for multiples of the values; around 1 their powers keep their digits
    middle = math.exp(df.agg(F.avg(F.ln(x))).first()[0] or 0.0)
    scaled = x / F.lit(middle)
    best = _likeliest(df, scaled, lambda k: power(scaled, k), F.sum(F.ln(scaled)), low, high)
    return df.withColumn(name, power(x, best)), best


def yeo_johnson(df: DataFrame, column: str, name: str, exponent: float | None = None, low: float = -2.0, high: float = 2.0) -> tuple[DataFrame, float]:
    """The Yeo-Johnson transform, for values of either sign, and its exponent: the one given or else the likeliest; nulls stay."""
    x = F.col(column).cast("double")

    def power(k: float) -> Column:
        up = F.log1p(x) if abs(k) < 1e-9 else (F.pow(1 + x, F.lit(k)) - 1) / k
        down = -F.log1p(-x) if abs(k - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - k)) - 1) / (2 - k)
        return F.when(x >= 0, up).when(x < 0, down)

    best = _likeliest(df, x, power, F.sum(F.signum(x) * F.log1p(F.abs(x))), low, high) if exponent is None else exponent
    return df.withColumn(name, power(best)), best


def compare_datasets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that only a or b has, in both, and how many of those differ in any common column; null keys match.

    Keys must be distinct on each side.
    """
    common = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*(F.col(k).alias(f"_a_{k}") for k in keys), F.struct(*common).alias("_p"), F.lit(True).alias("_a"))
    right = b.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.struct(*common).alias("_q"), F.lit(True).alias("_b"))
    on = reduce(lambda x, y: x & y, (F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return left.join(right, on, "full").agg(count(F.col("_b").isNull()).alias("only_a"), count(F.col("_a").isNull()).alias("only_b"), count(both).alias("in_both"), count(both & ~F.col("_p").eqNullSafe(F.col("_q"))).alias("changed"))


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: texts, nulls, blanks, distinct ones, shortest, longest and mean length, and words."""
    c = F.col(column)
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return df.agg(F.count(c).alias("texts"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.count(F.when(F.trim(c) == "", 1)).alias("blanks"), F.count_distinct(c).alias("distinct"), F.min(F.length(c)).cast("long").alias("shortest"), F.max(F.length(c)).cast("long").alias("longest"), F.avg(F.length(c)).alias("mean_length"), F.sum(F.when(c.isNotNull(), words)).alias("words"))


def choose_test(df: DataFrame, a: str = "", b: str = "", group: str = "") -> str:
    """Which test fits the columns given: correlation of two numbers; of a number by a group without numbers ttest for up to two
    groups and anova for more; chi_square of two columns without numbers. Anything else is an error."""
    kinds = dict(df.dtypes)
    number = lambda c: bool(c) and kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    if missing := [c for c in (a, b, group) if c and c not in kinds]:
        raise ValueError(f"no columns {missing}")
    if number(a) and number(b):
        return "correlation"
    if number(a) and group and not number(group):
        return "anova" if df.select(group).dropna().distinct().limit(3).count() > 2 else "ttest"
    if a and b and not number(a) and not number(b):
        return "chi_square"
    raise ValueError("no test fits these columns; name one")


def auto_test(df: DataFrame, a: str = "", b: str = "", group: str = "") -> DataFrame:
    """One row: test, statistic and p_value of the test that choose_test() finds; groups of a t test are taken in their order."""
    test = choose_test(df, a, b, group)
    if test == "correlation":
        n, r = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)), _corr(a, b)
        one = df.agg(r.alias("statistic"), n.alias("n"))
        t = F.col("statistic") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("statistic") * F.col("statistic")))
        found = one.select("statistic", D.p_value(D.student, F.when(F.col("n") > 2, t), F.col("n") - 2).alias("p_value"))
    elif test == "ttest":
        values = sorted(r[0] for r in df.select(group).dropna().distinct().limit(2).collect())
        first, second = [*values, None, None][:2]
        found = t_test(df, a, group, first, second)
    else:
        found = anova(df, a, group) if test == "anova" else chi_square(df, a, b)
    return found.select(F.lit(test).alias("test"), "statistic", "p_value")


def auto_scan(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """(kind, a, b, figure, p_value): normality of each number column by Shapiro and Wilk, and the top pairs by Pearson's r.

    columns: numbers to look at, all of the table's by default.
    """
    columns = columns or [c for c, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    normal = [shapiro_wilk(df, c).where("tested >= 3").select(F.lit("normality").alias("kind"), F.lit(c).alias("a"), F.lit(None).cast("string").alias("b"), F.col("statistic").alias("figure"), "p_value") for c in columns]
    pairs = [auto_test(df, x, y).select(F.lit("correlation").alias("kind"), F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("statistic").alias("figure"), "p_value") for i, x in enumerate(columns) for y in columns[i + 1 :]]
    union = lambda parts: reduce(lambda p, q: p.unionByName(q), parts)
    if not pairs:
        return union(normal)
    return union([*normal, union(pairs).orderBy(F.desc_nulls_last(F.abs("figure")), "a", "b").limit(top)])
