"""Rank statistics, models and series against brute force, enumeration and published figures."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.functions import distributions as D
from tablework.operators import decompose as L
from tablework.operators import inference as I
from tablework.operators import models as M
from tablework.operators import ranking as K
from tablework.operators import series as S


def pairs(spark, x, y):
    return spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in zip(x, y)], "x double, y double")


def tau_b(x, y):
    sign = lambda a, b: (a > b) - (a < b)
    c = xt = yt = 0
    for (a, p), (b, q) in itertools.combinations(zip(x, y), 2):
        c += sign(a, b) * sign(p, q)
        xt += a == b
        yt += p == q
    n = len(x) * (len(x) - 1) // 2
    return c / math.sqrt(n - xt) / math.sqrt(n - yt)


def test_inversions():
    r = random.Random(1)
    for size in (0, 1, 2, 5, 200):
        for top in (1, 3, 1000):
            y, w = np.array([r.randrange(top) for _ in range(size)], float), np.array([r.randrange(1, 9) for _ in range(size)], np.int64)
            assert K.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(size) for j in range(i) if y[j] > y[i])


@pytest.mark.parametrize("ranges", [1, 7])
def test_kendall(spark, ranges):
    r = random.Random(ranges)
    for top in (4, 10**6):
        x = [r.randrange(top) for _ in range(150)] + [1] * 60
        y = [a + r.randrange(top) for a in x]
        df = pairs(spark, [*x, None, 3, float("nan")], [*y, 1, None, 2]).withColumn("n", F.lit("x"))
        got = K.kendall(df, "x", "y", ranges).first()
        assert got["n"] == 210 and got["tau"] == pytest.approx(tau_b(x, y), abs=1e-12)


def test_kendall_edges(spark):
    assert tuple(K.kendall(pairs(spark, [], []), "x", "y").first()) == (None, 0, None)
    assert tuple(K.kendall(pairs(spark, [1, 1, 1], [1, 2, 3]), "x", "y").first()) == (None, 3, None)
    assert K.kendall(pairs(spark, [1], [1]), "x", "y").first()["tau"] is None
    # without ties p is the share of permutations that are at least as far from even
    for y in ([1, 2, 3, 4, 5], [2, 1, 4, 3, 5], [5, 3, 1, 4, 2]):
        got = K.kendall(pairs(spark, range(5), y), "x", "y").first()
        taus = [abs(tau_b(range(5), p)) for p in itertools.permutations(range(5))]
        assert got["p_value"] == pytest.approx(min(1, sum(t >= abs(got["tau"]) - 1e-9 for t in taus) / len(taus)))


def test_kendall_of_many_rows(spark):
    """A million rows, of which a third have one x, against counts of sorted arrays."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id") % 1000).cast("double").alias("x"), (F.xxhash64("id", F.lit(2)) % 100_000).cast("double").alias("y"))
    got = K.kendall(df, "x", "y").first()
    rows = df.toArrow()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    order = np.lexsort((y, x))
    d = K.inversions(y[order], np.ones(len(y), np.int64))
    ties = lambda v: sum(int(t) * (int(t) - 1) // 2 for t in np.unique(v, return_counts=True, axis=0)[1])
    n, xt, yt, both = 1_000_000 * 999_999 // 2, ties(x), ties(y), ties(np.stack([x, y], 1))
    assert got["tau"] == pytest.approx((n - xt - yt + both - 2 * d) / math.sqrt(n - xt) / math.sqrt(n - yt), abs=1e-12)


def test_tails_as_columns(spark):
    z = [-30.0, -9.0, -3.0, -1.0, -1e-9, 0.0, 1e-9, 0.3, 1.0, 2.5, 6.0, 8.4, 8.6, 20.0, 37.0, 200.0]
    df = spark.createDataFrame([(v,) for v in z], "z double").select("z", D.erfc(F.col("z")).alias("e"), D.log_normal_tail(F.col("z")).alias("l"), D.normal_p(F.col("z")).alias("p"))
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-13, abs=1e-300)
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-13, abs=1e-300)
        want = math.log(math.erfc(r["z"] / math.sqrt(2)) / 2) if r["z"] < 37 else -r["z"] ** 2 / 2 - math.log(r["z"] * math.sqrt(2 * math.pi)) + math.log1p(-1 / r["z"] ** 2 + 3 / r["z"] ** 4)
        assert r["l"] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_anderson_darling(spark):
    r = random.Random(2)
    x = [round(r.gauss(5, 2), 1) for _ in range(300)] + [5.0] * 40
    got = K.anderson_darling(pairs(spark, [*x, None], [*x, None]), "x").first()
    x, n = sorted(x), len(x)
    z = [(v - np.mean(x)) / np.std(x, ddof=1) for v in x]
    low, high = NormalDist().cdf, lambda v: NormalDist().cdf(-v)
    want = -n - sum((2 * i + 1) * (math.log(low(z[i])) + math.log(high(z[n - 1 - i]))) for i in range(n)) / n
    assert got["statistic"] == pytest.approx(want, abs=1e-8) and got["n"] == n
    assert got["critical_5"] == round(0.787 / (1 + 4 / n - 25 / n**2), 3) and got["normal"] == (want <= got["critical_5"])
    for few in ([], [1.0], [2.0, 2.0]):
        assert K.anderson_darling(pairs(spark, few, few), "x").first()["statistic"] is None


def test_shapiro_wilk(spark):
    # published: weights of eleven men, and the integers 1 to 20
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = K.shapiro_wilk(pairs(spark, [*weights, None], [*weights, None]), "x").first()
    assert got["statistic"] == pytest.approx(0.7888, abs=1e-4) and got["p_value"] == pytest.approx(0.006704, abs=1e-5) and got["tested"] == got["n"] == 11
    w, p = K.shapiro(np.arange(1.0, 21.0))
    assert w == pytest.approx(0.9604, abs=1e-4) and p == pytest.approx(0.5513, abs=2e-3)
    assert K.shapiro(np.array([1.0, 2.0, 3.0])) == (pytest.approx(1.0), pytest.approx(1.0))
    for few in ([], [1.0, 2.0], [3.0, 3.0, 3.0]):
        assert K.shapiro_wilk(pairs(spark, few, few), "x").first()["p_value"] is None
    many = spark.range(9000).select(F.rand(3).alias("x"))
    got = K.shapiro_wilk(many, "x").first()
    assert (got["n"], got["tested"]) == (9000, 5000) and got["p_value"] < 1e-6


def grouped(spark, a, b):
    return spark.createDataFrame([(float(v), "a") for v in a] + [(float(v), "b") for v in b] + [(None, "a")], "x double, g string")


def test_exact_tails(spark):
    """Against all ways to deal out ranks, signs or samples."""
    for n1, n2 in ((1, 1), (2, 3), (3, 5), (4, 4)):
        ranks = range(1, n1 + n2 + 1)
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
        for u in {*us}:
            far = max(u, n1 * n2 - u)
            assert D.rank_sum_exact(u, n1, n2) == pytest.approx(min(1, 2 * sum(v >= far for v in us) / len(us)))
        paths = [{*c} for c in itertools.combinations(ranks, n1)]
        off = lambda c: max(abs(sum(k in c for k in range(1, i + 1)) / n1 - sum(k not in c for k in range(1, i + 1)) / n2) for i in ranks)  # noqa: B023, E731
        ds = [off(c) for c in paths]
        for d in {*ds}:
            assert D.kolmogorov_exact(d, n1, n2) == pytest.approx(sum(v >= d - 1e-9 for v in ds) / len(ds))
    for n in (1, 3, 6):
        sums = [sum(r for r, s in enumerate(signs, 1) if s) for signs in itertools.product((0, 1), repeat=n)]
        for t in {min(s, n * (n + 1) // 2 - s) for s in sums}:
            assert D.signed_rank_exact(t, n) == pytest.approx(min(1, 2 * sum(s <= t for s in sums) / len(sums)))
    got = I.mann_whitney(grouped(spark, [1, 2, 3.5, 9], [4, 5, 6, 7, 8.5]), "x", "g", "a", "b").first()
    assert got["p_value"] == pytest.approx(D.rank_sum_exact(got["statistic"], 4, 5))
    got = I.wilcoxon(pairs(spark, [5, 7, 1, 9], [1, 9, 2, 3]), "x", "y").first()
    assert got["statistic"] == 3 and got["p_value"] == pytest.approx(D.signed_rank_exact(3, 4))
    got = I.kolmogorov_smirnov(grouped(spark, [1, 2, 3, 9], [4, 5, 6, 7, 8]), "x", "g", "a", "b").first()
    assert got["statistic"] == pytest.approx(0.75) and got["p_value"] == pytest.approx(D.kolmogorov_exact(0.75, 4, 5))
    assert I.kolmogorov_smirnov(grouped(spark, [1, 2], []), "x", "g", "a", "b").first()["statistic"] is None
    # large samples agree with the limits
    assert D.rank_sum_exact(30_000, 8, 10_000) == pytest.approx(D.normal((abs(30_000 - 40_000) - 0.5) / math.sqrt(80_000 / 12 * 10_009)), rel=0.05)
    assert D.kolmogorov_exact(0.03, 5000, 4000) == pytest.approx(D.kolmogorov(0.03 * math.sqrt(5000 * 4000 / 9000)), rel=0.1)


def test_student_quantile():
    for p, df, want in ((0.975, 10, 2.228139), (0.975, 1, 12.706205), (0.95, 30, 1.697261), (0.025, 10, -2.228139), (0.5, 3, 0.0)):
        assert D.student_quantile(p, df) == pytest.approx(want, abs=1e-6)


def model_rows(spark, n=400):
    r = np.random.default_rng(4)
    a, b, g = r.normal(1e3, 2, n), r.normal(size=n), r.integers(0, 3, n)
    at = 0.8 * (a - 1e3) - 0.5 * b + np.array([0, 1, -1])[g] + 0.3 * (a - 1e3) * b
    y = (r.random(n) < 1 / (1 + np.exp(-at))).astype(float)
    rows = [(float(p), float(q), "uvw"[k], float(v), float(w)) for p, q, k, v, w in zip(a, b, g, y, at + r.normal(size=n))]
    df = spark.createDataFrame([*rows, (None, 1.0, "u", 1.0, 1.0), (1.0, float("nan"), "u", 1.0, 1.0), (1.0, 1.0, None, 1.0, 1.0)], "a double, `v.b` double, g string, y double, x double")
    design = np.column_stack([np.ones(n), a, b, g == 1, g == 2, a * b])
    return df, design, y, np.array([x[4] for x in rows])


def test_least_squares(spark):
    df, x, _, y = model_rows(spark)
    got = M.least_squares(df, "x", ["a", "v.b", "g"], ["a * v.b", "a*none"]).collect()
    assert [r["term"] for r in got] == ["intercept", "a", "v.b", "g_v", "g_w", "a_x_v.b"]
    z = x.copy()
    z[:, 1] -= 1e3
    z[:, 5] = z[:, 1] * z[:, 2]  # the same columns' span, far better conditioned
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    rest = y - z @ beta
    n, k = z.shape
    one = got[0]
    assert one["n"] == n and one["rmse"] == pytest.approx(math.sqrt(rest @ rest / (n - k)), rel=1e-6) and one["mae"] == pytest.approx(np.abs(rest).mean(), rel=1e-5)
    whole = ((y - y.mean()) ** 2).sum()
    assert one["r2"] == pytest.approx(1 - rest @ rest / whole, rel=1e-6) and one["f"] == pytest.approx((whole - rest @ rest) / (k - 1) / (rest @ rest / (n - k)), rel=1e-5)
    likely = -n / 2 * (math.log(2 * math.pi * (rest @ rest) / n) + 1)
    assert one["aic"] == pytest.approx(2 * k - 2 * likely, rel=1e-6) and one["bic"] == pytest.approx(k * math.log(n) - 2 * likely, rel=1e-6)
    cov = np.linalg.inv(z.T @ z) * (rest @ rest / (n - k))
    for i in (3, 4, 5):  # terms that moving a leaves as they are
        assert got[i]["coefficient"] == pytest.approx(beta[i], rel=1e-4) and got[i]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-4)
        reach = D.student_quantile(0.975, n - k) * got[i]["std_error"]
        assert got[i]["ci_lower"] == pytest.approx(got[i]["coefficient"] - reach) and got[i]["p_value"] == pytest.approx(D.student(got[i]["t"], n - k))
    assert M.least_squares(df.where("false"), "x", ["a", "g"]).count() == 0
    assert M.least_squares(df.limit(2), "x", ["a", "v.b"]).count() == 0
    same = M.least_squares(df.withColumn("c", F.lit(3.0)).withColumn("d", F.col("a") * 2), "x", ["a", "c", "d"]).collect()
    alone = M.least_squares(df, "x", ["a"]).collect()
    assert same[0]["r2"] == pytest.approx(alone[0]["r2"]) and same[0]["adjusted_r2"] == pytest.approx(alone[0]["adjusted_r2"])
    with pytest.raises(ValueError, match="no columns"):
        M.least_squares(df, "x", ["nope"])


def test_logistic(spark):
    df, x, y, _ = model_rows(spark)
    got = M.logistic(df, "y", ["a", "v.b", "g"]).collect()
    z = x[:, :5].copy()
    z[:, 1] -= 1e3
    b = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        h = (z * (p * (1 - p))[:, None]).T @ z
        b = b + np.linalg.solve(h, z.T @ (y - p))
    likely = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    for i in range(1, 5):
        assert got[i]["coefficient"] == pytest.approx(b[i], rel=1e-6) and got[i]["std_error"] == pytest.approx(math.sqrt(np.linalg.inv(h)[i, i]), rel=1e-6)
    alone = len(y) * (y.mean() * math.log(y.mean()) + (1 - y.mean()) * math.log(1 - y.mean()))
    assert got[0]["log_likelihood"] == pytest.approx(likely) and got[0]["pseudo_r2"] == pytest.approx(1 - likely / alone) and got[0]["aic"] == pytest.approx(10 - 2 * likely)
    with pytest.raises(ValueError, match="separate"):
        M.logistic(df.withColumn("s", F.col("y") * 2 + F.col("`v.b`") / 100), "y", ["s"])
    with pytest.raises(ValueError, match="separate"):
        M.logistic(df.withColumn("s", F.when(F.col("y") == 1, F.col("`v.b`") > 1).otherwise(F.lit(False)).cast("int")), "y", ["s"])
    with pytest.raises(ValueError, match="constant"):
        M.logistic(df.withColumn("c", F.lit(1e7)), "y", ["a", "c"])
    with pytest.raises(ValueError, match="follow"):
        M.logistic(df.withColumn("c", F.col("a") * 2 + 1), "y", ["a", "c"])
    with pytest.raises(ValueError, match="both"):
        M.logistic(df.where("y = 1"), "y", ["a"])
    assert M.logistic(df.where("false"), "y", ["a"]).count() == 0


def test_uncentred_inflation(spark):
    df, x, _, _ = model_rows(spark)
    got = {r["term"]: r["vif"] for r in M.uncentred_inflation(df.where("g is not null"), ["a", "v.b"]).collect()}
    a, b = x[:, 1], x[:, 2]
    want = 1 / (1 - (a @ b) ** 2 / (a @ a) / (b @ b))
    assert got == {"a": pytest.approx(want, rel=1e-6), "v.b": pytest.approx(want, rel=1e-6)}
    assert [r["vif"] for r in M.uncentred_inflation(df.withColumn("c", F.col("a") * 2), ["a", "c"]).collect()] == [None, None]
    assert [r["vif"] for r in M.uncentred_inflation(df.where("false"), ["a"]).collect()] == [None]


def months(spark, y):
    return spark.createDataFrame([(f"{2000 + i // 12}-{1 + i % 12:02d}-01", float(v)) for i, v in enumerate(y)] + [(None, 5.0)], "d string, v double").withColumn("d", F.to_timestamp("d"))


def adf(y):
    """The same test, each regression on its own."""
    d, n = np.diff(y), len(y)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def fit(lags, start):
        x = np.column_stack([np.ones(len(d) - start), y[start:-1], *(d[start - k : len(d) - k] for k in range(1, lags + 1))])
        b, *_ = np.linalg.lstsq(x, d[start:], rcond=None)
        rest = d[start:] - x @ b
        return x, b, float(rest @ rest)

    lags = min(range(most + 1), key=lambda k: (len(d) - most) * math.log(fit(k, most)[2] / (len(d) - most)) + 2 * (k + 2))
    x, b, rest = fit(lags, lags)
    return b[1] / math.sqrt(rest / (len(x) - lags - 2) * np.linalg.inv(x.T @ x)[1, 1]), lags, len(x)


def test_dickey_fuller_auto(spark):
    r = np.random.default_rng(8)
    e = r.normal(size=140)
    still = np.zeros(140)
    for i in range(3, 140):
        still[i] = 0.3 * still[i - 1] - 0.4 * still[i - 2] + 0.35 * still[i - 3] + e[i]
    for y, low, high in ((still + 1e4, 0, 0.05), (np.cumsum(e) + 50, 0.05, 1)):
        got = S.dickey_fuller_auto(months(spark, y), "d", "v").first()
        statistic, lags, n = adf(y)
        assert got["statistic"] == pytest.approx(statistic, rel=1e-6) and (got["lags"], got["n"]) == (lags, n)
        assert low <= got["p_value"] <= high and got["stationary"] == (got["p_value"] < 0.05)
    # the critical values are where p is 1, 5 and 10 %
    for p, t in ((0.01, -3.43035), (0.05, -2.86154), (0.10, -2.56677)):
        assert S.dickey_fuller_p(t) == pytest.approx(p, abs=5e-4)
    for y in ([], [1.0], [1.0, 2.0, 1.0], [4.0] * 30):
        assert S.dickey_fuller_auto(months(spark, y), "d", "v").first()["statistic"] is None


def plain_stl(y, period, seasonal=7):
    """The published procedure, one point at a time."""
    n = len(y)
    odd = lambda k: k + (k % 2 == 0)
    trend_size, low_size = odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal))), odd(period + 1)

    def point(v, size, x, left, right, rw):  # places from 1
        h = max(x - left, right - x) + ((size - len(v)) // 2 if size > len(v) else 0)
        w = {}
        for j in range(left, right + 1):
            r = abs(j - x)
            if r <= 0.999 * h:
                w[j] = (1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3) * (rw[j - 1] if rw else 1)
        total = sum(w.values())
        if total <= 0:
            return None
        w = {j: k / total for j, k in w.items()}
        a = sum(k * j for j, k in w.items())
        c = sum(k * (j - a) ** 2 for j, k in w.items())
        if math.sqrt(c) > 0.001 * (len(v) - 1):
            w = {j: k * ((x - a) / c * (j - a) + 1) for j, k in w.items()}
        return sum(k * v[j - 1] for j, k in w.items())

    def smooth(v, size, rw=None):
        out, left, right = [], 1, min(size, len(v))
        for x in range(1, len(v) + 1):
            if size < len(v) and x > (size + 1) // 2 and right != len(v):
                left, right = left + 1, right + 1
            found = point(v, size, x, left, right, rw)
            out.append(v[x - 1] if found is None else found)
        return out

    average = lambda v, k: [sum(v[i : i + k]) / k for i in range(len(v) - k + 1)]
    trend, season, rw = [0.0] * n, [0.0] * n, None
    for outer in range(16):
        for _ in range(2):
            cycle = [0.0] * (n + 2 * period)
            for k in range(period):
                v, own = [y[i] - trend[i] for i in range(k, n, period)], [rw[i] for i in range(k, n, period)] if rw else None
                out = smooth(v, seasonal, own)
                first, last = point(v, seasonal, 0, 1, min(seasonal, len(v)), own), point(v, seasonal, len(v) + 1, max(1, len(v) - seasonal + 1), len(v), own)
                cycle[k::period] = [out[0] if first is None else first, *out, out[-1] if last is None else last]
            low = smooth(average(average(average(cycle, period), period), 3), low_size)
            season = [cycle[period + i] - low[i] for i in range(n)]
            trend = smooth([y[i] - season[i] for i in range(n)], trend_size, rw)
        off = [abs(y[i] - trend[i] - season[i]) for i in range(n)]
        middle = sorted(off)
        most = 3 * (middle[n // 2] + middle[n - n // 2 - 1])
        rw = [1.0 if r <= 0.001 * most else (1 - (r / most) ** 2) ** 2 if r <= 0.999 * most else 0.0 for r in off]
    return trend, season


@pytest.mark.parametrize("n,period", [(60, 12), (26, 12), (29, 7), (17, 4)])
def test_stl(spark, n, period):
    r = np.random.default_rng(n)
    y = np.arange(n) * 0.3 + 5 * np.sin(np.arange(n) * 2 * np.pi / period) + r.normal(size=n)
    y[n // 2] += 40
    rows = L.decompose(months(spark, y), "d", "v", period=period).orderBy("at").collect()
    trend, season = (np.array(v) for v in plain_stl(y.tolist(), period))
    assert np.allclose([x["trend"] for x in rows], trend, atol=1e-8) and np.allclose([x["seasonal"] for x in rows], season, atol=1e-8)
    rest = y - trend - season
    got = L.strengths(months(spark, y), "d", "v", period=period).first()
    assert got["periods"] == n
    assert got["trend_strength"] == pytest.approx(max(0, 1 - rest.var() / (trend + rest).var()), abs=1e-8)
    assert got["seasonal_strength"] == pytest.approx(max(0, 1 - rest.var() / (season + rest).var()), abs=1e-8)


def test_stl_of_short_series(spark):
    for y in ([], [1.0], [3.0] * 23):
        assert tuple(L.strengths(months(spark, y), "d", "v").first()) == (None, None, 0)
    assert tuple(L.strengths(months(spark, [3.0] * 30), "d", "v").first())[2] == 30


def test_time_series_of_several_columns(spark):
    r = np.random.default_rng(3)
    df = months(spark, np.arange(40) * 2.0 + 5 * np.sin(np.arange(40) * np.pi / 6) + r.normal(size=40)).withColumn("w.x", F.lit(-1.0)).withColumn("i", F.lit("x"))
    v, w = L.time_series(df, "d", ["v", "w.x"]).collect()
    assert (v["column"], v["periods"], v["direction"]) == ("v", 40, "up") and v["slope"] == pytest.approx(2, abs=0.2) and v["trend_strength"] > 0.9 and 1 in v["acf_lags"] and 1 in v["pacf_lags"]
    assert (w["direction"], w["adf_p_value"], w["acf_lags"]) == ("flat", None, []) and w["forecast"] == pytest.approx(-1)
    (empty,) = L.time_series(df.where("v is null"), "d", ["v"]).collect()
    assert (empty["periods"], empty["slope"], empty["acf_lags"], empty["pacf_lags"], empty["forecast"]) == (0, None, [], [], None)


def test_kolmogorov_of_one_sample(spark):
    assert 1 - D.kolmogorov_one(0.274, 10) == pytest.approx(0.6284796154565043, abs=1e-10)  # published
    assert D.kolmogorov_one(0.6, 1) == pytest.approx(0.8) and D.kolmogorov_one(0.5, 1) == 1 and D.kolmogorov_one(1.0, 5) == 0
    for d in (0.03, 0.045, 0.06):  # the two sides of the switch agree
        limit = D.kolmogorov((math.sqrt(1000) + 0.12 + 0.11 / math.sqrt(1000)) * d)
        assert D.kolmogorov_one(d, 1000) == pytest.approx(limit, abs=2e-3)
    x = [-1.2, 0.1, 0.1, 0.4, 2.5, None, float("nan")]
    got = K.kolmogorov_smirnov_normal(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()
    v = sorted(x[:5])
    cdf = [NormalDist().cdf(a) for a in v]
    assert got["statistic"] == pytest.approx(max(max(c - i / 5, (i + 1) / 5 - c) for i, c in enumerate(cdf))) and got["n"] == 5
    assert got["p_value"] == pytest.approx(D.kolmogorov_one(got["statistic"], 5))
    assert tuple(K.kolmogorov_smirnov_normal(spark.createDataFrame([(None,)], "x double"), "x").first()) == (None, 0, None)
