"""Operators on tables of few rows, constant columns and nulls, and figures known from tables of the distributions."""

import math

import pytest
from pyspark.sql import functions as F

from tablework.functions import distributions as D
from tablework.operators import columns as C
from tablework.operators import inference as I
from tablework.operators import inspection as N
from tablework.operators import profile as P
from tablework.operators import quantiles as Q
from tablework.sources import files


def test_tails():
    known = [(D.student(2.228, 10), 0.05), (D.fisher_f(3.326, 5, 10), 0.05), (D.chi_square(18.307, 10), 0.05), (D.normal(2.5758), 0.01), (D.kolmogorov(1.358), 0.05), (D.fisher_exact(3, 1, 1, 3), 34 / 70)]
    assert all(abs(a - b) < 2e-4 for a, b in known)
    assert D.fisher_f(0.0, 2, 3) == D.chi_square(0.0, 3) == 1.0 and D.student(0.0, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("values", [[], [5.0, 5.0, None]])
def test_few_rows(spark, values):
    df = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in enumerate(values)], "i long, x double, g string")
    for out in (
        P.describe(df, ["x"]), P.check_outliers(df, ["x"]), P.detect_anomalies(df, "x"), P.correlation(df, ["i", "x"]), P.correlation(df, ["i", "x"], "spearman"), P.t_test(df, "x", "g", "a", "b"), P.anova(df, "x", "g"), P.chi_square(df, "x", "g"),
        I.one_sample_t(df, "x", 1.0), I.paired_t(df, "x", "i"), I.levene(df, "x", "g"), I.kruskal(df, "x", "g"), I.mann_whitney(df, "x", "g", "a", "b"), I.wilcoxon(df, "x", "i"), I.proportion_z(df, F.col("x") > 1, "g", "a", "b"), I.fisher(df, F.col("x") > 1, F.col("g") == "a"), I.regression(df, "x", ["i"]),
        C.cap_outliers(df, "x"), C.winsorize(df, "x"), C.robust_scale(df, "x", "y"), C.bin_column(df, "x", "y", 4), C.qbin_column(df, "x", "y", 4), C.fill_nulls(df, "x", "median"), C.fill_nulls(df, "x", "mode"), C.label_encode(df, "g", "y"), N.inspect(df), N.detect_schema(df), N.alerts(df), N.eda(df),
    ):
        out.collect()


def test_quantiles(spark):
    values = [7.0, 1.0, None, 3.0, 3.0, 10.0]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, g int")
    assert Q.quantiles(df, ["x", "g"], (0, 0.25, 0.5, 1)).first()["q0"] == [1.0, 3.0, 3.0, 10.0]
    assert {r["g"]: r["q"] for r in Q.group_quantiles(df, "x", ["g"], (0.5,)).collect()} == {0: [5.0], 1: [3.0]}
    assert Q.quantiles(df.where("false"), ["x"], (0.5,)).first()["q0"] == [None]
    assert {r["x"]: r["rank"] for r in Q.ranked(df, "x").withColumnRenamed("value", "x").collect()} == {1.0: 1.0, 3.0: 2.5, 7.0: 4.0, 10.0: 5.0}


def test_edges_of_logarithms_and_bins(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "x double")
    zero, below, one, null = (r["y"] for r in C.log_transform(df, "x", "y", "log").collect())
    assert zero == -math.inf and math.isnan(below) and one == 0 and null is None
    assert [r["b"] for r in C.bin_column(df.withColumn("x", F.lit(2.0)), "x", "b", 4).collect()] == [1] * 4


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["A b", "a B", " ", "x__y", "a_b_2"])
    assert files.normalize_headers(df).columns == ["a_b", "a_b_2", "col", "x_y", "a_b_2_2"]


def test_words(spark):
    df = spark.createDataFrame([("Hi, hi! don't_stop",)], "t string")
    assert {r["word"]: r["count"] for r in P.word_frequency(df, "t").collect()} == {"hi": 2, "dont_stop": 1}


def test_variance_inflation_of_small_tables(spark):
    from tablework.operators import inference

    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], [(1.0, 5.0), (2.0, 5.0)]):
        found = inference.variance_inflation(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()
        assert [tuple(x) for x in found] == [("a", None), ("b", None)]
    assert inference.variance_inflation(spark.createDataFrame([(1.0,)], "a double"), ["a"]).first()["vif"] == 1.0


def test_yeo_johnson(spark):
    import numpy as np

    from tablework.operators import inference

    x = np.random.default_rng(3).normal(size=400) * 3 + 1
    x = np.sign(x) * np.abs(x) ** 1.6

    def moved(k):
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        return np.where(x >= 0, np.log1p(up) if k == 0 else ((1 + up) ** k - 1) / k, -np.log1p(-down) if k == 2 else -((1 - down) ** (2 - k) - 1) / (2 - k))

    likely = lambda k: -len(x) / 2 * np.log(moved(k).var()) + (k - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    out, k = inference.yeo_johnson(df, "x", "y")
    assert abs(k - max(np.arange(-2, 2, 0.001), key=likely)) < 2e-3
    assert np.allclose(sorted(r["y"] for r in out.collect() if r["x"] is not None), sorted(moved(k)))
    for rows in ([], [(None,)], [(2.0,)], [(2.0,), (2.0,)]):
        out, k = inference.yeo_johnson(spark.createDataFrame(rows, "x double"), "x", "y")
        assert out.count() == len(rows)


def test_dickey_fuller_of_small_series(spark):
    from tablework.operators import series

    for n in (0, 1, 2, 3):
        df = spark.sql(f"SELECT make_date(2020, 1 + CAST(id AS INT), 1) AS d, CAST(id AS DOUBLE) AS v FROM range({n})")
        assert [tuple(r)[:2] for r in series.dickey_fuller(df, "d", "v").collect()] == [(None, 0)]
    df = spark.sql("SELECT make_date(2020 + CAST(id AS INT) DIV 12, 1 + CAST(id AS INT) % 12, 1) AS d, CAST(hash(id) % 1000 AS DOUBLE) AS v FROM range(120)")
    found = series.dickey_fuller(df, "d", "v", lags=2).first()
    assert found["n"] == 117 and found["stationary"] and found["statistic"] < found["critical_1"] < found["critical_5"] < found["critical_10"]


def test_exponents_beyond_the_first_reach(spark):
    import numpy as np

    from tablework.operators import inference

    for power in (0.2, -0.25, 1 / 6):  # what makes these normal again is their inverse
        x = np.abs(np.random.default_rng(5).normal(10, 2, size=3000)) ** power
        _, k = inference.box_cox(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", "y")
        likely = lambda k: (k - 1) * np.log(x).sum() - len(x) / 2 * np.log(((x**k - 1) / k).var())  # noqa: B023, E731
        grid = np.arange(-9, 9, 0.001) + 0.0005
        assert abs(k - max(grid, key=likely)) < 2e-3 and abs(k) > 2
