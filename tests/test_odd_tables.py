"""NaN, names that clash or need quotes, tables of few rows, and hot keys."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablework.operators import columns as C
from tablework.operators import inference as I
from tablework.operators import inspection as N
from tablework.operators import profile as P
from tablework.operators import relations as R
from tablework.operators import series as S

NAN = float("nan")


def values(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.fixture(scope="module")
def holes(spark):
    return spark.createDataFrame([(0, 1.0), (1, NAN), (2, 2.0), (3, None), (4, 3.0), (5, 100.0)], "i int, x double")


def test_nan_is_missing(holes):
    assert values(C.fill_nulls(holes, "x", "mean"), "x") == [1, 26.5, 2, 26.5, 3, 100]
    assert values(C.fill_nulls(holes, "x", "ffill", ["i"]), "x") == [1, 1, 2, 2, 3, 100]
    assert values(C.cap_outliers(holes, "x"), "x") == [1, None, 2, None, 3, 2.5 * 27.25 - 1.5 * 1.75]
    assert values(C.winsorize(holes, "x", 0, 1), "x") == values(C.cap_outliers(holes, "x", "std"), "x") == [1, None, 2, None, 3, 100]
    assert values(C.bin_column(holes, "x", "b", 2), "b") == [0, None, 0, None, 0, 1] and values(C.qbin_column(holes, "x", "b", 2), "b") == [0, None, 0, None, 1, 1]
    d = P.describe(holes, ["x"]).first()
    assert (d["count"], d["mean"], d["q50"], d["max"]) == (4, 26.5, 2.5, 100)
    assert {r["column"]: r["nulls"] for r in N.inspect(holes).collect()} == {"i": 0, "x": 2}
    assert P.check_outliers(holes, ["x"]).first()["outliers"] == 1
    assert values(P.detect_anomalies(holes, "x"), "x_iqr_flag") == [0, 0, 0, 0, 0, 1]
    e = P.extended_stats(holes, ["x"]).first()
    assert (e["count"], e["mad"], e["p_50"], e["range"]) == (4, 1.0, 2.5, 99) and e["shape"] == "highly right-skewed"
    assert P.correlation(holes, ["i", "x"], "spearman").first()["r"] == pytest.approx(1)


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 3), (2.0, 4.0, "b", 4), (3.0, 9.0, "a", 5)], "`v.x` double, _q double, `a b` string, `_n` int")
    assert [r["column"] for r in P.describe(df, ["v.x", "_q"]).collect()] == ["v.x", "_q"]
    assert N.eda(df).first()["rows"] == 3 and N.inspect(df).count() == 4
    assert sorted(r["_q"] for r in C.cap_outliers(df, "_q").collect()) == [2, 4, 9]
    assert P.detect_anomalies(df, "_q").columns == [*df.columns, "_q_iqr_flag", "_q_zscore_flag", "_anomaly_score"]
    assert C.drop_duplicates(df, ["a b"], ["v.x"], "last").count() == 2 and C.drop_duplicates(df, ["a b"], [], "none").count() == 1
    for method in ("pearson", "spearman", "kendall"):
        assert [tuple(r) for r in P.correlation(df, ["v.x", "_q"], method).select("a", "b").collect()] == [("v.x", "_q")]
    assert N.search_columns(df, kind="numeric").count() == 3
    left, right = df.select(F.col("_n").alias("k"), F.col("_q").alias("v")), df.select(F.col("_n").alias("k"), F.lit(1).alias("v"), F.lit(2).alias("v_right"))
    got = R.merge(left, right, "k", "k")
    assert got.columns == ["k", "v", "v_right_right", "v_right"] and got.first()["v_right"] == 2


@pytest.mark.parametrize("rows", [[], [(1, 5.0, "a")], [(1, 5.0, "a"), (2, 5.0, "b")], [(1, None, None), (2, NAN, "a"), (3, 1.0, "a")]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "i long, x double, g string").withColumn("d", F.make_date(F.lit(2020), F.col("i").cast("int"), F.lit(1)).cast("timestamp"))
    for out in (
        P.validate(df, ["i", "x", "g"]), P.extended_stats(df, ["x"]), P.check_outliers(df, ["x"], "both"), I.kolmogorov_smirnov(df, "x", "g", "a", "b"), I.mann_whitney(df, "x", "g", "a", "b"), S.autocorrelation(df, "d", "x"), S.partial_autocorrelation(df, "d", "x"),
        C.ewm(df, "x", "y", 3, ["i"], ["g"]), C.drop_duplicates(df, ["g"], ["i"]), R.aggregate(df, ["g"], {"x": ["median", "sum"]}), R.cross_tabulate(df, "g", "i", [1, 2], "columns"), N.search_columns(df), C.split_column(df, "g"), I.auto_test(df, "i", "x"), I.auto_test(df, "x", group="g"), I.auto_test(df, "g", "g"), I.auto_scan(df),
    ):
        out.collect()
    assert P.validate(df.where("false"), ["x"]).first()["score"] == 100


def test_ewm(spark, monkeypatch):
    monkeypatch.setattr(C, "EWM_BLOCK", 7)
    r = np.random.default_rng(2)
    rows = [(i, "ab"[int(i % 3 == 0)] if i % 10 else None, None if i < 4 or r.random() < 0.3 else float(r.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(5).withColumn("at", F.lit("x")).withColumn("a b", F.lit(1))
    got = {x["i"]: x["y"] for x in C.ewm(df, "x", "y", 5, ["i"], ["g"]).collect()}
    want = pd.DataFrame(rows, columns=["i", "g", "x"]).groupby("g", dropna=False, group_keys=False)["x"].apply(lambda x: x.ewm(span=5, adjust=False).mean())
    assert len(got) == 200
    for i, y in want.items():
        assert (got[i] is None and math.isnan(y)) or got[i] == pytest.approx(y)


def test_bins_and_splits(spark):
    df = spark.createDataFrame([(i, float(x), t) for i, (x, t) in enumerate([(0, "a,b"), (1, "c"), (5, ""), (10, "d,e,f"), (11, None)])], "i int, x double, t string")
    assert values(C.bin_column(df, "x", "b", [0, 5, 10]), "b") == [None, 0, 0, 1, None]
    assert values(C.bin_column(df, "x", "b", [0, 5, 10], ["lo", "hi"], right=False), "b") == ["lo", "lo", "hi", None, None]
    assert values(C.bin_column(df, "x", "b", 2, right=False), "b") == [0, 0, 0, 1, 1]
    assert values(C.qbin_column(df, "x", "b", 2, ["lo", "hi"]), "b") == ["lo", "lo", "lo", "hi", "hi"]
    with pytest.raises(ValueError):
        C.bin_column(df, "x", "b", 3, ["one"])
    with pytest.raises(ValueError):
        C.bin_column(df, "x", "b", [3, 1])
    out = C.split_column(df, "t")
    assert out.columns[3:] == ["t_1", "t_2", "t_3"] and [tuple(r)[3:] for r in out.orderBy("i").collect()] == [("a", "b", None), ("c", None, None), ("", None, None), ("d", "e", "f"), (None,) * 3]
    assert values(C.split_column(df, "t", n_splits=1), "t_2") == ["b", None, None, "e,f", None]


def test_auto_test(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(float(x), float(x + r.normal()), "uvw"[i % 3], "yn"[i % 2]) for i, x in enumerate(r.normal(size=60))], "a double, b double, g string, h string")
    assert I.auto_test(df, "a", "b").first()["test"] == "correlation" and I.auto_test(df, "a", "b").first()["p_value"] < 1e-4
    assert I.auto_test(df, "a", group="g").first()["test"] == "anova" and I.auto_test(df, "g", "h").first()["test"] == "chi_square"
    assert I.auto_test(df, "a", group="h").first()["statistic"] == pytest.approx(P.t_test(df, "a", "h", "n", "y").first()["statistic"])
    scan = I.auto_scan(df).collect()
    assert [(x["kind"], x["a"], x["b"]) for x in scan] == [("normality", "a", None), ("normality", "b", None), ("correlation", "a", "b")]
    for wrong in ({}, {"a": "a"}, {"a": "g", "group": "h"}, {"a": "none"}):
        with pytest.raises(ValueError):
            I.choose_test(df, **wrong)
