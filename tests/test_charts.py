"""What charts show, of small tables with nulls, NaN, texts for numbers, constants and too many lines."""

import pytest
from pyspark.sql import functions as F

from tablework.operators import charts as G
from tablework.operators import inspection as N

NAN = float("nan")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or [f"`{c}`" for c in df.columns])).collect()]


@pytest.fixture(scope="module")
def table(spark):
    data = [("a", 1.0, 10, "1.5", "2020-01-31"), ("a", NAN, 20, "x", "2020-02-01"), ("b", 3.0, None, "-2", "bad"), (None, 4.0, 40, None, "2020-01-01"), ("b", 5.0, 50, "NaN", None)]
    return spark.createDataFrame(data, "g string, `v.x` double, n int, t string, d string")


def test_groups_and_months(table):
    assert rows(G.multi_bar(table, ["v.x", "n"], "g")) == [("a", 1.0, 30), ("b", 8.0, 50)]
    assert rows(G.multi_bar(table, ["v.x"], "g", "mean")) == [("a", 1.0), ("b", 4.0)]
    assert rows(G.multi_line(table, ["n"], "d")) == [("2020-01", 50), ("2020-02", 20)]
    for wrong in (lambda: G.multi_bar(table, ["no"], "g"), lambda: G.multi_bar(table, ["n"], "g", "no")):
        with pytest.raises(ValueError):
            wrong()


def test_points(table):
    assert rows(G.complete_rows(table)) == [(1.0, 10), (4.0, 40), (5.0, 50)] and G.complete_rows(table).columns == ["v.x", "n"]
    assert rows(G.map_points(table, "n", "t", "v.x", "g")) == [(10.0, 1.5, 1.0, "a")]
    assert rows(G.map_locations(table, "g")) == [("a", 2), ("b", 2)] and rows(G.map_locations(table, "g", "v.x")) == [("a", 1.0), ("b", 8.0)]
    assert G.points_3d(table, "v.x", "n", "t", "g").count() == 5
    some = rows(G.points_3d(table, "n", "n", "n", most=2))
    assert len(some) == 2 and some == rows(G.points_3d(table, "n", "n", "n", most=2))


def test_surface(spark, table):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 5.0), (2, 2, 1.0), (None, 1, 1.0), (1, 1, NAN)], "x int, y int, z double")
    assert rows(G.surface(df, "x", "y", "z")) == [(1, 2, 4.0), (2, 2, 1.0)]
    with pytest.raises(ValueError):
        G.surface(df, "x", "y", "z", most=1)
    with pytest.raises(ValueError):
        G.surface(table, "g", "n", "n")


def test_distributions(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(100)] + [(None, 7.0), (NAN, 7.0)], "x double, same double")
    got = rows(G.distributions(df, bins=10), "column", "bin")
    assert got[0] == ("same", 0, 7.0, 7.0, 102) and [r[4] for r in got[1:]] == [10] * 10 and got[-1][3] == pytest.approx(99)
    assert rows(G.distributions(df.where("false"))) == []
    box = rows(G.boxes(df.union(spark.createDataFrame([(1000.0, 7.0)], "x double, same double"))))
    assert box[0] == ("same", 7.0, 7.0, 7.0, 7.0, 7.0) and box[1] == ("x", 0.0, 25.0, 50.0, 75.0, 99.0)


def test_profiles(spark, table):
    got = {r["column"]: r for r in N.profile_columns(table, top=1).collect()}
    assert [(x["value"], x["count"]) for x in got["g"]["top_values"]] == [("a", 2)] and got["g"]["mode"] == "a" and got["v.x"]["mode"] is None
    assert (got["v.x"]["nulls"], got["v.x"]["null_pct"], got["v.x"]["unique_pct"]) == (1, 20.0, 80.0) and got["v.x"]["quality"] == pytest.approx(80)
    assert N.profile_columns(table.select("n")).first()["top_values"] is None
    summary = {r["column"]: r for r in N.load_summary(table.coalesce(1)).collect()}
    assert summary["g"]["sample"] == ["a", "a"] and summary["n"]["nulls"] == 1
    assert N.load_summary(table.where(F.lit(False))).count() == 0
