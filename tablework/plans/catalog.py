"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions import conditions
from tablework.operators import charts as G
from tablework.operators import columns as C
from tablework.operators import decompose as L
from tablework.operators import inference as I
from tablework.operators import inspection as N
from tablework.operators import models as M
from tablework.operators import profile as P
from tablework.operators import ranking as K
from tablework.operators import relations as R
from tablework.operators import series as S
from tablework.plans import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, sql: str | None, *more: str):
    """Register function(table, *more tables) under name."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(*(spark.read.parquet(f"{d}/{t}.parquet") for t in (table, *more)))
        if sql:
            ORACLE[name] = sql
        return f

    return put


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def student_p(t: str, df: str) -> str:
    """SQL for the two-sided tail of Student's t: Simpson's rule over the density, 4000 steps of 0.01."""
    return f"(SELECT 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-({df} + 1) / 2.0 * ln(1 + (abs({t}) + i / 100.0) * (abs({t}) + i / 100.0) / {df}))) / 300 FROM range(0, 4001) steps(i))"


def normal_p(z: str) -> str:
    """SQL for the two-sided normal tail, likewise."""
    return f"(SELECT 2 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(abs({z}) + i / 100.0) * (abs({z}) + i / 100.0) / 2)) / 300 FROM range(0, 4001) steps(i))"


def f4_p(f: str, d2: str) -> str:
    """SQL for the tail of F with 4 degrees of freedom above."""
    return f"pow({d2} / ({d2} + 4 * ({f})), {d2} / 2.0) * (1 + 4 * ({f}) / ({d2} + 4 * ({f})) * {d2} / 2.0)"


LI = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LIK = ", ".join(LI)


@query("group_aggregate", "lineitem", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def _(t):
    return t.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("filter_conditions", "orders", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
  AND regexp_matches(o_orderpriority, '-') AND o_orderkey > 10 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-06-30' AND o_custkey IS NOT NULL
  AND NOT (o_orderpriority = '5-LOW' AND o_orderpriority IS NOT NULL)""")
def _(t):
    return conditions.filter_rows(t, [
        {"column": "o_orderstatus", "op": "not_equals", "value": "P"}, {"column": "o_totalprice", "op": "between", "min": 1000, "max": 300000},
        {"column": "o_orderpriority", "op": "isin", "values": ["1-URGENT", "2-HIGH", "5-LOW"]}, {"column": "o_orderpriority", "op": "contains", "value": "-"},
        {"column": "o_orderkey", "op": "gt", "value": 10}, {"column": "o_orderdate", "op": "date_range", "start": "1996-01-01", "end": "1999-06-30"},
        {"column": "o_custkey", "op": "not_null"}, {"column": "o_orderpriority", "op": "not_isin", "values": ["5-LOW"]},
    ]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_text", "customer", """
SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer') AND NOT regexp_matches(c_name, '13') AND regexp_matches(c_mktsegment, '(?i)build|auto')""")
def _(t):
    return conditions.filter_rows(t, [{"column": "c_name", "op": "starts_with", "value": "Customer"}, {"column": "c_name", "op": "not_contains", "value": "13"}, {"column": "c_mktsegment", "op": "icontains", "value": "build|auto"}]).select("c_custkey", "c_name")


@query("filter_quantile", "orders", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.1) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)""")
def _(t):
    return conditions.filter_rows(t, [{"column": "o_totalprice", "op": "quantile_between", "min": 0.1, "max": 0.9}]).select("o_orderkey", "o_totalprice")


@query("top_n", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def _(t):
    return C.top_n(t, "o_totalprice", 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("cap_outliers_iqr", "orders", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM orders)
SELECT o_orderkey, round(CASE WHEN o_totalprice < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) WHEN o_totalprice > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE o_totalprice END, 4) AS o_totalprice FROM orders, q""")
def _(t):
    return rounded(C.cap_outliers(t.select("o_orderkey", "o_totalprice"), "o_totalprice"), "o_totalprice")


@query("cap_outliers_std", "orders", """
WITH q AS (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders)
SELECT o_orderkey, round(CASE WHEN o_totalprice < m - 3 * s THEN m - 3 * s WHEN o_totalprice > m + 3 * s THEN m + 3 * s ELSE o_totalprice END, 3) AS o_totalprice FROM orders, q""")
def _(t):
    return rounded(C.cap_outliers(t.select("o_orderkey", "o_totalprice"), "o_totalprice", "std"), "o_totalprice", digits=3)


@query("winsorize", "lineitem", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) a, quantile_cont(l_extendedprice, 0.95) b FROM lineitem)
SELECT {LIK}, round(CASE WHEN l_extendedprice < a THEN a WHEN l_extendedprice > b THEN b ELSE l_extendedprice END, 4) AS l_extendedprice FROM lineitem, q""")
def _(t):
    return rounded(C.winsorize(t.select(*LI, "l_extendedprice"), "l_extendedprice"), "l_extendedprice")


@query("normalize_minmax", "part", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled FROM part")
def _(t):
    return rounded(C.normalize(t, "p_retailprice", "minmax", "scaled").select("p_partkey", "scaled"), "scaled", digits=6)


@query("normalize_zscore", "part", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 5) AS scaled FROM part")
def _(t):
    return rounded(C.normalize(t, "p_retailprice", "zscore", "scaled").select("p_partkey", "scaled"), "scaled", digits=5)


@query("robust_scale", "part", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) m, quantile_cont(p_retailprice, 0.75) b FROM part) SELECT p_partkey, round((p_retailprice - m) / (b - a), 6) AS scaled FROM part, q")
def _(t):
    return rounded(C.robust_scale(t, "p_retailprice", "scaled").select("p_partkey", "scaled"), "scaled", digits=6)


def with_nulls(t: DataFrame) -> DataFrame:
    """events with nulls in value where event_id is a multiple of 3 or 4."""
    return t.select("event_id", "user_id", "event_type", "ts", F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 4 != 0), F.col("value")).alias("value"))


NULLED = "(SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN value END AS value FROM events)"

for strategy, sql in (("mean", "avg(value) OVER ()"), ("median", "(SELECT median(value) FROM e)")):
    query(f"fill_nulls_{strategy}", "events", f"WITH e AS {NULLED} SELECT event_id, round(coalesce(value, {sql}), 4) AS value FROM e")(lambda t, s=strategy: rounded(C.fill_nulls(with_nulls(t), "value", s).select("event_id", "value"), "value"))
for strategy, sql in (("ffill", "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), ("bfill", "first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")):
    query(f"fill_nulls_{strategy}", "events", f"WITH e AS {NULLED} SELECT event_id, user_id, {sql} AS value FROM e")(lambda t, s=strategy: C.fill_nulls(with_nulls(t), "value", s, ["event_id"], ["user_id"]).select("event_id", "user_id", "value"))


@query("fill_nulls_mode", "events", """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events),
m AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT event_id, coalesce(event_type, v) AS event_type FROM e, m""")
def _(t):
    return C.fill_nulls(t.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type")), "event_type", "mode")


@query("drop_duplicates", "lineitem", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1")
def _(t):
    return C.drop_duplicates(t.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("dedup_none", "orders", "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def _(t):
    return C.drop_duplicates(t.select("o_orderkey", "o_custkey"), ["o_custkey"], [], "none")


@query("label_encode", "customer", "SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM customer")
def _(t):
    return C.label_encode(t.select("c_custkey", "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "c_mktsegment", "code")


@query("ordinal_encode", "orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS BIGINT) AS code FROM orders WHERE o_orderstatus IS NOT NULL")
def _(t):
    return C.ordinal_encode(t.where("o_orderstatus is not null"), "o_orderstatus", ["O", "F"], "code").select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("binary_encode", "events", f"WITH e AS {NULLED} SELECT event_id, CAST(coalesce(value > 50, false) AS INTEGER) AS high, CAST(coalesce(event_type = 'click', false) AS INTEGER) AS click FROM e")
def _(t):
    return C.binary_encode(C.binary_encode(with_nulls(t), "value", "high", threshold=50), "event_type", "click", value="click").select("event_id", "high", "click")


@query("frequency_encode", "events", "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n FROM events")
def _(t):
    return C.frequency_encode(t, "event_type", "n").select("event_id", "n")


@query("frequency_encode_share", "events", "SELECT event_id, round(count(*) OVER (PARTITION BY event_type) / count(*) OVER (), 6) AS share FROM events")
def _(t):
    return rounded(C.frequency_encode(t, "event_type", "share", True).select("event_id", "share"), "share", digits=6)


@query("one_hot", "events", "SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type_click, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM events")
def _(t):
    return C.one_hot(t, "event_type", ["click", "view"]).select("event_id", "event_type_click", "event_type_view")


@query("keep_frequent", "part", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) >= 90 THEN p_brand ELSE 'Other' END AS brand FROM part")
def _(t):
    return C.keep_frequent(t, "p_brand", "brand", 90).select("p_partkey", "brand")


@query("extract_regex", "customer", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '0*([1-9][0-9]*)$') THEN regexp_extract(c_name, '0*([1-9][0-9]*)$', 1) END AS number FROM customer")
def _(t):
    return C.extract_regex(t, "c_name", "0*([1-9][0-9]*)$", "number", 1).select("c_custkey", "number")


@query("regex_replace", "orders", "SELECT o_orderkey, regexp_replace(o_orderpriority, '^([0-9])-(.*)$', '\\2 (\\1)', 'g') AS o_orderpriority FROM orders")
def _(t):
    return C.regex_replace(t.select("o_orderkey", "o_orderpriority"), "o_orderpriority", r"^([0-9])-(.*)$", r"\2 (\1)")


@query("split_combine", "orders", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS label, concat_ws('/', o_orderstatus, o_orderpriority) AS both FROM orders")
def _(t):
    return C.combine_columns(C.split_column(t, "o_orderpriority", "-", ["level", "label"]), ["o_orderstatus", "o_orderpriority"], "both", "/").select("o_orderkey", "level", "label", "both")


@query("str_slice", "customer", "SELECT c_custkey, substring(c_name, 3, 5) AS middle, right(c_name, 4) AS tail FROM customer")
def _(t):
    return C.str_slice(C.str_slice(t, "c_name", "middle", 2, 7), "c_name", "tail", -4).select("c_custkey", "middle", "tail")


@query("clean_text", "part", "SELECT p_partkey, array_to_string(list_transform(string_split(trim(lower(p_name)), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS p_name FROM part WHERE regexp_full_match(p_name, '[a-zA-Z ]*')")
def _(t):
    return C.clean_text(t.where(F.col("p_name").rlike("^[a-zA-Z ]*$")), ["p_name"]).select("p_partkey", "p_name")


@query("cast_column", "orders", "SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS level, TRY_CAST(o_orderstatus AS DOUBLE) AS nothing FROM orders")
def _(t):
    t = t.withColumn("level", F.substring("o_orderpriority", 1, 1)).withColumn("nothing", F.col("o_orderstatus"))
    return C.cast_column(C.cast_column(t, "level", "int"), "nothing", "float").select("o_orderkey", "level", "nothing")


@query("replace_values", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return C.replace_values(t.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "done", "O": "open"})


@query("add_column", "lineitem", f"SELECT {LIK}, round(((l_extendedprice - l_discount) * l_quantity) / 7 + 1, 2) AS made FROM lineitem")
def _(t):
    return rounded(C.add_column(t, "made", "l_extendedprice - l_discount * l_quantity / 7 + 1").select(*LI, "made"), "made", digits=2)


@query("conditional_assign", "part", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS class FROM part")
def _(t):
    return C.conditional_assign(t, "class", [(F.col("p_size") > 40, "large"), (F.col("p_size") > 10, "middle")], "small").select("p_partkey", "class")


@query("numeric_transforms", "customer", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 4) AS root, round(ln(1 + abs(c_acctbal)), 6) AS log, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN 5000 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    t = C.log_transform(C.sqrt_transform(t, "c_acctbal", "root").withColumn("size", F.abs("c_acctbal")), "size", "log")
    return rounded(rounded(C.clip_values(t, "c_acctbal", 0.0, 5000.0).select("c_custkey", "root", "log", "c_acctbal"), "root"), "log", digits=6)


@query("log_transform", "customer", "SELECT c_custkey, round(CASE WHEN c_acctbal - 100 > 0 THEN ln(c_acctbal - 100) WHEN c_acctbal - 100 = 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 6) AS log FROM customer")
def _(t):
    t = C.log_transform(t.withColumn("over", F.col("c_acctbal") - 100), "over", "log", "log")
    return rounded(t.select("c_custkey", "log"), "log", digits=6)


@query("round_values", "customer", "SELECT c_custkey, round_even(c_acctbal, 0) AS c_acctbal FROM customer")
def _(t):
    return C.round_values(t.select("c_custkey", "c_acctbal"), "c_acctbal", 0)


@query("bin_column", "part", "WITH q AS (SELECT CAST(min(p_size) AS DOUBLE) a, CAST(max(p_size) AS DOUBLE) b FROM part) SELECT p_partkey, CAST(least(greatest(ceil((p_size - a) / ((b - a) / 4)) - 1, 0), 3) AS INTEGER) AS bin FROM part, q")
def _(t):
    return C.bin_column(t, "p_size", "bin", 4).select("p_partkey", "bin")


@query("qbin_column", "part", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.5) b, quantile_cont(p_retailprice, 0.75) c FROM part) SELECT p_partkey, CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) + CAST(p_retailprice > c AS INTEGER) AS bin FROM part, q")
def _(t):
    return C.qbin_column(t, "p_retailprice", "bin", 4).select("p_partkey", "bin")


@query("date_diff", "lineitem", f"SELECT {LIK}, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days, CAST(round_even(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 30.44, 0) AS BIGINT) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "orders")
def _(t, o):
    t = t.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({c: F.to_date(c) for c in ("o_orderdate", "l_shipdate")})
    return C.date_diff(C.date_diff(t, "l_shipdate", "o_orderdate", "days"), "l_shipdate", "o_orderdate", "months", "months").select(*LI, "days", "months")


@query("date_parts", "orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM orders")
def _(t):
    t = C.date_parts(t, "o_orderdate")
    return t.select("o_orderkey", *(c for c in t.columns if c.startswith("o_orderdate_")))


RANKS = {"dense": "dense_rank() OVER w", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY event_type, round(value)) - 1", "average": "rank() OVER w + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2", "first": "row_number() OVER (PARTITION BY event_type ORDER BY round(value), event_id)"}
for method, sql in RANKS.items():
    query(f"rank_{method}", "events", f"SELECT event_id, CAST({sql} AS DOUBLE) AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY round(value))")(
        lambda t, m=method: C.rank_column(t.withColumn("value", F.round("value")), "value", "pos", m, True, ["event_id"], ["event_type"]).select("event_id", "pos"))

W = "OVER (PARTITION BY user_id ORDER BY event_id)"
for kind, sql in (("lag", f"lag(value) {W}"), ("lead", f"lead(value) {W}"), ("diff", f"value - lag(value) {W}")):
    query(f"shift_{kind}", "events", f"WITH e AS {NULLED} SELECT event_id, round({sql}, 6) AS shifted FROM e")(lambda t, k=kind: rounded(C.shift(with_nulls(t), "value", "shifted", k, ["event_id"], ["user_id"]).select("event_id", "shifted"), "shifted", digits=6))


@query("pct_change", "events", f"WITH e AS {NULLED}, f AS (SELECT event_id, user_id, last_value(value IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM e) SELECT event_id, round(100 * (x / nullif(lag(x) {W}, 0) - 1), 3) AS pct FROM f")
def _(t):
    return rounded(C.shift(with_nulls(t), "value", "pct", "pct_change", ["event_id"], ["user_id"]).select("event_id", "pct"), "pct", digits=3)


ROLL = f"{W[:-1]} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
for agg, sql in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("count", "count"), ("median", "median")):
    query(f"rolling_{agg}", "events", f"WITH e AS {NULLED} SELECT event_id, CASE WHEN count(value) {ROLL} >= 2 THEN round({sql}(value) {ROLL}, 4) END AS rolled FROM e" if agg != "count" else f"WITH e AS {NULLED} SELECT event_id, CASE WHEN count(value) {ROLL} >= 2 THEN count(value) {ROLL} END AS rolled FROM e")(
        lambda t, a=agg: (lambda d: d if a == "count" else rounded(d, "rolled"))(C.rolling(with_nulls(t), "value", "rolled", 7, a, ["event_id"], ["user_id"], 2).select("event_id", "rolled")))
RUN = f"{W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
for agg in ("sum", "max", "min"):
    query(f"cumulative_{agg}", "events", f"WITH e AS {NULLED} SELECT event_id, CASE WHEN value IS NOT NULL THEN round({agg}(value) {RUN}, 4) END AS total FROM e")(lambda t, a=agg: rounded(C.cumulative(with_nulls(t), "value", "total", a, ["event_id"], ["user_id"]).select("event_id", "total"), "total"))
query("ewm", "events", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM {NULLED}),
r AS (SELECT event_id, user_id, pos, value AS y, 0 AS wait FROM e WHERE pos = 1 UNION ALL SELECT e.event_id, e.user_id, e.pos, CASE WHEN e.value IS NULL THEN r.y WHEN r.y IS NULL THEN e.value ELSE (pow(0.75, r.wait + 1) * r.y + 0.25 * e.value) / (pow(0.75, r.wait + 1) + 0.25) END, CASE WHEN e.value IS NULL THEN r.wait + 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.pos = r.pos + 1)
SELECT event_id, round(y + 1.2345e-7, 4) AS ewm FROM r""")(  # moved a little, as quarters of sums in thousandths lie halfway between roundings
    lambda t: rounded(C.ewm(with_nulls(t).select("event_id", "user_id", "value"), "value", "ewm", 7, ["event_id"], ["user_id"]).select("event_id", (F.col("ewm") + 1.2345e-7).alias("ewm")), "ewm"))

for how, sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"merge_{how}", "part", f"SELECT coalesce(p_partkey, c_custkey + 500) AS p_partkey, p_name, c_name, c_acctbal FROM part {sql} customer ON p_partkey = c_custkey + 500", "customer")(
        lambda p, c, h=how: R.merge(p.select("p_partkey", "p_name"), c.select((F.col("c_custkey") + 500).alias("c_custkey"), "c_name", "c_acctbal"), "p_partkey", "c_custkey", h))


@query("merge_null_keys", "events", """WITH l AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type END AS k FROM events), r AS (SELECT k, count(*) AS n FROM l GROUP BY 1)
SELECT l.k AS k, event_id, n FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def _(t):
    left = t.select("event_id", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("k"))
    return R.merge(left, left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "k").select("k", "event_id", "n")


@query("unmatched_keys", "customer", "SELECT CAST(c_custkey + 500 AS BIGINT) AS key FROM customer WHERE c_custkey + 500 NOT IN (SELECT p_partkey FROM part)", "part")
def _(c, p):
    return R.unmatched_keys(c.select((F.col("c_custkey") + 500).alias("c_custkey")), p, "c_custkey", "p_partkey")


@query("concat_rows", "customer", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS __source FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier", "supplier")
def _(c, s):
    return R.concat_rows({"customer": c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), "supplier": s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))})


@query("concat_rows_common", "customer", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier", "supplier")
def _(c, s):
    return R.concat_rows({"c": c.select(F.col("c_name").alias("name"), "c_acctbal"), "s": s.select(F.col("s_name").alias("name"))}, False, None)


@query("aggregate", "lineitem", "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 4) AS l_quantity_mean, round(median(l_extendedprice), 4) AS l_extendedprice_median, round(stddev_samp(l_extendedprice), 2) AS l_extendedprice_std, count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def _(t):
    out = R.aggregate(t, ["l_returnflag"], {"l_quantity": ["sum", "mean"], "l_extendedprice": ["median", "std"], "l_suppkey": ["nunique"]})
    return rounded(rounded(out, "l_quantity_mean", "l_extendedprice_median"), "l_quantity_sum", "l_extendedprice_std", digits=2)


@query("value_counts", "part", "SELECT p_brand AS value, count(*) AS count, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM part GROUP BY 1")
def _(t):
    return rounded(R.value_counts(t, "p_brand"), "pct", digits=6)


@query("pivot", "orders", "SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2), 0) AS F, coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2), 0) AS O FROM orders GROUP BY 1")
def _(t):
    return R.pivot(t, ["o_orderpriority"], "o_orderstatus", ["F", "O"], r(F.sum("o_totalprice"), 2), 0.0)


@query("melt", "part", "SELECT p_partkey, variable, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def _(t):
    return R.melt(t.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("cross_tabulate", "events", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def _(t):
    return R.cross_tabulate(t, "user_id", "event_type", ["click", "view"])


@query("cross_tabulate_index", "orders", "SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 6) AS F, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 6) AS O FROM orders GROUP BY 1")
def _(t):
    return rounded(R.cross_tabulate(t, "o_orderpriority", "o_orderstatus", ["F", "O"], "index"), "F", "O", digits=6)


for freq, unit, step, label in (("D", "day", "1 day", "b"), ("H", "hour", "1 hour", "b"), ("W", "week", "7 days", "b + INTERVAL 6 DAY"), ("M", "month", "1 month", "CAST(last_day(b) AS TIMESTAMP)"), ("Q", "quarter", "3 months", "CAST(last_day(b + INTERVAL 2 MONTH) AS TIMESTAMP)"), ("Y", "year", "1 year", "CAST(last_day(b + INTERVAL 11 MONTH) AS TIMESTAMP)")):
    source, date, value = ("events", "ts", "value") if freq == "H" else ("orders", "o_orderdate", "o_totalprice")
    query(f"resample_{freq}", source, f"""WITH g AS (SELECT CAST(date_trunc('{unit}', {date}) AS TIMESTAMP) AS b, sum({value}) AS s, count({value}) AS n, avg({value}) AS m FROM {source} GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(b) FROM g), (SELECT max(b) FROM g), INTERVAL '{step}')) AS b)
SELECT CAST({label} AS TIMESTAMP) AS bucket, round(coalesce(s, 0), 2) AS sum, coalesce(n, 0) AS count, round(m, 5) AS mean FROM c LEFT JOIN g USING (b)""")(
        lambda t, f=freq, d=date, v=value: rounded(rounded(R.resample(t, d, f, v, ["sum", "count", "mean"]), "mean", digits=5), "sum", digits=2))


@query("period_comparison", "orders", """WITH s AS (SELECT sum(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1997-03-01') AS c, sum(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1996-03-01') AS p FROM orders)
SELECT round(c, 2) AS current, round(p, 2) AS reference, round(c - p, 2) AS delta, round(100 * (c - p) / abs(p), 4) AS pct, CASE WHEN c IS NULL OR p IS NULL THEN 'no_data' WHEN c > p THEN 'up' WHEN c < p THEN 'down' ELSE 'flat' END AS direction FROM s""")
def _(t):
    return rounded(rounded(R.period_comparison(t, "o_orderdate", "o_totalprice", "M", "1997-03-01", "1996-03-01"), "pct"), "current", "reference", "delta", digits=2)


@query("cohort", "orders", "SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def _(t):
    return rounded(R.cohort(t, "o_orderpriority", "o_orderdate", "o_totalprice"), "total", digits=2)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("describe", "lineitem", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis FROM lineitem""" for c in NUMBERS))
def _(t):
    return rounded(P.describe(t, NUMBERS), "mean", "std", "q25", "q50", "q75", "skew", "kurtosis")


@query("scan_nulls_zeros", "events", f"""WITH e AS {NULLED} SELECT 'value' AS "column", count(*) FILTER (WHERE value IS NULL) AS nulls, CAST(0 AS BIGINT) AS null_like, count(*) FILTER (WHERE value = 0) AS zeros FROM e
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), count(*) FILTER (WHERE trim(event_type) IN ('', '-', 'N/A', 'null', 'None')), 0 FROM e""")
def _(t):
    return P.scan_nulls_zeros(with_nulls(t), ["value", "event_type"])


@query("check_outliers", "lineitem", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(any_value(a) - 1.5 * (any_value(b) - any_value(a)), 6) AS low, round(any_value(b) + 1.5 * (any_value(b) - any_value(a)), 6) AS high, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM lineitem, (SELECT quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM lineitem)""" for c in NUMBERS[:2]))
def _(t):
    return rounded(P.check_outliers(t, NUMBERS[:2]), "low", "high", digits=6)


@query("detect_anomalies", "events", """WITH q AS (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b, avg(value) m, stddev_samp(value) s FROM events)
SELECT event_id, CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INTEGER) AS value_iqr_flag, CAST(abs(value - m) > 3 * s AS INTEGER) AS value_zscore_flag, CAST(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS INTEGER) + CAST(abs(value - m) > 3 * s AS INTEGER) AS _anomaly_score FROM events, q""")
def _(t):
    return P.detect_anomalies(t, "value").select("event_id", "value_iqr_flag", "value_zscore_flag", "_anomaly_score")


query("validate", "events", f"""WITH e AS {NULLED}, s AS (SELECT 100 * (count(*) - count(event_id)) / count(*) a, 100 * (count(*) - count(event_type)) / count(*) b, 100 * (count(*) - count(value)) / count(*) c, count(*) FILTER (WHERE event_id = 0) > 0 z1, count(*) FILTER (WHERE value = 0) > 0 z2, (SELECT max(n) > 1 FROM (SELECT count(*) n FROM e GROUP BY event_id, event_type, value)) d FROM e),
r AS (SELECT CAST((a > 5)::INT + (b > 5)::INT + (c > 5)::INT AS INT) AS errors, CAST((a > 0 AND a <= 5)::INT + (b > 0 AND b <= 5)::INT + (c > 0 AND c <= 5)::INT + z1::INT + z2::INT AS INT) AS warnings, d::INT AS infos FROM s) SELECT *, CAST(greatest(0, 100 - 5 * errors - 2 * warnings - infos) AS INT) AS score FROM r""")(lambda t: P.validate(with_nulls(t), ["event_id", "event_type", "value"]))


@query("correlation_pearson", "lineitem", """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def _(t):
    return rounded(P.correlation(t, NUMBERS), "r", digits=6)


@query("correlation_spearman", "lineitem", """WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(x, y), 6) AS r FROM k""")
def _(t):
    return rounded(P.correlation(t, ["l_quantity", "l_discount"], "spearman"), "r", digits=6)


@query("t_test", "orders", f"""WITH s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') n1, count(*) FILTER (WHERE o_orderstatus = 'O') n2, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') m1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') m2, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') v1, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') v2 FROM orders), d AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s)
SELECT round(d / sqrt(1 / n1 + 1 / n2), 6) AS statistic, n1 + n2 - 2 AS df, round(d, 6) AS cohens_d, round({student_p("(d / sqrt(1 / n1 + 1 / n2))", "(n1 + n2 - 2)")}, 6) AS p_value FROM d""")
def _(t):
    return rounded(P.t_test(t, "o_totalprice", "o_orderstatus", "F", "O"), "statistic", "cohens_d", "p_value", digits=6)


@query("anova", "orders", f"""WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) * count(*) w FROM orders GROUP BY 1), a AS (SELECT sum(n) n, count(*) k, sum(w) w, sum(n * m) / sum(n) gm FROM g), b AS (SELECT sum(g.n * (m - gm) * (m - gm)) b FROM g, a)
SELECT round(b / (k - 1) / (w / (n - k)), 4) AS statistic, round(b / (b + w), 6) AS eta_squared, round({f4_p("b / (k - 1) / (w / (n - k))", "(n - k)")}, 6) AS p_value FROM a, b""")
def _(t):
    return rounded(rounded(P.anova(t, "o_totalprice", "o_orderpriority"), "statistic"), "eta_squared", "p_value", digits=6)


@query("chi_square", "orders", """WITH c AS (SELECT o_orderpriority a, o_orderstatus b, count(*) o FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(o) r FROM c GROUP BY 1), k AS (SELECT b, sum(o) k FROM c GROUP BY 1), n AS (SELECT sum(o) n FROM c), e AS (SELECT r.a, k.b, r * k / n AS e FROM r, k, n),
x AS (SELECT sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS x, CAST((count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS BIGINT) AS df FROM e LEFT JOIN c ON c.a = e.a AND c.b = e.b)
SELECT round(x, 4) AS statistic, df, round(sqrt(x / (n * 2)), 6) AS cramers_v, round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value FROM x, n""")
def _(t):
    return rounded(rounded(P.chi_square(t, "o_orderpriority", "o_orderstatus"), "statistic"), "cramers_v", "p_value", digits=6)


@query("chi_square_2x2", "lineitem", f"""WITH c AS (SELECT l_linestatus = 'O' a, l_discount > 0.05 b, count(*) o FROM lineitem GROUP BY 1, 2), m AS (SELECT sum(o) FILTER (WHERE a AND b) p, sum(o) FILTER (WHERE a AND NOT b) q, sum(o) FILTER (WHERE NOT a AND b) r, sum(o) FILTER (WHERE NOT a AND NOT b) s, CAST(sum(o) AS DOUBLE) n FROM c),
x AS (SELECT n * pow(greatest(abs(CAST(p AS DOUBLE) * s - CAST(q AS DOUBLE) * r) - n / 2, 0), 2) / (CAST(p + q AS DOUBLE) * (r + s) * (p + r) * (q + s)) AS x, n FROM m)
SELECT round(x, 4) AS statistic, CAST(1 AS BIGINT) AS df, round(sqrt(x / n), 6) AS cramers_v, round({normal_p("sqrt(x)")}, 6) AS p_value FROM x""")
def _(t):
    t = t.select((F.col("l_linestatus") == "O").alias("a"), (F.col("l_discount") > 0.05).alias("b"))
    return rounded(rounded(P.chi_square(t, "a", "b"), "statistic"), "cramers_v", "p_value", digits=6)


@query("ols", "lineitem", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
def _(t):
    return rounded(rounded(P.ols(t, "l_extendedprice", "l_quantity"), "slope", "intercept"), "r2", digits=6)


@query("word_frequency", "orders", "SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(regexp_replace(lower(o_orderpriority || ': ' || o_orderstatus || '!'), '[^\\w\\s]', '', 'g'), '\\s+')) AS word FROM orders) WHERE word <> '' GROUP BY 1")
def _(t):
    return P.word_frequency(t.select(F.concat("o_orderpriority", F.lit(": "), "o_orderstatus", F.lit("!")).alias("note")), "note")


@query("rollup_totals", "orders", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS count FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t):
    return rounded(P.rollup_totals(t, ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "total", digits=2)


@query("histogram", "part", "SELECT CAST(floor(p_retailprice / 50.0) * 50.0 AS DOUBLE) AS start, count(*) AS count FROM part GROUP BY 1")
def _(t):
    return P.histogram(t, "p_retailprice", 50.0)


@query("sankey_edges", "customer", "SELECT c_mktsegment AS source, CAST(c_nationkey AS VARCHAR) AS target, count(*) AS weight FROM customer GROUP BY 1, 2")
def _(t):
    return t.groupBy(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


@query("one_sample_t", "orders", f"WITH s AS (SELECT (avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM orders) SELECT round(t, 5) AS statistic, df, round({student_p('t', 'df')}, 6) AS p_value FROM s")
def _(t):
    return rounded(rounded(I.one_sample_t(t, "o_totalprice", 150000.0), "statistic", digits=5), "p_value", digits=6)


@query("paired_t", "lineitem", f"WITH s AS (SELECT avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM lineitem) SELECT round(t, 5) AS statistic, df, round({student_p('t', 'df')}, 6) AS p_value FROM s")
def _(t):
    return rounded(rounded(I.paired_t(t, "l_discount", "l_tax"), "statistic", digits=5), "p_value", digits=6)


@query("proportion_z", "orders", f"""WITH s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') n1, count(*) FILTER (WHERE o_orderstatus = 'O') n2, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 200000) h1, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 200000) h2 FROM orders), z AS (SELECT *, (h1 / n1 - h2 / n2) / sqrt((h1 + h2) / (n1 + n2) * (1 - (h1 + h2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM s)
SELECT round(z, 6) AS statistic, round(h1 / n1, 6) AS share_1, round(h2 / n2, 6) AS share_2, round({normal_p("z")}, 6) AS p_value FROM z""")
def _(t):
    return rounded(I.proportion_z(t, F.col("o_totalprice") > 200000, "o_orderstatus", "F", "O"), "statistic", "share_1", "share_2", "p_value", digits=6)


@query("levene", "orders", f"""WITH d AS (SELECT o_orderpriority p, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d FROM orders), g AS (SELECT p, count(*) n, avg(d) m, var_pop(d) * count(*) w FROM d GROUP BY 1), a AS (SELECT sum(n) n, count(*) k, sum(w) w, sum(n * m) / sum(n) gm FROM g), b AS (SELECT sum(g.n * (m - gm) * (m - gm)) b FROM g, a)
SELECT round(b / (k - 1) / (w / (n - k)), 4) AS statistic, round({f4_p("b / (k - 1) / (w / (n - k))", "(n - k)")}, 6) AS p_value FROM a, b""")
def _(t):
    return rounded(rounded(I.levene(t, "o_totalprice", "o_orderpriority"), "statistic"), "p_value", digits=6)


RANKED = "SELECT {g} AS g, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {v}) AS t FROM {t}"


@query("kruskal", "lineitem", f"""WITH k AS ({RANKED.format(g="l_returnflag", v="l_quantity", t="lineitem")}), c AS (SELECT 1 - sum(CAST(t AS DOUBLE) * t - 1) / (CAST(count(*) AS DOUBLE) * count(*) * count(*) - count(*)) AS c, CAST(count(*) AS DOUBLE) AS n FROM k), s AS (SELECT sum(r) * sum(r) / count(*) AS q FROM k GROUP BY g),
h AS (SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(q) - 3 * (any_value(n) + 1)) / any_value(c) AS h, count(*) - 1 AS df FROM s, c) SELECT round(h, 4) AS statistic, df, round(exp(-h / 2), 6) AS p_value FROM h""")
def _(t):
    return rounded(rounded(I.kruskal(t, "l_quantity", "l_returnflag"), "statistic"), "p_value", digits=6)


@query("mann_whitney", "orders", f"""WITH k AS ({RANKED.format(g="o_orderstatus", v="o_totalprice", t="(SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O'))")}), u AS (SELECT sum(r) FILTER (WHERE g = 'F') - count(*) FILTER (WHERE g = 'F') * (count(*) FILTER (WHERE g = 'F') + 1) / 2 AS u, count(*) FILTER (WHERE g = 'F') * count(*) FILTER (WHERE g = 'O') AS n, CAST(count(*) AS DOUBLE) AS a, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k), z AS (SELECT *, greatest((abs(u - n / 2) - 0.5) / sqrt(n / 12 * (a + 1 - ties / (a * (a - 1)))), 0) AS z FROM u)
SELECT round(u, 2) AS statistic, round(1 - 2 * u / n, 6) AS rank_biserial, round({normal_p("z")}, 6) AS p_value FROM z""")
def _(t):
    return rounded(rounded(I.mann_whitney(t, "o_totalprice", "o_orderstatus", "F", "O"), "statistic", digits=2), "rank_biserial", "p_value", digits=6)


@query("wilcoxon", "lineitem", f"""WITH d AS (SELECT round(100 * (l_discount - l_tax)) AS d FROM lineitem), k AS (SELECT d > 0 AS up, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY abs(d)) AS DOUBLE) AS t FROM d WHERE d <> 0),
w AS (SELECT least(sum(r) FILTER (WHERE up), sum(r) FILTER (WHERE NOT up)) AS w, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS ties FROM k), z AS (SELECT w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w)
SELECT round(w, 2) AS statistic, round({normal_p("z")}, 6) AS p_value FROM z""")
def _(t):
    t = t.select(F.round(100 * (F.col("l_discount") - F.col("l_tax"))).alias("d"), F.lit(0.0).alias("z"))
    return rounded(rounded(I.wilcoxon(t, "d", "z"), "statistic", digits=2), "p_value", digits=6)


@query("kolmogorov_smirnov", "orders", """WITH v AS (SELECT o_totalprice v, o_orderstatus = 'F' f FROM orders WHERE o_orderstatus IN ('F', 'O')), d AS (SELECT count(*) FILTER (WHERE f) OVER (ORDER BY v) / (SELECT count(*) FILTER (WHERE f) FROM v) - count(*) FILTER (WHERE NOT f) OVER (ORDER BY v) / (SELECT count(*) FILTER (WHERE NOT f) FROM v) AS d FROM v), s AS (SELECT max(abs(d)) AS d FROM d),
l AS (SELECT d, d * sqrt(CAST((SELECT count(*) FILTER (WHERE f) FROM v) AS DOUBLE) * (SELECT count(*) FILTER (WHERE NOT f) FROM v) / (SELECT count(*) FROM v)) AS l FROM s)
SELECT round(d, 6) AS statistic, round(least(1, (SELECT 2 * sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * l * l)) FROM range(1, 101) x(i))), 6) AS p_value FROM l""")
def _(t):
    return rounded(I.kolmogorov_smirnov(t, "o_totalprice", "o_orderstatus", "F", "O", method="limit"), "statistic", "p_value", digits=6)


@query("fisher", "supplier", """WITH m AS (SELECT count(*) FILTER (WHERE x AND y) a, count(*) FILTER (WHERE x AND NOT y) b, count(*) FILTER (WHERE NOT x AND y) c, count(*) FILTER (WHERE NOT x AND NOT y) d FROM (SELECT s_acctbal > 4000 AS x, s_nationkey < 12 AS y FROM supplier)), h AS (SELECT i, i = a AS own, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM m, LATERAL (SELECT unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) AS i))
SELECT round(CAST(a AS DOUBLE) * d / (b * c), 6) AS odds_ratio, round((SELECT sum(p) FROM h WHERE p <= (SELECT p FROM h WHERE own) * (1 + 1e-7)), 6) AS p_value FROM m""")
def _(t):
    return rounded(I.fisher(t, F.col("s_acctbal") > 4000, F.col("s_nationkey") < 12), "odds_ratio", "p_value", digits=6)


@query("regression", "lineitem", f"""WITH m AS (SELECT count(*) n, avg(l_extendedprice) my, avg(l_quantity) m1, avg(l_discount) m2, count(*) * var_pop(l_extendedprice) yy, count(*) * var_pop(l_quantity) v11, count(*) * var_pop(l_discount) v22, count(*) * covar_pop(l_quantity, l_discount) v12, count(*) * covar_pop(l_extendedprice, l_quantity) y1, count(*) * covar_pop(l_extendedprice, l_discount) y2 FROM lineitem),
i AS (SELECT *, v22 / (v11 * v22 - v12 * v12) i11, v11 / (v11 * v22 - v12 * v12) i22, -v12 / (v11 * v22 - v12 * v12) i12 FROM m), b AS (SELECT *, i11 * y1 + i12 * y2 b1, i12 * y1 + i22 * y2 b2 FROM i), e AS (SELECT *, yy - b1 * y1 - b2 * y2 AS rest FROM b), s AS (SELECT *, rest / (n - 3) AS s2, 1 - rest / yy AS r2 FROM e),
c AS (SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS b, sqrt(s2 * (1 / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22)) AS se, r2, n FROM s UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * i11), r2, n FROM s UNION ALL SELECT 'l_discount', b2, sqrt(s2 * i22), r2, n FROM s)
SELECT term, round(b, 3) AS coefficient, round(se, 4) AS std_error, round(b / se, 4) AS t, round({student_p("(b / se)", "(n - 3)")}, 6) AS p_value, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2, round(r2 / 2 / ((1 - r2) / (n - 3)), 1) AS f, n FROM c""")
def _(t):
    out = I.regression(t, "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(rounded(rounded(rounded(out, "coefficient", digits=3), "std_error", "t"), "p_value", "r2", "adjusted_r2", digits=6), "f", digits=1)


query(
    "variance_inflation",
    "lineitem",
    """WITH m AS (SELECT corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM m)
SELECT 'l_quantity' AS term, round((1 - c * c) / det, 4) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 4) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 4) FROM d""",
)(lambda t: rounded(I.variance_inflation(t, ["l_quantity", "l_extendedprice", "l_discount"]), "vif"))


query("yeo_johnson", "customer", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(1 + c_acctbal, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS moved FROM customer")(
    lambda t: rounded(I.yeo_johnson(t, "c_acctbal", "moved", 0.5)[0].select("c_custkey", "moved"), "moved")
)


query("box_cox", "part", None)(lambda t: rounded(I.box_cox(t, "p_retailprice", "moved")[0].select("p_partkey", "moved"), "moved"))


@query("compare_datasets", "part", """WITH a AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS v FROM part), b AS (SELECT c_custkey + 500 AS k, CAST(c_nationkey AS DOUBLE) AS v FROM customer)
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b, count(*) FILTER (WHERE a.k = b.k) AS in_both, count(*) FILTER (WHERE a.k = b.k AND a.v IS DISTINCT FROM b.v) AS changed FROM a FULL JOIN b ON a.k = b.k""", "customer")
def _(p, c):
    a = p.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("v"))
    b = c.select((F.col("c_custkey") + 500).alias("k"), F.col("c_nationkey").cast("double").alias("v"))
    return I.compare_datasets(a, b, ["k"])


@query("text_profile", "part", "SELECT count(p_name) AS texts, count(*) FILTER (WHERE p_name IS NULL) AS nulls, count(*) FILTER (WHERE trim(p_name) = '') AS blanks, count(DISTINCT p_name) AS distinct, min(length(p_name)) AS shortest, max(length(p_name)) AS longest, round(avg(length(p_name)), 4) AS mean_length, CAST(sum(len(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM part")
def _(t):
    return rounded(I.text_profile(t, "p_name"), "mean_length")


MONTHS = "m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS y FROM orders GROUP BY 1), b AS (SELECT y, row_number() OVER (ORDER BY mon) - 1 AS i FROM m)"


@query("trend", "orders", f"WITH {MONTHS} SELECT round(regr_slope(y, i), 2) AS slope, round(regr_intercept(y, i), 2) AS intercept, round(regr_r2(y, i), 6) AS r2 FROM b")
def _(t):
    return rounded(rounded(S.trend(t, "o_orderdate", "o_totalprice"), "slope", "intercept", digits=2), "r2", digits=6)


@query("autocorrelation", "orders", f"""WITH {MONTHS}, d AS (SELECT i, y - avg(y) OVER () AS d, count(*) OVER () AS n FROM b), l AS (SELECT unnest(generate_series(1, 12)) AS lag), p AS (SELECT lag, (SELECT sum(x.d * z.d) FROM d x JOIN d z ON x.i = z.i + lag) / (SELECT sum(d * d) FROM d) AS acf, (SELECT max(n) FROM d) AS n FROM l)
SELECT CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, abs(acf) > 2 / sqrt(n) AS significant FROM p WHERE lag <= n // 2""")
def _(t):
    return rounded(S.autocorrelation(t, "o_orderdate", "o_totalprice"), "acf", digits=6)


@query("smoothed_level", "orders", f"WITH {MONTHS} SELECT round(sum(pow(0.7, (SELECT max(i) FROM b) - i) * CASE WHEN i = 0 THEN 1 ELSE 0.3 END * y), 2) AS level FROM b")
def _(t):
    return rounded(S.smoothed_level(t, "o_orderdate", "o_totalprice"), "level", digits=2)


@query("saved_steps", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice / 1000 - 1, 6) AS thousands FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 250000")
def _(t):
    steps = [
        {"op": "filter_isin", "column": "o_orderpriority", "values": ["1-URGENT", "2-HIGH"]}, {"op": "filter_between", "column": "o_totalprice", "min": 1000, "max": 250000},
        {"op": "replace_values", "column": "o_orderstatus", "mapping": {"F": "done"}}, {"op": "add_column", "name": "thousands", "expression": "o_totalprice / 1000 - 1"},
    ]
    return rounded(pipelines.apply(t, steps).select("o_orderkey", "o_orderstatus", "thousands"), "thousands", digits=6)


EVENT_COLUMNS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "ts": "timestamp_ntz", "value": "double"}
EVENT_KINDS = {"event_id": "numeric", "user_id": "numeric", "event_type": "categorical", "ts": "datetime", "value": "numeric"}


@query("inspect", "events", f"WITH e AS {NULLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{EVENT_KINDS[c]}' AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, round(100 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct FROM e""" for c, t in EVENT_COLUMNS.items()))
def _(t):
    return N.inspect(with_nulls(t))


@query("search_columns", "events", f"""WITH e AS {NULLED} SELECT 'value' AS "column", 'double' AS dtype, count(*) - count(value) AS nulls, count(*) FILTER (WHERE value = 0) AS zeros FROM e HAVING count(*) > count(value)""")
def _(t):
    return N.search_columns(with_nulls(t), has_nulls=True, kind="numeric", name_contains="VAL", min_null_pct=10)


@query("detect_schema", "orders", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'int'), ('o_totalprice', 'double', 'float'), ('o_orderdate', 'timestamp_ntz', 'datetime'), ('o_orderstatus', 'string', 'category'), ('level', 'string', 'numeric'), ('day', 'string', 'datetime'), ('code', 'string', 'id')) v("column", dtype, inferred)
UNION ALL SELECT 'size', 'int', CASE WHEN count(DISTINCT length(o_orderpriority)) <= 20 AND count(DISTINCT length(o_orderpriority)) < 0.05 * count(*) THEN 'category_encoded' ELSE 'int' END FROM orders""")
def _(t):
    return N.detect_schema(t.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("code"), F.length("o_orderpriority").alias("size")))


@query("sample_tail", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def _(t):
    return N.sample_rows(t.select("o_orderkey", "o_totalprice"), 50, "tail", ["o_orderkey"])


@query("smart_impute", "events", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events),
m AS (SELECT event_type AS top FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, user_id, coalesce(event_type, (SELECT top FROM m)) AS event_type, last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts, round(coalesce(value, (SELECT median(value) FROM e)), 4) AS value FROM e""")
def _(t):
    i = F.col("event_id")
    t = t.select("event_id", "user_id", F.when(i % 5 != 0, F.col("event_type")).alias("event_type"), F.when(i % 4 != 0, F.col("ts")).alias("ts"), F.when(i % 3 != 0, F.col("value")).alias("value"))
    return rounded(N.smart_impute(t, ["event_id"], partition_by=["user_id"]), "value")


@query("concat_columns", "customer", "WITH a AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT c_acctbal, c_custkey AS c_custkey_2, row_number() OVER (ORDER BY -c_custkey) AS i FROM customer) SELECT c_custkey, c_name, c_acctbal, c_custkey_2 FROM a JOIN b USING (i)")
def _(t):
    right = t.select("c_acctbal", "c_custkey", (-F.col("c_custkey")).alias("back"))
    return N.concat_columns(t.select("c_custkey", "c_name"), right, "c_custkey", "back").drop("back")


@query("transpose", "region", "SELECT 'r_regionkey' AS key, " + ", ".join(f"CAST(max(CASE WHEN r_name = '{n}' THEN r_regionkey END) AS VARCHAR) AS \"{n}\"" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region")
def _(t):
    return N.transpose(t.select("r_name", "r_regionkey"), "r_name")


@query("alerts", "events", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 20 = 0 THEN event_type ELSE 'click' END AS event_type, CASE WHEN event_id % 4 = 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS flag, 2.0 * event_id AS twice, 7 AS same FROM events),
k AS (SELECT count(*) n, count(value) v, count(*) FILTER (WHERE flag = 0) z, (SELECT max(c) FROM (SELECT count(*) c FROM e GROUP BY event_type)) top, corr(event_id, twice) r FROM e)
SELECT 'same' AS "column", 'CONSTANT' AS type, 'error' AS severity, 1.0::DOUBLE AS figure UNION ALL SELECT 'value', 'HIGH NULLS', 'error', round(100 * (n - v) / n, 1) FROM k UNION ALL SELECT 'flag', 'ZEROS', 'warning', round(100 * z / n, 1) FROM k UNION ALL SELECT 'event_type', 'IMBALANCED', 'warning', round(100 * top / n, 1) FROM k WHERE round(100 * top / n, 1) > 90
UNION ALL SELECT 'event_id', 'HIGH CORR', 'warning', round(r, 3) FROM k UNION ALL SELECT 'value', 'SKEWED', 'warning', round(skewness(value), 2) FROM e HAVING abs(round(skewness(value), 2)) > 2
UNION ALL SELECT 'value', 'OUTLIERS', 'warning', round(100 * count(*) FILTER (WHERE value < 2.5 * a - 1.5 * b OR value > 2.5 * b - 1.5 * a) / count(*), 1) AS s FROM e, (SELECT quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b FROM e) HAVING s > 10""")
def _(t):
    i = F.col("event_id")
    return N.alerts(t.select("event_id", "user_id", F.when(i % 20 == 0, F.col("event_type")).otherwise("click").alias("event_type"), F.when(i % 4 == 0, F.col("value")).alias("value"), F.when(i % 3 == 0, 1.0).otherwise(0.0).alias("flag"), (2.0 * i).alias("twice"), F.lit(7).alias("same")))


@query("eda", "lineitem", """WITH t AS (SELECT l_quantity, l_discount, l_returnflag FROM lineitem), n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d FROM t), q AS (SELECT quantile_cont(l_quantity, 0.25) a, quantile_cont(l_quantity, 0.75) b, quantile_cont(l_discount, 0.25) c, quantile_cont(l_discount, 0.75) d FROM t),
o AS (SELECT count(*) FILTER (WHERE l_quantity < 2.5 * a - 1.5 * b OR l_quantity > 2.5 * b - 1.5 * a) + count(*) FILTER (WHERE l_discount < 2.5 * c - 1.5 * d OR l_discount > 2.5 * d - 1.5 * c) AS o FROM t, q), s AS (SELECT n AS rows, 0.0::DOUBLE AS null_pct, 100 * (n - d) / n AS duplicate_pct, 100 * o / (2 * n) AS outlier_pct FROM n, o)
SELECT rows, 3 AS columns, null_pct, round(duplicate_pct, 6) AS duplicate_pct, round(outlier_pct, 6) AS outlier_pct, greatest(0, round(100 - null_pct - 0.5 * duplicate_pct - 0.3 * outlier_pct)) AS score FROM s""")
def _(t):
    return rounded(N.eda(t.select("l_quantity", "l_discount", "l_returnflag")), "duplicate_pct", "outlier_pct", digits=6)


@query("compare_columns", "customer", """SELECT 'name' AS "column", 'both' AS side, 'string' AS dtype_a, 'string' AS dtype_b, 0 AS nulls_a, 0 AS nulls_b, NULL::DOUBLE AS mean_a, NULL::DOUBLE AS mean_b, NULL::DOUBLE AS pct_change
UNION ALL SELECT 'balance', 'both', 'double', 'double', 0, 0, round(a, 4), round(b, 4), round(100 * (b - a) / a, 4) FROM (SELECT avg(c_acctbal) a FROM customer), (SELECT avg(s_acctbal) b FROM supplier) UNION ALL SELECT 'segment', 'a', 'string', NULL, 0, NULL, NULL, NULL, NULL UNION ALL SELECT 'supplier', 'b', NULL, 'bigint', NULL, 0, NULL, NULL, NULL""", "supplier")
def _(c, s):
    a = c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("supplier"))
    return rounded(N.compare_columns(a, b), "mean_a", "mean_b", "pct_change")


@query("resample_groups", "orders", """WITH g AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS mon, sum(o_totalprice) AS s, avg(o_totalprice) AS m, count(o_custkey) AS n FROM orders GROUP BY 1, 2), c AS (SELECT o_orderstatus, unnest(generate_series(min(mon), max(mon), INTERVAL 1 MONTH)) AS mon FROM g GROUP BY 1)
SELECT c.o_orderstatus, CAST(last_day(c.mon) AS TIMESTAMP) AS bucket, round(coalesce(s, 0), 2) AS o_totalprice_sum, round(m, 5) AS o_totalprice_mean, coalesce(n, 0) AS o_custkey_count FROM c LEFT JOIN g ON g.o_orderstatus = c.o_orderstatus AND g.mon = c.mon""")
def _(t):
    out = R.resample_groups(t, "o_orderdate", "M", {"o_totalprice": ["sum", "mean"], "o_custkey": ["count"]}, ["o_orderstatus"])
    return rounded(rounded(out, "o_totalprice_sum", digits=2), "o_totalprice_mean", digits=5)


@query("period_changes", "orders", """WITH p AS (SELECT o_orderpriority, 'o_totalprice' AS metric, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1998) AS c, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS r FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'o_custkey', sum(o_custkey) FILTER (WHERE year(o_orderdate) = 1998), sum(o_custkey) FILTER (WHERE year(o_orderdate) = 1997) FROM orders GROUP BY 1)
SELECT o_orderpriority, metric, round(c, 2) AS current, round(r, 2) AS reference, round(c - r, 2) AS delta, round(100 * (c - r) / abs(r), 4) AS pct, CASE WHEN r IS NULL OR c IS NULL OR r = 0 THEN 'no_data' WHEN c > r THEN 'up' WHEN c < r THEN 'down' ELSE 'flat' END AS direction FROM p""")
def _(t):
    out = R.period_changes(t.withColumn("o_custkey", F.col("o_custkey").cast("double")), "o_orderdate", ["o_totalprice", "o_custkey"], "Y", "1998-01-01", "1997-01-01", ["o_orderpriority"])
    return rounded(rounded(out, "current", "reference", "delta", digits=2), "pct")


@query("partial_autocorrelation", "orders", f"""WITH {MONTHS}, d AS (SELECT i, y - avg(y) OVER () AS d, count(*) OVER () AS n FROM b), r AS (SELECT (SELECT sum(x.d * z.d) FROM d x JOIN d z ON x.i = z.i + 1) / (SELECT sum(d * d) FROM d) AS r1, (SELECT sum(x.d * z.d) FROM d x JOIN d z ON x.i = z.i + 2) / (SELECT sum(d * d) FROM d) AS r2, (SELECT max(n) FROM d) AS n),
p AS (SELECT 1 AS lag, r1 AS pacf, n FROM r UNION ALL SELECT 2, (r2 - r1 * r1) / (1 - r1 * r1), n FROM r) SELECT lag, round(pacf, 6) AS pacf, abs(pacf) > 2 / sqrt(n) AS significant FROM p""")
def _(t):
    return rounded(S.partial_autocorrelation(t, "o_orderdate", "o_totalprice", lags=2), "pacf", digits=6)


@query("dickey_fuller", "orders", f"""WITH {MONTHS}, d AS (SELECT y - lag(y) OVER (ORDER BY i) AS dy, lag(y) OVER (ORDER BY i) AS level FROM b), s AS (SELECT count(*) n, regr_slope(dy, level) AS k, count(*) * var_pop(level) AS xx, count(*) * var_pop(dy) AS yy FROM d WHERE level IS NOT NULL),
t AS (SELECT n, k / sqrt((yy - k * k * xx) / (n - 2) / xx) AS t, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS c FROM s)
SELECT round(t, 4) AS statistic, 0 AS lags, n, round(-3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (n * n * n), 4) AS critical_1, round(c, 4) AS critical_5, round(-2.56677 - 1.5384 / n - 2.809 / (n * n), 4) AS critical_10, t < c AS stationary FROM t""")
def _(t):
    return rounded(S.dickey_fuller(t, "o_orderdate", "o_totalprice"), "statistic", "critical_1", "critical_5", "critical_10")


@query("missing_matrix", "events", f"SELECT event_id, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in EVENT_COLUMNS if c != "event_id") + f" FROM {NULLED} ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 300")
def _(t):
    return N.missing_matrix(with_nulls(t), ["event_id"])


@query("kendall", "customer", f"""WITH p AS (SELECT sign(a.c_acctbal - b.c_acctbal) * sign(a.c_nationkey - b.c_nationkey) AS s, a.c_acctbal = b.c_acctbal AS tx, a.c_nationkey = b.c_nationkey AS ty FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey),
t AS (SELECT CAST(sum(s) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS pairs, CAST(count(*) FILTER (WHERE tx) AS DOUBLE) AS xt, CAST(count(*) FILTER (WHERE ty) AS DOUBLE) AS yt FROM p),
x AS (SELECT sum(CAST(t AS DOUBLE) * (t - 1) * (t - 2)) AS x0, sum(CAST(t AS DOUBLE) * (t - 1) * (2 * t + 5)) AS x1 FROM (SELECT count(*) AS t FROM customer GROUP BY c_acctbal)), y AS (SELECT sum(CAST(t AS DOUBLE) * (t - 1) * (t - 2)) AS y0, sum(CAST(t AS DOUBLE) * (t - 1) * (2 * t + 5)) AS y1 FROM (SELECT count(*) AS t FROM customer GROUP BY c_nationkey)), k AS (SELECT count(*) AS n FROM customer),
z AS (SELECT c / sqrt(pairs - xt) / sqrt(pairs - yt) AS tau, n, c / sqrt((2 * pairs * (2.0 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / (2 * pairs) + x0 * y0 / (9 * 2 * pairs * (n - 2))) AS z FROM t, x, y, k)
SELECT round(tau, 9) AS tau, n, round({normal_p("z")}, 6) AS p_value FROM z""")
def _(t):
    return rounded(rounded(K.kendall(t, "c_acctbal", "c_nationkey"), "tau", digits=9), "p_value", digits=6)


@query("anderson_darling", "supplier", f"""WITH s AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal) AS i, count(*) OVER () AS n, avg(s_acctbal) OVER () AS m, stddev_samp(s_acctbal) OVER () AS sd FROM supplier), z AS (SELECT i, n, (x - m) / sd AS z FROM s),
u AS (SELECT i, n, CASE WHEN z > 0 THEN {normal_p("z")} / 2 ELSE 1 - {normal_p("z")} / 2 END AS high FROM z)
SELECT round(-any_value(n) - sum((2 * i - 1) * ln(1 - high) + (2 * (n - i) + 1) * ln(high)) / any_value(n), 5) AS statistic, any_value(n) AS n, round(0.787 / (1 + 4.0 / any_value(n) - 25.0 / (any_value(n) * any_value(n))), 3) AS critical_5 FROM u""")
def _(t):
    return rounded(K.anderson_darling(t, "s_acctbal").select("statistic", "n", "critical_5"), "statistic", digits=5)


query("shapiro_wilk", "supplier", None)(lambda t: rounded(K.shapiro_wilk(t, "s_acctbal"), "statistic", "p_value", digits=6))


PRIORITIES = "g AS (SELECT o_orderpriority AS term, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) AS m FROM orders GROUP BY 1), f AS (SELECT * FROM g ORDER BY term LIMIT 1)"


@query("logistic", "orders", f"""WITH {PRIORITIES}, b AS (SELECT 'intercept' AS term, ln(a / CAST(n - a AS DOUBLE)) AS b, sqrt(1.0 / a + 1.0 / (n - a)) AS e FROM f UNION ALL SELECT 'o_orderpriority_' || g.term, ln(g.a / CAST(g.n - g.a AS DOUBLE)) - ln(f.a / CAST(f.n - f.a AS DOUBLE)), sqrt(1.0 / g.a + 1.0 / (g.n - g.a) + 1.0 / f.a + 1.0 / (f.n - f.a)) FROM g, f WHERE g.term <> f.term),
l AS (SELECT sum(a * ln(a / CAST(n AS DOUBLE)) + (n - a) * ln(1 - a / CAST(n AS DOUBLE))) AS l, sum(a) * ln(sum(a) / sum(n)) + (sum(n) - sum(a)) * ln(1 - sum(a) / sum(n)) AS l0, sum(n) AS n FROM g)
SELECT term, round(b, 5) AS coefficient, round(e, 5) AS std_error, round(b / e, 4) AS z, round({normal_p("(b / e)")}, 5) AS p_value, round(b - 1.959963984540054 * e, 5) AS ci_lower, round(b + 1.959963984540054 * e, 5) AS ci_upper, CAST(l.n AS BIGINT) AS n, round(1 - l / l0, 8) AS pseudo_r2, round(l, 4) AS log_likelihood, round(10 - 2 * l, 4) AS aic, round(5 * ln(l.n) - 2 * l, 4) AS bic FROM b, l""")
def _(t):
    found = M.logistic(t.withColumn("filled", (F.col("o_orderstatus") == "F").cast("int")), "filled", ["o_orderpriority"]).drop("significant")
    return rounded(rounded(rounded(found, "coefficient", "std_error", "p_value", "ci_lower", "ci_upper", digits=5), "z", "log_likelihood", "aic", "bic"), "pseudo_r2", digits=8)


# Student's quantile of 97.5 % by its expansion around the normal one, for the many degrees of freedom here
REACH = "(1.959963984540054 + 2.372271230298562 / (n - 5) + 2.8224986157396112 / ((n - 5) * (n - 5)))"


@query("least_squares", "orders", f"""WITH {PRIORITIES}, r AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(pow(o_totalprice - m, 2)) AS s, sum(abs(o_totalprice - m)) AS d, var_pop(o_totalprice) * count(*) AS w FROM orders JOIN g ON term = o_orderpriority),
b AS (SELECT 'intercept' AS term, m AS b, sqrt(1.0 / n) AS e FROM f UNION ALL SELECT 'o_orderpriority_' || g.term, g.m - f.m, sqrt(1.0 / g.n + 1.0 / f.n) FROM g, f WHERE g.term <> f.term), c AS (SELECT term, b, e * sqrt(s / (n - 5)) AS e, n, s, d, w FROM b, r)
SELECT term, round(b, 2) AS coefficient, round(e, 3) AS std_error, round(b / e, 4) AS t, round({student_p("(b / e)", "(n - 5)")}, 5) AS p_value, round(b - {REACH} * e, 1) AS ci_lower, round(b + {REACH} * e, 1) AS ci_upper, CAST(n AS BIGINT) AS n, round(1 - s / w, 8) AS r2, round(1 - (s / w) * (n - 1) / (n - 5), 8) AS adjusted_r2, round(sqrt(s / (n - 5)), 3) AS rmse, round(d / n, 3) AS mae, round((w - s) / 4 / (s / (n - 5)), 4) AS f, round({f4_p("(w - s) / 4 / (s / (n - 5))", "(n - 5)")}, 6) AS f_p_value, round(10 + n * (ln(2 * pi()) + ln(s / n) + 1), 3) AS aic, round(5 * ln(n) + n * (ln(2 * pi()) + ln(s / n) + 1), 3) AS bic FROM c""")
def _(t):
    found = M.least_squares(t, "o_totalprice", ["o_orderpriority"]).drop("significant")
    found = rounded(rounded(rounded(found, "coefficient", digits=2), "std_error", "rmse", "mae", "aic", "bic", digits=3), "t", "f")
    return rounded(rounded(rounded(rounded(found, "p_value", digits=5), "ci_lower", "ci_upper", digits=1), "r2", "adjusted_r2", digits=8), "f_p_value", digits=6)


@query("uncentred_inflation", "lineitem", """WITH s AS (SELECT sum(l_quantity * l_discount) / sqrt(sum(l_quantity * l_quantity) * sum(l_discount * l_discount)) AS r FROM lineitem)
SELECT unnest(['l_quantity', 'l_discount']) AS term, round(1 / (1 - r * r), 6) AS vif FROM s""")
def _(t):
    return rounded(M.uncentred_inflation(t, ["l_quantity", "l_discount"]), "vif", digits=6)


query("dickey_fuller_auto", "orders", None)(lambda t: rounded(S.dickey_fuller_auto(t, "o_orderdate", "o_totalprice"), "statistic", "p_value"))
query("stl_strengths", "orders", None)(lambda t: rounded(L.strengths(t, "o_orderdate", "o_totalprice"), "trend_strength", "seasonal_strength"))


REACH_1 = "(1.959963984540054 + 2.372271230298562 / (n - 1) + 2.8224986157396112 / ((n - 1) * (n - 1)))"


@query("extended_stats", "orders", f"""WITH m AS (SELECT median(o_totalprice) AS med FROM orders), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS d, min(o_totalprice) AS lo, max(o_totalprice) AS hi, median(abs(o_totalprice - med)) AS mad, skewness(o_totalprice) AS sk, quantile_cont(o_totalprice, 0.05) AS p5, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders, m)
SELECT 'o_totalprice' AS "column", CAST(n AS BIGINT) AS count, round(d * d, 0) AS variance, round(hi - lo, 2) AS range, round(d / a, 6) AS cv, round(mad, 3) AS mad, round(a - {REACH_1} * d / sqrt(n), 2) AS ci_lower, round(a + {REACH_1} * d / sqrt(n), 2) AS ci_upper, round(p5, 3) AS p_5, round(p99, 3) AS p_99, CASE WHEN abs(sk) <= 0.5 THEN 'symmetric' ELSE (CASE WHEN abs(sk) > 1 THEN 'highly ' ELSE '' END) || (CASE WHEN sk > 0 THEN 'right-skewed' ELSE 'left-skewed' END) END AS shape FROM s""")
def _(t):
    found = P.extended_stats(t, ["o_totalprice"]).select("column", "count", "variance", "range", "cv", "mad", "ci_lower", "ci_upper", "p_5", "p_99", "shape")
    return rounded(rounded(rounded(rounded(found, "variance", digits=0), "range", "ci_lower", "ci_upper", digits=2), "mad", "p_5", "p_99", digits=3), "cv", digits=6)


@query("check_outliers_both", "lineitem", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem), l AS (SELECT 'iqr' AS method, 2.5 * a - 1.5 * b AS low, 2.5 * b - 1.5 * a AS high FROM q UNION ALL SELECT 'std', m - 3 * s, m + 3 * s FROM q)
SELECT 'l_extendedprice' AS "column", method, round(low, 3) AS low, round(high, 3) AS high, count(*) FILTER (WHERE l_extendedprice < low OR l_extendedprice > high) AS outliers FROM lineitem, l GROUP BY method, low, high""")
def _(t):
    return rounded(P.check_outliers(t, ["l_extendedprice"], "both"), "low", "high", digits=3)


@query("cross_tabulate_all", "orders", "SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / sum(count(*)) OVER (), 8) AS F, round(count(*) FILTER (WHERE o_orderstatus = 'O') / sum(count(*)) OVER (), 8) AS O, round(count(*) FILTER (WHERE o_orderstatus = 'P') / sum(count(*)) OVER (), 8) AS P FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def _(t):
    return rounded(R.cross_tabulate(t, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "all"), "F", "O", "P", digits=8)


@query("bin_edges", "customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal >= 9000 THEN NULL WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM customer")
def _(t):
    return C.bin_column(t.select("c_custkey", "c_acctbal"), "c_acctbal", "band", [0, 1000, 5000, 9000], ["low", "middle", "high"], right=False).select("c_custkey", "band")


@query("split_column_default", "orders", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority_1, CASE WHEN o_orderpriority LIKE '%-%' THEN split_part(o_orderpriority, '-', 2) END AS o_orderpriority_2 FROM orders")
def _(t):
    return C.split_column(t.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-").drop("o_orderpriority")


@query("correlation_kendall", "supplier", """WITH p AS (SELECT sign(a.s_acctbal - b.s_acctbal) * sign(a.s_nationkey - b.s_nationkey) AS s, a.s_acctbal = b.s_acctbal AS tx, a.s_nationkey = b.s_nationkey AS ty FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey)
SELECT 's_acctbal' AS a, 's_nationkey' AS b, round(sum(s) / sqrt(CAST(count(*) FILTER (WHERE NOT tx) AS DOUBLE)) / sqrt(CAST(count(*) FILTER (WHERE NOT ty) AS DOUBLE)), 9) AS r FROM p""")
def _(t):
    return rounded(P.correlation(t, ["s_acctbal", "s_nationkey"], "kendall"), "r", digits=9)


@query("chart_multi_bar", "orders", "SELECT o_orderpriority, round(avg(o_totalprice), 3) AS o_totalprice, avg(o_custkey) AS o_custkey FROM orders GROUP BY 1")
def _(t):
    return rounded(G.multi_bar(t, ["o_totalprice", "o_custkey"], "o_orderpriority", "mean"), "o_totalprice", digits=3)


@query("chart_multi_line", "orders", "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS o_totalprice, CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders GROUP BY 1")
def _(t):
    return rounded(G.multi_line(t, ["o_totalprice", "o_custkey"], "o_orderdate"), "o_totalprice", digits=2)


@query("chart_pairwise", "events", f"SELECT event_id, user_id, value FROM {NULLED} WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _(t):
    return G.complete_rows(with_nulls(t), ["event_id", "user_id", "value"])


@query("chart_parallel", "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(t):
    return G.complete_rows(t, most=G.PARALLEL)


@query("chart_map_points", "supplier", "SELECT CAST(s_suppkey AS DOUBLE) AS lat, s_acctbal AS lon, CAST(s_nationkey AS DOUBLE) AS value, s_name AS color FROM supplier WHERE s_nationkey <> 3")
def _(t):
    return G.map_points(t.withColumn("lat", F.when(F.col("s_nationkey") == 3, "none").otherwise(F.col("s_suppkey").cast("string"))), "lat", "s_acctbal", "s_nationkey", "s_name")


@query("chart_map_locations", "customer", "SELECT n_name AS location, round(sum(c_acctbal), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "nation")
def _(c, n):
    return rounded(G.map_locations(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_name", "c_acctbal"), "value", digits=2)


query("chart_points_3d", "lineitem", None)(lambda t: G.points_3d(t, "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))


@query("chart_surface", "lineitem", "SELECT l_linenumber AS x, l_discount AS y, round(avg(l_extendedprice), 3) AS z FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(G.surface(t, "l_linenumber", "l_discount", "l_extendedprice"), "z", digits=3)


@query("chart_distributions", "customer", """WITH e AS (SELECT min(c_acctbal) AS a, (max(c_acctbal) - min(c_acctbal)) / 30 AS w FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - a) / w), 29) AS INTEGER) AS bin, a, w FROM customer, e)
SELECT 'c_acctbal' AS "column", bin, round(a + bin * w, 4) AS start, round(a + (bin + 1) * w, 4) AS "end", count(*) AS count FROM b GROUP BY bin, a, w""")
def _(t):
    return rounded(G.distributions(t, ["c_acctbal"]), "start", "end")


@query("chart_boxes", "orders", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders)
SELECT 'o_totalprice' AS "column", round(min(o_totalprice), 4) AS low, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(max(o_totalprice), 4) AS high FROM orders, q WHERE o_totalprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY q25, q50, q75""")
def _(t):
    return rounded(G.boxes(t, ["o_totalprice"]), "low", "q25", "q50", "q75", "high")


@query("profile_columns", "orders", """WITH f AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_orderpriority) AS b FROM orders), m AS (SELECT o_orderpriority AS mode FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT 'o_orderkey' AS "column", 'numeric' AS kind, a AS distinct, round(100.0 * a / n, 1) AS unique_pct, CAST(NULL AS VARCHAR) AS mode, round(70 + 0.3 * round(100.0 * a / n, 1), 4) AS quality FROM f UNION ALL SELECT 'o_orderpriority', 'categorical', b, round(100.0 * b / n, 1), mode, round(70 + 0.3 * round(100.0 * b / n, 1), 4) FROM f, m""")
def _(t):
    return rounded(N.profile_columns(t.select("o_orderkey", "o_orderpriority")).select("column", "kind", "distinct", "unique_pct", "mode", "quality"), "quality")


@query("load_summary", "nation", """SELECT 'n_nationkey' AS "column", count(*) AS rows, count(*) - count(n_nationkey) AS nulls, count(DISTINCT n_nationkey) AS distinct FROM nation UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name), count(DISTINCT n_name) FROM nation""")
def _(t):
    return N.load_summary(t.select("n_nationkey", "n_name")).select("column", "rows", "nulls", "distinct")


DOUBLED = "c_custkey * 2"  # beyond the parts' keys for a third of the customers, whatever the size of the tables

query("unmatched_keys_doubled", "customer", f"SELECT {DOUBLED} AS key FROM customer WHERE {DOUBLED} NOT IN (SELECT p_partkey FROM part)", "part")(
    lambda c, p: R.unmatched_keys(c.select((F.col("c_custkey") * 2).alias("c_custkey")), p, "c_custkey", "p_partkey"))
for how, sql in (("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"merge_{how}_doubled", "part", f"SELECT coalesce(p_partkey, {DOUBLED}) AS p_partkey, p_name, c_name FROM part {sql} customer ON p_partkey = {DOUBLED}", "customer")(
        lambda p, c, h=how: R.merge(p.select("p_partkey", "p_name"), c.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name"), "p_partkey", "c_custkey", h))

TEXTS = [("contains", "ro"), ("icontains", "RO"), ("not_contains", "a"), ("starts_with", "A"), ("ends_with", "E"), ("equals", "MACHINERY"), ("not_equals", "MACHINERY"), ("search", "[AB]U"), ("not_search", "U")]
TEXT_SQL = ["s LIKE '%ro%'", "s ILIKE '%RO%'", "s IS NULL OR s NOT LIKE '%a%'", "s LIKE 'A%'", "s LIKE '%E'", "s = 'MACHINERY'", "s IS DISTINCT FROM 'MACHINERY'", "regexp_matches(s, '[AB]U')", "NOT coalesce(regexp_matches(s, 'U'), FALSE)"]


@query("filter_texts", "customer", "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS s FROM customer) " + " UNION ALL ".join(f"SELECT '{op}' AS op, c_custkey FROM c WHERE {sql}" for (op, _), sql in zip(TEXTS, TEXT_SQL, strict=True)))
def _(t):
    rows = t.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("s"))
    return reduce(lambda a, b: a.union(b), (conditions.filter_rows(rows, [{"column": "s", "op": op, "value": v}]).select(F.lit(op).alias("op"), "c_custkey") for op, v in TEXTS))


SIGNS = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<="}


@query("filter_numbers", "events", f"WITH e AS {NULLED} " + " UNION ALL ".join([*(f"SELECT '{op}' AS op, event_id FROM e WHERE value {sign} 50" for op, sign in SIGNS.items()), "SELECT 'is_null', event_id FROM e WHERE value IS NULL", "SELECT 'not_null', event_id FROM e WHERE value IS NOT NULL", "SELECT 'left', event_id FROM e WHERE value >= 10 AND value < 50"]))
def _(t):
    rows = with_nulls(t)
    specs = [*({"op": op, "value": 50} for op in SIGNS), {"op": "is_null"}, {"op": "not_null"}]
    parts = [conditions.filter_rows(rows, [{"column": "value", **s}]).select(F.lit(s["op"]).alias("op"), "event_id") for s in specs]
    parts.append(conditions.filter_rows(rows, [{"column": "value", "op": "between", "min": 10, "max": 50, "inclusive": "left"}]).select(F.lit("left").alias("op"), "event_id"))
    return reduce(lambda a, b: a.union(b), parts)


@query("filter_open_dates", "orders", "SELECT 'from' AS side, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION ALL SELECT 'to', o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def _(t):
    side = lambda name, **s: conditions.filter_rows(t, [{"column": "o_orderdate", "op": "date_range", **s}]).select(F.lit(name).alias("side"), "o_orderkey")
    return side("from", start="1996-01-01").union(side("to", end="1996-01-01"))


@query("steps_abs_drop_top", "customer", "SELECT c_custkey, abs(c_acctbal) AS size FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def _(t):
    steps = [{"op": "abs_values", "column": "c_acctbal", "name": "size"}, {"op": "filter_top_n", "column": "c_acctbal", "n": 20, "order_by": ["c_custkey"], "keep": "bottom"}, {"op": "sort", "by": ["size"], "ascending": False}, {"op": "drop_column", "columns": ["c_acctbal"]}]
    return pipelines.apply(t.select("c_custkey", "c_acctbal"), steps)


@query("dedup_last", "lineitem", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def _(t):
    return C.drop_duplicates(t.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"], "last")


@query("cumulative_product", "lineitem", "SELECT l_orderkey, l_linenumber, round(exp(sum(ln(1 + l_tax)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM lineitem")
def _(t):
    rows = t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 + F.col("l_tax")).alias("f"))
    return rounded(C.cumulative(rows, "f", "growth", "product", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "growth"), "growth", digits=6)


@query("sample_head", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t):
    return N.sample_rows(t.select("o_orderkey", "o_totalprice"), 50, "head", ["o_orderkey"])


query("sample_random", "orders", None)(lambda t: N.sample_rows(t.select("o_orderkey"), 50))


@query("proportion_z_one", "orders", f"WITH s AS (SELECT count(*) AS n, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS p FROM orders), z AS (SELECT (p - 0.25) / sqrt(0.25 * 0.75 / n) AS z, p FROM s) SELECT round(z, 6) AS statistic, round(p, 6) AS share, round({normal_p('z')}, 6) AS p_value FROM z")
def _(t):
    return rounded(I.proportion_z_one(t, F.col("o_totalprice") > 200000, 0.25), "statistic", "share", "p_value", digits=6)


@query("time_series", "orders", f"WITH {MONTHS} SELECT 'o_totalprice' AS \"column\", count(*) AS periods, round(regr_slope(y, i), 2) AS slope, round(regr_r2(y, i), 6) AS r2, CASE WHEN regr_slope(y, i) > 0 THEN 'up' WHEN regr_slope(y, i) < 0 THEN 'down' ELSE 'flat' END AS direction FROM b")
def _(t):
    return rounded(rounded(L.time_series(t, "o_orderdate", ["o_totalprice"]).select("column", "periods", "slope", "r2", "direction"), "slope", digits=2), "r2", digits=6)


@query("box_cox_exponent", "part", """WITH x AS (SELECT p_retailprice / (SELECT exp(avg(ln(p_retailprice))) FROM part) AS x FROM part), g AS (SELECT i / 100.0::DOUBLE AS k FROM range(-500, 501) r(i)),
l AS (SELECT k, (k - 1) * sum(ln(x)) - count(*) / 2.0 * ln(var_pop(CASE WHEN k = 0 THEN ln(x) ELSE (pow(x, k) - 1) / k END)) AS likely FROM x, g GROUP BY k)
SELECT round(arg_max(k, likely), 2) AS exponent FROM l""")
def _(t):
    return t.limit(1).select(F.round(F.lit(I.box_cox(t, "p_retailprice", "moved")[1]), 2).alias("exponent"))


@query("ks_normal", "supplier", f"""WITH s AS (SELECT (s_acctbal - 4500) / 3000 AS z, row_number() OVER (ORDER BY s_acctbal) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM supplier), u AS (SELECT i, n, CASE WHEN z > 0 THEN 1 - {normal_p("z")} / 2 ELSE {normal_p("z")} / 2 END AS c FROM s)
SELECT round(max(greatest(c - (i - 1) / n, i / n - c)), 6) AS statistic, CAST(any_value(n) AS BIGINT) AS n FROM u""")
def _(t):
    return rounded(K.kolmogorov_smirnov_normal(t, "s_acctbal", 4500, 3000).select("statistic", "n"), "statistic", digits=6)
