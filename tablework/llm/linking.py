"""Links between the members of band buckets, and the components they form.

A bucket that holds a large group of near copies is never expanded into all its pairs. Its most central member, the lead
(the one that shares the most bucket places), is compared with the rest; what that links needs no more comparisons, and neither
does a bucket of two. Members of larger buckets that are still apart are compared with each other by how they differ from their
lead, many within one row. No link between parts is lost; a group of n near copies costs about n comparisons and n m more for m
members that its lead is not linked with, of which no rows but links come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import discard, stage

#: Members of an array whose members are compared within one row, about; steps of distance from the lead by which they are put together.
TOGETHER, ZONES = 128, 10


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps, each written to the shared folder; joins are on node ids, which Spark
    splits where one node has a large share of the edges. Null ends and loops are ignored.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, e = e, stage(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        old, mark = mark, _mark(e)
        discard(before)
        if old == mark:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def shared_buckets(members: DataFrame) -> DataFrame:
    """(key, id, places), staged: the members of buckets that hold two or more; places: how many they hold.

    Most buckets hold one member, and most others two, whose ids the least and the greatest are; so only members of the rest
    are looked up.
    """
    ends = members.groupBy("key").agg(F.count(F.lit(1)).alias("places"), F.min("id").alias("low"), F.max("id").alias("high"))
    full = stage(ends.where("low < high"), "full")
    two = full.where("places = 2").select("key", F.explode(F.array("low", "high")).alias("id"), "places")
    found = stage(two.union(members.join(full.where("places > 2").select("key", "places"), "key").select("key", "id", "places")), "buckets")
    discard(full)
    return found


def differences(pairs: DataFrame, sets: DataFrame, set_of: Callable[[Column], Column] = lambda items: items) -> DataFrame:
    """(lead, id, wide, n, more, less) for pairs (lead, id, wide): size of the lead's set, what the other set has besides, what it lacks.

    sets: (id, items); set_of makes an array of the set's values from items. So every set is built once for each lead it is
    compared with, and all later comparisons work on these differences.
    """
    both = pairs.join(sets.select("id", F.col("items").alias("p")), "id").join(sets.select(F.col("id").alias("lead"), F.col("items").alias("c")), "lead")
    both = both.select("lead", "id", "wide", F.inline(F.array(F.struct(set_of(F.col("p")).alias("p"), F.array_distinct(set_of(F.col("c"))).alias("c")))))
    return both.select("lead", "id", "wide", F.size("c").alias("n"), F.array_except("p", "c").alias("more"), F.array_except("c", "p").alias("less"))


def _linked(percent: int) -> str:
    """Whether a row's set and y, both known by their size and their differences from one and the same set, are linked."""
    inter = "(n - size(less) - size(y.less) + size(array_intersect(more, y.more)) + size(array_intersect(less, y.less)))"
    return f"{100 + percent}L * {inter} >= {percent}L * (own + y.own)"


def _links_between(d: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of which some members are linked, for members (lead, members, id, label, n, more, less) of one lead and different labels.

    A lead's members are put into arrays of about TOGETHER and every member meets every array once, so pairs of members are
    compared within a row and only labels come out: there are as many rows as members times arrays. Jaccard distances are a
    metric, so linked members lie at distances from their lead that differ by no more than a link's; members at like
    distances share an array, and arrays that hold no member within reach are passed over. No link is lost.
    """
    away = (F.size("more") + F.size("less")) / F.greatest(F.col("n") + F.size("more"), F.lit(1))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / TOGETHER)).cast("int")
    own = F.col("n") + F.size("more") - F.size("less")
    d = d.select("lead", "id", "label", "n", "more", "less", own.alias("own"), away.alias("away"), F.struct(F.floor(away * ZONES), part).alias("chunk"))
    each = F.collect_list(F.struct("id", "label", "n", "own", "away", "more", "less")).alias("ys")
    bounds = [f(c).alias(f"{name}_{c}") for c in ("label", "away", "own") for f, name in ((F.min, "low"), (F.max, "high"))]
    arrays = d.groupBy("lead", "chunk").agg(each, *bounds).withColumnRenamed("lead", "of").withColumnRenamed("chunk", "other")
    most = (100 - percent) / 100 + 1e-9
    met = "lead = of and chunk <= other and (label <> low_label or label <> high_label)"
    met += f" and away >= low_away - {most} and away <= high_away + {most} and 100L * own >= {percent}L * low_own and 100L * high_own >= {percent}L * own"
    both = d.join(arrays.hint("merge"), F.expr(met))
    near = f"y.label <> label and (chunk < other or id < y.id) and abs(y.away - away) <= {most}"
    near += f" and 100L * least(own, y.own) >= {percent}L * greatest(own, y.own) and {_linked(percent)}"
    found = both.select("label", F.expr(f"array_distinct(transform(filter(ys, y -> {near}), y -> y.label))").alias("others"))
    found = found.where(F.size("others") > 0).select("label", F.explode("others").alias("other"))
    return found.select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def bucket_links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, set_of: Callable[[Column], Column] = lambda items: items, fetched: Callable[[], None] = lambda: None) -> DataFrame:
    """(id, component) of all members that are linked with another.

    members: (key, id), one row a bucket and id. sets_of: takes distinct ids (id) and gives their sets (id, items array<long>),
    or what set_of makes these arrays from; fetched is called when they are no longer needed. Links are pairs of members of one bucket with
    100 * intersection >= percent * union.
    """
    m = shared_buckets(members)
    central = stage(m.groupBy("id").agg(F.sum("places").alias("score")), "central")
    best = F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("best")
    leaders = m.join(central, "id").groupBy("key").agg(best).select("key", F.col("best.id").alias("lead"))
    held = m.join(leaders, "key").where("id <> lead")
    led = stage(held.groupBy("lead", "id").agg(F.max(F.col("places") > 2).alias("wide")), "led")
    # a bucket of two is settled by the comparison with its lead
    larger = stage(held.where("places > 2").select("key", "lead", "id"), "larger")
    sets = stage(sets_of(central.select("id")), "sets")
    fetched()
    apart = differences(led, sets, set_of).withColumn("near", F.expr(f"100L * (n - size(less)) >= {percent}L * (n + size(more))"))
    # differences are of use only to those that meet others than the lead
    apart = stage(apart.select("lead", "id", "n", "wide", "near", *(F.when(F.col("wide"), F.col(c)).alias(c) for c in ("more", "less"))), "apart")
    discard(m, central, led, sets)
    links = stage(apart.where("near").select(F.col("lead").alias("a"), F.col("id").alias("b")), "links")
    found = stage(components(links), "found")
    # a bucket whose members, but for the lead, are all in one component needs no more comparisons
    larger_now = larger.join(found, "id", "left").select("key", "lead", "id", F.coalesce("component", "id").alias("label"))
    mixed = larger_now.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    slim = stage(larger_now.join(mixed, "key").select("lead", "id", "label").distinct(), "slim")
    each = slim.groupBy("lead").agg(F.count(F.lit(1)).alias("members"))
    d = stage(slim.join(each, "lead").join(apart.where("wide").select("lead", "id", "n", "more", "less"), ["lead", "id"]), "apart")
    discard(apart, found, larger, slim)
    between = stage(_links_between(d, percent), "pairs")
    discard(d)
    out = components(links.union(between))
    discard(links, between)
    return out
