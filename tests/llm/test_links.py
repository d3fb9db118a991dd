"""Line bands and links at what made op1 fail: chance meetings of unlike lines, and large groups that no lead settles."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from tablework.llm import lines, linking


def test_unlike_lines_seldom_share_a_band(spark):
    """Pairs with a tenth in common: with bands of three values about 0.8 % of them met, and such pairs grow with the square of the corpus."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    shared = text(50)
    rows = [(i, shared + text(200)) for i in range(1500)]
    held = collections.defaultdict(set)
    for x in lines.signatures(spark.createDataFrame(rows, "id long, line string")).collect():
        held[x["key"]].add(x["id"])
    met = {p for ids in held.values() for p in itertools.combinations(sorted(ids), 2)}
    assert len(met) < 0.003 * 1500 * 1499 / 2


def test_arrays_of_members_lose_no_link(spark, monkeypatch):
    """Every pair is compared, though it lies in other arrays, and no join has a row a pair."""
    monkeypatch.setattr(linking, "TOGETHER", 16)
    r = random.Random(4)
    base = [r.getrandbits(60) for _ in range(100)]
    edits = [[r.getrandbits(60) for _ in range(9)] for _ in range(14)]
    sets = {}
    for i in range(200):
        s = list(base)
        for k in r.sample(range(14), r.randint(2, 7)):
            s[7 * k : 7 * k + 7] = edits[k][:7]
        sets[i] = set(s)
    full = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parent = {i: i for i in sets}
    for _ in range(200):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert len(set(parent.values())) > 5 and len({a for a, _ in links}) > 50
    got = dict(linking.bucket_links(full.select(F.lit(1).alias("key"), "id"), lambda ids: full.join(ids, "id", "left_semi"), 80).collect())
    assert {i: got.get(i, i) for i in sets} == parent


def test_distinct_lines_are_staged_compressed(spark, monkeypatch):
    """They lie in the shared folder beside the shuffles that come next, and so decide how much disk line dedup needs."""
    files, stage = {}, lines.stage

    def staged(df, name, *more):
        out = stage(df, name, *more)
        files[name] = out.inputFiles()
        return out

    monkeypatch.setattr(lines, "stage", staged)
    table = spark.createDataFrame([(1, "a line of some length here\nand another of them"), (2, "a line of some length here")], "doc_id long, text string")
    assert sorted(x["kept"] for x in lines.line_duplicates(table).collect()) == [False, True, True]
    assert files["lines"] and all(x.endswith(".zstd.parquet") for x in files["lines"])


def test_distinct_lines_are_hashed_and_not_sorted(spark):
    """A least line as an aggregate was sorted for, twice, and lines were shuffled beside their bands."""
    table = spark.createDataFrame([(1, "one line\nTWO  lines\none line"), (2, "two lines")], "doc_id long, text string")
    distinct = lines.distinct_lines(lines.lines_of(table))
    assert sorted(x["line"] for x in distinct.collect()) == ["one line", "two lines"]
    plan = distinct._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "bands" not in distinct.columns
