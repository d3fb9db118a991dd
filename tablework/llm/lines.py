"""Fuzzy line deduplication across documents, by MinHash over character shingles.

Equal lines are merged first, so each distinct line is signed, banded and verified once, however often it occurs. All of it
is DataFrame expressions.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import by_row, discard, own_rows, stage
from tablework.llm.fingerprints import let
from tablework.llm.linking import bucket_links

#: Characters of a shingle; similarity in percent from which lines are linked.
SHINGLE, PERCENT = 8, 80
#: The signature: MINIMA least values of each of two hashes, under as many orders; ROWS of them make a band. Two lines of 80 %
#: similarity share a band with a chance of 99.7 %, two of 1 % with one of 1 in 9 million, so that of millions of unlike lines few meet.
MINIMA, ROWS = 22, 4
#: Shingles that are signed in one row.
BLOCK = 4


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, key, other): every line (split at \\n) that holds more than white space, from 0.

    key and other: two hashes of its normal form, 128 bits together. Normal form: lower case, runs of white space as one space, none at the ends.
    """
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # this test is cheaper than one on the normal form, which would be worked out twice
    each = each.where(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "")
    # most lines have single spaces alone, and a search for others costs far less than a replacement
    others = reduce(or_, (F.col("line").contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    single = F.when(others, F.regexp_replace("line", r"\s+", " ")).otherwise(F.col("line"))
    each = each.select("doc_id", "line_no", F.trim(F.lower(single)).alias("line"))
    return each.withColumn("key", F.xxhash64("line")).withColumn("other", F.xxhash64(F.lit(1), "line"))


def _masks() -> list[int]:
    draw = random.Random(7)
    return [draw.getrandbits(32) - (1 << 31) for _ in range(MINIMA)]


def _last(points: Column) -> Column:
    """Where the last shingle of a line begins, given its UTF-32 form; a line shorter than a shingle is its own shingle."""
    return F.greatest(F.shiftright(F.length(points), 2) - SHINGLE, F.lit(0))


def _shingle(points: Column, at: Column) -> Column:
    return F.substring(points, 4 * at + 1, F.lit(4 * SHINGLE))


def bands(distinct: DataFrame, *by: str) -> DataFrame:
    """(by, bands): the band keys of distinct lines (by, line), signed over all their shingles.

    A shingle's hash is put in as many orders as there are masks; the least value under each is one of the signature. A row
    has BLOCK shingles in turn (the last one again where a line ends), whose least values are found before rows are grouped.
    Rows of a line lie in one task, so it is its least values that are shuffled, not its text.
    """
    points = distinct.select(*by, F.encode("line", "UTF-32").alias("u"))
    points = points.select(*by, "u", _last(F.col("u")).alias("last"))
    each = points.select(*by, "u", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(BLOCK))).alias("at"))
    each = each.select(*by, *(F.hash(_shingle(F.col("u"), F.least(F.col("at") + i, "last"))).alias(f"h{i}") for i in range(BLOCK)))
    each = each.select("*", *(F.hash(f"h{i}").alias(f"g{i}") for i in range(BLOCK)))
    names = [f"{c}_{k}" for c in "hg" for k in range(MINIMA)]
    least = [F.min(F.least(*(F.col(f"{c}{i}").bitwiseXOR(F.lit(m)) for i in range(BLOCK)))) for c in "hg" for m in _masks()]
    keys = [F.xxhash64(F.lit(k), *names[k : k + ROWS]) for k in range(0, 2 * MINIMA, ROWS)]
    return each.groupBy(*by).agg(*(x.alias(name) for x, name in zip(least, names, strict=True))).select(*by, F.array(*keys).alias("bands"))


def signatures(distinct: DataFrame) -> DataFrame:
    """(key, id) for every band of distinct lines (id, line)."""
    return bands(distinct, "id").select(F.explode("bands").alias("key"), "id")


def _hashes(line: Column) -> Column:
    """The hashes of a line's shingles."""
    # places are counted in bytes, from 1: what is worked out for each shingle counts
    of = lambda u: F.transform(F.sequence(F.lit(1), 4 * _last(u) + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(u, at, F.lit(4 * SHINGLE))))
    return F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), of))


def distinct_lines(each: DataFrame) -> DataFrame:
    """(key, other, line, id): the distinct lines of lines_of(), with numbers of their own.

    Lines are part of what they are grouped by, so they are hashed; a least line as an aggregate would be sorted for.
    """
    return each.select("key", "other", "line").distinct().withColumn("id", F.monotonically_increasing_id())


def line_groups(distinct: DataFrame) -> DataFrame:
    """(id, component): for every distinct line (id, line) that is linked with another, the smallest id reachable.

    Sets are many times as large as lines, so lines are what is staged and joined; sets are built where lines are compared.
    distinct must be staged and is deleted once those lines that share a band are known.
    """
    lines = distinct.select("id", F.col("line").alias("items"))
    signed = stage(bands(distinct, "id"), "bands")
    members = signed.select(F.explode("bands").alias("key"), "id")
    return bucket_links(members, lambda ids: lines.join(ids.hint("merge"), "id", "left_semi"), PERCENT, _hashes, lambda: discard(distinct, signed))


@own_rows("doc_id", "first_doc_id")
def line_duplicates(docs: DataFrame) -> DataFrame:
    """One row a line: doc_id, line_no, group_id, first_doc_id, first_line_no, kept.

    Lines of equal normal form, and lines whose sets of 8-character shingles have a Jaccard similarity of 0.8 or more, are
    linked; of each component the first line by doc_id and line_no is kept; group_id is one number a component and may differ
    from run to run. Each row is a document of its own, also where doc_ids are repeated or null, which come last. Null and empty texts have no lines, and lines
    of white space alone are none; a line shorter than a shingle is its own shingle; an empty table gives no rows; other
    columns aren't read.
    """
    each = lines_of(docs)
    # distinct lines lie there beside the next shuffles, so they decide how much disk is needed at most
    distinct = stage(distinct_lines(each), "lines", "zstd")
    keys = stage(distinct.select("key", "other", "id"), "keys")
    groups = line_groups(distinct)
    # what grows with the corpus is merged with it at every size
    named = keys.join(groups.hint("merge"), "id", "left").select("key", "other", F.coalesce("component", "id").alias("group_id"))
    named = each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "key", "other").join(named.hint("merge"), ["key", "other"])
    named = stage(named.select("doc_id", "line_no", "group_id"), "groups")
    discard(keys)
    heads = named.groupBy("group_id").agg(F.min(F.struct("doc_id", "line_no")).alias("head"))
    out = named.join(heads, "group_id")
    kept = (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.line_no") == F.col("line_no"))
    return out.select("doc_id", "line_no", "group_id", F.col("head.doc_id").alias("first_doc_id"), F.col("head.line_no").alias("first_line_no"), kept.alias("kept"))


@by_row
def drop_duplicate_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that line_duplicates() doesn't keep; documents left without any line go, empty ones stay.

    Rows with null or repeated doc_ids are documents of their own, so of repeated rows the first alone stays. n_chars, where docs has it, is counted anew for changed texts.
    """
    gone = line_duplicates(docs).where("not kept").groupBy("doc_id").agg(F.collect_list(F.col("line_no").cast("int")).alias("gone"))
    rest = lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "gone"), lambda i: F.get(own, i))
    text = let(F.split("text", "\n", -1), lambda own: F.array_join(rest(own), "\n"))
    # columns of docs are packed, so that none of its names can clash
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")).join(gone, "doc_id", "left")
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(text)).where(F.col("gone").isNull() | F.col("text").rlike(r"\S"))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(new.alias("row")).select("row.*")
