"""Order MinHash fingerprints, sensitive to the order of a text as well as to its content.

A text's tokens are its runs of up to 16 characters other than white space; a longer run, as scripts without spaces have, is
taken letter by letter, so that what follows an insertion keeps its tokens. Under each permutation the two smallest
k-mers of tokens, told apart by how often they occurred before, are put back into text order and hashed as a tuple. The
permutations are rotations of one random order, so each needs a bisection of the sorted values instead of a pass over them.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import own_rows

#: Tokens in a k-mer; permutations.
WIDTH, PERMUTATIONS = 2, 32
#: A token: a short word, or one character of a longer run.
TOKEN = r"(?<!\S)\S{1,16}(?!\S)|\S"
#: A k-mer's value holds its place in its low bits, as many as an array's length can need, and its hash in those above.
PLACE_BITS = 31


def let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def smaller(s: Column, bound: Column) -> Column:
    """How many values of s, which is sorted, are smaller than bound; by bisection."""
    step = lambda lo, b: F.when((lo + b <= F.size(s)) & (F.get(s, lo + b - 1) < bound), lo + b).otherwise(lo)
    halves = F.filter(F.array(*(F.lit(1 << b) for b in range(PLACE_BITS - 2, -1, -1))), lambda b: b <= F.size(s))
    return F.aggregate(halves, F.lit(0), step)


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _base(x: Column) -> Column:
    """x without its place."""
    return F.shiftleft(_high(x), PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _numbered(s: Column) -> Column:
    """From sorted values (hash, place): repeats of a hash get a new one that depends on their number."""

    def one(x: Column, i: Column) -> Column:
        again = (i > 0) & (_high(F.get(s, i - 1)) == _high(x))
        new = _base(F.xxhash64(_high(x), i - smaller(s, _base(x)))).bitwiseOR(_place(x))
        return F.when(again, new).otherwise(x)

    return F.transform(s, one)


def _tuple(u: Column, mask: int) -> Column:
    """The hash of the two values that come first from mask on, cyclically, in text order."""
    pair = lambda f, g: F.when((F.size(u) < 2) | (_place(f) < _place(g)), F.hash(_high(f), F.when(F.size(u) > 1, _high(g)))).otherwise(F.hash(_high(g), _high(f)))
    at = lambda k: F.get(u, F.pmod(k, F.size(u)))
    return let(smaller(u, F.lit(mask)), lambda k: let(at(k), lambda f: let(at(k + 1), lambda g: pair(f, g))))


def fingerprint(text: Column, width: int = WIDTH, permutations: int = PERMUTATIONS) -> Column:
    """array<int> of one tuple hash a permutation; empty if the text is null or has no token."""
    draw = random.Random(7)
    masks = [draw.getrandbits(64 - PLACE_BITS) << PLACE_BITS for _ in range(permutations)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    mer = lambda h: lambda x, i: _base(F.xxhash64(x, *(F.get(h, i + k) for k in range(1, width)))).bitwiseOR(i.cast("long"))
    values = let(tokens, lambda h: F.sort_array(F.transform(h, mer(h))))
    numbered = let(values, lambda s: F.sort_array(_numbered(s)))
    return let(numbered, lambda u: F.when(F.size(u) > 0, F.array(*(_tuple(u, m) for m in masks))).otherwise(F.array().cast("array<int>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples; two empty fingerprints are alike, an empty one and another not."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame, columns: list[str], rows_a_part: int = 4096) -> DataFrame:
    """docs (doc_id, columns) with next_<column>: those of the row with the next larger doc_id; the last row's are the first's.

    doc_ids are cut into ranges of about rows_a_part rows at percentiles. Each range also gets the first row of the one
    after it, so every range is complete by itself and rows move once. doc_ids must be distinct and not null.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = max(1, min(10_000, n // rows_a_part))  # the bounds come to the driver: a few numbers a part, at most 10,000 parts
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(parts)], 0.2 / parts)}) if n else []
    part = F.lit(0)
    if len(bounds) > 1:
        inner = F.array(*(F.lit(b) for b in bounds[1:]))
        halves = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length(), -1, -1)))
        step = lambda lo, b: F.when((lo + b <= len(bounds) - 1) & (F.get(inner, lo + b - 1) <= F.col("doc_id")), lo + b).otherwise(lo)
        part = F.aggregate(halves, F.lit(0), step)
    own = docs.select("doc_id", *columns, part.alias("part"))
    first = own.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect() if n else []
    starts = sorted((r["part"], r["doc_id"]) for r in first)
    before = {b[1]: a[0] for a, b in zip(starts, starts[1:] + starts[:1], strict=True)}
    if before:
        at = F.create_map(*(F.lit(x) for k, v in before.items() for x in (k, v)))
        edge = own.where(F.col("doc_id").isin(list(before))).withColumn("part", F.element_at(at, F.col("doc_id"))).dropDuplicates(["doc_id"])
        own = own.withColumn("edge", F.lit(0)).unionByName(edge.withColumn("edge", F.lit(1)))
    else:
        own = own.withColumn("edge", F.lit(0))
    by = Window.partitionBy("part").orderBy("edge", "doc_id")
    return own.select("doc_id", *columns, "edge", *(F.lead(c).over(by).alias(f"next_{c}") for c in columns)).where("edge = 0").drop("edge")


def fingerprints(docs: DataFrame, width: int = WIDTH, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, fingerprint array<int>) of each document (doc_id, text)."""
    return docs.select("doc_id", fingerprint(F.col("text"), width, permutations).alias("fingerprint"))


@own_rows("doc_id")
def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document (ascending doc_id, then the first).

    Edited: the last quarter of the code points, rounded down, gives way to as many (or all) first ones of the next text.
    Null texts are empty; a single document is its own next; each row is a document of its own, those of equal doc_id in the
    order of their texts and nulls last; an empty table gives no rows; other columns aren't read. A text is one value of a
    task, which holds a few dozen bytes a token.
    """
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    both = with_next(marked, ["text", "fp"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    made = both.select("doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(edited)).alias("edited"), "fp", "next_fp")
    made = made.select("*", F.explode(F.array(fingerprint(F.col("edited")))).alias("efp"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
