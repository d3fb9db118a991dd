"""Packing of tokenized documents into sequences of bounded length, by a configuration linear program.

Spark counts pieces by length. That histogram, at most one row a length however many documents there are, is all that the
driver sees. There the configuration program (how many sequences to fill by each pattern of lengths) is solved by
multiplicative weights: lengths that are covered least weigh most, and a knapsack program over the capacity finds the
pattern of the largest weight. Whole multiples of the patterns are kept, and what is left goes by best fit, again by
length and not by piece. Spark then numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.bpe import Vocabulary, encode_map
from tablework.llm.common import ranges, stage

#: Lengths are rounded up to so many parts of the capacity within the linear program.
GRAINS = 256
#: Rounds of multiplicative weights, and how much of the least covered length a round may cover.
ROUNDS, STEP = 3000, 0.02

#: A plan's entry: so many sequences, each with these lengths.
Plan = list[tuple[int, tuple[int, ...]]]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> list[int]:
    """The multiset of items (as indexes) with the largest value within capacity; items may repeat."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes[0])
    for c in range(low, capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))
        total = best[c - sizes[:n]] + values[:n]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], pick[c] = total[k], k
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c >= low:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(pick[c]))
            c -= int(sizes[pick[c]])
    return out


def solve_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[float, tuple[int, ...]]]:
    """A near-optimal fractional solution: (sequences, pattern of indexes into sizes), not covering any size twice over.

    sizes ascend. Each size's weight falls exponentially with the share of its pieces that is covered.
    """
    share = np.zeros(len(sizes))
    found: dict[tuple[int, ...], float] = {}
    base = sizes / capacity / counts
    for _ in range(rounds):
        weight = base * np.exp(-share / step / 4)
        pattern = np.array(_knapsack(sizes, weight * counts.max(), capacity))
        kinds, copies = np.unique(pattern, return_counts=True)
        amount = step * float((counts[kinds] / copies).min())
        share[kinds] += amount * copies / counts[kinds]
        key = tuple(sorted(pattern.tolist(), reverse=True))
        found[key] = found.get(key, 0.0) + amount
        if share.min() >= 1:
            break
    return [(x / max(1.0, float(share[list(p)].max())), p) for p, x in found.items()]


def best_fit(left: dict[int, int], open_bins: Plan, capacity: int) -> Plan:
    """Best fit, longest first, of left (length to pieces) into open_bins and new ones; equal bins are handled together."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, lengths in open_bins:
        room.setdefault(capacity - sum(lengths), []).append((n, lengths))
    for length in sorted(left, reverse=True):
        n = left[length]
        spaces = [r for r in room if r >= length]
        heapq.heapify(spaces)
        while n and spaces:
            r = spaces[0]
            if not room.get(r):
                heapq.heappop(spaces)
                continue
            bins, lengths = room[r].pop()
            each = min(r // length, n)
            used = min(bins, n // each)
            if used < bins:
                room[r].append((bins - used, lengths))
            room.setdefault(r - each * length, []).append((used, lengths + (length,) * each))
            n -= used * each
        each = capacity // length
        for bins, copies in ((n // each, each), (1, n % each)):
            if bins and copies:
                room.setdefault(capacity - copies * length, []).append((bins, (length,) * copies))
    merged: dict[tuple[int, ...], int] = {}
    for rows in room.values():
        for n, lengths in rows:
            merged[lengths] = merged.get(lengths, 0) + n
    return [(n, lengths) for lengths, n in merged.items()]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for all pieces of a histogram (length to pieces): the program's rounded patterns, the rest by best fit."""
    left = {k: v for k, v in histogram.items() if v}
    if not left:
        return []
    grain = max(1, -(-capacity // GRAINS))
    groups: dict[int, list[int]] = {}
    for length in sorted(left):
        groups.setdefault(-(-length // grain), []).append(length)
    sizes = np.array(sorted(groups))
    counts = np.array([sum(left[k] for k in groups[s]) for s in sizes], float)
    bins: Plan = []
    for amount, pattern in sorted(solve_program(sizes, counts, capacity // grain), key=lambda x: -sum(sizes[k] for k in x[1])):
        n = int(amount)
        while n:
            # the longest that is left of each group, for as many sequences as its pieces last
            take: dict[int, int] = {}
            lengths = []
            for k in pattern:
                own = next((x for x in reversed(groups[int(sizes[k])]) if left.get(x, 0) > take.get(x, 0)), None)
                if own is None:
                    break
                take[own] = take.get(own, 0) + 1
                lengths.append(own)
            if len(lengths) < len(pattern):
                break
            many = min(n, *(left[x] // c for x, c in take.items()))
            for x, c in take.items():
                left[x] -= many * c
            bins.append((many, tuple(lengths)))
            n -= many
    return best_fit({k: v for k, v in left.items() if v}, bins, capacity)


def _places(found: Plan) -> tuple[np.ndarray, ...]:
    """For each run of a length's pieces: length, first number, pieces a sequence, first sequence, offset; sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in found:
        offset = 0
        for x in dict.fromkeys(lengths):
            copies = lengths.count(x)
            rows.append((x, taken.get(x, 0), copies, sequence, offset))
            taken[x] = taken.get(x, 0) + n * copies
            offset += x * copies
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """pieces with number: 0, 1, ... within each length. A length with many pieces is numbered in salted parts."""
    parts = max(64, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = p.groupBy("length", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    p = p.withColumn("own", own).join(before.select("length", "part", "before"), ["length", "part"])
    return p.withColumn("number", F.col("before") + F.col("own")).drop("part", "own", "before")


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut where they exceed capacity."""

    def make(v: Vocabulary, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bounds = ranges(counts)
        whole = np.insert(ids, bounds[1:], end_id).astype("<u4")
        sizes = counts + 1
        bounds = ranges(sizes)
        n = -(-sizes // capacity)
        piece = np.arange(int(n.sum())) - np.repeat(ranges(n)[:-1], n)
        start = piece * capacity
        length = np.minimum(capacity, np.repeat(sizes, n) - start)
        first = np.repeat(bounds[:-1], n) + start
        data = memoryview(whole.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(np.repeat(np.arange(len(counts)), n))), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    # a lexicon would need a pass over all texts to count their words, which costs more than merging its words in each worker
    return encode_map(docs, path, make, "doc_id long, piece long, start long, length long, ids_crc32 long", most=0)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents (doc_id, text) are tokenized by the file at path; null and empty texts are end_id alone. Only documents of
    over capacity ids are cut. Repeated rows are packed each; an empty table gives no rows; other columns aren't read.
    """
    pieces = stage(tokenized_pieces(docs, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    length, first, copies, sequence, offset = _places(plan(histogram, capacity))
    key = length << 40 | first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            k = np.searchsorted(key, size << 40 | number, "right") - 1
            within = number - first[k]
            out = [sequence[k] + within // copies[k], offset[k] + within % copies[k] * size]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, out)], [*names, "sequence_id", "offset"])

    rows = numbered(pieces, ["doc_id", "piece", "ids_crc32"])
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
