"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are turned by one random rotation and split into blocks of a few components. If two vectors lie within a squared
distance, then in some block they lie within that block's share of it. So each block is a range join in few dimensions: a
vector has a home cell in a grid over the block's first components and visits the later cells that its ball touches. Pairs
within a block's share are candidates; a candidate of several blocks belongs to the first of them alone, and its cosine is
taken from the vectors as they are.

Rotated components are whole numbers small enough for all sums of products to be exact in double precision, so every task
finds the same squared distance for a pair, however it gets there.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.buckets import dealt, whole_groups
from tablework.llm.common import discard, stage
from tablework.llm.linking import components

#: Components of a block, and how many of them its grid has.
WIDTH, GRID = 8, 3
#: Pairs whose cosines are taken together.
TOGETHER = 1 << 16


class Blocks:
    """The rotation, blocks and budgets for vectors of n components."""

    def __init__(self, n: int, cosine: float, width: int):
        self.bits = min(20, (50 - n.bit_length()) // 2)  # sums of n products stay below 2^53
        one = 1 << self.bits
        self.starts = list(range(0, n, width))
        self.ends = [*self.starts[1:], n]
        turn, _ = np.linalg.qr(np.random.default_rng(97).standard_normal((n, n)))
        self.turn = np.rint(turn * one)
        # rounding of vectors, rotation and result widens a distance by no more than this
        reach = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 2 * n / one) + 4 * math.sqrt(n) / one
        self.budgets = np.array([math.ceil((reach * one) ** 2 * (b - a) / n) for a, b in zip(self.starts, self.ends, strict=True)], float)
        self.radius = np.ceil(np.sqrt(self.budgets))
        self.side = np.maximum(3 * self.radius, 4)
        self.low = -2.0 * one

    def rotated(self, units: np.ndarray) -> np.ndarray:
        one = 1 << self.bits
        return np.rint(np.rint(units * one) @ self.turn / one)

    def cells(self, w: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells) of home cells, then of those that rows visit, one offset at a time."""
        at = (w[:, self.starts[block] : min(self.starts[block] + GRID, self.ends[block])] - self.low) / self.side[block]
        home = np.floor(at)
        within, reach = at - home, self.radius[block] / self.side[block] + 1e-9
        touches = {-1: within <= reach, 0: np.ones_like(within, bool), 1: within >= 1 - reach}
        pack = np.array([1 << 20 * k for k in range(at.shape[1])], np.int64)
        for offset in product((0, 1, -1), repeat=at.shape[1]):
            if offset < (0,) * len(offset):
                continue  # the other vector visits this one's cell
            rows = np.flatnonzero(np.logical_and.reduce([touches[o][:, k] for k, o in enumerate(offset)]))
            yield rows, (home[rows] + offset).astype(np.int64) @ pack


@functools.lru_cache(16)
def blocks(n: int, cosine: float, width: int) -> Blocks:
    return Blocks(n, cosine, width)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def comparable(embedding: Column, label: Column) -> Column:
    """Whether a vector is compared at all: it and its label are not null, its components are finite and not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _norm(embedding: Column) -> Column:
    top = F.array_max(F.transform(embedding, lambda x: F.abs(x.cast("double"))))
    square = lambda x: (x.cast("double") / top) * (x.cast("double") / top)
    return top * F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + square(x)))


def placed(classes: DataFrame, cosine: float, width: int, vectors: bool) -> DataFrame:
    """(label, size, block, cell, home, id) of each cell a class is at home in or visits, with its vector if asked for."""
    more = ["copies", "norm", "embedding"] if vectors else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                b = blocks(size, cosine, width)
                for part in (some.slice(i, 2048) for i in range(0, some.num_rows, 2048)):
                    w = b.rotated(_matrix(part["embedding"], size) / part["norm"].to_numpy()[:, None])
                    for block in range(len(b.starts)):
                        for k, (rows, cell) in enumerate(b.cells(w, block)):
                            if len(rows):
                                taken = part.take(pa.array(rows))
                                columns = [taken["label"], taken["size"], pa.array(np.full(len(rows), block, np.int32)), pa.array(cell), pa.array(np.full(len(rows), k == 0)), taken["id"]]
                                yield pa.RecordBatch.from_arrays(columns + [taken[c] for c in more], ["label", "size", "block", "cell", "home", "id", *more])

    kinds = dict(classes.dtypes)
    schema = f"label {kinds['label']}, size int, block int, cell long, home boolean, id long" + "".join(f", {c} {kinds[c]}" for c in more)
    return classes.select("label", "size", "id", *(more or ["norm", "embedding"])).mapInArrow(run, schema)


def _joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """root, where each row points to the first of its component, with links (p, q) besides."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


class Compared:
    """What one group of cells' vectors links: for each row the vectors linked with it and the first row it is linked with."""

    def __init__(self, b: Blocks, block: int, units: np.ndarray, w: np.ndarray, copies: np.ndarray, cosine: float):
        self.b, self.block, self.units, self.w, self.copies, self.cosine = b, block, units, w, copies, cosine
        self.own = w[:, b.starts[block] : b.ends[block]]
        self.squares = (self.own * self.own).sum(1)
        self.links, self.root = np.zeros(len(w)), np.arange(len(w))

    def pairs(self, left: np.ndarray, right: np.ndarray, once: bool = False) -> None:
        """Compares rows left with rows right; once: both are the same rows, each pair is taken once."""
        for i in range(0, len(left), 512):
            some = left[i : i + 512]
            near = self.squares[some][:, None] + self.squares[right][None, :] - 2 * (self.own[some] @ self.own[right].T) <= self.b.budgets[self.block]
            if once:
                near &= some[:, None] < right[None, :]
            x, y = np.nonzero(near)
            for k in range(0, len(x), TOGETHER):
                self._verified(some[x[k : k + TOGETHER]], right[y[k : k + TOGETHER]])

    def _verified(self, p: np.ndarray, q: np.ndarray) -> None:
        apart = self.w[p] - self.w[q]
        share = np.add.reduceat(apart * apart, self.b.starts, 1) <= self.b.budgets
        mine = share.argmax(1) == self.block  # the pair belongs to the first block that finds it
        p, q = p[mine], q[mine]
        near = np.einsum("ij,ij->i", self.units[p], self.units[q]) >= self.cosine
        p, q = p[near], q[near]
        self.links += np.bincount(p, self.copies[q], len(self.links)) + np.bincount(q, self.copies[p], len(self.links))
        self.root = _joined(self.root, p, q)


def class_links(classes: DataFrame, cosine: float, width: int) -> DataFrame:
    """(id, links, root): in each group of cells the vectors that a class is linked with, and one class of its component."""
    keys = ["label", "size", "block", "cell"]
    by = [*keys, "first", "second"]
    rows = dealt(placed(classes, cosine, width, True), keys, "id", placed(classes, cosine, width, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, by):
            block, size, ids, first, second, chunk = (table[c].to_numpy() for c in ("block", "size", "id", "first", "second", "chunk"))
            home = table["home"].to_numpy()
            copies, norm = table["copies"].to_numpy().astype(float), table["norm"].to_numpy()
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s < 2:
                    continue
                b = blocks(int(size[s]), cosine, width)
                units = _matrix(table["embedding"].slice(s, e - s), int(size[s])) / norm[s:e, None]
                found = Compared(b, int(block[s]), units, b.rotated(units), copies[s:e], cosine)
                one, two = chunk[s:e] == first[s], chunk[s:e] == second[s]
                at = lambda mask: np.flatnonzero(mask)
                at_home = home[s:e]
                if first[s] == second[s]:
                    found.pairs(at(at_home), at(at_home), once=True)
                    found.pairs(at(at_home), at(~at_home))
                else:
                    found.pairs(at(one & at_home), at(two))
                    found.pairs(at(one & ~at_home), at(two & at_home))
                has = at(found.links > 0)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][has]), pa.array(found.links[has].astype(np.int64)), pa.array(ids[s:e][found.root[has]])], ["id", "links", "root"])

    return rows.select(*by, "chunk", "home", "id", "copies", "norm", "embedding").mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, width: int = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept): near-duplicate groups of vectors (vec_id, embedding, label).

    Vectors are compared only where labels are equal and not null and lengths are equal; those with a cosine of at least that
    given, in double precision, are linked. n_links: other vectors linked directly; component_id: the smallest vec_id reachable
    by links, itself included; kept marks it. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Equal vectors are one class, compared once and counted as often as they occur. Each row is a vector of its
    own, also with a repeated vec_id; a null vec_id counts as larger than any. An empty table gives no rows; other columns are
    not read. A group of n near, unequal vectors costs n * n / 2 comparisons within tasks, of which only counts and one
    link a vector come out.
    """
    ok = comparable(F.col("embedding"), F.col("label"))
    rows = vectors.select("vec_id", F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("embedding")).alias("embedding"))
    classes = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.select("*", F.monotonically_increasing_id().alias("id"), F.size("embedding").alias("size"), _norm(F.col("embedding")).alias("norm")), "classes")
    links = stage(class_links(classes, cosine, width), "class-links")
    joined = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "low", "copies").join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(joined, "id", "left")
    named = stage(named.select("id", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    told = classes.select("id", "label", "embedding").join(named.join(least, "component").select("id", "n_links", "component_id"), "id").drop("id")
    discard(links)
    out = rows.join(told, ["label", "embedding"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
