"""Removal of byte strings that repeat anywhere in the corpus, by way of a sparse suffix sample.

Every string of 200 bytes holds one sample suffix, chosen by content alone (the least-hashed 32-byte string within it), so
equal strings hold equal samples at the same offset. This is not external induced sorting, which is one sequence of steps over
all suffixes; it keeps that a sample is settled first and all else follows from it: only strings around samples that
occur twice are looked at, 32 neighbouring starts at a time, and single starts only where such a block is neither unique
nor repeated as a whole. Of a text with exact copies one stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import byte_texts, discard, mix, own_rows, stage

#: Bytes of a sample suffix's name; neighbouring starts that are looked at together.
NAME, BLOCK = 32, 32
#: Texts are hashed together up to so many bytes.
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15


class Chunk:
    """Prefix hashes of the concatenation of some texts; hashes of its substrings depend on their bytes alone."""

    inverse = pow(_BASE, -1, 2**64)
    powers: list[np.ndarray] = []

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(self.buf)
        if not Chunk.powers or len(Chunk.powers[0]) <= n:
            with np.errstate(over="ignore"):
                Chunk.powers = []
                for base in (_BASE, Chunk.inverse):
                    x = np.full(max(n + 1, 1 << 20), base, np.uint64)
                    x[0] = 1
                    Chunk.powers.append(np.cumprod(x, dtype=np.uint64))
        self.prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * Chunk.powers[0][:n], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * Chunk.powers[1][start])

    def samples(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """place, first, last, doc: each sample suffix and the first and last start of those strings that hold it."""
        n, w = len(self.buf), length - NAME + 1
        empty = (np.zeros(0, np.int64),) * 4
        if n < length:
            return empty
        with np.errstate(over="ignore"):
            h = (self.prefix[NAME:] - self.prefix[:-NAME]) * Chunk.powers[1][: n - NAME + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        # the place decides between equal hashes; it has as many low bits as a chunk, or one longer text, needs
        bits = np.uint64(max(22, int(n).bit_length()))
        v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        pad = -len(v) % w
        blocks = np.concatenate([v, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, 1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        low = np.minimum(right[: n - length + 1], left[w - 1 : n - NAME + 1])
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[: len(place)]
        whole = np.arange(len(place)) + length <= self.bounds[doc + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return empty
        p = place[at]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[at][1:] != doc[at][:-1])]))
        return p[new], at[new], at[np.append(new[1:], len(at)) - 1], doc[at[new]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts, at = byte_texts(batch["text"]), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size, to = size + len(texts[to]), to + 1
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def _digest(text: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(text)
    return (value >> 64) - (1 << 63), (value & (2**64 - 1)) - (1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, high, low, n_bytes, whole_sha256) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            digests = [_digest(t) for t in texts]
            cols = [part["doc_id"], pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "high", "low", "n_bytes", "whole_sha256"])

    return docs.mapInArrow(run, "doc_id long, high long, low long, n_bytes long, whole_sha256 string")


def _samples(docs: DataFrame, length: int) -> DataFrame:
    """(name, at, doc_id, place): all sample suffixes; at: the same for equal places of equal texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            c = Chunk(texts)
            place, _, _, doc = c.samples(length)
            own = np.array([_digest(t)[1] for t in texts], np.int64).view(np.uint64)
            within = place - c.bounds[doc]
            at = mix(own[doc] ^ mix(within.astype(np.uint64)))
            ids = part["doc_id"].take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(c.hashes(place, place + NAME).view(np.int64)), pa.array(at.view(np.int64)), ids, pa.array(within)], ["name", "at", "doc_id", "place"])

    return docs.mapInArrow(run, "name long, at long, doc_id long, place long")


def _blocks(marked: DataFrame, length: int) -> DataFrame:
    """(doc_id, first, last, hull, core, at) for marked (doc_id, text, places): blocks of starts around the samples at places.

    hull: the hash of all bytes that strings of the block may have, core: of those they all have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            c = Chunk(texts)
            place, first, last, doc = c.samples(length)
            wanted = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) + c.bounds[k] for k, x in enumerate(part["places"].to_pylist()))])
            some = np.isin(place, wanted)
            place, first, last, doc = place[some], first[some], last[some], doc[some]
            low = (place - last) // BLOCK
            n = (place - first) // BLOCK - low + 1
            k = np.repeat(np.arange(len(place)), n)
            j = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            near, far = j * BLOCK, np.minimum(j * BLOCK + BLOCK - 1, length - NAME)
            p, doc = place[k], doc[k]
            start, end = c.bounds[doc], c.bounds[doc + 1]
            ids = part["doc_id"].to_numpy()
            with np.errstate(over="ignore"):
                at = mix(mix(ids.view(np.uint64))[doc] + (p - start).astype(np.uint64) * np.uint64(8) + j.astype(np.uint64))
                salt = mix(j.astype(np.uint64) + np.uint64(11))
            inside = (p - far >= start) & (p - near + length <= end)
            hull = np.where(inside, c.hashes(np.maximum(p - far, start), np.minimum(p - near + length, end)) ^ salt, at)
            core = c.hashes(p - near, p - far + length) ^ salt
            f, t = np.maximum(first[k], p - far) - start, np.minimum(last[k], p - near) - start
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(f), pa.array(t), *(pa.array(x.view(np.int64)) for x in (hull, core, at))], ["doc_id", "first", "last", "hull", "core", "at"])

    return marked.mapInArrow(run, "doc_id long, first long, last long, hull long, core long, at long")


def _strings(marked: DataFrame, length: int) -> DataFrame:
    """(string, at, doc_id, first) for marked (doc_id, text, starts): every string that starts in one of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _chunks(batches):
            c = Chunk(texts)
            ids = part["doc_id"].to_numpy()
            for k, own in enumerate(part["starts"].to_pylist()):
                s = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in own])) + c.bounds[k]
                with np.errstate(over="ignore"):
                    at = mix(mix(ids[k : k + 1].view(np.uint64)) + s.astype(np.uint64) - np.uint64(c.bounds[k]))
                yield pa.RecordBatch.from_arrays([pa.array(c.hashes(s, s + length).view(np.int64)), pa.array(at.view(np.int64)), pa.array(np.full(len(s), ids[k])), pa.array(s - c.bounds[k])], ["string", "at", "doc_id", "first"])

    return marked.mapInArrow(run, "string long, at long, doc_id long, first long")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, leader): keys that occur at two places or more, and one of the places; counted within tasks first."""
    ends = rows.groupBy(key).agg(F.min("at").alias("leader"), F.max("at").alias("other"))
    return ends.where("leader <> other").select(key, "leader")


def repeated_spans(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(doc_id, spans): for the first document of each text, ranges (first, last) of starts of repeated strings.

    docs: (doc_id, text); classes: (id) of those documents.
    """
    samples = stage(_samples(docs, length), "samples")
    places = samples.join(_repeated(samples, "name"), "name").select("doc_id", "place").join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    blocks = stage(_blocks(docs.join(places, "doc_id"), length), "blocks")
    discard(samples)
    hulls = stage(_repeated(blocks, "hull"), "hulls")
    cores = _repeated(blocks, "core").select("core", F.lit(True).alias("again"))
    # a block neither of whose hashes repeats holds no repeated string
    known = blocks.join(hulls, "hull", "left").join(cores, "core", "left").where("leader is not null or again")
    known = stage(known.select("doc_id", "first", "last", "core", "at", "leader", "again"), "blocks")
    discard(blocks, hulls)
    whole = known.where("leader is not null").select("doc_id", "first", "last")
    unsure = known.where("leader is null and again")
    # what an unsure block may share with blocks that repeat as a whole: one block of each such hull
    peers = known.where("at = leader").join(unsure.select("core").distinct(), "core", "left_semi")
    starts = unsure.unionByName(peers).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    strings = stage(_strings(docs.join(starts, "doc_id"), length), "strings")
    single = strings.join(_repeated(strings, "string"), "string").select("doc_id", "first", F.col("first").alias("last"))
    spans = stage(whole.union(single).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    discard(known, strings)
    return spans


@own_rows("doc_id")
def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (null: none).

    Every byte that a string of length bytes covers which also starts anywhere else in the texts, the same one included,
    is removed; spans are the removed runs (start, end). Null texts are empty; texts shorter than length are left whole;
    exact copies of longer ones are removed whole; each row is a document of its own, whatever its doc_id; an empty table gives no rows; other columns
    aren't read. Strings are told apart by 64-bit hashes, of which no two among 10^8 agree but with odds of 1 to 3000.
    """
    docs = docs.select("doc_id", "text")
    seen = stage(_texts(docs), "texts")
    classes = stage(seen.where(F.col("n_bytes") >= length).groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    spans = repeated_spans(docs, classes, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(byte_texts(batch["text"]), batch["spans"].to_pylist(), strict=True):
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, [r["first"] for r in own], 1)
                np.add.at(edge, [r["last"] + length for r in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                at = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), len(at) // 2, sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True)]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_removed", "n_spans", "kept_sha256", "spans"])

    single = classes.where("copies = 1").select(F.col("id").alias("doc_id"))
    parts = docs.join(spans.join(single, "doc_id", "left_semi"), "doc_id").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    copied = classes.where("copies > 1").select("high", "low", F.lit(True).alias("copied"))
    out = seen.join(copied, ["high", "low"], "left").join(parts, "doc_id", "left")
    pick = lambda whole, part, none: F.when(F.col("copied"), whole).otherwise(F.coalesce(part, none))
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("whole_sha256")).alias("kept_sha256"),
        pick(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))), F.col("spans"), F.lit(None)).alias("spans"),
    )
