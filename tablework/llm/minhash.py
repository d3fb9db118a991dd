"""Near-duplicate documents by min-max hashing.

Of every permutation both the minimum and the maximum are kept: each is an unbiased sample of the set, so half the hash
evaluations give as many signature values. Bands of these values bring candidates together; a link is confirmed on the
full sets of 2-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import byte_texts, long_lists, mix, own_rows, stage, word_hashes
from tablework.llm.linking import bucket_links

#: Signature: BANDS bands of ROWS values; two values come from each permutation.
BANDS, ROWS = 32, 5


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the width-word shingles of each text, A-Z lower-cased and split at ASCII space.

    A text of fewer words gives its whole sequence as one shingle; without words the set is empty.
    """
    flat, counts = word_hashes(texts, lower=True)
    out, at = [], 0
    with np.errstate(over="ignore"):
        total = np.zeros(len(flat), np.uint64)
        for k in range(width):
            most = max(0, len(flat) - k)  # shingles that begin so early that they have a word k
            total[:most] = mix(total[:most] + flat[k:]) + np.uint64(k + 1)
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(total[at : at + n - width + 1]))
            else:
                whole = np.zeros(min(n, 1), np.uint64)
                for h in flat[at : at + n]:
                    whole = mix(whole + h) + np.uint64(0x5851F42D4C957F2D)
                out.append(whole)
            at += n
    return out


def permutations(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray, factors: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One key a band: the minima and maxima under each permutation, dealt out in turn."""
    low, high = np.full(len(factors), 2**64 - 1, np.uint64), np.zeros(len(factors), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            x = shingles[None, i : i + 4096] * factors[:, None]
            np.minimum(low, x.min(1), out=low)
            np.maximum(high, x.max(1), out=high)
        values = np.concatenate([low, high])[: n_bands * rows].reshape(rows, n_bands)
        key = np.arange(1, n_bands + 1, dtype=np.uint64)
        for row in values:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def signatures(docs: DataFrame, width: int = 2, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, size, high, low, bands) of each document: size and 128-bit digest of its shingle set, and its band keys."""
    factors = permutations((n_bands * rows + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = shingle_sets(byte_texts(part["text"]), width)
                digests = np.array([xxhash.xxh128_intdigest(s.tobytes()) >> k & (2**64 - 1) for s in sets for k in (64, 0)], np.uint64).view(np.int64).reshape(-1, 2)
                keys = [bands(s, factors, n_bands, rows) if len(s) else np.zeros(0, np.uint64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), long_lists(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys]))],
                    ["doc_id", "size", "high", "low", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, high long, low long, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, items): the full shingle sets of the documents named in ids (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = shingle_sets(byte_texts(part["text"]), width)
                values = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], long_lists(values, np.array([len(s) for s in found]))], ["id", "items"])

    wanted = docs.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, items array<long>")


@own_rows("doc_id", "component_id")
def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate groups of documents (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable and kept marks that document. Equal sets are one class, compared once. Null or empty texts and texts
    without words have no shingles and are linked with nothing; very long texts are signed in slices of their shingles. Other
    columns are not read; each row is a document of its own, also where doc_ids are repeated or null (of which the first by
    text is kept; nulls are larger than any). An empty table gives no rows.
    """
    seen = stage(signatures(docs, width, n_bands, rows), "signatures")
    full = seen.where("size > 0")
    classes = stage(full.groupBy("size", "high", "low").agg(F.min("doc_id").alias("id")), "classes")
    heads = full.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi")
    members = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    found = bucket_links(members, lambda ids: sets_of(docs, ids, width), percent)
    named = classes.join(found, "id", "left").select("size", "high", "low", F.coalesce("component", "id").alias("component_id"))
    out = seen.select("doc_id", "size", "high", "low").join(named, ["size", "high", "low"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
