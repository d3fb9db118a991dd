"""Language identification with one Bloom filter of bit-sliced n-grams for all languages.

Every slot of the filter holds a bitmask of languages. The slots that an n-gram hashes to, combined by AND, give all
languages that contain it at once. A text's n-grams are counted per language, the counts are corrected for the filter's
false positives in each language, and the largest decides. All learned n-grams are set; a second bit a language tells where
an n-gram is typical of it, and where it isn't, it weighs less.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import discard, mix, shared_dir, stage

#: n-gram length; hashes an n-gram; rate of false positives a language at most, from which slots follow.
N, HASHES, WRONG = 4, 3, 0.01
#: An n-gram whose rate in a language is below this share of its highest rate in any language counts this share there, others 1.
SHARE = 0.25
#: Bytes of the filter that one task fills, and that the driver holds at a time.
SEGMENT = 1 << 20
UNKNOWN = "und"
CHUNK = 2_000_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points of the basic plane: whether they are letters, and their lower case where that is one code point."""
    chars = [chr(i) for i in range(0x10000)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return letter, lower


_LETTER, _LOWER = _tables()


def ngrams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the text each belongs to, and letters a text.

    Letters count in lower case; any run of other characters counts as one space.
    """
    joined = " " + "  ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    basic = np.minimum(codes, 0xFFFF)
    letter = np.where(codes < 0x10000, _LETTER[basic], True)
    lower = np.where(letter, np.where(codes < 0x10000, _LOWER[basic], codes), 32)
    if len(high := np.flatnonzero(codes >= 0x10000)):
        seen, which = np.unique(codes[high], return_inverse=True)
        chars = [chr(c) for c in seen.tolist()]
        letter[high] = np.array([c.isalpha() for c in chars])[which]
        lower[high] = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in chars], np.uint32)[which]
    codes = lower
    letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter
    keep[0] = True
    edge = np.flatnonzero(np.diff(doc)) + 1
    keep[edge] = True
    codes, doc = codes[keep].astype(np.uint64), doc[keep]
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    total = np.zeros(len(codes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(total)]
    same = doc[: len(total)] == doc[n - 1 :]
    return mix(total[same]), doc[: len(total)][same], letters


def _slots(hashes: np.ndarray, slots: int, count: int) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for k in range(count):
            out.append(((hashes * np.uint64(2 * k + 1) ^ (hashes >> np.uint64(17 + 7 * k))) & np.uint64(slots - 1)).astype(np.int64))
    return out


def slots_for(n: int, hashes: int = HASHES, wrong: float = WRONG) -> int:
    """Slots, a power of two, at which n n-grams in one language give at most this rate of false positives."""
    need = n * hashes / -np.log1p(-(wrong ** (1 / hashes)))
    return 1 << max(10, int(np.ceil(np.log2(max(1, need)))))


def planes_of(languages: list[str]) -> int:
    """Bytes of a slot."""
    return max(1, -(-2 * len(languages) // 8))


class LanguageFilter:
    """languages: names, two bits each, that an n-gram occurs and that it is typical; wrong: each bit's rate of false positives.

    masks, (slots, planes) bytes, lie in a file that Spark gives to every executor; whoever asks for them maps it into memory.
    """

    def __init__(self, languages: list[str], slots: int, ones: np.ndarray, file: str | None, hashes: int = HASHES):
        self.languages, self.slots, self.hashes, self.file = languages, slots, hashes, file
        self.planes = planes_of(languages)
        self.wrong = (ones / slots) ** hashes
        self._masks: np.ndarray | None = None

    @property
    def masks(self) -> np.ndarray:
        if self._masks is None:
            self._masks = np.memmap(SparkFiles.get(self.file), np.uint8, "r", shape=(self.slots, self.planes))
        return self._masks

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_masks": None}

    def counts(self, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """(texts, languages): n-grams of each text that the language holds, less the expected false positives, weighed."""
        found = None
        for slot in _slots(hashes, self.slots, self.hashes):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        total = np.bincount(doc, minlength=n_docs).astype(float)
        out = np.zeros((n_docs, len(self.languages)))
        for k, wrong in enumerate(self.wrong):
            hits = np.bincount(doc, weights=found[:, k // 8] >> (k % 8) & 1, minlength=n_docs)
            out[:, k // 2] += (1 - SHARE if k % 2 else SHARE) * np.maximum(0, (hits - total * wrong) / max(1e-9, 1 - wrong))
        return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts, at = [t or "" for t in batch["text"].to_pylist()], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size, to = size + len(texts[to]), to + 1
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def fit(labelled: DataFrame, n: int = N) -> LanguageFilter:
    """A filter of all n-grams of (text, lang), over all its rows; rows without a language or text teach nothing.

    n-grams are counted within tasks, then by Spark. The filter is filled a range of slots at a time, each by one task, and
    put together in a file in the shared folder; the driver holds one range at a time and never an n-gram. The file's size is
    in proportion to the number of n-grams.
    """
    spark = labelled.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            names, lang = np.unique(np.array(part["lang"].to_pylist(), object).astype(str), return_inverse=True)
            hashes, doc, _ = ngrams(texts, n)
            for k, name in enumerate(names):
                keys, counts = np.unique(hashes[lang[doc] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "ngram", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, ngram long, n long")
    counts = rows.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    # an n-gram has one row a language at most; totals has one row a language
    by_gram = stage(counts.groupBy("ngram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("ns")), "ngrams")
    totals = {r["lang"]: r["t"] for r in by_gram.select(F.explode("ns").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    languages = sorted(totals)
    slots, planes = slots_for(by_gram.count()), planes_of(languages)
    if not languages:
        discard(by_gram)
        return LanguageFilter([], slots, np.zeros(0), None)
    total = F.create_map(*(F.lit(x) for name in languages for x in (name, float(totals[name]))))
    number = F.create_map(*(F.lit(x) for k, name in enumerate(languages) for x in (name, 2 * k)))
    rates = by_gram.select("ngram", F.transform_values("ns", lambda k, v: v / F.element_at(total, k)).alias("rates"))
    rates = rates.withColumn("top", F.array_max(F.map_values("rates")))
    typical = lambda e: F.when(e["value"] >= SHARE * F.col("top"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    bits = F.flatten(F.transform(F.map_entries("rates"), lambda e: F.transform(typical(e), lambda x: F.element_at(number, e["key"]) + x)))
    size = min(slots, 1 << max(0, (SEGMENT // planes).bit_length() - 1))  # slots of a range

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, k = batch["bits"], batch.num_rows
            masks = np.zeros((k, planes), np.uint8)
            bit = own.flatten().to_numpy()
            np.bitwise_or.at(masks, (np.repeat(np.arange(k), own.value_lengths().to_numpy()), bit // 8), (1 << bit % 8).astype(np.uint8))
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(planes), k, [None, pa.py_buffer(masks.tobytes())]).cast(pa.binary())
            for slot in _slots(batch["ngram"].to_numpy().view(np.uint64), slots, HASHES):
                yield pa.RecordBatch.from_arrays([pa.array(slot // size), pa.array(slot % size), column], ["part", "slot", "mask"])

    def filled(table: pa.Table) -> pa.Table:
        masks = np.zeros((size, planes), np.uint8)
        for chunk in table.to_batches():
            np.bitwise_or.at(masks, chunk["slot"].to_numpy(), np.frombuffer(b"".join(chunk["mask"].to_pylist()), np.uint8).reshape(-1, planes))
        ones = np.unpackbits(masks, 1, bitorder="little").sum(0, dtype=np.int64)[: 2 * len(languages)]
        return pa.table({"part": table["part"].slice(0, 1), "masks": pa.array([masks.tobytes()], pa.binary()), "ones": pa.array([ones.tolist()], pa.list_(pa.int64()))})

    each = rates.select("ngram", bits.alias("bits")).mapInArrow(spread, "part long, slot long, mask binary")
    parts = stage(each.groupBy("part").applyInArrow(filled, "part long, masks binary, ones array<long>"), "filter")
    discard(by_gram)
    name, ones = f"languages-{uuid.uuid4().hex}.bin", np.zeros(2 * len(languages), np.int64)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, done = fs.create(path, True), 0
    for r in parts.orderBy("part").toLocalIterator():
        for _ in range(r["part"] - done):  # ranges that no n-gram falls into
            out.write(bytearray(size * planes))
        out.write(r["masks"])
        ones, done = ones + np.array(r["ones"]), r["part"] + 1
    for _ in range(slots // size - done):
        out.write(bytearray(size * planes))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    discard(parts)
    return LanguageFilter(languages, slots, ones, name)


def predict(docs: DataFrame, model: LanguageFilter, n: int = N) -> DataFrame:
    """(doc_id, lang_pred, score) of each document (doc_id, text).

    score: the language's share of the two largest corrected counts, from 0.5 (a tie, which goes to the first name) to 1;
    0 where no language has any of the n-grams. Null texts and texts without a letter are "und" with score 0. Texts are read
    whole; repeated rows are predicted each; an empty table gives no rows; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and rates; the filter itself is a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, texts in _parts(batches):
            hashes, doc, letters = ngrams(texts, n)
            counts = m.counts(hashes, doc, len(texts)) if m.languages else np.zeros((len(texts), 1))
            best = counts.argmax(1)
            top = np.sort(np.column_stack([counts, np.zeros(len(texts))]), 1)[:, -2:]
            score = np.where(top[:, 1] > 0, top[:, 1] / np.maximum(top.sum(1), 1e-9), 0.0)
            unknown = (letters == 0) | (not m.languages)
            names = np.where(unknown, UNKNOWN, np.array(m.languages or [UNKNOWN], object)[best])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names.tolist(), pa.string()), pa.array(np.where(unknown, 0.0, score))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
