"""Alignment of two tokenizers' tokens by a dictionary of distinct groups.

The bytes at which tokens of both end cut a text into groups of A and B tokens. Groups recur far more often than they are
new, so each distinct one is given a number where texts are encoded, its links are worked out once, counts are multiplied by
how often it occurs, and what follows from them is joined back by its key: to bundles of documents, each of which has every
distinct group once, and from there to the documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.bpe import byte_symbols, chunks
from tablework.llm.common import long_lists, stage

#: Characters of a bundle of documents, unless one text is longer.
BUNDLE = 16_000_000
#: Units of text, and distinct groups, that a task remembers before it starts anew.
REMEMBERED = 300_000
#: Longer units are left to the tokenizer itself, as its ranks alone are slow or limited in long runs.
RANKED = 1000
#: White space beside white space, or other than space and line break; and what marks cuts below.
_ODD = re.compile("\\s\\s|[^\\S \n]|\x02")
_CUT = re.compile(r"(?<=\S)(?= )")
#: The high bit marks B's ids where both kinds are joined into one key.
_B = 1 << 31


class _Numbers(dict):
    """Key to number; unseen keys get the next numbers and are listed in new."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.new.append(key)
        return number


class Tokenizers:
    """A (byte-level BPE) and B (pieces with byte fallback), and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_symbols())}
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, special = spec["model"]["vocab"], {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [vocabulary[m] for m in merged]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
        # where ids are in the order of merges they are ranks, by which the same tokens are found faster
        self.ranked = None
        if plain and order == sorted(order) and len(order) + 256 == len(ranks):
            self.ranked = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = self._by_id({i: t for t, i in ranks.items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.bytes_b = self._by_id({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # a cut before a space that follows something else, or around a single line break, is one of A's; it is one of B's if no piece spans it
        self.cuts = plain and not any(re.search("[^▁]▁|\n", p) for p in pieces.values()) and len(self.b.encode("x\n")) == 2

    @staticmethod
    def _by_id(table: dict[int, bytes]) -> list[bytes]:
        return [table.get(i, b"") for i in range(1 + max(table))]

    def encode_a(self, units: list[str]) -> list[np.ndarray]:
        if self.ranked is None:
            return [np.array(x.ids, np.int64) for x in self.whole.encode_batch_fast(units, add_special_tokens=False)]
        slow = [u for u in units if len(u) > RANKED]
        found = iter(self.whole.encode_batch_fast(slow, add_special_tokens=False))
        return [np.array(next(found).ids, np.int64) if len(u) > RANKED else self.ranked.encode_to_numpy(u).astype(np.int64) for u in units]

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """Units as they are within a text: behind a line break, whose tokens are left out, or at its beginning, where B adds the space."""
        if self.cuts:
            return [ids[2:] for ids in self.b.encode(["x\n" + u for u in units], num_threads=1)]
        return self.b.encode([u[1:] for u in units], num_threads=1)

    def units(self, text: str) -> list[str]:
        """Space and text, cut where tokens of A and of B end in any case."""
        text = " " + text
        if not self.cuts:
            return [text]
        if _ODD.search(text):
            return _CUT.split(text)
        return text.replace("\n", "\x02\n\x02").replace(" ", "\x02 ")[1:].removesuffix("\x02").split("\x02")


# Fixed value: the pattern by which byte-level tokenizers of this kind split text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Aligner:
    """Aligns texts within a task. Units seen before are looked up; groups are numbered as they come."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.known, self.groups = _Numbers(), _Numbers()
        self.keys: list[str] = []  # of groups, by number
        self.texts: list[str] = []  # a unit's groups, written out
        self.counts = np.zeros((0, 3), np.int64)  # a unit's tokens of A and B, and whether its bytes are its text's
        self.starts, self.members = np.zeros(1, np.int64), np.zeros(0, np.int64)

    @property
    def full(self) -> bool:
        return len(self.known) > REMEMBERED or len(self.groups) > REMEMBERED

    def _learn(self, units: list[str]) -> None:
        t = self.t
        ids_a, ids_b = t.encode_a(units), [np.array(x, np.int64) for x in t.encode_b(units)]
        ok = np.array([b"".join(map(t.bytes_a.__getitem__, a.tolist())) == (raw := u.encode()) and b"".join(map(t.bytes_b.__getitem__, b.tolist())) == raw for u, a, b in zip(units, ids_a, ids_b, strict=True)], bool)
        n_a, n_b = (np.array([len(x) if good else 0 for x, good in zip(ids, ok, strict=True)], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x for x, good in zip(ids, ok, strict=True) if good)]) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        last_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
        last_b = np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True))
        raw_a, raw_b = a.astype(np.uint32).tobytes(), (b + _B).astype(np.uint32).tobytes()
        to_a, to_b = (4 * (last_a + 1)).tolist(), (4 * (last_b + 1)).tolist()
        numbers = list(map(self.groups.__getitem__, (raw_a[i:j] + raw_b[k:m] for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b))))  # noqa: B905
        for key in self.groups.new:
            both = np.frombuffer(key, np.uint32).astype(np.int64)
            own = [",".join(map(str, part.tolist())) for part in (both[both < _B], both[both >= _B] - _B)]
            self.keys.append("|".join(own))
        self.groups.new = []
        size = np.diff(np.searchsorted(last_a, np.append(0, np.cumsum(n_a))))
        at = np.append(0, np.cumsum(size)).tolist()
        written = list(map(self.keys.__getitem__, numbers))
        self.texts += [";".join(written[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, ok], 1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
        self.members = np.concatenate([self.members, np.array(numbers, np.int64)])

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """For each text: (n_a, n_b, n_groups); and all (text, group) with times, as text << 32 | group; and the digests."""
        split = [self.t.units(x) if x else [] for x in texts]
        n = np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self._learn(new)
        owner = np.repeat(np.arange(len(texts)), n)
        fine = np.bincount(owner, 1 - self.counts[at, 2], len(texts)) == 0
        figures = np.zeros((len(texts), 3), np.int64)
        size = self.starts[at + 1] - self.starts[at]
        for k, x in enumerate((self.counts[at, 0], self.counts[at, 1], size)):
            figures[:, k] = np.where(fine, np.bincount(owner, x, len(texts)), 0)
        ends = np.cumsum(size)
        flat = self.members[np.arange(int(size.sum())) + np.repeat(self.starts[at] - (ends - size), size)]
        of = np.repeat(owner, size)
        keep = fine[of]
        cells, times = np.unique(of[keep] << 32 | flat[keep], return_counts=True)
        bounds = np.append(0, np.cumsum(n)).tolist()
        units = at.tolist()
        digest = lambda i, j: sha256(";".join(map(self.texts.__getitem__, units[i:j])).encode()).hexdigest()
        digests = [digest(i, j) if good and j > i else "" for i, j, good in zip(bounds[:-1], bounds[1:], fine.tolist(), strict=True)]
        return figures, cells, times, digests


_SCHEMA = "bundle long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<long>, times array<long>, keys array<string>"


def aligned(docs: DataFrame, path_a: str, path_b: str, bundle: int = BUNDLE) -> DataFrame:
    """A row a document with its distinct groups, by number, and a row a bundle with its groups' keys and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b))
        name, size = TaskContext.get().partitionId() << 32, 0
        total = np.zeros(0, np.int64)

        def dictionary() -> pa.RecordBatch:
            has = np.flatnonzero(total)
            none = [pa.array([None], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            keys = pa.array([[aligner.keys[i] for i in has.tolist()]], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([name]), *none, long_lists(has, np.array([len(has)])), long_lists(total[has], np.array([len(has)])), keys], names)

        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for part, texts in chunks(batches, 1_000_000):
            figures, cells, times, digests = aligner.align(texts)
            n, groups = len(texts), cells & 0xFFFFFFFF
            total = np.append(total, np.zeros(len(aligner.keys) - len(total), np.int64)) + np.bincount(groups, times, len(aligner.keys)).astype(np.int64)
            sizes = np.bincount(cells >> 32, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, name)), part["doc_id"], *(pa.array(figures[:, k]) for k in range(3)), pa.array(digests, pa.string()), long_lists(groups, sizes), long_lists(times, sizes), pa.nulls(n, pa.list_(pa.string()))], names
            )
            size += sum(map(len, texts))
            if size > bundle or aligner.full:
                yield dictionary()
                name, size, total = name + 1, 0, np.zeros(0, np.int64)
                if aligner.full:
                    aligner.forget()
        if size or len(total):
            yield dictionary()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def _last(key: Column, side: int) -> Column:
    return F.element_at(F.split(F.element_at(F.split(key, r"\|"), side), ","), -1).cast("int")


def group_links(rows: DataFrame) -> DataFrame:
    """(key, a, b, n): every distinct group of the bundles, the tokens of A and B that end together with it, and how often it occurs.

    Within a group no other two tokens end together, as the bytes where they do cut the groups.
    """
    each = rows.where("keys is not null").select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("times").alias("n"))))
    groups = each.groupBy("key").agg(F.sum("n").alias("n"))
    return groups.select("key", _last(F.col("key"), 1).alias("a"), _last(F.col("key"), 2).alias("b"), "n")


def pair_counts(groups: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold the pair of ids, and whether no other pair of b's has more."""
    pairs = groups.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, bundle: int = BUNDLE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document (doc_id, text).

    A encodes space and text, B the text, both without special tokens. Tokens of A and B that end at the same byte are linked;
    a pair of ids counts as many links as hold it in all documents. n_best: links whose pair has the most of all pairs of its B
    id, ties included; count_sum: over links. Null and empty texts, and those whose tokens' bytes aren't space and text, have no
    tokens and figures of 0. Each row is a document of its own, whatever its doc_id; an empty table gives no rows; other
    columns are not read. A text's units are encoded in one piece, so a text needs memory of a few hundred bytes a character.
    """
    rows = stage(aligned(docs, path_a, path_b, bundle), "aligned")
    groups = stage(group_links(rows), "groups")
    told = groups.join(pair_counts(groups), ["a", "b"]).select("key", "count", "best")
    each = rows.where("keys is not null").select(F.col("bundle").alias("of"), F.inline(F.arrays_zip(F.col("groups").alias("number"), F.col("keys").alias("key"))))
    values = each.join(told, "key").select("of", "number", "count", "best")

    def run(documents: pa.Table, values: pa.Table) -> pa.Table:
        number = values["number"].to_numpy()
        count, best = (np.zeros(1 + number.max(initial=-1), np.int64) for _ in range(2))
        count[number], best[number] = values["count"].to_numpy(), values["best"].to_numpy().astype(np.int64)
        groups, times = (documents[c].combine_chunks() for c in ("groups", "times"))
        n = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
        of, group, times = np.repeat(np.arange(len(n)), n), groups.flatten().to_numpy(), times.flatten().to_numpy()
        sums = []
        for x in (best, count):
            total = np.zeros(len(n), np.int64)
            np.add.at(total, of, x[group] * times)
            sums.append(pa.array(total))
        return pa.table([documents["doc_id"], documents["n_a"], documents["n_b"], documents["n_groups"], documents["n_groups"], *sums, documents["groups_sha256"]], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    documents = rows.where("keys is null").drop("keys")
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return documents.groupBy("bundle").cogroup(values.groupBy("of")).applyInArrow(run, schema)
