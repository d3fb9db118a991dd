"""Byte-pair encoding with a minimal acyclic transducer as lexicon, and decoding.

The corpus's frequent words are compiled into an acyclic automaton whose equal endings are shared. Every arc carries the
number of words that sort before it among its state's, so the sum along a path is a word's number, and that number names its
slice of token ids. The automaton is one flat file that Spark ships to the executors, whose tasks map it into memory. Words
that it lacks are merged exactly, many at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.common import ranges, shared_dir

#: Words in the lexicon: the bound of what is compiled on the driver and shipped.
LEXICON_WORDS = 50_000
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 600_000
#: Documents are encoded together up to so many characters.
CHUNK = 4_000_000
#: The rank of pairs that don't merge.
FAR = 1 << 30
#: White space as the tokenizer's \s has it, for use within brackets.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's vocabulary, merges and pre-tokenizing pattern. It is small and fixed, and never trained here."""

    tokens: list[str]
    ids: dict[str, int]
    merges: np.ndarray  # (left id, right id, merged id), best first
    suffix: str
    pattern: str
    added: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in [*ids.items(), *added.items()]:
            tokens[i] = token
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        return Vocabulary(tokens, ids, merges, model["end_of_word_suffix"] or "", pattern, added)

    @cached_property
    def merge_table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing: slot of (left << 20 | right) to rank; -1 where empty."""
        bits = 18
        keys, ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo = np.arange(len(self.merges))
        key = self.merges[:, 0] << 20 | self.merges[:, 1]
        slot = _slot(key, bits)
        while len(todo):
            free = keys[slot[todo]] < 0
            place, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            keys[place], ranks[place] = key[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        return keys, ranks, bits

    @cached_property
    def numbers(self) -> list[str]:
        return [str(i) for i in range(len(self.tokens))]

    @cached_property
    def byte_ids(self) -> np.ndarray:
        """Ids of each byte within a word, and as its last."""
        return np.array([[self.ids[c], self.ids[c + self.suffix]] for c in byte_symbols()], np.int64)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def merge_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of each word by the merge rules alone: the best-ranked adjacent pair merges, leftmost first, until none is left."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    sizes = np.array([len(w) for w in words])
    for low, high in ((0, 4), (4, 7), (7, 10), (10, 14), (14, 20), (20, 32), (32, 64), (64, 1 << 60)):
        for block in np.array_split(some := np.flatnonzero((sizes > low) & (sizes <= high)), max(1, len(some) // 20_000)):
            if high > 64:
                for i in block:
                    out[i] = _merge_long(words[i], v)
            elif len(block):
                for i, ids in zip(block, _merge_block([words[i] for i in block], v), strict=True):
                    out[i] = ids
    return out


def _rank(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Rank of each pair, or a number beyond all ranks."""
    keys, ranks, bits = v.merge_table
    key = left.astype(np.int64) << 20 | right
    slot, out = _slot(key, bits), np.full(len(key), FAR, np.int64)
    todo = np.arange(len(key))
    while len(todo):
        k = keys[slot[todo]]
        hit = k == key[todo]
        out[todo[hit]] = ranks[slot[todo[hit]]]
        todo = todo[~hit & (k >= 0)]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return out


def _merge_block(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    n, width = len(words), max(map(len, words))
    length = np.array([len(w) for w in words])
    text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    ids = v.byte_ids[text, 0]
    row = np.arange(n)
    ids[row, length - 1] = v.byte_ids[text[row, length - 1], 1]
    far = FAR
    ids = ids.astype(np.int32)
    rank = np.full((n, width), far, np.int32)  # of the pair at i and i + 1
    r, c = np.nonzero(np.arange(width)[None, :] < (length - 1)[:, None])
    rank[r, c] = _rank(ids[r, c], ids[r, c + 1], v)
    live, place = row, np.arange(width)[None, :]
    done: list[np.ndarray] = [ids[0]] * n
    while True:
        at = rank.argmin(1)
        k = np.arange(len(live))
        best = rank[k, at]
        more = best < far
        for i in np.flatnonzero(~more):
            done[live[i]] = ids[i, : length[i]].copy()
        if not more.any():
            return done
        live, ids, rank, length, at, best = live[more], ids[more], rank[more], length[more], at[more], best[more]
        k = np.arange(len(live))
        ids[k, at] = v.merges[best, 2]
        shift = place > at[:, None]
        ids[:, :-1] = np.where(shift[:, :-1], ids[:, 1:], ids[:, :-1])
        rank[:, :-1] = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
        length = length - 1
        rank[k, length - 1] = far
        has = at < length - 1
        rank[k[has], at[has]] = _rank(ids[k[has], at[has]], ids[k[has], at[has] + 1], v)
        has = at > 0
        rank[k[has], at[has] - 1] = _rank(ids[k[has], at[has] - 1], ids[k[has], at[has]], v)


def _merge_long(word: bytes, v: Vocabulary) -> np.ndarray:
    """The same for one very long word, in rounds: all places of the best pair merge together, left to right."""
    ids = v.byte_ids[np.frombuffer(word, np.uint8), 0].copy()
    ids[-1] = v.byte_ids[word[-1], 1]
    rank = _rank(ids[:-1], ids[1:], v)
    while len(rank) and (best := rank.min()) < FAR:
        at = np.flatnonzero(rank == best)
        if len(at) > 1:  # of overlapping places in a run, every second one counts
            start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            within = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[within % 2 == 0]
        ids[at] = v.merges[best, 2]
        ids = np.delete(ids, at + 1)
        at = at - np.arange(len(at))
        rank = np.delete(rank, np.minimum(at + np.arange(len(at)), len(rank) - 1)) if len(at) else rank
        again = np.unique(np.concatenate([at, at - 1]))
        again = again[(again >= 0) & (again < len(ids) - 1)]
        rank = rank[: len(ids) - 1]
        rank[again] = _rank(ids[again], ids[again + 1], v)
    return ids


class Lexicon:
    """The transducer as flat arrays: arcs sorted by state and byte; start: where a word's ids begin."""

    FIELDS = ("arcs", "targets", "before", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(words: list[bytes], ids: list[np.ndarray]) -> Lexicon:
        """words: sorted and distinct. Equal endings become one state as soon as no later word can pass through them."""
        register: dict[tuple, int] = {}
        states: list[tuple[int, tuple]] = []  # (final, ((byte, target), ...))
        path: list[list] = [[0, []]]  # the last word's states: [final, arcs]; the last arc is still open

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1], register[key])

        last = b""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            close(same)
            for byte in word[same:]:
                path[-1][1].append(byte)
                path.append([0, []])
            path[-1][0], last = 1, word
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []
        arcs, targets, before = [], [], []
        for i, (final, out) in enumerate(states):
            total = final
            for byte, to in out:
                arcs.append(i << 8 | byte)
                targets.append(to)
                before.append(total)
                total += count[to]
            count.append(total)
        start = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        arrays = (arcs, targets, before, [f for f, _ in states], start, flat)
        return Lexicon({k: np.asarray(x, np.int64) for k, x in zip(Lexicon.FIELDS, arrays, strict=True)})

    def pack(self) -> bytes:
        parts = [getattr(self, k) for k in self.FIELDS]
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(x.tobytes() for x in parts)

    @staticmethod
    def map(path: str) -> Lexicon:
        flat = np.memmap(path, np.int64, "r")
        sizes = flat[: len(Lexicon.FIELDS)]
        bounds = len(Lexicon.FIELDS) + np.cumsum([0, *sizes])
        return Lexicon({k: flat[a:b] for k, a, b in zip(Lexicon.FIELDS, bounds[:-1], bounds[1:], strict=True)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words take a step at a time."""
        state = np.full(len(words), len(self.final) - 1)
        number = np.zeros(len(words), np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        offset = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        live, step = np.flatnonzero(sizes > 0), 0
        while len(live) and len(self.arcs):
            key = state[live] << 8 | text[offset[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            state[live[~ok]] = -1
            live, arc = live[ok], arc[ok]
            number[live] += self.before[arc]
            state[live] = self.targets[arc]
            step += 1
            live = live[sizes[live] > step]
        found = (state >= 0) & (sizes > 0)
        found[found] = self.final[state[found]] == 1
        return np.where(found, number, -1)


def _lower(text: str) -> str:
    """Lower case of each character alone, without the final sigma that str.lower() makes by context."""
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class _Numbers(dict):
    """Word to number; unseen words get the next numbers and are listed in new."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts within tasks; the ids of words seen before are remembered in one flat array."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon
        self.pattern = regex.compile(vocabulary.pattern.replace("\\s", _SPACE))
        self.ascii = re.compile(vocabulary.pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"), re.ASCII)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self._forget()

    def _forget(self) -> None:
        # the added tokens come first, under their ids as keys
        self.known = _Numbers((x, k) for k, x in enumerate(self.v.added.values()))
        self.ids = np.array(list(self.known), np.int64)
        self.starts = np.arange(len(self.ids) + 1)

    def words(self, text: str) -> list:
        """The words that are merged each alone; an added token's place is taken by its id."""
        if self.special and any(x in text for x in self.v.added):
            out: list = []
            for i, part in enumerate(self.special.split(text)):
                out += [self.v.added[part]] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        return self.pattern.findall(_lower(unicodedata.normalize("NFC", text)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.words(t) for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        self.known.new = []
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        found = self._encode_words([w.encode() for w in self.known.new])
        self.ids = np.concatenate([self.ids, *found])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.starts[at] - (ends - size), size)]
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(n))])

    def _encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        number = self.lexicon.find(words)
        start, ids = self.lexicon.start, self.lexicon.ids
        out: list = [None] * len(words)
        rest = np.flatnonzero(number < 0).tolist()
        for i in np.flatnonzero(number >= 0).tolist():
            out[i] = ids[start[number[i]] : start[number[i] + 1]]
        for i, x in zip(rest, merge_words([words[i] for i in rest], self.v), strict=True):
            out[i] = x
        return out


_KEPT: dict[str, Encoder] = {}


def kept_encoder(key: str, make: Callable[[], Encoder]) -> Encoder:
    """The encoder of this key, made once a worker process: its next tasks find the words remembered. Only the last one is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def frequent_words(docs: DataFrame, pattern: str, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most so many. Text is counted by Spark; only the top comes to the driver."""
    # one space is found much faster than any white space; what else a piece holds is split with the few that are taken
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("piece")).groupBy("piece").count()
    top = words.where(F.length("piece").between(1, 64)).orderBy(F.desc("count"), "piece").limit(most).select("piece")
    compiled = regex.compile(pattern)
    return sorted({w for r in top.toLocalIterator() for w in compiled.findall(_lower(unicodedata.normalize("NFC", r["piece"])))})


def ship(spark: SparkSession, lexicon: Lexicon) -> str:
    """Put the lexicon's file into the shared folder and have Spark give every executor a copy; returns the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(lexicon.pack()))
    out.close()
    spark.sparkContext.addFile(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return name


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> Lexicon:
    words = sorted(w.encode() for w in frequent_words(docs, vocabulary.pattern, most))
    return Lexicon.build(words, merge_words(words, vocabulary))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, of bounded size unless one text is longer; null texts as empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            part = batch.slice(at, to - at)
            yield part, [x or "" for x in part["text"].to_pylist()]
            at = to


def encode_map(docs: DataFrame, path: str, make, schema: str, most: int = LEXICON_WORDS) -> DataFrame:
    """mapInArrow over (doc_id, text): make(vocabulary, doc_ids, ids, counts) gives the output columns.

    most: words of the lexicon; with 0 there is none, texts are read once and every word is merged where it is first met.
    """
    vocabulary = Vocabulary.load(path)
    name = ship(docs.sparkSession, compile_lexicon(docs, vocabulary, most)) if most else None
    key = name or uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(key, lambda: Encoder(shared.value, Lexicon.map(SparkFiles.get(name)) if name else Lexicon.build([], [])))
        for part, texts in chunks(batches):
            yield make(shared.value, part["doc_id"], *encoder.encode(texts))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of each document (doc_id, text); null and empty texts have no ids."""

    def make(v: Vocabulary, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ranges(counts).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return encode_map(docs, path, make, "doc_id long, ids array<int>", most)


def decode(ids: list[int], v: Vocabulary) -> str:
    """The file names no decoder: tokens' strings joined with spaces, special tokens too."""
    return " ".join(map(v.tokens.__getitem__, ids))


def digests(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again.

    Null and empty texts have no tokens; repeated rows are encoded each; an empty table gives no rows; other columns are
    not read.
    """

    def make(v: Vocabulary, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bounds, a, b = ranges(counts).tolist(), [], []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            own = ids[x:y].tolist()
            a.append(sha256(" ".join(map(v.numbers.__getitem__, own)).encode()).hexdigest())
            b.append(sha256(decode(own, v).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_map(docs, path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most)
