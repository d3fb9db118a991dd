"""Toxicity scores of deobfuscated text.

A noisy channel is assumed to have written letters as look-alike digits and signs, repeated them, or spaced them out. Each
token that may have gone through it becomes a lattice of readings of every character; Viterbi decoding under a character
trigram model of the corpus picks the likeliest restoration. Words of the restored text are scored by a logistic model.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a look-alike may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c",
}
#: Log costs of the channel: a look-alike, a dropped repeat, a dropped separator, a sign kept as it is, a sign dropped at
#: an end of the token, where it may be punctuation or is one of LETTERLIKE.
LOOK, REPEAT, SEPARATOR, KEPT, EDGE, LETTER_EDGE = -1.0, -0.5, -0.5, -6.0, -1.0, -3.0
LETTERLIKE = "@$€£"
#: Evidence in nats, the gain in log-likelihood from knowing a word, from which the model takes it; and the most words it takes,
#: those with the most evidence: the bound of what is fitted on the driver.
EVIDENCE, MOST_WORDS = 6.0, 50_000
#: Labelled rows that the logistic model is fitted on at most, by smallest hash of doc_id; word counts take all rows.
MOST_ROWS = 50_000
#: Strings of one to three letters that the character model holds at most, the most frequent ones, whatever their script.
MOST_STRINGS = 1_000_000
#: Strings a task counts before it hands its counts on.
COUNTED = 2_000_000

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(c for c in LOOKS if not c.isdigit()))
#: Characters of a token that are set apart: three or more letters, digits or look-alike signs, each alone or repeated, with any
#: other signs between them.
_SPACED = re.compile(rf"(?<![\w{_SIGNS}])(?:([\w{_SIGNS}])\1*[^\w{_SIGNS}]{{1,8}}){{2,}}([\w{_SIGNS}])\2*(?![\w{_SIGNS}])")
_APART = re.compile(rf"([\w{_SIGNS}])\1*[^\w{_SIGNS}]*")
#: A token that is one character, alone or repeated, or none, with other signs around it.
_UNIT = re.compile(rf"[^\w{_SIGNS}]*(?:([\w{_SIGNS}])\1*)?[^\w{_SIGNS}]*")
#: What is not seen: soft hyphens, joiners, marks of direction.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SEPARATORS = " .-_*"
#: What is at the ends of a token and neither a letter, a digit nor a look-alike.
_ENDS = re.compile(r"^(?:[^\w{0}]|_)+|(?:[^\w{0}]|_)+$".format(re.escape("".join(LOOKS))))
_NOISE = frozenset(LOOKS) | frozenset(_SEPARATORS)


class CharModel:
    """Character trigrams with interpolated bigrams and unigrams; what it has not seen costs the same everywhere."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = max(1, sum(v for k, v in counts.items() if len(k) == 1))
        self.known: dict[tuple[str, str, str], float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        found = self.known.get((a, b, c))
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[a, b, c] = self._log(a, b, c)
        return found

    def _log(self, a: str, b: str, c: str) -> float:
        n = self.counts.get
        one = (n(c, 0) + 0.5) / (self.total + 64)
        two = n(b + c, 0) / max(1, n(b, 0))
        three = n(a + b + c, 0) / max(1, n(a + b, 0))
        return math.log(0.6 * three + 0.3 * two + 0.1 * one)


def readings(token: str, whole: bool = False) -> Iterator[list[tuple[str, float]]]:
    """The lattice of a token: for each character what it may have been, with log costs; '' where it is dropped.

    whole: look-alike signs are all taken as written for letters, none dropped as punctuation or as a repeat.
    """
    first = next((i for i, c in enumerate(token) if c.isalnum()), len(token))
    last = next((i for i in range(len(token) - 1, -1, -1) if token[i].isalnum()), -1)
    for i, c in enumerate(token):
        if c in LOOKS:
            own = [(x, LOOK) for x in LOOKS[c]] + [(c, KEPT)]
            if not whole:
                if i and token[i - 1] == c:
                    own.append(("", REPEAT))
                elif i < first or i > last:
                    own.append(("", LETTER_EDGE if c in LETTERLIKE else EDGE))
        elif c in _SEPARATORS:
            own = [("", SEPARATOR), (" ", KEPT)]
        elif (i < first or i > last) and not c.isalnum():
            own = [("", 0.0)]
        else:
            own = [(c, 0.0)]
            if i and token[i - 1] == c:
                run = i + 1 < len(token) and token[i + 1] == c or i > 1 and token[i - 2] == c
                own = [(c, 0.0 if not run else REPEAT), ("", REPEAT if run else KEPT)]
        yield own


def _settled(back: list[dict], states: set) -> tuple[list[str], list[dict], set]:
    """What all paths to states have in common, written out, the steps after it and the state it ends in."""
    at = len(back)
    while at and len(states) > 1:
        at -= 1
        states = {back[at][s][0] for s in states}
    if len(states) > 1:
        return [], back, set()
    (state,) = end = states
    out = []
    for step in reversed(back[:at]):
        state, c = step[state]
        out.append(c)
    return out[::-1], back[at:], end


def decode(token: str, model: CharModel, whole: bool = False) -> str:
    """The likeliest reading of a token: Viterbi over the last two characters written, in time proportional to its length."""
    scores = {(" ", " "): 0.0}
    back: list[dict] = []
    done: list[str] = []
    log, limit = model.log, 512
    for own in itertools.chain(readings(token, whole), [[(" ", 0.0)]]):
        step: dict[tuple[str, str], float] = {}
        came: dict[tuple[str, str], tuple[tuple[str, str], str]] = {}
        for state, score in scores.items():
            a, b = state
            for c, cost in own:
                key = (b, c) if c else state
                new = score + cost + (log(a, b, c) if c else 0.0)
                if key not in step or new > step[key]:
                    step[key], came[key] = new, (state, c)
        scores = step
        back.append(came)
        if len(back) >= limit:
            out, back, _ = _settled(back, set(scores))
            done += out
            limit = 2 * len(back) + 512
    best = max(scores, key=lambda s: (scores[s], s))
    return "".join(done + _settled(back, {best})[0]).strip()


def char_model(docs: DataFrame, most: int = MOST_STRINGS) -> CharModel:
    """Counts of one to three letters, of any script, over the words of all texts; the most frequent strings reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.zeros(0x110000, bool)
        letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        place = np.zeros(len(letter), np.int64)
        total: dict[int, int] = {}

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])
            total.clear()
            return out

        for batch in batches:
            texts = " ".join(x.lower() for x in batch["text"].to_pylist() if x)
            for at in range(0, len(texts), 2_000_000):
                codes = np.frombuffer(texts[at : at + 2_000_000].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                codes = np.concatenate([[32], np.where(letter[codes], codes, 32), [32]])
                keep = np.ones(len(codes), bool)
                keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
                codes = codes[keep]
                used = np.flatnonzero(np.bincount(codes, minlength=len(letter)))
                k = len(used)
                place[used] = np.arange(k)
                d = place[codes]
                for width in (1, 2, 3):
                    key = d[: len(d) - width + 1]
                    for x in range(1, width):
                        key = key * k + d[x : len(d) - width + 1 + x]
                    if k**width <= 1 << 22:
                        seen = np.flatnonzero(times := np.bincount(key))
                        times = times[seen]
                    else:
                        seen, times = np.unique(key, return_counts=True)
                    code = sum(used[seen // k**x % k] << 21 * x for x in range(width))
                    for c, n in zip(code.tolist(), times.tolist(), strict=True):
                        total[c] = total.get(c, 0) + n
                if len(total) > COUNTED:
                    yield counts()
        yield counts()

    rows = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # shorter strings first among equals, as longer ones rest on them
    kept = rows.orderBy(F.desc("n"), "key").limit(most).toArrow()
    text = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    return CharModel({text(k): n for k, n in zip(kept["key"].to_pylist(), kept["n"].to_pylist(), strict=True)})


class Restorer(dict):
    """Restores texts within a task: token to what use() makes of its words; tokens are remembered up to a bound.

    wholes: words that count even if they are written in two pieces.
    """

    def __init__(self, model: CharModel, use=tuple, wholes=frozenset(), most: int = 500_000):
        super().__init__()
        self.model, self.use, self.wholes, self.most = model, use, wholes, most
        self.fronts = {w[:k] for w in wholes for k in range(2, len(w))}
        self.letters: dict[str, str] = {}  # of tokens that are one character, or none
        self.units: set[str] = set()

    def __missing__(self, token: str):
        if len(self) > self.most:
            self.clear(), self.letters.clear(), self.units.clear()
        if (len(token) < 3 or token[0] == token[-1] or not token[0].isalnum()) and (m := _UNIT.fullmatch(token)):
            self.letters[token] = m[1] or ""
            self.units.add(token)
        found = self[token] = self.use(self.restored(token))
        return found

    def restored(self, token: str) -> list[str]:
        """The words of a white-space separated token as written, and those of its restoration where it may be noisy."""
        words = _WORD.findall(token)
        if len(words) == 1 and len(words[0]) == len(token) and not _REPEATED.search(token):
            return words
        for m in _SPACED.finditer(token):
            words += self.decoded(" ".join(x[1] for x in _APART.finditer(m[0])))
        core = _ENDS.sub("", token)
        if not _NOISE.isdisjoint(core) or _REPEATED.search(core):
            words += self.decoded(core)
        return words

    def decoded(self, core: str) -> list[str]:
        """Words of the likeliest reading, and of that which takes every sign for a letter where the two may differ."""
        words = _WORD.findall(decode(core, self.model))
        signs = [i for i, c in enumerate(core) if c in LOOKS]
        if any(i in (0, len(core) - 1) or core[i - 1] == core[i] for i in signs):
            words += _WORD.findall(decode(core, self.model, whole=True))
        return words

    def words(self, text: str) -> set:
        """What use() made of all distinct words of the restored text, in lower case."""
        text = text.lower()
        if not text.isascii():
            text = _HIDDEN.sub("", text)
        tokens = text.split()
        own = set(tokens)
        found = set().union(*map(self.__getitem__, own))
        # characters set apart by white space: neighbouring tokens of one character each
        units = own & self.units
        if len(units) > 1:
            run, last = "", -2
            for i in [i for i, t in enumerate(tokens) if t in units] + [len(tokens) + 1]:
                if i != last + 1:
                    if len(run) > 2:
                        found.update(self.use(self.decoded(" ".join(run))))
                    run = ""
                last = i
                run += self.letters[tokens[i]] if i < len(tokens) else ""
        # a word in two pieces is taken for one only where the model knows it
        if not self.fronts.isdisjoint(own):
            found.update(self.use([w for a, b in zip(tokens, tokens[1:]) if a in self.fronts and (w := a + b) in self.wholes]))
        return found


@dataclass(frozen=True)
class Model:
    chars: CharModel
    words: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def fit(labelled: DataFrame, docs: DataFrame) -> Model:
    """A model from labelled (doc_id, text, toxic) and all docs (doc_id, text), those labelled among them; the others teach the character model alone.

    Words are counted over all labelled rows. The logistic model takes the words with EVIDENCE or more for toxic documents,
    MOST_WORDS at most, fitted on at most MOST_ROWS rows. Rows without a label or text teach nothing.
    """
    chars = char_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(chars)
    labelled = labelled.where("text is not null and toxic in (0, 1)").select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(shared.value), {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0))], ["word", "p", "q"])

        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                for w in restorer.words(text):
                    if w not in seen:
                        seen[w] = [0, 0]
                    seen[w][toxic] += 1
                if len(seen) > 300_000:
                    yield rows()
                    seen.clear()
        yield rows()

    per_class = {r["toxic"]: r["count"] for r in labelled.groupBy(F.col("toxic").cast("long").alias("toxic")).count().collect()}
    n0, n1 = per_class.get(0, 0), per_class.get(1, 0)
    if not n0 or not n1:
        return Model(chars, (), (), 8.0 if n1 else -8.0)
    counts = labelled.mapInArrow(count, "word string, p long, q long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    # evidence: the gain in log-likelihood from knowing the word, for words of toxic documents
    p, q = F.col("p"), F.col("q")
    rate = F.lit(n1 / (n0 + n1))
    gain = p * F.log(p / ((p + q) * rate)) + F.when(q > 0, q * F.log(q / ((p + q) * (1 - rate)))).otherwise(0)
    top = counts.where((gain >= EVIDENCE) & (p / n1 > q / n0)).orderBy(F.desc(gain), "word").limit(MOST_WORDS).collect()
    words = [r["word"] for r in top]
    index = {w: i for i, w in enumerate(words)}
    held = docs.sparkSession.sparkContext.broadcast(index)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        restorer = Restorer(shared.value, lambda words: tuple(known[w] for w in words if w in known))
        for batch in batches:
            found = [sorted(restorer.words(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    # ids first: at most MOST_ROWS of them are broadcast, and texts stay where they are
    ids = labelled.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS).dropDuplicates()
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    table = sample.mapInArrow(features, "toxic long, found array<int>").toArrow()
    weights, bias = _logistic(table["found"].combine_chunks(), table["toxic"].to_numpy(), len(words))
    return Model(chars, tuple(words), tuple(weights.tolist()), bias)


def _logistic(found: pa.ListArray, y: np.ndarray, width: int, penalty: float = 3e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on presence of words, by gradient steps with momentum; classes weigh alike."""
    items = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(found.offsets.to_numpy()))
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b, v, u = np.zeros(width), 0.0, np.zeros(width), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights=w[items], minlength=len(y)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        v = 0.9 * v - 4.0 * (np.bincount(items, weights=g[row], minlength=width) + penalty * w)
        u = 0.9 * u - 4.0 * g.sum()
        w, b = np.maximum(w + v, 0), b + u
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each document (doc_id, text): score from 0 to 1, predicted 1 from 0.5 on.

    Null and empty texts are scored as texts without any word. Texts are read whole, repeated rows are scored each, an
    empty table gives no rows, other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {w: k for k, w in enumerate(m.words)}
        restorer = Restorer(m.chars, lambda words: tuple(number[w] for w in words if w in number), frozenset(number))
        for batch in batches:
            z = np.array([m.bias + sum(m.weights[k] for k in restorer.words(t or "")) for t in batch["text"].to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
