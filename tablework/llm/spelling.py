"""Spelling variants: words of the corpus that lie one edit apart, and the most frequent word each leads to.

Words are found by an inverted index over positional q-grams. One edit touches at most q of a word's padded q-grams, so of its
q + 1 rarest at least one is also in the other word, at the same place or, behind an insertion, the next. A posting list is
therefore the words of one length that have a rare gram at one place; Spark's shuffle merges the lists of all words by gram,
place and length. Within a list, words are kept as a pair if they share as many grams under these limits as one edit leaves,
and then compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.buckets import dealt, whole_groups
from tablework.llm.common import discard, stage

#: Letters of a gram.
Q = 3
#: Counters that grams share when their frequencies are taken: the bound of what the driver gathers.
COUNTERS = 1 << 20
#: Words a task counts before it hands its counts on.
COUNTED = 400_000
#: A run of letters.
RUN = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, pattern: str = RUN, dropped: int | None = None) -> DataFrame:
    """(word, n): the runs of all texts with A-Z lower-cased, and how often each occurs.

    dropped: where crc32 of "<doc_id>:<run>" is divisible by it, the run loses the letter at that crc32 modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        total: Counter = Counter()

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text:
                    continue
                own = Counter(find(text.lower() if text.isascii() else text.translate(_LOWER)))
                if dropped:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % dropped == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                else:
                    total.update(own)
                if len(total) > COUNTED:
                    yield counts()
        yield counts()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams(letters: np.ndarray) -> np.ndarray:
    """The q-grams of words of one length (a row of code points each), padded at both ends; each is one number, exactly."""
    n, size = letters.shape
    padded = np.zeros((n, size + 2 * (Q - 1)), np.int64)
    padded[:, Q - 1 : Q - 1 + size] = letters
    padded[:, Q - 1 + size :] = 1
    out = np.zeros((n, size + Q - 1), np.int64)
    for k in range(Q):
        out = out << 21 | padded[:, k : k + size + Q - 1]
    return out


def letters_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length; 0 and 1 are left to the padding."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int64) + 2


def _counter(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of a batch that have words of one length, and these words."""
    words = batch["word"].to_pylist()
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, [words[i] for i in rows.tolist()]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many words have a gram of each counter; grams that share one are told apart later, so this only sets their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, some in by_length(batch):
                total += np.bincount(_counter(grams(letters_of(some)).ravel()), minlength=COUNTERS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["counter", "n"])

    found = words.select("word").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def postings(words: DataFrame) -> DataFrame:
    """(gram, place, size, longer, id, word): each word in the lists of its rarest grams, and (longer) where words that are a letter longer would be."""
    often = words.sparkSession.sparkContext.broadcast(gram_counts(words))  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some in by_length(batch):
                g = grams(letters_of(some))
                order = np.lexsort((g, often.value[_counter(g)]), axis=1)[:, : Q + 1]
                rare = np.take_along_axis(g, order, 1)
                # every place of a rare gram counts, not only that of the one chosen
                word, place = np.nonzero((g[:, :, None] == rare[:, None, :]).any(2))
                gram, taken, size = g[word, place], batch.take(pa.array(rows[word])), len(some[0])
                for longer, step in ((False, 0), (True, 0), (True, 1)):
                    n = len(word)
                    columns = [pa.array(gram), pa.array((place + step).astype(np.int32)), pa.array(np.full(n, size + longer, np.int32)), pa.array(np.full(n, longer)), taken["id"], taken["word"]]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "place", "size", "longer", "id", "word"])

    return words.select("id", "word").mapInArrow(run, "gram long, place int, size int, longer boolean, id long, word string")


def _same_length(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y, words of one length, that differ in one letter."""
    gx, gy = grams(x), grams(y)
    shared = sum((gx[:, None, k] == gy[None, :, k]).astype(np.int16) for k in range(gx.shape[1]))
    p, q = np.nonzero(shared >= gx.shape[1] - Q)
    near = (x[p] != y[q]).sum(1) == 1
    return p[near], q[near]


def _one_longer(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x, and of y, whose words have a letter more and are otherwise the same."""
    gx, gy = grams(x), grams(y)
    shared = sum(((gx[:, None, k] == gy[None, :, k]) | (gx[:, None, k] == gy[None, :, k + 1])).astype(np.int16) for k in range(gx.shape[1]))
    p, q = np.nonzero(shared >= gy.shape[1] - Q)
    same = x[p] == y[q, :-1]
    tail = x[p] == y[q, 1:]
    size = x.shape[1]
    ahead = np.where(same.all(1), size, same.argmin(1))  # letters that agree from the front
    behind = np.where(tail.all(1), size, tail[:, ::-1].argmin(1))
    near = ahead + behind >= size
    return p[near], q[near]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: ids of distinct words (id, word) that are one inserted, deleted or replaced letter apart. No word may be empty."""
    keys = ["gram", "place", "size"]
    by = [*keys, "first", "second"]
    rows = dealt(stage(postings(words), "postings"), keys, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, by):
            ids, longer, chunk, first, second, size = (table[c].to_numpy() for c in ("id", "longer", "chunk", "first", "second", "size"))
            words = table["word"].to_pylist()
            found = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = ~longer[s:e]
                if e - s < 2 or not own.any():
                    continue
                one, two = chunk[s:e] == first[s], chunk[s:e] == second[s]
                same = first[s] == second[s]
                at = lambda mask, s=s: s + np.flatnonzero(mask)
                found += _compared(at(one & own), at(two & own), words, _same_length)
                found += _compared(at(one & ~own), at(two & own), words, _one_longer)
                if not same:
                    found += _compared(at(two & ~own), at(one & own), words, _one_longer)
            if found:
                x, y = (ids[np.concatenate([pair[k] for pair in found])] for k in (0, 1))
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return rows.select(*by, "chunk", "longer", "id", "word").mapInArrow(run, "a long, b long").distinct()


def _compared(x: np.ndarray, y: np.ndarray, words: list[str], compare) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows x and y, some rows of x at a time."""
    if len(x) and len(y):
        right = letters_of([words[i] for i in y.tolist()])
        step = max(1, (1 << 21) // (len(y) + right.shape[1]))
        for i in range(0, len(x), step):
            some = x[i : i + step]
            p, q = compare(letters_of([words[k] for k in some.tolist()]), right)
            if len(p):
                yield some[p], y[q]


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    n_near: words one edit away. form: the one of them with the largest n (ties: the smallest in code-point order) if that is
    at least times as large as the word's own, else null; form_n is its n. root: where following forms ends, the word itself if
    it has none. Null and empty words are left out; an empty table gives no rows. Forms grow by times at each step, so roots
    are found in a number of joins that grows with the logarithm of the largest n's logarithm.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    own = stage(words.where("word <> ''").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = near_pairs(own)
    both = stage(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*"), "pairs")
    best = F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("best")
    near = both.join(own.select(F.col("id").alias("b"), "word", "n"), "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best)
    told = own.join(near, "id", "left")
    fit = -F.col("best.m") >= times * F.col("n")
    told = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, F.col("best.word")).alias("form"), F.when(fit, -F.col("best.m")).alias("form_n")), "told")
    steps = stage(told.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:  # each round doubles how far a word has come
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, steps = steps, stage(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        moved = not steps.where("moved").isEmpty()
        steps = steps.drop("moved")
        discard(before)
        if not moved:
            break
    discard(both)
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, times: int = 5, dropped: int | None = None) -> DataFrame:
    """variants() of the words of all texts of docs (doc_id, text) that are long and frequent enough; null texts have none.

    Rows are counted each, whatever their doc_id; other columns are not read.
    """
    found = word_counts(docs, RUN, dropped).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    return variants(found, times)
