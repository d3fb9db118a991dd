"""Quality rules: word, symbol and line counts, and repetition read off suffix arrays.

Each document's words are suffix-sorted (prefix doubling, many documents in one array, none across documents). The
longest-common-prefix intervals of the order are the maximal repeated substrings; the union of their spans and the longest
of them decide the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablework.llm.common import IS_SPACE, byte_texts, ranges, word_hashes

SYMBOLS = b"#*$%&|<>"
#: A repeat is of so many words or more.
WINDOW = 8
#: The verdict's limits: share of a document's characters in words that repeats cover, and share and length of the longest.
MOST_COVERED, MOST_LONGEST, LONG_WORDS = 0.30, 0.15, 50
#: Documents are sorted together up to so many bytes.
CHUNK = 4 << 20


def _levels(ids: np.ndarray, doc: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of those suffixes whose first window words are repeated in their document, and the ranks by first 2^k words."""
    n = len(ids)
    order = np.lexsort((ids, doc))
    new = np.ones(n, bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    ranks, width = [rank], 1
    active = order[~(new & np.append(new[1:], True))]
    done = [active]
    while len(active):
        rank = ranks[-1]
        after = np.where(active + width < end[active], rank[np.minimum(active + width, n - 1)] + 1, 0)
        at = np.lexsort((after, rank[active]))
        a, r, s = active[at], rank[active][at], after[at]
        group = np.ones(len(a), bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= s[1:] != s[:-1]
        place = np.arange(len(a))
        first = np.maximum.accumulate(np.where(group, place, 0))
        own = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[a] = r + own - first
        ranks.append(rank)
        width *= 2
        again = ~(new & np.append(new[1:], True))
        if width <= window:
            done = [a[again]]
        active = a[again]
    kept = done[0]
    return kept[np.argsort(ranks[-1][kept], kind="stable")], ranks


def repeats(ids: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every word whether a repeat of window words or more covers it, and each document's longest repeat in words.

    ids: a number a word, documents one after another; counts: words of each document.
    """
    bounds = ranges(counts)
    covered, longest = np.zeros(len(ids), bool), np.zeros(len(counts), np.int64)
    if not len(ids):
        return covered, longest
    doc = np.repeat(np.arange(len(counts)), counts)
    end = bounds[doc + 1]
    order, ranks = _levels(ids, doc, end, window)
    if len(order) > 1:
        x, y = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(len(x), np.int64)
        inside = doc[x] == doc[y]
        last = np.minimum(end[x], end[y])
        for k in range(len(ranks) - 1, -1, -1):
            ok = inside & (np.maximum(x, y) + (1 << k) <= last)
            same = np.zeros(len(x), bool)
            same[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
            step = same * (1 << k)
            lcp, x, y = lcp + step, x + step, y + step
        length = np.maximum(np.append(lcp, 0), np.append(0, lcp))
        at = length >= window
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, order[at], 1)
        np.add.at(edge, order[at] + length[at], -1)
        covered = np.cumsum(edge[:-1]) > 0
        np.maximum.at(longest, doc[order[at]], length[at])
    return covered, longest


def _measure(texts: list[bytes], window: int) -> dict[str, np.ndarray]:
    hashes, counts = word_hashes(texts)
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    covered, longest = repeats(ids, counts, window)
    bounds, doc = ranges(counts), np.repeat(np.arange(len(counts)), counts)
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = ranges(np.array([len(x) + 1 for x in texts]))[:-1]
    # a code point starts at each byte that isn't a continuation byte
    points = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & ~IS_SPACE[buf])])
    ends = np.append(sizes[1:] - 1, len(buf))
    chars = points[ends] - points[sizes]
    inside = ~IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    word_chars = points[edge[1::2]] - points[edge[::2]]
    lines = []
    for x in texts:
        own = [y for y in x.split(b"\n") if y.strip(b" \t\n\r\x0b\x0c")]
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": np.bincount(doc, weights=covered, minlength=len(counts)).astype(np.int64),
        "covered_chars": np.bincount(doc, weights=covered * word_chars, minlength=len(counts)).astype(np.int64),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED, most_longest: float = MOST_LONGEST, long_words: int = LONG_WORDS) -> DataFrame:
    """One row a document (doc_id, text): counts, base_failed, covered_fraction, longest_repeat and kept.

    Base rules reject documents of under 20 words, or with over 30 % of their words in repeated windows. Of the others the
    verdict rejects those where repeats cover over most_covered of the characters in words, or where the longest repeat
    has over long_words words and over most_longest of all words. Null and empty texts have no words, so base_failed is
    true. Texts are read whole; other columns aren't read; repeated rows are judged each on its own; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = byte_texts(batch["text"]), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size, to = size + len(texts[to]), to + 1
                m = _measure(texts[at:to], window)
                n = np.maximum(m["n_words"], 1)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                share = m.pop("covered_chars") / np.maximum(m["word_chars"], 1)
                bad = (share > most_covered) | ((m["longest_repeat"] > long_words) & (m["longest_repeat"] > most_longest * n))
                longest = m.pop("longest_repeat")
                cols = {"doc_id": batch["doc_id"].slice(at, to - at), **m, "base_failed": failed, "kept": ~failed & ~bad, "covered_fraction": share, "longest_repeat": longest}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], list(cols))
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long")
