"""Embedding near-duplicates, token alignment and spelling variants against brute force."""

import bisect
import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.llm import alignment, buckets, embeddings, queries, spelling

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


# embeddings


def vectors(seed, n, size):
    """Random vectors, copies, chains of near vectors and a dense group, with labels, and vectors that link with nothing."""
    r = np.random.default_rng(seed)
    rows = []
    add = lambda v, label: rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label))
    for _ in range(n):
        add(r.standard_normal(size), int(r.integers(3)))
    for i in range(0, n, 7):
        add(np.array(rows[i][1]) * 3.5, rows[i][2])
        add(rows[i][1], rows[i][2])
        add(rows[i][1], None)
    v = r.standard_normal(size)
    for _ in range(40):  # each near the next, the ends far apart
        v = v + 0.12 * np.linalg.norm(v) * (d := r.standard_normal(size)) / np.linalg.norm(d)
        add(v, 1)
    center = r.standard_normal(size)
    for _ in range(120):
        add(center + 0.14 * np.linalg.norm(center) * (d := r.standard_normal(size)) / np.linalg.norm(d), 2)
    add(None, 1), add([], 1), add([0.0] * size, 1), add([None] + [1.0] * (size - 1), 1), add([float("nan")] + [1.0] * (size - 1), 1), add([float("inf")] * size, 1), add([1.0] * (size + 1), 1), add([1.0] * size, 1)
    add([1e-30] * size, 1), add([1e300] * size, 1)
    return rows


def vector_groups(rows, cosine=0.98):
    ok = [(i, np.array(v), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in ok}
    links = [(a, b) for (a, v, k), (b, w, m) in itertools.combinations(ok, 2) if k == m and len(v) == len(w) and unit[a] @ unit[b] >= cosine]
    n = collections.Counter(itertools.chain.from_iterable(links))
    own = union_find([i for i, _, _ in rows], links)
    return {i: (n[i], own[i], own[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("size,width,chunk", [(64, 8, 4096), (10, 8, 16), (3, 8, 50), (1, 8, 4096), (64, 5, 30)])
def test_embeddings(spark, monkeypatch, size, width, chunk):
    rows = vectors(size, 150, size)
    monkeypatch.setattr(embeddings, "dealt", lambda *a: buckets.dealt(*a, chunk))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x")).withColumn("cell", F.lit(None).cast("int"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, width=width).collect()}
    assert got == vector_groups(rows)
    assert embeddings.near_duplicates(df.where("false"), width=width).count() == 0


def test_embeddings_ids(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [1.0, 0.001], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (9, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 3, 3, False), (7, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (None, 0, None, True), (9, 0, 9, True)], key=repr)


# alignment


def alignment_rows(rows):
    """The contract's columns by offsets alone, whole texts at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(sorted({*range(256)} - {*plain}))}
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, pairs = [], collections.Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ends = []
        for ids, of in ((ids_a, lambda i: bytes(byte[c] for c in names[i])), (ids_b, piece)):
            tokens = [of(i) for i in ids]
            if text and b"".join(tokens) != (" " + text).encode():
                ids_a, ids_b = [], []
            ends.append(list(itertools.accumulate(map(len, tokens))))
        if not ids_a:
            ends = [[], []]
        at_b = dict(zip(ends[1], ids_b))
        links = [(i, at_b[e]) for i, e in zip(ids_a, ends[0]) if e in at_b]
        pairs.update(links)
        groups, at = [], [0, 0]
        for e in sorted({*ends[0]} & {*ends[1]}):
            to = [bisect.bisect_right(x, e) for x in ends]
            groups.append("|".join(",".join(map(str, ids[p:q])) for ids, p, q in zip((ids_a, ids_b), at, to)))
            at = to
        docs.append((doc_id, len(ids_a), len(ids_b), links, groups))
    most = collections.defaultdict(int)
    for (_, j), n in pairs.items():
        most[j] = max(most[j], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted((d, na, nb, len(g), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), digest(g)) for d, na, nb, links, g in docs)


def test_alignment(spark):
    r = random.Random(11)
    alphabet = ["a", "b", " ", "\n", "  ", "é", "日本", "▁", "'s", ",", "\t", "\x02", "\x1c", "\xa0", "<|endoftext|>", "😀", "the ", "1234", "mente ", "\r\n", "<s>", "\x00", "ﬁ", "é", "　", "don't "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["", None, " ", "\n", "a ", " a", "a\n", "a\n\nb", "the cat\nsat on the mat. " * 50, "the cat\nsat on the mat. " * 50, "x" * 3000, " " * 3000 + "x", "a" + " " * 2000, "\n" * 1500, "one two\nthree"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("keys", F.lit("x")).withColumn("bundle", F.lit(1))
    want = alignment_rows(rows)
    assert sum(x[1] > 0 for x in want) > 100
    assert sorted(map(tuple, alignment.align(df, A, B).collect())) == want
    assert sorted(map(tuple, alignment.align(df, A, B, bundle=200).collect())) == want
    assert alignment.align(df.where("false"), A, B).count() == 0


def test_alignment_ids(spark):
    rows = [(1, "one two"), (1, "one two"), (1, None), (2, "three")]
    df = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string")
    got = [tuple(r) for r in alignment.align(df, A, B).collect()]
    want = alignment_rows([*rows, (9, "one")])
    assert sorted((9 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_alignment_forgets(spark, monkeypatch):
    aligner = alignment.Aligner(alignment.Tokenizers(A, B))
    texts = ["some words\nand more", "some words", "other things here"]
    first = [x for x in aligner.align(texts)[3]]
    aligner.forget()
    assert first == [x for x in aligner.align(texts)[3]] and len(aligner.keys) == len(aligner.groups)


# spelling


def spelling_rows(rows, letters=6, least=5, times=5, dropped=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % dropped == 0 else w] += 1
    words = sorted(w for w in n if len(w) >= letters and n[w] >= least)

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in words if near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: best[w] if w in best and n[best[w]] >= times * n[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in words)


@pytest.mark.parametrize("chunk,dropped", [(4096, 3), (8, 7)])
def test_spelling(spark, monkeypatch, chunk, dropped):
    r = random.Random(chunk)
    base = ["".join(r.choice("abÀÿéc") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "bababababa", "abababab", "straße", "ÀÉÎÕÜý", "x" * 300, "x" * 301]
    words = [*base]
    for w in base:
        for _ in range(3):
            at = r.randrange(len(w))
            words.append(r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abc") + w[at:], w[:at] + r.choice("abc") + w[at + 1 :]]))
    texts = [" ".join(r.choice([str.upper, str, str, str])(w) if w.isascii() else w for w in r.choices(words, [1 / (1 + k) for k in range(len(words))], k=200)) for _ in range(120)]
    texts += [None, "", "12 - \n", " ".join(words * 6), "aaaaaa×bbbbbb÷cccccc " * 9, "日本aaaaaaa日本" * 30]
    rows = list(enumerate(texts))
    monkeypatch.setattr(spelling, "dealt", lambda *a: buckets.dealt(*a, size=chunk))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = spelling.spelling_variants(df, dropped=dropped).select("word", "form", "root", "n", "n_near", "form_n")
    want = spelling_rows(rows, dropped=dropped)
    assert len(want) > 100 and any(x[1] and x[1] != x[2] for x in want)
    assert sorted(map(tuple, got.collect())) == want
    assert spelling.spelling_variants(df.where("false"), dropped=dropped).count() == 0


def test_spelling_ties_and_nulls(spark):
    df = spark.createDataFrame([("letter", 1), ("lettera", 5), ("letterb", 5), (None, 9), ("", 9), ("lettex", 6), ("far", 100)], "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == {"letter": ("lettex", "lettex", 1, 3, 6), "lettera": (None, "lettera", 5, 2, None), "letterb": (None, "letterb", 5, 2, None), "lettex": (None, "lettex", 6, 1, None), "far": (None, "far", 100, 0, None)}
    with pytest.raises(ValueError):
        spelling.variants(df, 1)
    chain = spark.createDataFrame([("a" * k, 5 ** (k + 1)) for k in range(1, 12)], "word string, n long")
    assert {r["root"] for r in spelling.variants(chain).collect()} == {"a" * 11}
