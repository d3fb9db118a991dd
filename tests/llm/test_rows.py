"""Null and repeated doc_ids, words made to deceive hashes, and texts without spaces."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from tablework.llm import common, fingerprints, lines, minhash, quality, repeats

A, B = "one two three four five six", "seven eight nine ten eleven twelve"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1)).repartition(3)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_self_similar_words():
    words = [thue_morse(n, *ab).encode() for n in (64, 65, 1024, 2048, 4096) for ab in ("ab", "ba")] + [b"ab" * 100, b"ba" * 100, b"a" * 63, b"a" * 64, b"a" * 65, b"", b"ba", b"ab"]
    hashes, counts = common.word_hashes(words)
    assert len({*hashes.tolist()}) == len([w for w in words if w]) and counts.tolist() == [1 if w else 0 for w in words]
    alone = [common.word_hashes([w])[0].tolist() for w in words]
    assert [h for x in alone for h in x] == hashes.tolist()
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 90))) for _ in range(50)) for _ in range(40)]
    flat = [w for t in texts for w in t.split()]
    hashes = common.word_hashes([t.upper().encode() for t in texts], lower=True)[0].tolist()
    assert len(hashes) == len(flat) and len({*zip(flat, hashes)}) == len({*flat}) == len({*hashes})


def test_self_similar_texts(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, [(1, f"{x} {x}"), (2, f"{y} {y}"), (3, f"{x} {x}")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    first, second = " ".join([x] * 4 + [y] * 4), " ".join([y, x] * 4)
    got = quality.quality(table(spark, [(1, " ".join(f"{w}" for w in [x, "a", "b", "c", "d", "e", "f", "g", "h", y, "a", "b", "c", "d", "e", "f", "g"]))])).first()
    assert got["n_repeat_words"] == 0
    assert quality.quality(table(spark, [(1, f"{first} {second}")])).first()["n_words"] == 16


def test_near_duplicates_of_any_ids(spark):
    got = minhash.near_duplicates(table(spark, [(1, A), (1, B), (2, A), (3, B), (None, A), (None, "alone here now"), (4, None)])).collect()
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (4, 4, True)]
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)


def test_lines_of_any_ids(spark):
    got = lines.line_duplicates(table(spark, [(1, A), (None, A), (None, f"{B}\n{A}"), (2, B), (2, B)])).collect()
    kept = sorted((r["doc_id"], r["line_no"]) for r in got if r["kept"])
    assert len(got) == 6 and kept == [(1, 0), (2, 0)]
    assert {(r["first_doc_id"], r["first_line_no"]) for r in got} == {(1, 0), (2, 0)}


def test_repeats_of_any_ids(spark):
    r = random.Random(5)
    own = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    shared, clean = own(300), own(400)
    rows = [(1, own(100) + shared), (1, clean), (None, shared + own(50)), (2, own(250))]
    got = repeats.remove_repeats(table(spark, rows)).collect()
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in got), key=repr) == sorted([(1, 400, 300), (1, 400, 0), (None, 350, 300), (2, 250, 0)], key=repr)
    assert hashlib.sha256(clean.encode()).hexdigest() in {x["kept_sha256"] for x in got}
    assert repeats.remove_repeats(table(spark, [(None, shared), (None, shared)])).select("n_removed").distinct().collect()[0][0] == 300


def test_periodic_and_self_similar_bytes(spark):
    """Which bytes go, string by string."""
    texts = ["ab" * 150, "a" * 250, thue_morse(512), thue_morse(512, "b", "a"), thue_morse(700)[150:], "x" * 199, "日本語" * 100]
    seen = collections.Counter(t.encode()[i : i + 200] for t in texts for i in range(len(t.encode()) - 199))
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(table(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        gone = {j for i in range(len(t.encode()) - 199) if seen[t.encode()[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert got[k] == len(gone), k


def test_fingerprints_of_any_ids(spark):
    rows = [(2, "later text here"), (None, "b null"), (1, "y of one"), (1, "x of one"), (None, None)]
    got = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in fingerprints.compare_edited(table(spark, rows)).collect()}
    order = ["x of one", "y of one", "later text here", "b null", ""]
    want = {}
    for i, t in enumerate(order):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + order[(i + 1) % 5][:cut]
        want.setdefault(((1, 1, 2, None, None)[i], len(t)), hashlib.sha256(edited.encode()).hexdigest())
    assert got.keys() == want.keys() and all(got[k] == v for k, v in want.items() if k != (1, 8))
    assert fingerprints.compare_edited(table(spark, [(None, "alone")])).first()["near_next"] == 1


def test_fingerprints_without_spaces(spark):
    r = random.Random(1)
    for letters in ("".join(chr(c) for c in range(0x4E00, 0x4E00 + 800)), "ACGT" + "acgt0123456789"):
        text = "".join(r.choice(letters) for _ in range(600))
        edits = [text, "第" + text, text[:300] + "第" + text[300:], text[:-1], "".join(r.choice(letters) for _ in range(600))]
        df = spark.createDataFrame([(text, e) for e in edits], "a string, b string")
        near = [x["n"] for x in df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("n")).collect()]
        assert near[0] == 1 and min(near[1:4]) > 0.8 and near[4] < 0.6, near


def test_set_apart_words_are_scored(spark):
    """However a toxic word is set apart, it scores as it does in plain, and clean texts stay clean."""
    from tablework.llm import toxicity

    r = random.Random(9)
    common_words = "the weather of this house was good and we all went home again with some bread".split()
    clean = [" ".join(r.choice(common_words) for _ in range(20)) for _ in range(120)]
    toxic = [f"{t} {w} {t}" for t in clean[:60] for w in ["wretched"]]
    foreign = ["这是一个很好的地方" * 3, "дом и хлеб были хороши " * 3]
    docs = spark.createDataFrame(list(enumerate(clean + toxic + foreign)), "doc_id long, text string")
    labelled = docs.withColumn("toxic", F.when(F.col("doc_id") >= 120, 1).otherwise(0)).where("doc_id < 180")
    model = toxicity.fit(labelled, docs)
    assert "wretched" in model.words and model.chars.counts["很"] == 3 and model.chars.counts["хле"] == 3
    w = "wretched"
    forms = [w, "  ".join(w), "\t".join(w), "\n".join(w), " . ".join(w), "/".join(w), ",".join(w), " ".join(c * 3 for c in w), "wret ched", "​".join(w), "w­retched", "wr3tch3d", "w.r.e.t.c.h.e.d", "wrrretched"]
    rows = [(i, f"the house was {f} and good") for i, f in enumerate(forms)] + [(100 + i, t) for i, t in enumerate([*clean[:20], "a b c d e", "1, 2, 3, 4, 5", "i. ii. iii", "", "- - - -", foreign[0]])]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i] == got[0] > 0.5 for i in range(len(forms))), got
    assert all(v < 0.5 for k, v in got.items() if k >= 100)


def test_language_filter_against_exact_sets(spark, monkeypatch):
    """The filter, filled in many ranges, holds all that exact sets hold and little else, and predicts as they do."""
    from tablework.llm import langid

    monkeypatch.setattr(langid, "SEGMENT", 512)
    r = random.Random(6)
    names = [f"l{k:02d}" for k in range(9)]  # more than a byte of bits
    make = lambda k: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 10]) for _ in range(5)) for _ in range(30))
    rows = [(make(k), name) for k, name in enumerate(names) for _ in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert model.languages == names and model.slots * model.planes > 3 * 512
    counts = {name: collections.Counter() for name in names}
    for text, name in rows:
        counts[name].update(langid.ngrams([text])[0].tolist())
    totals = {name: sum(c.values()) for name, c in counts.items()}
    best = collections.defaultdict(float)
    for name, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / totals[name])
    weight = {name: {g: 1.0 if n / totals[name] >= langid.SHARE * best[g] else langid.SHARE for g, n in c.items()} for name, c in counts.items()}
    texts = [make(k) for k in range(9) for _ in range(4)]
    wrong = total = 0
    for text in texts:
        grams, doc, _ = langid.ngrams([text])
        exact = [sum(weight[name].get(g, 0.0) for g in grams.tolist()) for name in names]
        found = model.counts(grams, doc, 1)[0]
        assert max(abs(a - b) for a, b in zip(exact, found)) < 0.06 * len(grams)
        for k, name in enumerate(names):
            for g in set(grams.tolist()):
                held = model.counts(langid.np.array([g], langid.np.uint64), doc[:1], 1)[0, k] > 0
                assert held or g not in counts[name]
                wrong, total = wrong + (held and g not in counts[name]), total + (g not in counts[name])
    assert wrong < 0.02 * total
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    sure = 0
    for x in got:
        exact = [sum(weight[name].get(g, 0.0) for g in langid.ngrams([texts[x["doc_id"]]])[0].tolist()) for name in names]
        first, second = sorted(exact)[:-3:-1]
        if first > 1.2 * second:
            sure += 1
            assert x["lang_pred"] == names[exact.index(first)]
    assert sure > 20
