"""The pipeline's stages one after another: on planted cases, and against plain Python that decides what each keeps."""

import collections
import itertools
import random
import re

import corpus_pipeline as p
from tablework.llm import quality
from tablework.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_secrets, prose, union_find


def test_stages(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(80))
    texts = [long, long + " more", other + "\npassword=abcdef123", "too short", None, " ".join(["same old phrase repeated over and over here"] * 20), "\n".join([" ".join(f"x{i}" for i in range(40)), long])]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    seen = []
    for name, f in p.STAGES:
        at = f(spark, at, str(tmp_path))
        if name != p.STAGES[-1][0]:
            assert at.columns == docs.columns
        seen.append({r["doc_id"]: r.asDict() for r in at.collect()} if name != p.STAGES[-1][0] else at.collect())
    assert set(seen[0]) == {r["doc_id"] for r in quality.quality(docs).where("kept").collect()} == {0, 1, 2, 6}
    # 1 is like 0 in its only line, 6 has 0's line as its second
    assert set(seen[1]) == {0, 2, 6} and seen[1][6]["text"] == " ".join(f"x{i}" for i in range(40))
    assert set(seen[2]) == {0, 2, 6}
    assert seen[3][2]["text"] == other + "\n[secret]" and seen[3][2]["n_chars"] == len(seen[3][2]["text"])
    assert {r["doc_id"] for r in seen[4]} == {0, 2, 6}
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(p.run(spark, str(tmp_path)).collect()) == key(seen[4])


def test_null_and_repeated_doc_ids(spark):
    text = lambda c, n=40: " ".join(f"{c}{i}{c}{c}" for i in range(n))
    clean, other, third = text("a"), text("b"), text("c")
    rows = [(None, clean), (None, "too short"), (7, other), (7, "short too"), (7, f"{third}\npassword=abcdef123"), (8, text("d"))]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good = [rows[0], rows[2], rows[4], rows[5]]
    assert key(p.quality_rules(spark, make(rows), "")) == sorted(good, key=str)
    assert key(p.near_dedup(spark, make([*good, good[0], good[1]]), "")) == sorted(good, key=str)
    cut = [(i, t.replace("password=abcdef123", "[secret]")) for i, t in good]
    assert key(p.secret_scan(spark, make(good), "")) == sorted(cut, key=str)
    # the line numbers of one row aren't taken for another's: the second line of one goes, that of the other stays
    two = [(7, f"{clean}\n{other}"), (7, f"{third}\n{text('e')}"), (6, other), (None, clean)]
    assert key(p.line_dedup(spark, make(two), "")) == sorted([(6, other), (7, clean), two[1]], key=str)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _passes(text):
    ws = _words(text)
    if len(ws) < 20:
        return False
    seen = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cover = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    longest = max((n for n in range(8, len(ws)) if len({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}) < len(ws) - n + 1), default=0)
    share = sum(len(ws[i]) for i in cover) / sum(map(len, ws))
    return 100 * len(cover) <= 30 * len(ws) and share <= quality.MOST_COVERED and not (longest > quality.LONG_WORDS and longest > quality.MOST_LONGEST * len(ws))


def _alike(sets):
    """Whose representative each is, linked from a Jaccard similarity of 0.8."""
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return union_find(sorted(sets), near)


def _without_repeated_lines(texts):
    own = {(i, k): re.sub(r"\s+", " ", x).strip().lower() for i, t in texts.items() for k, x in enumerate(t.split("\n")) if x.strip()}
    first = _alike({at: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for at, x in own.items()})
    out = {}
    for i, t in texts.items():
        rest = [x for k, x in enumerate(t.split("\n")) if (i, k) not in own or first[i, k] == (i, k)]
        if any(x.strip() for x in rest):
            out[i] = "\n".join(rest)
    return out


def _without_near_copies(texts):
    ws = {i: [w.lower() for w in _words(t)] for i, t in texts.items()}
    first = _alike({i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ws.items()})
    return {i: t for i, t in texts.items() if first[i] == i}


def _redacted(text):
    for _, a, b in sorted((x.split(":") for x in brute_secrets(text)), key=lambda x: -int(x[1])):
        text = text[: int(a)] + "[secret]" + text[int(b) :]
    return text


def test_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(21)
    base = ["\n".join(prose(r, r.randint(6, 25)) for _ in range(r.randint(2, 5))) for _ in range(12)]
    broken = lambda t: re.sub(r"\n", " ", t)
    shared = prose(r, 15)
    texts = [*base, *(broken(t) + " end" for t in base[:4]), *(broken(t) for t in base[2:6]), *(f"{shared}\n{prose(r, 30)}" for _ in range(3)), base[7]]
    texts += [f"{prose(r, 40)}\npassword=abcdef{k}xyz then {prose(r, 5)} AKIAABCDEFGHIJKLMNO{k}" for k in range(3)]
    texts += [None, "", "short", " ".join([prose(r, 12)] * 9), f"{prose(r, 70)} {'again and again the same nine words are here ' * 3}"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t for i, t in enumerate(texts) if _passes(t)}
    steps = [len(want)]
    for step in (_without_repeated_lines, _without_near_copies):
        want = step(want)
        steps.append(len(want))
    assert len(texts) > steps[0] > steps[1] > steps[2]
    library = Tokenizer.from_file(tokenizer_path())
    sizes = {i: len(library.encode(_redacted(t), add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {i for i, t in want.items() if _redacted(t) != t}
    found = p.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["piece"], x["length"]) for x in found) == sorted((i, 0, n) for i, n in sizes.items())
    assert len({x["sequence_id"] for x in found}) == -(-sum(sizes.values()) // 4096)
