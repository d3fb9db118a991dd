"""Packing's encoders: no pass over the texts before encoding, and words remembered from task to task."""

import random

from tablework.llm import bpe, packing
from tablework.llm.queries import tokenizer_path


def test_pack_counts_no_words_first(spark, monkeypatch):
    """What made op5 fail: all texts were read once more, to count their words, than encoding them needs."""
    from tokenizers import Tokenizer

    def counted(*_):
        raise AssertionError("words were counted")

    monkeypatch.setattr(bpe, "frequent_words", counted)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgàß漢") for _ in range(r.randint(1, 12)))
    texts = [None, "", *(" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(60))]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7), tokenizer_path(), capacity=64).collect()
    library = Tokenizer.from_file(tokenizer_path())
    sizes = {}
    for x in found:
        sizes[x["doc_id"]] = sizes.get(x["doc_id"], 0) + x["length"]
    assert sizes == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_encoders_are_kept_for_one_key_alone():
    v = bpe.Vocabulary.load(tokenizer_path())
    made = []

    def make():
        made.append(bpe.Encoder(v, bpe.Lexicon.build([], [])))
        return made[-1]

    first = bpe.kept_encoder("a", make)
    ids, _ = first.encode(["some words here"])
    assert bpe.kept_encoder("a", make) is first and "words" in first.known and first.encode(["some words here"])[0].tolist() == ids.tolist()
    assert bpe.kept_encoder("b", make) is not first and list(bpe._KEPT) == ["b"] and len(made) == 2
