import random

import numpy as np
from tokenizers import Tokenizer

from llm import bpe

TEXTS = ["", "Hello  world!\n\n it's 2024 ", "<|endoftext|>a<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "漢字🙂 ñandú  x\x1c\x85\xa0y", "ab" * 3000, " " * 500, "'ll'LL don't"]


def library():
    return Tokenizer.from_file(bpe.vocabulary())


def test_same_ids_and_text_as_the_library():
    rng = random.Random(2)
    letters = list("abcdefghijklmnopqrstuvwxyzeeettaa   \n\t.,'019éñ漢🙂ü") + ["​", "\xa0", "<|endoftext|>", "\x00", "²", "́"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    own, lib = bpe.Codec(bpe.vocabulary()), library()
    for text, ids in zip(texts, own.encode_batch(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    assert own.verified > 1000 and own.failed > 100  # both ways are taken


def test_verification_agrees_with_merging_and_forgetting_changes_nothing(monkeypatch):
    own = bpe.Codec(bpe.vocabulary())
    words = [w.encode() for w in ("therein", "unbelievable", " reconstruct", " thsh", "xqzj")]
    for word, merged in zip(words, own._merge(words)):
        assert merged.tolist() == own._merge_long([own.byte_id[b] for b in word])
    monkeypatch.setattr(bpe, "MEMORY", 3)
    assert own.encode_batch(["one two three", "four five six"]) == bpe.Codec(bpe.vocabulary()).encode_batch(["one two three", "four five six"])


def test_frames_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", b"x", "i"), (1, "a b", b"x", "i"), (2, None, b"x", "i"), (None, "", b"x", "i"), (3, "w " * 40_000, b"x", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens string")
    path = bpe.vocabulary()
    trip = bpe.round_trip(docs, path, keep_ids=True).collect()
    assert len(trip) == 5 and {r.doc_id: r.n_tokens for r in trip} == {1: 2, 2: 0, None: 0, 3: 40_001}
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.round_trip(docs.limit(0), path).count() == 0
