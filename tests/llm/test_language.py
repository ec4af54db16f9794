import numpy as np

from llm import language as lang

SPACE = (512, 3, 1)


def test_bound_vectors_and_bundles():
    space = lang.Space(*SPACE)
    keys, counts = space.counts("Ab, ab")
    bits = space.bits
    pack = lambda s: sum(ord(c) << (bits * (2 - i)) for i, c in enumerate(s))
    assert dict(zip(keys.tolist(), counts.tolist())) == {pack(" ab"): 2, pack("ab "): 2, pack("b a"): 1}
    want = sum(n * np.roll(space.letter(ord(w[0])), 2) * np.roll(space.letter(ord(w[1])), 1) * space.letter(ord(w[2])) for w, n in ((" ab", 2), ("ab ", 2), ("b a", 1)))
    assert np.array_equal(space.bundle(keys, counts), want)
    assert [len(space.counts(t)[0]) for t in ("", " 1, 2!", "x")] == [0, 0, 1]


def test_predictions_nulls_letterless_and_repeats(spark):
    en, de = "the cat sat on the mat and then it went there", "der hund und die katze sind nicht hier gewesen über"
    rows = [(k, (en if k % 2 else de) + f" {k}", "en" if k % 2 else "de", 1.0) for k in range(30)] + [(50, None, "en", 1.0), (51, "12 !?", "de", 1.0), (52, "the and", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = lang.profiles(docs, space=SPACE)
    assert list(known) == ["de", "en"] and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in known.values())
    tests = [(1, "then the mat", "x"), (2, "nicht über die", "x"), (3, None, "x"), (4, "", "x"), (5, "42", "x"), (5, "42", "x"), (None, "the cat " * 20_000, "x")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(spark.createDataFrame(tests, "doc_id long, text string, lang_pred string"), known, space=SPACE).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en"}
    assert got[3][1] == 0 and all(0 <= v[1] <= 1 for v in got.values())
    nothing = lang.profiles(docs.limit(0), space=SPACE)
    assert nothing == {} and {r.lang_pred for r in lang.identify(docs, nothing, space=SPACE).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["op7_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang and r.text and len(r.text) > 100]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
