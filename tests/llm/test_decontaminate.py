import re

import numpy as np

from llm import decontaminate as d


def brute(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = {}
    for key, text in docs:
        words, hit, found = split(text), set(), set()
        for item, other in items:
            w = split(other)
            n = min(13, len(w))
            for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ():
                for i in range(len(words) - n + 1):
                    if tuple(words[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[key] = (len(words), len(hit), sorted(found))
    return out


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 40, k))
    items = [(i, word(int(n))) for i, n in enumerate((30, 13, 14, 12, 5, 1, 60, 25))] + [(20, None), (21, "--- !"), (7, word(20)), (22, "é É, ñ-x9")]
    docs = []
    for k in range(40):
        parts = [word(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            source = items[int(rng.integers(len(items)))][1] or ""
            w = source.split()
            a = int(rng.integers(0, max(1, len(w) - 12)))
            parts += [" ".join(w[a : a + int(rng.integers(5, 30))]).upper(), word(int(rng.integers(0, 9)))]
        docs.append((k, ", ".join(parts)))
    docs += [(50, ""), (51, None), (52, "w1 " * 4000), (53, items[0][1] + " " + items[0][1]), (54, "é É ñ X9")]
    frame = spark.createDataFrame([(*r, "e", 1) for r in docs] + [(None, "w1", "e", 1), (53, docs[-2][1], "e", 1)], "doc_id long, text string, item_id string, n_words int")
    bench = spark.createDataFrame([(*r, 1) for r in items] + [(None, "w1", 1)], "item_id long, text string, doc_id int")
    got = d.contamination(frame, bench).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == brute(docs, items)


def test_every_long_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(50):
        shared = rng.integers(0, 2**40, 7).astype(np.uint64)  # the grams of 13 shared words
        a, b = (np.concatenate((rng.integers(0, 2**40, k).astype(np.uint64), shared, rng.integers(0, 2**40, 9).astype(np.uint64))) for k in (4, 11))
        assert set(a[d.winnow(a, 7)]) & set(b[d.winnow(b, 7)]) & set(shared)
    assert len(d.winnow(np.zeros(20, np.uint64), 7)) == 14 and len(d.winnow(np.zeros(3, np.uint64), 7)) == 0


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    text = " ".join(f"x{i}" for i in range(13))
    rows = [(1, text, 5), (2, text + " y" * 300, 5), (3, "clean", 5), (None, text, 5), (4, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    kept = d.decontaminate(docs, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, none).count() == 5
    assert d.contamination(docs.limit(0), none).count() == 0
