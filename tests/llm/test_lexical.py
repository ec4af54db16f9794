import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import lexical as x

DOCS, ITEMS = "doc_id long, text string, item_id int, rank string", "item_id long, text string, doc_id int"


def split(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    counted = [(i, Counter(split(t))) for i, t in docs if i is not None]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in set(items):
        if item is None:
            continue
        scores = []
        for doc, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // length
            score = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(split(text)) if w in c)
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(300)] + ["É", "ñandú", "X9", "the", "of"])
    chance = 1 / np.arange(1, len(words) + 1)
    text = lambda k: " ".join(rng.choice(words[::-1], k, p=chance / chance.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)]
    docs += [(n + i, "the same, copy of w1 W2 w3!") for i in range(40)]
    docs += [(9001, None), (9002, ""), (9003, "--- ?"), (9004, "w1 " * 5000), (9005, text(8000)), (None, "w1 w2")]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "no_such_term_anywhere"), (53, "The SAME copy of W2"), (54, " ".join(words)), (None, "w1"), (3, items[3][1]), (4, "w7 w8")]
    return docs, items


@pytest.mark.parametrize("k", (3, 50))
def test_same_as_scoring_everything(spark, k):
    docs, items = made(1, 300)
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    rows = x.search(frame, asked, k)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in rows.collect()) == brute(docs, items, k)


def test_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK", 5)
    docs, items = made(2, 120)
    docs += docs[:10]  # repeated rows are documents of their own
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], DOCS).repartition(40)
    asked = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    assert sorted(tuple(r) for r in x.search(frame, asked, 7).collect()) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "w1", 1)], ITEMS)
    assert x.search(docs, some).count() == 0
    assert x.search(spark.createDataFrame([(1, "w1", 1, "r")], DOCS), items).count() == 0


def shard_of(docs, wanted=lambda w: True):
    held = x._Collector(wanted)
    for i, t in docs:
        held.add(i, t.encode())
    c = {name: v[0] for name, v in held.columns(0).items()}
    sizes = np.frombuffer(c["sizes"], "<i8")
    return x.Shard(c["ids"], sizes, c["terms"], np.array(c["df"]), np.frombuffer(c["at"], "<u2"), np.frombuffer(c["tf"], "<u4"), len(sizes), int(sizes.sum()))


def test_greatest_of_any_stretch():
    shard = shard_of([d for d in made(3, 200)[0] if d[0] is not None and d[1]])
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = int(rng.integers(len(shard.starts) - 1))
        lo, hi = sorted(rng.integers(shard.starts[t], shard.starts[t + 1] + 1, 2).tolist())
        value, doc = shard._greatest(np.array([[lo]]), np.array([[hi]]), np.array([3]))
        part = shard.impact[lo:hi]
        assert value[0] == 3 * part.max(initial=0)
        if hi > lo:
            assert doc[0] == shard.at[lo + part.argmax()]


def test_bounds_spare_documents():
    """With rare terms most documents are never scored."""
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"r{j}" for j in rng.integers(0, 3000, 40)) + " common words here") for i in range(4000)]
    shard = shard_of(docs)
    best, scored = shard.search([b"r1", b"r2", b"common", b"here"], [5000, 5000, 1, 1], 5)
    assert len(best) == 5 and scored < 400


def test_oracle_agrees(spark, write):
    import duckdb

    from llm.queries import ORACLES, QUERIES
    docs, items = made(5, 150)
    docs = [d for d in docs if d[0] is not None]
    items = [i for i in items if i != (4, "w7 w8") and i[0] is not None]
    folder = write(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    ours = defaultdict(list)
    for r in QUERIES["op12_lexical"](spark, folder).collect():
        ours[r.item_id].append((r["rank"], r.doc_id, r.score))
    theirs = defaultdict(list)
    for item, rank, doc, score in db.sql(ORACLES["op12_lexical"]).fetchall():
        theirs[item].append((rank, doc, score))
    assert {i: sorted(v) for i, v in ours.items()} == {i: sorted(v) for i, v in theirs.items()}
