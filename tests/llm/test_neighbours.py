import numpy as np

from llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, queries, k=5):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])}
    out = {}
    for q in queries:
        if q in good:
            scored = [(-float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), i) for i, v in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, "s") for i, v in rows], SCHEMA)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 8).tolist()) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4),
                                                          (2004, [float("inf")] * 8), (2005, [1.0]), (None, rows[1][1]), (2006, [])]
    vectors = frame(spark, rows + [rows[3]])
    got = nb.nearest(vectors, vectors.where("vec_id % 20 = 0"), block=64, leaf=16).collect()
    want = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0])
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys()
    for q, pairs in want.items():
        assert np.allclose([s for _, s in pairs], [s for _, s in found[q]], atol=1e-12) and len(pairs) == 5
    assert [i for i, _ in found[0]][:1] != [0] and [i for i, _ in found[1000]] == [i for i, _ in want[1000]]  # equal vectors, by key


def test_few_and_no_candidates(spark):
    vectors = frame(spark, [(0, [1, 0]), (1, [1, 1]), (2, [0, 2])])
    assert [(r.query_id, r.rank, r.vec_id) for r in nb.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nb.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
    assert nb.nearest(vectors.where("vec_id = 0"), vectors.where("vec_id = 0")).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    vectors = frame(spark, rows)
    got = nb.nearest(vectors, vectors.where("vec_id % 50 = 0"), visit=0, sample=1000, floor=200)
    want = brute(rows, range(0, 4000, 50))
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got.collect())
    assert hits / (5 * len(want)) >= 0.9
