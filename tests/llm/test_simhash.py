import numpy as np
import xxhash

from llm import simhash
from llm.common import durable

SCHEMA = "doc_id long, text string, key string, fp int, component_id string"


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    keys = sorted(fps)
    of = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if of[a] > of[b] and bin(fps[a] ^ fps[b]).count("1") <= 3:
                    of[a], changed = of[b], True
    return of


def test_fingerprint_matches_the_definition():
    for text in ("", None, " \n", "one", "One  TWO", "a b c", "a b c d e a b c", "Ä ä ÉÉ x y z", "w " * 500):
        assert simhash.fingerprint(None if text is None else text.encode()) & (2**64 - 1) == slow_fingerprint(text), text


def test_links_find_every_pair_of_three_bits_or_fewer(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = set(base.tolist()) | {0, -1, 7}
    for b in base[:8]:
        for k in (1, 2, 3, 3, 4, 5):
            fps.add(int(np.int64(b) ^ np.bitwise_xor.reduce(np.int64(1) << rng.choice(64, k, replace=False).astype(np.int64))))
    fps = sorted(fps)
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert {tuple(sorted(r)) for r in got} == want and len(want) > 20


def test_index_of_links_is_not_broadcast_however_small_it_is_taken_to_be(spark):
    fps = durable(spark.createDataFrame([(i,) for i in range(50)], "fp long"))
    found = simhash.links(fps)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_chains_ties_nulls_and_other_columns(spark):
    texts = {5: "", 9: None, 3: "the same words here now", 4: "the same words here now", 8: "The SAME words\there\nnow", 2: "alone", 1: "x " * 3000}
    rows = [(k, t, "k", 1, "c") for k, t in texts.items()] + [(None, "alone", "k", 1, "c"), (3, texts[3], "k", 1, "c")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 8  # the repeated row comes out repeated, the row without a key does not
    want = slow_components({k: slow_fingerprint(t) for k, t in texts.items()})
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.fingerprint for r in found}[5] == "0" * 16 and want[9] == 5
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 5]
    assert kept.columns == ["doc_id", "text", "key", "fp", "component_id"]


def test_chain_longer_than_one_link(spark):
    from llm.components import components

    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(3, 3), (None, 2), (100, 101), (101, 100)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(100, 100), (101, 100)}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
