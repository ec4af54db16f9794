import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm import lm

SCHEMA = "doc_id long, text string, word string, score int"


def network(seed=3):
    net = lm.Network.fresh(np.random.default_rng(seed).random(lm.Network.symbols) * 9)
    net.flat[:] += np.random.default_rng(seed + 1).normal(0, 0.2, len(net.flat))
    return net


def test_probabilities_sum_to_one_and_gradients_are_right():
    net = network()
    states = np.random.default_rng(0).normal(size=(3, net.hidden)).astype(np.float32)
    for h in states:
        p = np.exp(net.log_probability(np.repeat(h[None], net.symbols, 0), np.arange(net.symbols)))
        assert abs(p.sum() - 1) < 1e-3
    rng = np.random.default_rng(5)
    inputs, targets = rng.integers(0, net.symbols, (4, 3)), rng.integers(0, net.symbols, (4, 3))
    mask = np.ones((4, 3), bool)
    mask[2:, 1] = False
    net = lm.Network(net.flat.astype(np.float64))
    state = rng.normal(size=(3, net.hidden))
    grad, _, _ = net.gradient(inputs, targets, mask, state)
    used = np.concatenate((np.flatnonzero(np.abs(grad.flat) > 1e-6)[:: max(1, np.count_nonzero(grad.flat) // 40)],))
    for k in used.tolist():
        losses = []
        for step in (1e-4, -1e-4):
            moved = lm.Network(net.flat.copy())
            moved.flat[k] += step
            losses.append(moved.gradient(inputs, targets, mask, state)[2] / mask.sum())
        assert abs((losses[0] - losses[1]) / 2e-4 - grad.flat[k]) < 2e-3 * max(0.1, abs(grad.flat[k]))


def test_state_runs_through_whole_documents_whatever_the_lanes():
    net, rng = network(), np.random.default_rng(8)
    texts = [np.r_[rng.integers(1, net.symbols, int(n)), 0] for n in (0, 1, 5, 300, 63, 64, 65, 128, 7)] + [np.zeros(0, np.int64)]
    want = []
    for t in texts:
        state, before, total = np.zeros((1, net.hidden), np.float32), 0, 0.0
        for s in t:
            state = net.step(np.array([before]), state)[0]
            total += net.log_probability(state, np.array([s]))[0]
            before = s
        want.append(total)
    for lanes in (1, 2, 512):
        assert np.allclose(lm.document_scores(net, texts, lanes), want, rtol=1e-4)


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.4, 40) if k < 500).upper(), "x", 1) for i in range(80)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, "never seen w1 never", "x", 1), (203, "w1 " * 30_000, "x", 1), (203, "w1 " * 30_000, "x", 1), (None, "w1", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = docs.where("doc_id < 60")
    counts = lm.word_counts(known).cache()
    vocab, net = lm.fit(known, counts, rounds=1, shared=20)  # most words come by the join
    got = {r.doc_id: r for r in lm.score(docs, counts, vocab, net).collect()}
    split = lambda t: (t or "").lower().split() + ["\n"]
    c = Counter(w for i, t, *_ in rows if i is not None and i < 60 for w in split(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == 84
    for i, t, *_ in rows[:-1]:
        r, w = got[i], split(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        symbols = vocab.encode((t or "").encode())[2]
        rare = [(c[x] + 1) / (vocab.rare_tokens[k] + vocab.rare_words[k] + 1) for x, s in zip(w[:-1], symbols) for k in [s - (net.symbols - lm.RARE)] if k >= 0]
        want = lm.document_scores(net, [symbols])[0] / math.log(10) + sum(map(math.log10, rare))
        assert abs(r.score - want) < 1e-3 * max(1, len(w) / 50)
    # All words of a form and one never seen share that form's probability.
    for k in range(lm.RARE):
        own = [x for x in c if x != "\n" and vocab.index.get(x.encode(), 10**9) >= vocab.named and lm.form(x.encode()) == k]
        assert abs(sum(c[x] + 1 for x in own) - vocab.rare_tokens[k] - vocab.rare_words[k]) < 1e-9


def test_training_reads_every_token_of_long_documents(spark):
    names = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(names), "x", 1), (2, "w1", "x", 1)], SCHEMA)
    vocab, net = lm.fit(docs, lm.word_counts(docs), rounds=1)
    weight = np.zeros(net.symbols)
    weight[0], weight[1 : vocab.named + 1], weight[-lm.RARE :] = 2, vocab.counts, vocab.rare_tokens
    moved = (net.x != lm.Network.fresh(weight).x).any(1)
    assert vocab.named == 3000 and moved[:3001].all() and not moved[3001:].any()
    texts = [np.r_[0, np.arange(1, n), 0] for n in (1, 2, 700, 40)]
    assert lm.train(network(), texts, passes=2) == 2 * sum(len(t) - 1 for t in texts) and lm.PASSES == 2


def test_texts_of_one_lane_keep_their_own_state():
    net, rng = lm.Network(network().flat.astype(np.float64)), np.random.default_rng(2)
    x = rng.integers(0, net.symbols, 8)
    apart, aims, mask = np.zeros((4, 2), np.int64), np.zeros((4, 2), np.int64), np.ones((4, 2), bool)
    apart[:3, 0], apart[:, 1], aims[:3, 0], aims[:, 1], mask[3, 0] = x[:3], x[3:7], x[1:4], x[4:8], False
    one, _, _ = net.gradient(apart, aims, mask, np.zeros((2, net.hidden)))
    fresh = np.zeros((7, 1), bool)
    fresh[[0, 3]] = True
    two, state, _ = net.gradient(x[:7, None], x[1:8, None], np.ones((7, 1), bool), np.ones((1, net.hidden)), fresh)
    assert np.allclose(one.flat, two.flat, atol=1e-6)


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    none = docs.limit(0)
    counts = lm.word_counts(none)
    vocab, net = lm.fit(none, counts)
    (row,) = lm.score(docs, counts, vocab, net).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0, 0)
    assert lm.score(none, counts, vocab, net).count() == 0


def test_better_than_unigrams_on_held_out_documents(spark):
    from llm.queries import QUERIES

    got = QUERIES["op5_lm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_repeated_rows_stay_repeated(spark):
    rows = [(k, f"a b c word{k % 3} tail") for k in range(20)] + [(3, "a b c word0 tail")] * 2 + [(50, "A b unseen"), (50, "A b unseen"), (51, None), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm.word_counts(docs.where("doc_id < 20"))
    vocab, net = lm.fit(docs.where("doc_id < 20"), counts, rounds=1)
    got = [tuple(r) for r in lm.score(docs, counts, vocab, net).collect()]
    assert sorted(r[0] for r in got) == sorted(k for k, _ in rows)
    for key in (3, 50, 51):
        same = [r for r in got if r[0] == key]
        assert len(same) >= 2 and all(np.allclose(r[1:], same[0][1:]) for r in same if r[1:4] == same[0][1:4])
