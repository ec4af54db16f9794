import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm import prefixes as p

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, role or "", key, text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in sorted(full.items()):
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(full[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    """Conversations that share first turns, copies of one conversation, odd rows."""
    rng = np.random.default_rng(seed)
    said = ["hello there", "hello\tthere you", "", None, "what  is this", "no", "é è\x0b\x1cx", "one two three"]
    roles = ["user", "assistant", None, ""]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c + (c % 7) * 20, t if rng.random() > 0.05 else None, roles[int(rng.integers(2 if t else 1))], said[int(rng.integers(len(said)) if t > 1 else rng.integers(2))]))
    for c in range(1000, 1000 + n):  # one conversation, many copies
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", "hello there"), (c, 2, "assistant", "one two three")]
    rows += [(5000, t, "user", f"turn {t % 40}") for t in range(300)] + [(5001, t, "user", f"turn {t % 40}") for t in range(299)]
    rows += [(None, 0, "user", "lost"), (6013, 0, "user", "alone"), rows[0], (7000, 1, "", "x"), (7000, 1, None, "x"), (7000, 1, "a", None)]
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("seed, paths, ends", [(1, 50_000, 4_096), (2, 7, 16), (3, 1, 2)])
def test_same_as_brute_force(spark, seed, paths, ends):
    data = made(seed, 60)
    found = p.conversation_trie(spark.createDataFrame(data, SCHEMA).repartition(5), shard=paths, ends=ends)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(data)


def test_shards_cut_anywhere():
    """Nodes of a partition cut into shards of every size add up to the same counts."""
    rng = np.random.default_rng(0)
    key = lambda t: hashlib.md5(str(t).encode()).digest()
    paths = sorted({tuple(key(t) for t in rng.integers(0, 4, int(rng.integers(0, 6)))) for _ in range(120)})
    sums = []
    for size in (1, 2, 5, 1000):
        total = defaultdict(int)
        for at in range(0, len(paths), size):
            held = p._Shard()
            for n, path in enumerate(paths[at : at + size]):
                held.paths.append([{"key": k, "words": 3} for k in path]), held.n.append(2), held.least.append(at + n), held.ends.append("e")
            nodes = held.nodes()
            for prefix, n in zip(nodes["prefix"], nodes["n_convs"]):
                total[prefix or "whole"] += n
        sums.append(sum(total.values()))
    assert len(set(sums)) == 1 and sums[0] == sum(2 * (len(x) + 1) for x in paths)


@pytest.mark.parametrize("seed", range(6))
def test_double_array_holds_just_the_prefixes(seed):
    rng = np.random.default_rng(seed)
    wide = int(rng.integers(2, 400))
    paths = [tuple((rng.integers(0, wide, int(rng.integers(0, 9))) + 1).tolist()) for _ in range(300)]
    flat = np.array([t for x in paths for t in x], np.int64)
    trie = p.DoubleArray.pack(flat, np.concatenate(([0], np.cumsum([len(x) for x in paths]))))
    prefixes = {x[:d] for x in paths for d in range(len(x) + 1)}
    where = {}
    for prefix in prefixes:
        at = np.ones(1, np.int64)
        for t in prefix:
            at = trie.step(at, np.array([t]))
        assert at[0] > 0 and trie.depth[at[0]] == len(prefix)
        where[int(at[0])] = prefix
        for t in range(1, wide + 1):
            assert bool(trie.step(at, np.array([t]))[0]) == (prefix + (t,) in prefixes)
    assert len(where) == len(prefixes) == int((trie.check != 0).sum()) - 1


def test_empty_and_turnless(spark):
    assert p.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert p.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)).count() == 0
    data = [(c, 0, "user", "x", "", 1) for c in range(21, 40)]  # none has its group's first conversation
    found = p.conversation_trie(spark.createDataFrame(data, SCHEMA))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(data)
