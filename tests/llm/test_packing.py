import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import packing as p

KINDS = "doc_id long, text string, task int, length int"


def one_by_one(counts, capacity):
    """The same packing without repeating a filling: one sequence after another."""
    left, out = Counter({n: c for n, c in counts.items() if c}), []
    while +left:
        free = sorted((+left).elements(), reverse=True)
        filling, gap = [], capacity
        for n in free:
            if n <= gap:
                filling.append(n)
                gap -= n
        left.subtract(filling)
        while gap:
            small = min(filling)
            lengths = sorted(+left)
            pairs = [(a + b, a, b) for i, a in enumerate(lengths) for b in lengths[i:]
                     if small < a + b <= gap + small and (a != b or left[a] > 1)]
            if not pairs:
                break
            total = max(pairs)[0]
            _, a, b = min(x for x in pairs if x[0] == total)
            filling.remove(small)
            left[small] += 1
            filling += [a, b]
            left.subtract([a, b])
            gap += small - a - b
        out.append(sorted(filling))
    return sorted(out)


def laid_out(runs):
    """The sequences that a plan describes, and a check that pieces lie gapless."""
    found = defaultdict(list)
    for r in runs:
        for k in range(r.n):
            found[r.sequence + k // r.per].append((r.offset + k % r.per * r.length, r.length))
    for parts in found.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
    return sorted(sorted(n for _, n in parts) for parts in found.values())


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_as_one_after_another(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 60))
    counts = Counter(rng.integers(1, capacity + 1, int(rng.integers(0, 150))).tolist())
    counts[int(rng.integers(1, capacity + 1))] += 60  # a length that many share
    runs = p.plan(counts, capacity)
    assert laid_out(runs) == one_by_one(counts, capacity)
    for n, c in counts.items():  # every number of a length once
        assert sorted(i for r in runs if r.length == n for i in range(r.first, r.first + r.n)) == list(range(c))


def test_two_smaller_pieces_replace_one():
    # Greedy fills 6 + 3 of 10; 3 gives way to 2 + 2.
    assert p.fill([2, 3, 6], {2: 2, 3: 1, 6: 1}, 10) == [2, 2, 6]
    assert p.plan({}) == []
    with pytest.raises(ValueError):
        p.plan({11: 1}, 10)


def test_plan_grows_with_the_capacity_alone():
    rng = np.random.default_rng(1)
    shape = rng.integers(1, 2049, 4000)
    small = p.plan(Counter(shape.tolist()))
    large = p.plan({n: 10**6 * c for n, c in Counter(shape.tolist()).items()})
    assert len(large) < 12 * 2048
    size = lambda runs: max(r.sequence + (r.n - 1) // r.per for r in runs) + 1
    assert size(small) <= 1.03 * np.ceil(shape.sum() / 2048) and size(large) <= 1.03 * np.ceil(10**6 * shape.sum() / 2048)
    usual = np.clip(np.exp(rng.normal(6.3, 1, 20_000)).astype(int), 1, 2048)
    assert size(p.plan(Counter(usual.tolist()))) <= 1.001 * np.ceil(usual.sum() / 2048)


TEXTS = ["Hello there, it's 2024!", "", None, "  a\tb\n\nc \x1c d e f ", "<|endoftext|>x <|startoftext|>", "ÀÉÎ ΑΣ ΟΔΟΣ. é ́x İstanbul",
         "word " * 5000, "it's we've I'd'll 's", "日本語テキスト 🙂🙂", "a" * 3000]


def test_ids_are_the_library_s():
    model = Tokenizer.from_file(p.vocabulary())
    expected = [np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    assert p.Encoder(p.vocabulary()).encode_batch(TEXTS) == expected


def test_merging_at_once_is_the_library_s():
    rng = np.random.default_rng(2)
    letters = np.array(list("aaabcdeeeinorsttuvwxyz'.-,!?<|>0123456789ABCÀÉßñÿ×ÞŒǅ´\u0301\xa0\x1c"))
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 20)))) for _ in range(4000)]
    texts += ["".join(rng.choice(letters[:20], int(rng.integers(1, 300)))) for _ in range(200)]
    texts += ["aaaa" * k for k in range(1, 40)] + ["it's 'll''s x'S d'D", "<|startoftext|>'s", "ǅ", "\x1cx", "É́"]
    model = Tokenizer.from_file(p.vocabulary())
    expected = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert p.Encoder(p.vocabulary()).encode_batch(texts) == expected


def packed_rows(spark, texts, capacity, parts=3):
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], KINDS).repartition(parts)
    return docs, p.pack(docs, p.vocabulary(), capacity=capacity, keep_ids=True)


@pytest.mark.parametrize("capacity", (7, 64))
def test_whole_texts_are_packed(spark, capacity):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta's", "42"]
    texts = [(k, " ".join(rng.choice(words, int(rng.integers(0, 2 * capacity))))) for k in range(150)]
    texts += [(1000 + k, "copy of one text") for k in range(80)] + [(2000 + k, t) for k, t in enumerate(TEXTS)]
    texts += [(1000, "copy of one text"), (None, "no key")]
    docs, packed = packed_rows(spark, texts, capacity)
    rows = packed.collect()
    model = Tokenizer.from_file(p.vocabulary())
    expected = Counter()
    for k, t in texts:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            expected[k, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for parts in found.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity
    # The number of sequences of the plain procedure.
    assert sorted(sorted(n for _, n in x) for x in found.values()) == one_by_one(Counter(r.length for r in rows), capacity)
    whole = {r.sequence_id: bytes(r.ids) for r in p.sequences(packed).collect()}
    for r in rows:
        assert bytes(r.ids) == whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]


def test_empty_table(spark):
    docs, packed = packed_rows(spark, [], 16)
    assert packed.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id"] and packed.count() == 0
