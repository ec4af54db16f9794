"""Byte-level BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match. A token sequence is the one that
merging yields exactly when every adjacent pair is: if merging the two tokens' own bytes
gives just these two. Pairs are tested for all new words at once with array operations;
the words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow, raw

#: The word pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers; beyond that it forgets all and starts anew.
MEMORY = 200_000
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(0x100 + n)] = b
    return letters


class Codec:
    """Encodes and decodes with a vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = _byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        #: Order of the merge that makes a token; below all merges for single bytes.
        self.rank = np.full(size, -1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.rank[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, n
            self.merge.setdefault((i, j), (n, k))
        self.size = size
        keys = np.array([i * size + j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([n for n, _ in self.merge.values()], np.int64)[order]
        self._made = np.array([k for _, k in sorted(self.merge.values())], np.int64)
        if len(self._made) != len(merges):
            raise ValueError("a pair is merged twice")
        self.byte_id = [self.ids_of_byte(vocab, b, letters) for b in range(256)]
        whole = np.flatnonzero(self.rank >= 0)
        made = np.ones(size, bool)
        made[whole] = self.compatible(self.left[whole], self.right[whole], self.rank[whole])
        #: Tokens that merging their own bytes yields; no other can be proposed.
        self.token = {self.bytes_of[i]: i for i in vocab.values() if made[i]}
        self.longest = max(map(len, self.token), default=1)
        self.words = regex.compile(PATTERN)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.verified = self.failed = 0

    @staticmethod
    def ids_of_byte(vocab: dict[str, int], byte: int, letters: dict[str, int]) -> int:
        return next((vocab[c] for c, b in letters.items() if b == byte and c in vocab), -1)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of each a and b leaves the two apart (until rank ``before``).

        Seen backwards in time: the token merged last is taken apart into its halves, and
        the halves now at the border must not have been mergeable before that moment.
        """
        left, right = a.copy(), b.copy()
        until = np.full(len(a), _NEVER) if before is None else before.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = left[open_], right[open_]
            clash = self._pair_rank(x, y) < until[open_]
            good[open_[clash]] = False
            done = clash | ((self.rank[x] < 0) & (self.rank[y] < 0))
            open_, x, y = open_[~done], x[~done], y[~done]
            # Of equal ranks the left one is merged first, so the right one is taken apart.
            take_left = self.rank[x] > self.rank[y]
            until[open_] = np.where(take_left, self.rank[x], self.rank[y] + 1)
            left[open_] = np.where(take_left, self.right[x], x)
            right[open_] = np.where(take_left, y, self.left[y])
        return good

    def _propose(self, word: bytes) -> list[int]:
        token = self.token
        if word in token:
            return [token[word]]
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                i = token.get(word[at:end])
                if i is not None:
                    out.append(i)
                    at = end
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many words at once, for words whose proposal failed.

        Each round merges, in every word still open, all places of its best pair.
        """
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(words)
        for k, w in enumerate(words):
            if len(w) > 256:
                out[k] = np.array(self._merge_long([self.byte_id[b] for b in w]), "<u4")
        short = [k for k, w in enumerate(words) if 0 < len(w) <= 256]
        if not short:
            return out
        ids = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
        word = np.repeat(np.array(short), [len(words[k]) for k in short])
        ranks = np.full(len(ids), _NEVER)
        fresh = np.arange(len(ids) - 1)
        while len(ids):
            fresh = fresh[word[fresh] == word[fresh + 1]]
            ranks[fresh] = self._pair_rank(ids[fresh], ids[fresh + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(ranks, starts)
            for n in np.flatnonzero(best == _NEVER).tolist():
                out[word[starts[n]]] = ids[starts[n] : starts[n] + lengths[n]].astype("<u4")
            best = np.repeat(best, lengths)
            open_ = best != _NEVER
            hit = open_ & (ranks == best)
            at = np.flatnonzero(hit)
            if len(at):  # of places that overlap, every other one from the left
                run = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            ids[at] = self._made[best[at]]
            keep = open_
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            fresh = moved[at]
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            ranks[fresh] = _NEVER
            fresh = np.unique(np.r_[fresh - 1, fresh])
            fresh = fresh[(fresh >= 0) & (fresh < len(ids) - 1)]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word, over linked positions and a heap."""
        n = len(ids)
        after, ahead, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(*self.merge[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heap = [(r, k, new, a, b) for r, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[j] >= 0:
                ahead[after[j]] = k
            for p, q in ((ahead[k], k), (k, after[k])):
                if p >= 0 and q >= 0 and (ids[p], ids[q]) in self.merge:
                    r, m = self.merge[ids[p], ids[q]]
                    heapq.heappush(heap, (r, p, m, ids[p], ids[q]))
        return [i for i, a in zip(ids, alive) if a]

    def learn(self, words) -> None:
        """Encode words not known yet and remember them as little-endian ids."""
        raws = [w.encode() for w in words]
        proposals = [self._propose(w) for w in raws]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(proposals)), lengths)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.size, pairs % self.size)[where]
        failed = np.unique(word[inner[wrong]]).tolist()
        self.verified, self.failed = self.verified + len(raws) - len(failed), self.failed + len(failed)
        ids = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(lengths)).tolist()
        self.known.update(zip(words, [ids[a:b] for a, b in zip([0, *ends], ends)]))
        for k, found in zip(failed, self._merge([raws[k] for k in failed])):
            self.known[words[k]] = found.tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        pieces = [[p] if not self.split else self.split.split(p) for p in (t or "" for t in texts)]
        found = [[p if p in self.added else self.words.findall(p) for p in parts if p] for parts in pieces]
        new = {w for parts in found for p in parts if not isinstance(p, str) for w in p if w not in self.known}
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = {w for parts in found for p in parts if not isinstance(p, str) for w in p}
        if new:
            self.learn(list(new))
        known = self.known
        return [b"".join([np.uint32(self.added[p]).astype("<u4").tobytes() if isinstance(p, str) else b"".join([known[w] for w in p])
                          for p in parts]) for parts in found]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    return Codec(path)


def _forget(path: str):
    """What ends a task: the codec stays, the words that it remembers go."""
    return lambda: codec(path).known.clear()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): each whole text's token ids as little-endian unsigned 32-bit integers.

    ``path`` is the vocabulary file, present on every executor. A null or empty text has
    no ids. Repeated rows come out repeated, a null key stays null. Other columns are
    ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("#text")), run,
                     f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary", rows=256, done=_forget(path))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text) of an encoded table; null ids give a null text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else codec(path).decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_arrow(encoded.select(key, F.col(ids).alias("#ids")), run,
                     f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string", rows=256)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded again.

    With ``keep_ids`` also the ids themselves, as an array.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path)
        ids = coder.encode_batch(batch.column(1).to_pylist())
        columns = {
            key: batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        }
        if keep_ids:
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("#text")), run,
                     f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                     + ", ids array<int>" * keep_ids, rows=256, done=_forget(path))
