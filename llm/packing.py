"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A sequence is filled greedily, the longest piece that fits first. While it has a gap, its
smallest piece is taken out and replaced by the two unpacked pieces that fill the widened
gap best. Which pieces these are depends on the number of unpacked pieces of each length
alone, so the plan is made from that histogram (as many numbers as the capacity, whatever
the table's size): a filling is repeated for as long as its lengths last. Every piece finds
its place by its length and its number among the pieces of that length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import durable, map_arrow

CAPACITY = 2048
#: The id that ends every document.
END = 0
#: Chunks of text whose ids a task remembers; beyond that it forgets all and starts anew.
MEMORY = 500_000
#: Texts encoded at a time.
BATCH = 500
#: Bits of a piece's number among those of its length.
_NUMBER = 48


# -- token ids -----------------------------------------------------------------------


class Merger:
    """Merges many words at once by a vocabulary with word ends, in rounds of array operations."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(other)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the merge of each pair; as many as there are merges where there is none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], len(self.keys))

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers. No word may be empty.

        A round merges every word's earliest merge wherever the word has it, of overlapping
        places the left one; a merge made of merges comes after them, so that rounds and
        single steps agree.
        """
        none = len(self.keys)
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.inner[data], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[data[ends]]
        done_ids, done_words = [], []
        while len(ids):
            ranks = np.full(len(ids), none)
            ranks[:-1] = np.where(word[1:] == word[:-1], self.rank(ids[:-1], ids[1:]), none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(ids)])
            best = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            still = best == none
            done_ids.append(ids[still]), done_words.append(word[still])
            at = np.flatnonzero((ranks == best) & ~still)
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1]) if len(at) else at
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))) % 2 == 0]
            ids[at] = self.made[best[at]]
            keep = ~still
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        flat, word = np.concatenate(done_ids), np.concatenate(done_words)
        raw_ids = flat[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw_ids[a:b] for a, b in zip([0, *stops], stops)]


#: The pattern of words that the fast way below follows (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of ASCII and of Latin letters that stay as they are when composed, and the pattern on them, lower-cased.
_PLAIN = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\t-\\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Words beyond this are left to the library.
_LONG = 256


class Encoder:
    """Token ids of whole texts; a word, or a run between ASCII white space, is encoded once.

    For vocabularies that drop white space and let no token span it, as the one with word
    ends does: the ids of a text are those of its runs, one after another. Plain texts are
    split into words and merged here, many at once; runs of others go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        split = data["pre_tokenizer"]["pretokenizers"][0] if data["pre_tokenizer"]["type"] == "Sequence" else {}
        self.merger = Merger(data["model"]) if split.get("pattern") == {"Regex": PATTERN} else None
        self.added = [t["content"] for t in data["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers; null is empty."""
        if len(self.known) + len(self.words) > MEMORY:
            self.forget()
        parts = [_WORDS.findall(t.lower()) if self._plain(t) else t.encode().split() for t in (t or "" for t in texts)]
        words, runs = set(), set()
        for found in parts:
            if found:
                (words if isinstance(found[0], str) else runs).update(found)
        self._learn(words - self.words.keys(), runs - self.known.keys())
        of = {str: self.words.__getitem__, bytes: self.known.__getitem__}
        return [b"".join(map(of[type(found[0])], found)) if found else b"" for found in parts]

    def _plain(self, text: str) -> bool:
        return self.merger is not None and bool(_PLAIN.fullmatch(text)) and not any(a in text for a in self.added)

    def _learn(self, words: set[str], runs: set[bytes]) -> None:
        short = [w for w in words if len(w) <= _LONG]
        if short:
            self.words.update(zip(short, self.merger.ids([w.encode() for w in short])))
        other = [*(w for w in words if len(w) > _LONG), *runs]
        found = self.model.encode_batch_fast([w if isinstance(w, str) else w.decode() for w in other], add_special_tokens=False) if other else []
        for w, e in zip(other, found):
            (self.words if isinstance(w, str) else self.known)[w] = np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
           keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, task, nth): every document's ids and ``end``, cut at ``capacity``.

    ``task`` is the task that made the row and ``nth`` counts that task's earlier rows of
    the same length: together with the number of such rows in tasks before it, a piece's
    number among all of its length. To be written before it is read twice. With ``keep_ids``
    also the ids, as little-endian unsigned 32-bit integers.
    """
    stop = np.uint32(end).astype("<u4").tobytes()

    def run(batches):
        coder, seen, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    rows: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "nth", "ids")}
                    for row, ids in enumerate(coder.encode_batch(part.column(1).to_pylist())):
                        ids += stop
                        for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                            cut = ids[4 * start : 4 * (start + capacity)]
                            n = len(cut) // 4
                            for name, value in zip(rows, (row, piece, start, n, zlib.crc32(cut), int(seen[n]), cut if keep_ids else b"")):
                                rows[name].append(value)
                            seen[n] += 1
                    columns = [part.column(0).take(pa.array(rows.pop("row"), pa.int32()))]
                    cuts = rows.pop("ids")
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    columns += [pa.array(v, t) for v, t in zip(rows.values(), kinds)]
                    columns.append(pa.array([task] * len(cuts), pa.int32()))
                    names = [key, *rows, "task"]
                    if keep_ids:
                        columns.append(pa.array(cuts, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            coder.forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("#text")).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int" + ", ids binary" * keep_ids)


# -- the plan ------------------------------------------------------------------------


@dataclass
class Run:
    """Pieces first .. first + n - 1 of a length: ``per`` a sequence, from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    n: int
    per: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go, from the number of pieces of each length.

    The same sequences as packing one after another: the next filling is repeated while
    its lengths last, because nothing it chose has run out and nothing else was added.
    Each round halves what is left of some length at least, so that the number of rounds
    is bounded by the capacity (12 for each length at 2048), not by the number of pieces.
    """
    left = {n: int(c) for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than a sequence")
    lengths, used, runs, sequence = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        filling = fill(lengths, left, capacity)
        per: dict[int, int] = {}
        for n in filling:
            per[n] = per.get(n, 0) + 1
        times = min(left[n] // k for n, k in per.items())
        offset = 0
        for n, k in per.items():
            runs.append(Run(n, used[n], k * times, k, sequence, offset))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                lengths.remove(n)
        sequence += times
    return runs


def fill(lengths: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """The lengths of the next sequence, ascending; ``lengths`` are the sorted ones with pieces left."""
    taken: dict[int, int] = {}
    free = lambda n: left[n] - taken.get(n, 0)
    filling: list[int] = []
    gap, at = capacity, bisect_right(lengths, capacity)
    while at:
        n = lengths[at - 1]
        if n > gap:
            at = bisect_right(lengths, gap, 0, at)
        elif not free(n):
            at -= 1
        else:
            taken[n] = taken.get(n, 0) + 1
            insort(filling, n)
            gap -= n
    while gap:
        pair = two(lengths, free, filling[0], gap + filling[0])
        if pair is None:
            break
        gap += filling[0] - sum(pair)
        taken[filling.pop(0)] -= 1
        for n in pair:
            taken[n] = taken.get(n, 0) + 1
            insort(filling, n)
    return filling


def two(lengths: list[int], free, smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of largest sum above ``smallest`` and within ``room``, if any."""
    best, pair, low, high = smallest, None, 0, bisect_right(lengths, room) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if not free(lengths[low]):
            low += 1
        elif not free(lengths[high]):
            high -= 1
        elif total > room or (low == high and free(lengths[low]) < 2):
            high -= 1
        else:
            if total > best:
                best, pair = total, (lengths[low], lengths[high])
                if total == room:
                    break
            low += 1
    return pair


# -- places --------------------------------------------------------------------------


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a written table of pieces with sequence_id and offset instead of task and nth."""
    spark = cut.sparkSession
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most one row for each task and length, whichever lengths are frequent.
    before = durable(counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))))
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(totals, capacity), key=lambda r: (r.length, r.first))
    fields = {f: np.array([getattr(r, f) for r in runs], np.int64) for f in Run.__annotations__}
    shared = spark.sparkContext.broadcast(fields)

    def locate(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = shared.value
        length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
        at = np.searchsorted((runs["length"] << _NUMBER) + runs["first"], (length << _NUMBER) + number, "right") - 1
        k, per = number - runs["first"][at], runs["per"][at]
        found = {"sequence_id": runs["sequence"][at] + k // per, "offset": runs["offset"][at] + k % per * length}
        keep = [c for c in batch.schema.names if c not in ("nth", "task")]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(v, pa.int64()) for v in found.values())], [*keep, *found])

    numbered = cut.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("#before")), ["task", "length"]).select(
        *[(F.col("nth") + F.col("#before")).alias("nth") if c == "nth" else F.col(f"`{c}`") for c in cut.columns])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("nth", "task"))
    return map_arrow(numbered, locate, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
         keep_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``capacity`` ids.

    ``path`` is the vocabulary file, present on every executor. A document is its ids and
    one ``end``; only documents beyond ``capacity`` are cut, into pieces of that length and
    a last one. The pieces of a sequence lie gapless from offset 0.

    Null and empty texts are one ``end``. Every row is a document, repeated rows too; a null
    key stays null. Other columns are ignored. An empty table gives no rows. One length that
    most pieces share is spread over all tasks.
    """
    return place(durable(pieces(docs, path, key, text, capacity, end, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, length, ids): the sequences themselves, from pieces packed with ``keep_ids``.

    A group holds at most a sequence's worth of ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate(F.expr("transform(parts, x -> x.ids)"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
