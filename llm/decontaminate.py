"""Benchmark contamination by winnowed fingerprints, extended to whole shared windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable, map_arrow, raw, span_hashes

WINDOW = 13
#: Words in a fingerprinted gram: any shared span of 2 * GRAM - 1 = WINDOW words holds a chosen gram.
GRAM = 7
#: Bits of the fixed-size filter that every task gets: 2 MB whatever the benchmark's size.
FILTER_BITS = 24

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_CANDIDATES = "array<struct<n:int,hash:long,words:binary,lead:int,at:array<int>>>"


class Words:
    """The words of a text, one space apart, with the offsets of each."""

    def __init__(self, text: bytes | None):
        self.data = b" ".join((text or b"").translate(_FOLD).split())
        codes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(codes == 32)
        self.n = len(gaps) + 1 if self.data else 0
        self.starts = np.concatenate(([0], gaps + 1)) if self.data else np.zeros(0, np.int64)
        self.ends = np.concatenate((gaps, [len(codes)])) if self.data else np.zeros(0, np.int64)

    def span(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first] : self.ends[last]]

    def grams(self, n: int) -> np.ndarray:
        if self.n < n:
            return np.zeros(0, np.uint64)
        return span_hashes(self.data, self.starts[: self.n - n + 1], self.ends[n - 1 :])


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every ``window`` consecutive ones, the last of equals."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    at = np.arange(len(hashes))
    best, span = at, 1
    while span < window:  # a minimum over 2, 4, ... and at last ``window`` grams
        step = min(span, window - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    return np.unique(best)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _candidates(words: Words, lengths: list[int], bitmap: np.ndarray | None, window: int, gram: int) -> list[dict]:
    """Chosen grams and short spans that the filter lets through, equal ones together.

    A chosen gram carries the up to window - gram words on either side: every window
    that holds the gram lies within.
    """
    found: dict[tuple, list[int]] = defaultdict(list)
    for n in [0, *lengths]:
        hashes = words.grams(n or gram)
        at = np.arange(len(hashes)) if n else winnow(hashes, window - gram + 1)
        if bitmap is not None and len(at):
            slots = _slots(hashes[at])
            at = at[(bitmap[slots >> 3] >> (slots & 7)) & 1 == 1]
        reach = 0 if n else window - gram
        for p in at.tolist():
            first, last = max(0, p - reach), min(words.n, p + (n or gram) + reach) - 1
            found[n, int(hashes[p].astype(np.int64)), words.span(first, last), p - first].append(p)
    return [{"n": n, "hash": h, "words": w, "lead": lead, "at": at} for (n, h, w, lead), at in found.items()]


def _run(words: list[bytes], lead: int, other: list[bytes], other_lead: int, gram: int) -> tuple[int, int]:
    """Words that agree before the gram and from its start on; (0, 0) if the gram itself differs."""
    back = 0
    while back < min(lead, other_lead) and words[lead - back - 1] == other[other_lead - back - 1]:
        back += 1
    on = 0
    while lead + on < len(words) and other_lead + on < len(other) and words[lead + on] == other[other_lead + on]:
        on += 1
    return (back, on) if on >= gram else (0, 0)


def _verify(window: int, gram: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, length = [], []
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "words", "lead", "item_words", "item_lead")]
        for n, words, lead, item, item_lead in zip(*cols):
            if item is None:
                first.append(None), length.append(None)
            elif n:
                first.append(0 if words == item else None), length.append(n if words == item else None)
            else:
                back, on = _run(words.split(b" "), lead, item.split(b" "), item_lead, gram)
                hit = back + on >= window
                first.append(-back if hit else None), length.append(back + on if hit else None)
        keep = [c for c in batch.schema.names if c in ("row", "key", "n_words", "item_id", "at")]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(first, pa.int32()), pa.array(length, pa.int32())],
            [*keep, "first", "length"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (key, n_words, n_hit, item_ids): words inside benchmark windows, and the items found.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all other characters
    from U+0080. A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. ``n_hit`` counts a document's words inside any
    occurrence of a window, ``item_ids`` lists the items as text, in text order.

    Benchmark and documents are winnowed: of every ``window - gram + 1`` consecutive grams
    the one of smallest hash is kept, so that each shared window shares a kept gram. Grams
    join on their hash; the words around both are compared and extend the hit, so hashes
    decide nothing. Items below ``window`` words are looked up by their whole length.
    Before the join, documents drop grams that a bit map of fixed size rules out.

    Null texts have no words. Items or documents with a null id take no part. Rows that
    repeat a key and its text are one document; rows that repeat a key with other words
    come out once each. An empty benchmark gives zero hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = map_arrow(
        benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item_id"), raw(item_text).alias("text")),
        _item_grams(window, gram), "item_id string, n int, hash long, words binary, lead int", rows=256)
    items = durable(items.distinct())
    lengths = sorted(r[0] for r in items.where("n > 0").select("n").distinct().collect())
    bits = items.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS + 3).cast("int").alias("byte"),
                        F.expr("shiftleft(1, CAST(shiftrightunsigned(hash, %d) & 7L AS INT))" % (64 - FILTER_BITS)).alias("bit"))
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for at, bit in bits.groupBy("byte").agg(F.bit_or("bit")).toLocalIterator():
        bitmap[at] = bit
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [Words(t) for t in batch.column(1).to_pylist()]
        found = [_candidates(w, lengths, shared.value, window, gram) for w in words]
        kind = pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("lead", pa.int32()), ("at", pa.list_(pa.int32()))]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([w.n for w in words], pa.int64()), batch.column(2), pa.array(found, kind)], ["key", "n_words", "row", "found"])

    source = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), raw(text).alias("text"), F.xxhash64(text).alias("row"))
    kind = docs.schema[key].dataType.simpleString()
    scanned = map_arrow(source, scan, f"key {kind}, n_words long, row long, found {_CANDIDATES}", rows=64)
    spread = scanned.select("key", "n_words", "row", F.explode_outer("found").alias("f")).select(
        "key", "n_words", "row", F.coalesce("f.n", F.lit(-1)).alias("n"),
        F.coalesce("f.hash", F.xxhash64("key")).alias("hash"), "f.words", "f.lead", "f.at")
    grams = items.select("n", "hash", "item_id", F.col("words").alias("item_words"), F.col("lead").alias("item_lead"))
    met = spread.join(grams, ["n", "hash"], "left")
    checked = map_arrow(met.select("row", "key", "n_words", "item_id", "at", "n", "words", "lead", "item_words", "item_lead"),
                        _verify(window, gram), f"row long, key {kind}, n_words long, item_id string, at array<int>, first int, length int")
    one = ["key", "row", "n_words"]
    # A document's hits are bounded by its own words and the items that occur in it.
    per_span = checked.select(*one, "item_id", F.explode_outer(F.when(F.col("length") > 0, F.col("at"))).alias("p"), "first", "length")
    spans = per_span.select(*one, F.when(F.col("p").isNotNull(), F.col("item_id")).alias("item_id"),
                            (F.col("p") + F.col("first")).alias("from"), (F.col("p") + F.col("first") + F.col("length")).alias("to"))
    merged = spans.groupBy(*one).agg(
        F.collect_set("item_id").alias("items"), F.collect_set(F.when(F.col("from").isNotNull(), F.struct("from", "to"))).alias("spans"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["to"] - F.greatest(x["from"], s["end"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(s["end"], x["to"]).alias("end")))["n"]
    return merged.select(F.col("key").alias(key), "n_words", covered.alias("n_hit"), F.array_sort("items").alias("item_ids"))


def _item_grams(window: int, gram: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"item_id": [], "n": [], "hash": [], "words": [], "lead": []}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Words(text)
            if words.n >= window:
                found = _candidates(words, [], None, window, gram)
            else:
                found = [{"n": words.n, "hash": int(words.grams(words.n)[0].astype(np.int64)), "words": words.data, "lead": 0}] if words.n else []
            for row in found:
                out["item_id"].append(item)
                for c in ("n", "hash", "words", "lead"):
                    out[c].append(row[c])
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = 20, **kinds) -> DataFrame:
    """The rows of ``docs`` of which less than one word in ``share`` is inside benchmark windows.

    Rows without a key or without words stay; rows that repeat a key go together.
    """
    bad = contamination(docs, benchmark, key, text, **kinds).where((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    bad = durable(bad.select(F.col(key).alias("#key")).distinct())
    return docs.join(bad, docs[key] == bad["#key"], "left_anti")
