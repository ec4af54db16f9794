"""Ranked lexical search over posting lists with range-maximum tables.

Documents are kept in shards of bounded size, each with one posting list for every term that
may be searched: documents (by length) with their term counts. Over a list's impacts lies a
sparse table that gives the posting of greatest impact in any stretch of the list at once.
A search starts with the interval of all documents of a shard. An interval's bound is the
sum of its terms' greatest impacts; the intervals of highest bound are taken first, the
document of the greatest single impact in each is scored, and what lies to its left and
right goes back. It ends when no interval's bound reaches the score of the k-th document.
Every score is exact, so that the best of all shards are the best of all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from llm.common import durable, map_arrow, raw

#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 3_000_000
#: Items that a task gets at a time, and their bytes.
BLOCK, BLOCK_BYTES = 1_024, 8 << 20
#: Intervals taken at a time, and terms times intervals held at a time.
WAVE, WAVE_CELLS = 48, 1 << 18
#: Bits of the fixed-size filter of searched terms that every task gets: 2 MB.
FILTER_BITS = 24
#: Remembered answers of the filter.
MEMORY = 1_000_000
#: Part tables that merge the shards' best before the last one does.
PARTS = 64

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), digits and all characters from U+0080, as UTF-8."""
    return (text or b"").translate(_FOLD).split()


# -- the index -----------------------------------------------------------------------


class _Collector:
    """Gathers documents until a shard is full."""

    def __init__(self, wanted):
        self.wanted = wanted
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.postings = [], [], 0
        self.slots: dict[bytes, int] = {}
        self.slot, self.tf, self.held = [], [], []

    def add(self, key, text: bytes | None) -> None:
        words = terms(text)
        if not words:
            return
        counts = {w: n for w, n in Counter(words).items() if self.wanted(w)}
        self.ids.append(key)
        self.sizes.append(len(words))
        self.slot += [self.slots.setdefault(w, len(self.slots)) for w in counts]
        self.tf += counts.values()
        self.held.append(len(counts))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def columns(self, shard: int) -> dict[str, list]:
        """The shard: documents by length, postings by term and document."""
        sizes = np.array(self.sizes, np.int64)
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = np.repeat(place, self.held)
        slot, tf = np.array(self.slot, np.int64), np.array(self.tf, np.int64)
        by = np.lexsort((at, slot))
        return {
            "shard": [shard], "ids": [[self.ids[i] for i in order.tolist()]], "sizes": [sizes[order].astype("<i8").tobytes()],
            "terms": [list(self.slots)], "df": [np.bincount(slot, minlength=len(self.slots)).tolist()],
            "at": [at[by].astype("<u2").tobytes()], "tf": [tf[by].astype("<u4").tobytes()],
        }


def index(docs: DataFrame, searched: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the documents with postings of the searched terms, to be written before use.

    ``searched`` has a column ``term``; a bit map of fixed size stands for it, so that a
    few other terms get postings too. Rows without a key and documents without terms are
    in no shard.
    """
    spark, shift = docs.sparkSession, 32 - FILTER_BITS
    slots = searched.select(F.shiftright(F.crc32("term"), shift).alias("slot"))
    bits = slots.groupBy(F.shiftright("slot", 3).cast("int").alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, CAST(slot & 7L AS INT))")).alias("bits"))
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for byte, value in bits.toLocalIterator():
        bitmap[byte] = value
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    kind = docs.schema[key].dataType
    schema = f"shard long, ids array<{kind.simpleString()}>, sizes binary, terms array<binary>, df array<long>, at binary, tf binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, memo, task, n = shared.value, {}, TaskContext.get().partitionId(), 0

        def wanted(word: bytes) -> bool:
            known = memo.get(word)
            if known is None:
                if len(memo) > MEMORY:
                    memo.clear()
                slot = zlib.crc32(word) >> shift
                known = memo[word] = bool(filled[slot >> 3] >> (slot & 7) & 1)
            return known

        held, ids = _Collector(wanted), None
        for batch in batches:
            ids = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.add(k, t.as_py())
                if held.full():
                    yield _shard(held, (task << 32) + n, ids)
                    n += 1
        if held.ids:
            yield _shard(held, (task << 32) + n, ids)

    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), raw(text).alias("text")).mapInArrow(run, schema)


def _shard(held: _Collector, shard: int, ids: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(ids), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary())
    columns = held.columns(shard)
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds)], list(columns))


# -- searching a shard ---------------------------------------------------------------


class Shard:
    """A shard's posting lists, one after another, with their impacts and sparse tables.

    An impact is (10**9 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * n * N) div L for a
    document of n terms, N documents and L terms in all. A score sums weight times impact.
    """

    def __init__(self, ids: list, sizes: np.ndarray, names: list[bytes], df: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int, length: int):
        self.ids, self.slots = ids, {w: i for i, w in enumerate(names)}
        self.starts = np.concatenate(([0], np.cumsum(df)))
        self.at = at.astype(np.int64)
        m = 50 + (50 * sizes * n) // max(1, length)
        tf = tf.astype(np.int64)
        self.impact = (10**9 * tf) // (1000 * tf + 20 * m[self.at])
        self.table = self._table(int(df.max(initial=1)))
        self.log = np.frexp(np.arange(len(ids) + 2))[1] - 1

    def _table(self, longest: int) -> np.ndarray:
        """Row j: the posting of greatest impact, the first of equals, of the 2**j from each on."""
        rows = [np.arange(len(self.at), dtype=np.int32)]
        while 2 << (len(rows) - 1) <= longest:
            span, row = 1 << (len(rows) - 1), rows[-1].copy()
            other = rows[-1][span:]
            row[: len(other)] = np.where(self.impact[other] > self.impact[row[: len(other)]], other, row[: len(other)])
            rows.append(row)
        return np.concatenate(rows)

    def _greatest(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For stretches lo:hi of each term's list (rows of intervals): the sum of the terms'
        greatest weighted impacts, and the document of the greatest."""
        n = len(self.at)
        size = hi - lo
        some = size > 0
        j = self.log[np.maximum(size, 1)]
        lo, last = np.minimum(lo, n - 1), np.maximum(hi - (1 << j), 0)
        a, b = self.table[j * n + lo], self.table[j * n + np.minimum(last, n - 1)]
        x, y = self.impact[a], self.impact[b]
        value = np.where(some, np.maximum(x, y) * weights, 0)
        rows, top = np.arange(len(lo)), value.argmax(1)
        best = np.where(y > x, b, a)[rows, top]
        return value.sum(1), self.at[best]

    def search(self, names: list[bytes], weights: list[int], k: int, least: int = 1) -> tuple[list, int]:
        """The k best (score, id) of at least ``least``, best first, and the number of documents scored."""
        known = [(self.slots[w], x) for w, x in zip(names, weights) if x > 0 and w in self.slots]
        if not known:
            return [], 0
        slots, weight = (np.array(c, np.int64) for c in zip(*known))
        starts, ends = self.starts[slots], self.starts[slots + 1]
        n, t = len(self.ids) + 1, np.arange(len(slots))
        # The lists of these terms alone, so that a document is found in each by one sorted search.
        keys = np.concatenate([self.at[a:b] + i * n for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))])
        shift = starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
        find = lambda docs: np.searchsorted(keys, docs[:, None] + t * n) + shift
        wave = max(1, min(WAVE, WAVE_CELLS // len(t)))
        bound, split = self._greatest(starts[None], ends[None], weight)
        left, right = np.zeros(1, np.int64), np.full(1, n - 1)
        if bound[0] < least:
            return [], 0
        scores, found, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while len(bound):
            take = np.argpartition(-bound, wave - 1)[:wave] if len(bound) > wave else np.arange(len(bound))
            lo, hi, doc = left[take], right[take], split[take]
            a, at, b = find(lo), find(doc), find(hi)
            hit = (at < b) & (self.at[np.minimum(at, len(self.at) - 1)] == doc[:, None])
            score = (np.where(hit, self.impact[np.minimum(at, len(self.at) - 1)], 0) * weight).sum(1)
            scored += len(take)
            scores, found = np.concatenate((scores, score)), np.concatenate((found, doc))
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                scores, found = scores[keep], found[keep]
            new_bound, new_split = self._greatest(np.concatenate((a, at + hit)), np.concatenate((at, b)), weight)
            rest = np.ones(len(bound), bool)
            rest[take] = False
            bound, split = np.concatenate((bound[rest], new_bound)), np.concatenate((split[rest], new_split))
            left, right = np.concatenate((left[rest], lo, doc + 1)), np.concatenate((right[rest], doc, hi))
            # Equal bounds stay: an equal score with a smaller id ranks higher.
            open_ = bound >= least
            bound, split, left, right = bound[open_], split[open_], left[open_], right[open_]
        best = sorted(((-s, self.ids[d]) for s, d in zip(scores.tolist(), found.tolist()) if s >= least))[:k]
        return [(-s, i) for s, i in best], scored


# -- all shards ----------------------------------------------------------------------


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (key, item, term): the distinct terms of every distinct (item, text)."""
    distinct = items.where(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), F.sha2(F.coalesce(raw(text), F.lit(b"")), 256).alias("text_key"), raw(text).alias("text")).dropDuplicates(["item", "text_key"])
    source = distinct.select(F.struct("item", "text_key").alias("key"), "text")
    kind = items.schema[item].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(set(terms(t))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["key", "terms"])

    split = map_arrow(source, run, f"key struct<item:{kind},text_key:string>, terms array<binary>", rows=256)
    return split.select("key", F.explode("terms").alias("term"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """Rows (item, rank, key, score): the ``k`` documents of highest score above 0 for every item.

    Terms are those of ``terms``; an item's terms count once each. With N documents of at
    least one term, L terms in all and df documents that hold a term, its weight is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))); scores are 64-bit integers (``Shard``).
    Equal scores rank by ascending key.

    Null or empty texts have no terms: such documents are not counted, such items have no
    rows. Rows with a null key or item take no part. Every row is a document of its own,
    repeated keys too; equal rows of items are one item, an item with several texts has a
    list of ranks for each. Other columns are ignored, empty tables give no rows. Items of
    any number of terms are searched; items come to the tasks in blocks of bounded size.
    """
    spark = docs.sparkSession
    asked = durable(_item_terms(items, item, item_text))
    shards = durable(index(docs, asked.select("term"), key, text))
    sizes = map_arrow(shards.select("sizes"), _sizes, "n long, length long", rows=16)
    total = sizes.agg(F.sum("n"), F.sum("length")).first()
    n, length = total[0] or 0, total[1] or 0
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = durable(asked.join(df.where("df > 0"), "term").select("key", "term", weight.alias("weight")).where("weight > 0"))
    lists = weighted.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum(F.length("term") + 16).alias("bytes"))
    found = [_search_block(shards, block, n, length, k, docs.schema[key].dataType, items.schema[item].dataType) for block in _blocks(durable(lists))]
    if not found:
        return spark.createDataFrame([], f"`{item}` {items.schema[item].dataType.simpleString()}, rank int, `{key}` {docs.schema[key].dataType.simpleString()}, score long")
    return reduce(DataFrame.unionByName, map(durable, found) if len(found) > 1 else found).select(
        F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def _search_block(shards: DataFrame, block: list, n: int, length: int, k: int, id_type: DataType, item_type: DataType) -> DataFrame:
    """Rows (item, rank, doc, score) of a block of items: the best of each task's shards, merged in parts and then as a whole.

    A shard is searched for what reaches the k-th score of the task's shards before it.
    """
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast([(names, weights) for _, names, weights in block])
    kinds = (pa.int32(), pa.int32(), to_arrow_type(id_type), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in shared.value]
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                shard = Shard(row["ids"], np.frombuffer(row["sizes"], "<i8"), row["terms"], np.array(row["df"], np.int64),
                              np.frombuffer(row["at"], "<u2"), np.frombuffer(row["tf"], "<u4"), n, length)
                for i, (names, weights) in enumerate(shared.value):
                    more, _ = shard.search(names, weights, k, best[i][-1][0] if len(best[i]) == k else 1)
                    if more:
                        best[i] = sorted([*best[i], *more], key=lambda x: (-x[0], x[1]))[:k]
        rows = [(i, doc, score) for i, found in enumerate(best) for score, doc in found]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        columns.insert(1, [TaskContext.get().partitionId()] * len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["at", "task", "doc", "score"])

    found = shards.mapInArrow(run, f"at int, task int, doc {id_type.simpleString()}, score long")
    order = [F.desc("score"), F.asc("doc")]
    first = Window.partitionBy("at", F.col("task") % PARTS).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where(F.col("rank") <= k)
    items = spark.createDataFrame([(i, item) for i, (item, *_) in enumerate(block)], f"at int, item {item_type.simpleString()}")
    return ranked.join(items, "at").select("item", "rank", "doc", "score")


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes = [np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array([len(x) for x in sizes], pa.int64()), pa.array([int(x.sum()) for x in sizes], pa.int64())], ["n", "length"])


def _blocks(lists: DataFrame) -> Iterator[list]:
    """Items with their terms, so many at a time as fit a block."""
    block, size = [], 0
    for row in lists.toLocalIterator():
        if block and (len(block) >= BLOCK or size + row["bytes"] > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row["key"][0], [bytes(t[0]) for t in row["terms"]], [t[1] for t in row["terms"]]))
        size += row["bytes"]
    if block:
        yield block
