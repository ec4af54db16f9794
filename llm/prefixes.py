"""The trie of conversation prefixes, packed as double arrays.

Conversations are rebuilt as paths of turn keys. Equal paths become one row with their
number, so that a conversation copied very often is one path. Paths are dealt by range of
their keys into shards, each a stretch of the trie. A shard numbers its distinct turns
densely and packs its prefixes into the arrays BASE and CHECK: node s has the child of turn t
at BASE[s] + t if CHECK there is s. All paths walk through them at once, turn by turn. Only
the nodes on a shard's first and last path can also lie in other shards: those come out as
parts, which are added up by their prefix; all other nodes are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import durable, map_arrow, raw

#: A turn's key: a 128-bit digest of its role and text.
KEY = 16
#: A shard ends at so many paths or turns.
SHARD_PATHS, SHARD_TURNS = 50_000, 400_000
#: Ids of conversations that end alike come in rows of at most so many.
ENDS = 4_096
_NONE = hashlib.sha256(b"").hexdigest()


# -- paths ---------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, n, key, words): each turn's number in its conversation, its key and its words.

    Conversations are ordered by turn, null first; equal turns by role and key, so that no
    text is shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [len((t or b"").split()) for t in batch.column(4).to_pylist()]  # bytes 9 to 13 and 32 separate
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(words, pa.int64())], ["conv_id", "turn", "role", "key", "words"])

    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), key.alias("key"), raw("text").alias("text"))
    counted = map_arrow(rows, count, "conv_id long, turn long, role string, key binary, words long")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "key")
    return counted.select("conv_id", (F.row_number().over(order) - 1).alias("n"), "key", "words")


def rebuilt(numbered: DataFrame, share: int = 20, heads: int = 4) -> DataFrame:
    """Rows (conv_id, path): every conversation with its first turns taken from its group's first conversation.

    The first h turns of conversation c - c % share (all if fewer, none if absent), then c's
    own after its first h; h is the unsigned crc32 of the decimal c, modulo ``heads``.
    ``path`` lists (key, words). A conversation without turns has an empty path.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = numbered.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % share).alias("from"), h.alias("h"))
    turn = [F.col("n"), F.col("key"), F.col("words")]
    lent = numbered.where(F.col("n") < heads - 1).select(F.col("conv_id").alias("from"), *turn)
    lent = convs.join(lent, "from").where("n < h").select("conv_id", F.lit(0).alias("own"), *turn)
    own = numbered.withColumn("h", h).where("n >= h").select("conv_id", F.lit(1).alias("own"), *turn)
    none = convs.select("conv_id", F.lit(None).cast("int").alias("own"), *(F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("key", "binary"), ("words", "long"))))
    path = F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", "n", "key", "words"))))
    return lent.unionByName(own).unionByName(none).groupBy("conv_id").agg(
        F.transform(path, lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("path"))


# -- the double array ----------------------------------------------------------------


@dataclass
class DoubleArray:
    """BASE and CHECK of a trie over dense turn ids from 1 on; node 1 is the root, 0 is no node."""

    base: np.ndarray
    check: np.ndarray
    depth: np.ndarray

    @classmethod
    def pack(cls, flat: np.ndarray, starts: np.ndarray) -> DoubleArray:
        """The trie of the sequences flat[starts[i]:starts[i + 1]]."""
        self = cls(*(np.zeros(1024, np.int64) for _ in range(3)))
        self.check[:2] = -1  # no node, and the root
        self._free = 2
        state, lengths = np.ones(len(starts) - 1, np.int64), np.diff(starts)
        for d in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > d)
            turn = flat[starts[live] + d]
            edges = np.unique(np.stack((state[live], turn)), axis=1)
            self._place(edges[0], edges[1], d + 1)
            state[live] = self.step(state[live], turn)
        return self

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            for name in ("base", "check", "depth"):
                setattr(self, name, np.concatenate((getattr(self, name), np.zeros(more, np.int64))))

    def _place(self, parents: np.ndarray, ids: np.ndarray, depth: int) -> None:
        """Children of a level: nodes with several take the first base that leaves all places free,
        nodes with one take the next free place."""
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        counts = np.diff(np.r_[first, len(parents)])
        for at, n in zip(first[counts > 1].tolist(), counts[counts > 1].tolist()):
            self._family(int(parents[at]), ids[at : at + n], depth)
        alone = first[counts == 1]
        self._grow(self._free + 2 * len(alone) + 16)
        free = np.flatnonzero(self.check[self._free :] == 0) + self._free
        while len(free) < len(alone):
            self._grow(2 * len(self.check))
            free = np.flatnonzero(self.check[self._free :] == 0) + self._free
        place = free[: len(alone)]
        self.base[parents[alone]] = place - ids[alone]
        self.check[place], self.depth[place] = parents[alone], depth
        if len(place):
            self._free = int(place[-1]) + 1

    def _family(self, parent: int, ids: np.ndarray, depth: int) -> None:
        offsets, at = ids - ids[0], self._free
        while True:
            self._grow(at + int(offsets[-1]) + 2)
            if not self.check[at + offsets].any():
                break
            taken = self.check[at + 1 : at + 4096] == 0
            at += 1 + int(taken.argmax()) if taken.any() else 4096
        self.base[parent] = at - int(ids[0])
        self.check[at + offsets], self.depth[at + offsets] = parent, depth

    def step(self, states: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The child of each state by a turn; 0 where there is none."""
        to = self.base[states] + turn
        inside = (to > 1) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, 0)


# -- a shard's nodes -----------------------------------------------------------------

_NODES = (("prefix", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
          ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
          ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()))
_SCHEMA = ("prefix binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, words long, ends_sha256 string")


class _Shard:
    """Sorted distinct paths, each with its number of conversations, the smallest, and the digest of their ids."""

    def __init__(self):
        self.paths: list[list[dict]] = []
        self.n: list[int] = []
        self.least: list[int] = []
        self.ends: list[str] = []
        self.turns = 0

    def full(self, paths: int) -> bool:
        return len(self.paths) >= paths or self.turns >= SHARD_TURNS

    def nodes(self) -> dict[str, list]:
        """All nodes: with ``prefix`` where other shards may have parts of it, with ``above`` where their parent's is such a prefix."""
        lengths = np.array([len(p) for p in self.paths], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        keys = np.frombuffer(b"".join(t["key"] for p in self.paths for t in p), f"S{KEY}") if starts[-1] else np.zeros(0, f"S{KEY}")
        keys = keys.view("V%d" % KEY)
        _, flat = np.unique(keys.view(np.uint64).reshape(-1, KEY // 8) if len(keys) else np.zeros((0, KEY // 8), np.uint64), axis=0, return_inverse=True)
        flat = flat.reshape(-1) + 1
        words = np.array([t["words"] for p in self.paths for t in p], np.int64)
        trie = DoubleArray.pack(flat, starts)
        size = len(trie.check)
        n_convs, least, own_words = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        weight, first = np.array(self.n, np.int64), np.array(self.least, np.int64)
        state = np.ones(len(lengths), np.int64)
        n_convs[1], least[1] = weight.sum(), first.min()
        border = {1: hashlib.md5(b"").digest()}  # nodes of the first and the last path: a digest of the prefix
        for path in (0, len(lengths) - 1):
            at, prefix = 1, hashlib.md5(b"")
            for d in range(int(lengths[path])):
                at = int(trie.step(np.array([at]), flat[starts[path] + d : starts[path] + d + 1])[0])
                prefix.update(self.paths[path][d]["key"])
                border[at] = prefix.digest()
        for d in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > d)
            at = starts[live] + d
            state[live] = trie.step(state[live], flat[at])
            np.add.at(n_convs, state[live], weight[live])
            np.minimum.at(least, state[live], first[live])
            own_words[state[live]] = words[at]
        digest = dict(zip(state.tolist(), self.ends))  # where paths end
        shared = np.zeros(size, bool)
        shared[list(border)] = True
        used = np.flatnonzero(n_convs)
        n_children, n_leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
        below = used[used > 1]
        np.add.at(n_children, trie.check[below[~shared[below]]], 1)
        inner = np.zeros(size, bool)  # nodes with any child in this shard
        inner[trie.check[below]] = True
        for d in range(int(trie.depth[used].max(initial=0)), 0, -1):
            level = used[trie.depth[used] == d]
            level = level[~shared[level]]
            n_leaves[level] += ~inner[level]
            saved[level] += (n_convs[level] - 1) * own_words[level]
            np.add.at(n_leaves, trie.check[level], n_leaves[level])
            np.add.at(saved, trie.check[level], saved[level])
        parent = np.where(used > 1, trie.check[used], 0)
        hidden = shared[parent]  # whose parent's smallest conversation other shards decide
        return {
            "prefix": [border.get(s) for s in used.tolist()],
            "above": [border[p] if h else None for p, h in zip(parent.tolist(), hidden.tolist())], "conv_id": least[used].tolist(), "depth": trie.depth[used].tolist(),
            "parent_conv_id": [None if h or not p else int(least[p]) for p, h in zip(parent.tolist(), hidden.tolist())],
            "n_convs": n_convs[used].tolist(), "n_children": n_children[used].tolist(), "n_leaves": n_leaves[used].tolist(),
            "saved_tokens": saved[used].tolist(), "words": own_words[used].tolist(),
            "ends_sha256": [digest.get(s, _NONE) for s in used.tolist()],
        }


def _shards(batches: Iterator[pa.RecordBatch], paths: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards of a partition whose rows (path, n, least, ids) are sorted by path and ids' range."""
    held, last, sha = _Shard(), None, None
    for batch in batches:
        for path, n, least, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if path != last:
                if last is not None:
                    held.ends.append(sha.hexdigest())
                if held.full(paths):
                    yield _rows(held)
                    held = _Shard()
                held.paths.append(path), held.n.append(n), held.least.append(least)
                held.turns += len(path)
                last, sha = path, hashlib.sha256(ids.encode())
            else:  # the next ids of the same path: hashed on, never held together
                held.n[-1] += n
                held.least[-1] = min(held.least[-1], least)
                sha.update(b"," + ids.encode())
    if last is not None:
        held.ends.append(sha.hexdigest())
        yield _rows(held)


def _rows(held: _Shard) -> pa.RecordBatch:
    found = held.nodes()
    return pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in _NODES], [c for c, _ in _NODES])


# -- all shards ----------------------------------------------------------------------


def trie(paths: DataFrame, shard: int = SHARD_PATHS, ends: int = ENDS) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of rows (conv_id, path).

    ``shard`` bounds the paths of a double array, ``ends`` the ids in a row.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    some = paths.groupBy("path", F.floor(F.col("conv_id") / ends).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    dealt = some.repartitionByRange(F.col("path")).sortWithinPartitions("path", "range")
    nodes = durable(dealt.select("path", "n", "least", "ids").mapInArrow(lambda batches: _shards(batches, shard), _SCHEMA))
    parts = nodes.where(F.col("prefix").isNotNull())
    merged = durable(parts.groupBy("prefix").agg(
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))), F.lit(_NONE)).alias("ends_sha256")))
    children = merged.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("prefix")).agg(F.count(F.lit(1)).alias("more"))
    # What shared nodes add to those above them: their own share, and that of whole nodes below them.
    whole = merged.join(children, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = durable(whole.select(
        "prefix", "above", "conv_id", "depth", "n_convs", "n_children", "ends_sha256",
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).alias("saved_tokens")))
    shared = own.drop("n_leaves", "saved_tokens").join(_subtrees(own), "prefix")
    parent = own.select(F.col("prefix").alias("above"), F.col("conv_id").alias("#parent"))
    columns: list[str | Column] = ["conv_id", "depth", F.coalesce("parent_conv_id", "#parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                                   "saved_tokens", "ends_sha256"]
    private = nodes.where(F.col("prefix").isNull()).select("above", "parent_conv_id", *(c for c in columns if isinstance(c, str)))
    loose = private.where(F.col("above").isNotNull()).join(parent, "above")
    tied = shared.withColumn("parent_conv_id", F.lit(None).cast("long")).join(parent, "above", "left")
    return private.where(F.col("above").isNull()).withColumn("#parent", F.lit(None).cast("long")).select(*columns).unionByName(
        loose.select(*columns)).unionByName(tied.select(*columns))


def _subtrees(own: DataFrame) -> DataFrame:
    """Rows (prefix, n_leaves, saved_tokens) summed over each shared node's subtree, by doubling.

    After k rounds a row sums the nodes fewer than 2**k turns below, and ``above`` leads
    2**k turns up.
    """
    state, sums = own.select("prefix", "above", "n_leaves", "saved_tokens"), ("n_leaves", "saved_tokens")
    for _ in range(int(own.agg(F.max("depth")).first()[0] or 0).bit_length()):
        more = state.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("prefix")).agg(*(F.sum(c).alias(f"#{c}") for c in sums))
        jump = state.select(F.col("prefix").alias("above"), F.col("above").alias("#above"))
        state = durable(state.join(more, "prefix", "left").join(jump, "above", "left").select(
            "prefix", F.col("#above").alias("above"), *((F.col(c) + F.coalesce(f"#{c}", F.lit(0))).alias(c) for c in sums)))
    return state.drop("above")


def conversation_trie(conversations: DataFrame, share: int = 20, heads: int = 4, **sizes: int) -> DataFrame:
    """A row for every distinct prefix of the rebuilt conversations (``rebuilt``), the empty one included.

    conv_id is the smallest conversation that starts with the prefix, depth its number of
    turns, parent_conv_id that of the prefix one turn shorter (null for the root), n_convs
    the conversations that start with it, n_children the distinct next turns, n_leaves the
    nodes without children in its subtree (itself included), saved_tokens the sum over its
    subtree of (n_convs - 1) times the words of the last text, ends_sha256 the hash of the
    ascending, comma-joined decimal ids of the conversations that end there.

    Null roles and texts are empty; a null turn comes first; rows with the same turn are
    ordered by role and key, and repeated rows are turns of their own. Rows without a
    conversation id take no part. An empty table has no nodes. Other columns are ignored.
    A conversation's path, 24 bytes a turn, is one row; texts are never held together.
    """
    return trie(rebuilt(durable(turns(conversations.select("conv_id", "turn", "role", "text"))), share, heads), **sizes)
