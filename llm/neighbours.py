"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import durable, map_arrow

#: Vectors at most that the trees' planes are fitted on; every vector is indexed.
SAMPLE = 20_000
TREES = 8
LEAF = 256
#: A query visits leaves until they hold this share of all trees' entries. Directions that
#: are spread evenly in 64 dimensions have no near neighbours, so it takes much to find the
#: nearest; data with real neighbourhoods need far less.
SHARE = 0.12
#: ... and a few leaves at least.
VISIT = 1_024
#: Sampled vectors that give each query a floor: its k nearest can't be below.
FLOOR = 1_000
#: Vectors of a leaf that one task compares at a time; larger leaves are split.
BLOCK = 4_096


@dataclass
class Forest:
    """Trees in flat arrays. A child below zero is a leaf: -1 - its number."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.zeros((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(points), root)
            at = np.flatnonzero(node >= 0)
            while len(at):
                n = node[at]
                side = (np.einsum("ij,ij->i", points[at], self.normals[n]) > self.offsets[n]).astype(np.int64)
                node[at] = self.children[n, side]
                at = at[node[at] >= 0]
            out[:, t] = -1 - node
        return out

    def visit(self, point: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
        """Leaves of all trees, nearest first by one shared queue, until they hold ``least`` rows.

        A leaf is as near as the smallest margin by which the point is on its side of the
        planes above it.
        """
        margins = (self.normals @ point - self.offsets).tolist() if len(self.normals) else []
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found, seen = [], 0
        while queue and seen < least:
            near, node = heapq.heappop(queue)
            if node < 0:
                if counts[-1 - node]:
                    found.append(-1 - node)
                    seen += counts[-1 - node]
                continue
            m = margins[node]
            low, high = self.children[node]
            heapq.heappush(queue, (max(near, m), int(low)))
            heapq.heappush(queue, (max(near, -m), int(high)))
        return found


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """Trees over unit vectors, deep enough that ``rows`` rows leave about ``leaf`` in each leaf.

    A plane stands across the line between two sample vectors of its node, at the median.
    A node of fewer than 4 sample vectors is a leaf.
    """
    rng, share = np.random.default_rng(seed), rows / max(1, len(sample))
    normals, offsets, children, roots, leaves = [], [], [], [], 0
    for _ in range(trees):
        stack, root = [(np.arange(len(sample)), -1, 0)], None
        while stack:
            at, parent, side = stack.pop()
            node = None
            if len(at) >= 4 and len(at) * share > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(at, 2, replace=False)]
                    normal = b - a
                    length = np.linalg.norm(normal)
                    if length < 1e-9:
                        continue
                    along = sample[at] @ (normal / length)
                    middle = np.median(along)
                    if (along > middle).any():
                        node = len(normals)
                        normals.append(normal / length), offsets.append(middle), children.append([0, 0])
                        stack += [(at[along <= middle], node, 0), (at[along > middle], node, 1)]
                        break
            if node is None:
                leaves += 1
                node = -leaves
            if parent < 0:
                root = node
            else:
                children[parent][side] = node
        roots.append(root)
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(normals).reshape(len(normals), width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, leaves)


def _unpack(cells, dtype: str) -> np.ndarray:
    """Vectors in double precision."""
    return np.frombuffer(b"".join(cells), dtype).reshape(len(cells), -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(dtype: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.array(v, dtype).tobytes() for v in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "vector"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, visit: int = VISIT, share: float = SHARE, sample: int = SAMPLE,
            block: int = BLOCK, floor: int = FLOOR) -> DataFrame:
    """Rows (query_id, rank, key, score): each query's ``k`` nearest rows found, by cosine.

    ``queries`` are rows of the same shape; a query's own key is no candidate. Equal
    vectors are one class in the index, which keeps its k + 1 smallest keys: no query can
    use more. Trees are fitted on about ``sample`` classes chosen by hash; then every
    class is filed under its leaf in each tree. A query visits leaves of all trees by one
    shared queue until they hold ``share`` of all entries and ``visit`` entries at least,
    and is compared exactly, in double precision, with all classes of these leaves, a leaf
    of more than ``block`` classes in several tasks. Up to ``floor`` sampled classes are
    compared with every query first: what scores below the k nearest of these is not
    passed on. With no more than ``visit / trees`` classes in all, the result is exact.

    Vectors that are null, zero, empty, of another length than the most common one, or
    hold null or non-finite parts take no part, nor do rows without a key. Rows that
    repeat a key and vector count once. Ties go to the smaller key; an empty table gives
    no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    dtype = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"
    good = _usable(vectors, key, vector)
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = width[0] if width else 0
    packed = map_arrow(good.where(F.size("v") == width).select("id", "v"), _pack(dtype), "id long, vector binary", rows=4096)
    order = Window.partitionBy("vector").orderBy("id")
    # Spark keeps the first k + 1 of a class in each task before the shuffle.
    members = durable(packed.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("vector").agg(
        F.min("id").alias("class"), F.array_sort(F.collect_list("id")).alias("ids")))
    n = members.count()
    step = max(1, -(-n // sample))
    chosen = members.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).orderBy("class").limit(2 * sample).select("class", "vector").toPandas()
    points = _unit(_unpack(chosen["vector"].tolist(), dtype)) if len(chosen) else np.zeros((0, width))
    forest = fit(points, n, trees, leaf)
    few = np.random.default_rng(11).permutation(len(points))[:floor]
    shared = spark.sparkContext.broadcast((forest, points[few], chosen["class"].to_numpy(np.int64)[few]))

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf_of = shared.value[0].leaf_of(_unit(_unpack(batch.column(1).to_pylist(), dtype)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of.tolist(), pa.list_(pa.int64()))], ["class", "vector", "leaves"])

    filed = durable(map_arrow(members.select("class", "vector"), file, "class long, vector binary, leaves array<long>", rows=2048))
    counts = np.zeros(forest.leaves, np.int64)
    for at, c in filed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toLocalIterator():
        counts[at] = c
    blocks = np.maximum(1, -(-counts // block))
    least = max(visit, int(share * trees * n))
    shared_counts = spark.sparkContext.broadcast((counts, blocks))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        many = shared_counts.value[1]
        spots = [[x * (1 << 20) + c % int(many[x]) for x in own] for c, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spots, pa.list_(pa.int64()))], ["class", "vector", "spots"])

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        (own, some, classes), (own_counts, many) = shared.value, shared_counts.value
        x = _unit(_unpack(batch.column(1).to_pylist(), dtype)) if batch.num_rows else np.zeros((0, width))
        spots = [[p * (1 << 20) + b for p in own.visit(q, own_counts, least) for b in range(many[p])] for q in x]
        score = x @ some.T
        at = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
        # The query's own class may be among them, so the floor is the one after the k-th.
        floors = [float(score[i, j[k]]) - 1e-9 if len(j) > k else -2.0 for i, j in enumerate(at)]
        near = [[{"class": int(classes[c]), "score": float(score[i, c])} for c in j] for i, j in enumerate(at)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(spots, pa.list_(pa.int64())), pa.array(floors, pa.float64()),
             pa.array(near, pa.list_(pa.struct([("class", pa.int64()), ("score", pa.float64())])))],
            ["query_id", "vector", "spots", "floor", "near"])

    asked = map_arrow(_usable(queries, key, vector).where(F.size("v") == width).select("id", "v").distinct(), _pack(dtype), "id long, vector binary", rows=4096)
    asked = durable(map_arrow(asked, probe, "query_id long, vector binary, spots array<long>, floor double, near array<struct<class:long,score:double>>", rows=256))
    rows = map_arrow(filed, deal, "class long, vector binary, spots array<long>", rows=4096).select(
        F.explode("spots").alias("spot"), "class", "vector")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y, classes = _unit(_unpack(right["vector"].tolist(), dtype)), right["class"].to_numpy()
            for start in range(0, len(left), 512):
                some = left.iloc[start : start + 512]
                score = _unit(_unpack(some["vector"].tolist(), dtype)) @ y.T
                for i, row, least_score in zip(some["query_id"].tolist(), score, some["floor"].tolist()):
                    at = np.flatnonzero(row >= least_score)
                    if len(at) > k + 1:  # a class may hold just the query itself, so one more than k
                        at = at[np.lexsort((classes[at], -row[at]))[: k + 1]]
                    out += [(i, c, s) for c, s in zip(classes[at].tolist(), row[at].tolist())]
        return pd.DataFrame(out, columns=["query_id", "class", "score"]).astype({"query_id": "int64", "class": "int64", "score": "float64"})

    met = asked.select(F.explode("spots").alias("spot"), "query_id", "vector", "floor").groupBy("spot").cogroup(
        rows.groupBy("spot")).applyInPandas(compare, "query_id long, class long, score double")
    met = met.unionByName(asked.select("query_id", F.explode("near").alias("c")).select("query_id", "c.class", "c.score"))
    best = met.groupBy("query_id", "class").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    best = best.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    each = best.join(members.select("class", "ids"), "class").select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), F.least(F.greatest("score", F.lit(-1.0)), F.lit(1.0)).alias("score"))


def _usable(frame: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
