"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable, map_arrow, raw
from llm.components import components

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The majority bits of XXH64 over all word shingles; zero where there is no word.

    A-Z is lower-cased and words end at ASCII white space. A text of fewer words than
    ``words`` is one shingle.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(p) + 1 for p in parts))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])]
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[start : start + (1 << 16)], "<u8")
        counts += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (key, fp): the fingerprint of each text as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    frame = docs.select(F.col(key).alias("key"), raw(text).alias("text"))
    return map_arrow(frame, run, f"key {docs.schema[key].dataType.simpleString()}, fp long", rows=256)


def links(fps: DataFrame, distance: int = 3, fp: str = "fp") -> DataFrame:
    """Rows (a, b): every pair of different fingerprints at ``distance`` bits or fewer, for 2 or 3.

    At most 3 different bits leave one of the two halves with at most one of them. Such
    halves are equal, or equal once the differing bit is deleted, so each fingerprint is
    indexed under its two halves and under their 64 one-wildcard variants. Fingerprints
    meet under a whole half, or under a wildcard with a 0 on one side and a 1 on the
    other: each pair meets once for a half, not once per wildcard. Only verified pairs
    leave the join; hot signatures are split there as skewed join partitions are. The join
    is named because Spark gives the index the size of the fingerprints it is made of, 66
    times too small, and would send it through the driver to every task.
    """
    if not 0 < distance <= 3:
        raise ValueError("two halves carry up to 3 different bits")
    seen = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    index = seen.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("variant"))
    index = index.selectExpr("fp", "variant", "variant % 33 as spot", "IF(variant < 33, fp & 4294967295L, shiftrightunsigned(fp, 32)) as half")
    index = index.selectExpr(
        "fp", "IF(spot = 32, 2, CAST(shiftright(half, spot) & 1L AS INT)) as side",
        "shiftleft(CAST(variant AS BIGINT), 32) | IF(spot = 32, half, half & ~shiftleft(1L, spot)) as signature")
    a = index.where("side <> 1").select("signature", "side", F.col("fp").alias("a"))
    b = index.where("side <> 0").select("signature", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b.hint("merge"), "signature").where(near & ((F.col("side") == 0) | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """Rows (key, fingerprint, component_id, n_links) for the rows of ``docs`` with a key.

    Fingerprints at ``distance`` bits or fewer are linked; ``component_id`` is the smallest
    key that links reach, ``n_links`` the number of other fingerprints linked to this one.
    Empty and null texts have fingerprint zero and are linked like others. Rows without a
    key have no place in a component and are left out; a repeated row comes out repeated.
    An empty table gives no rows. Only the two columns are read.
    """
    fps = durable(fingerprints(docs.where(F.col(key).isNotNull()), key, text, words))
    classes = durable(fps.groupBy("fp").agg(F.min("key").alias("rep")))
    pairs = durable(links(classes, distance).distinct())
    reps = classes.select(F.col("fp").alias("a"), F.col("rep").alias("x"))
    edges = pairs.join(reps, "a").join(reps.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of = components(edges, "x", "y").select(F.col("node").alias("rep"), "component")
    classes = classes.join(of, "rep", "left").join(degree, "fp", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return fps.join(classes, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its group; rows without a key stay."""
    gone = near_duplicates(docs, key, text, words, distance).where(F.col(key) != F.col("component_id"))
    gone = durable(gone.select(F.col(key).alias("#key")).distinct())
    return docs.join(gone, docs[key] == gone["#key"], "left_anti")
