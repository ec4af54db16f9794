"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.session import durable
from trailspark.session import tune as tune_base

__all__ = ["bucket", "durable", "hash64", "map_arrow", "one_thread", "raw", "span_hashes", "table", "tree_sum", "tune"]

_BLAS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads")
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


#: Rows of an Arrow batch between the JVM and Python: long texts make the default too large.
BATCH_ROWS = 1_000


def tune(spark: SparkSession) -> SparkSession:
    """The library's session settings, and Arrow batches that suit texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return tune_base(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def raw(column: str):
    """The UTF-8 bytes of a text column, so that Python gets them undecoded."""
    return F.col(column).cast("binary")


def bucket(column: str, n: int):
    """crc32 of an id written as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def map_arrow(frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 0,
              done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``function`` to Arrow batches, cut to at most ``rows`` rows where given.

    ``done`` runs when a task ends: Python workers live on, and so would what they remember.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                    yield function(batch.slice(start, rows) if rows else batch)
        finally:
            if done:
                done()

    return frame.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keep numpy's matrix products in this Python worker to one thread: Spark has a task for every core.

    Threads of small products mostly wait for each other, at full load.
    """
    try:
        with open("/proc/self/maps") as maps:
            found = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # no such file on this system: nothing to be set
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in _BLAS:
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def tree_sum(frame: DataFrame, dtype: str = "<f8") -> np.ndarray | None:
    """The sum of the packed vectors in a frame's one column, a few at a time in any task.

    None where there is no row.
    """
    packed = frame.rdd.map(lambda row: np.frombuffer(bytes(row[0]), dtype))
    n = packed.getNumPartitions()
    if not n:
        return None
    depth = max(2, int(np.ceil(np.log(n) / np.log(16))))
    return packed.treeAggregate(None, _add, _add, depth)


def _add(a, b):
    return b if a is None else a if b is None else a + b


def hash64(values: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], by one prefix sum over all bytes."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    up, down = _Powers.of(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=total[1:])
        value = (total[ends] - total[starts]) * down[starts]
        value += (ends - starts).astype(np.uint64) * np.uint64(_ODD)
    return hash64(value)
