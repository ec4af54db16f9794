"""Session settings and durable lineage cuts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE converts joins on measured sizes and splits hot join partitions, so no
# operator in this package hints a broadcast of a table that grows with the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Sides dealt by contract alone meet on (contract, ...) without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A union of stored buckets keeps their partitioning; the rule would take the buckets from under it.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("trailspark")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; raises on a cluster that names none.

    Only a session whose executors are threads of this process (``local[n]``, as in
    tests) gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Tables that ``durable`` has written and nobody has removed: folder -> its Hadoop settings.
_written: dict[str, object] = {}


def durable(frame: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder.

    A result that several outputs read is computed once and survives executor loss. The
    table stays until ``discard``, the end of a ``scratch`` block or of the process.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written[path] = spark.sparkContext._jsc.hadoopConfiguration()
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._cut = path
    return found


def durable_buckets(frame: DataFrame, *by: str, buckets: int | None = None) -> DataFrame:
    """The same, stored in buckets of the columns ``by`` and sorted by them in each.

    Joins and aggregates on these columns of tables with equal buckets need no exchange.
    Choose columns of which no value holds a large share of the rows: a bucket is read by
    one task. As many buckets as shuffle partitions where none are given.
    """
    spark = frame.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    if not _written:
        atexit.register(release)
    _written[path] = spark.sparkContext._jsc.hadoopConfiguration()
    frame.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    found = spark.table(name)
    found._cut = path
    return found


def discard(frame: DataFrame) -> None:
    """Remove the table behind a frame that ``durable`` returned; nothing may read it any more."""
    _remove(frame._cut, frame.sparkSession._jvm)


def _remove(path: str, jvm) -> None:
    conf = _written.pop(path, None)
    if conf is not None:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove every table that ``durable`` writes within the block at its end.

    Results that read them must be written or collected before.
    """
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _remove(path, spark._jvm)


def release() -> None:
    """Remove all tables that ``durable`` has written in this process, as far as Spark still runs."""
    spark = SparkSession.getActiveSession()
    for path in list(_written) if spark is not None else ():
        _remove(path, spark._jvm)
