"""One hash for a group of lines, by the same formula whatever the group's size.

Lines are dealt to leaves by the first four hex digits of their own SHA-256. A leaf's
digest is the SHA-256 of its sorted distinct lines, joined by newlines; the group's is the
SHA-256 of its sorted leaf digests, joined by newlines. A task holds one leaf of a group,
or the digests of a group's leaves (65,536 at most), never all lines of a hot group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.text import sha256


#: Line items that one task holds, about: the sorts of its stage, which run at once, fit its memory.
TASK_ROWS = 1 << 16
_PARTS = "spark.trailspark.partitions"


def deal_for(spark: SparkSession, rows: int) -> None:
    """From now on deal out to so many partitions that ``rows`` line items give each about ``TASK_ROWS``."""
    spark.conf.set(_PARTS, str(-(-rows // TASK_ROWS)))


def partitions(spark: SparkSession) -> int:
    """As many as a shuffle has, or as ``deal_for`` asks for where that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_PARTS, "0")))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` to ``partitions``, so that frames dealt alike can be joined, united and grouped in place."""
    return rows.repartition(partitions(rows.sparkSession), *keys)


def group_digest(rows: DataFrame, keys: Sequence[str], line: Column, out: str, *, repeats: bool = False) -> DataFrame:
    """The hash of each group's lines as ``out``.

    Equal lines count once; with ``repeats`` a line is led by the number of times it comes.
    """
    lines = rows.select(*keys, line.alias("_line"))
    if repeats:
        lines = lines.groupBy(*keys, "_line").agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, F.concat_ws(" ", F.col("_n").cast("string"), "_line").alias("_line"))
    return root_digest(leaf_digests(lines, keys, F.col("_line")), keys, out)


def leaf_of(line: Column) -> Column:
    """The leaf that a line is dealt to."""
    return F.substring(sha256(line), 1, 4)


def leaf_digests(rows: DataFrame, keys: Sequence[str], line: Column) -> DataFrame:
    """Rows (keys, leaf, digest) of every leaf that holds lines: what a group's hash is made of."""
    lines = rows.select(*keys, line.alias("_line"))
    return lines.groupBy(*keys, leaf_of(F.col("_line")).alias("leaf")).agg(_joined("_line").alias("digest"))


def root_digest(leaves: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """The hash of each group from the digests of its leaves."""
    return leaves.groupBy(*keys).agg(_joined("digest").alias(out))


def group_digests(rows: DataFrame, keys: Sequence[str], section: str, line: Column, outs: Mapping[str, str]) -> DataFrame:
    """The hashes of several sections of each group's lines at once, one column for each.

    ``outs`` names a section's column. Each is what ``group_digest`` gives for the lines of
    that section alone, null where a group has none; all sections share its two shuffles.
    """
    lines = rows.select(*keys, F.col(section).alias("_section"), line.alias("_line"))
    leaves = lines.groupBy(*keys, "_section", leaf_of(F.col("_line")).alias("_leaf")).agg(_joined("_line").alias("_digest"))
    return leaves.groupBy(*keys).agg(*[
        F.when(F.count(F.when(F.col("_section") == s, 1)) > 0, _joined(F.when(F.col("_section") == s, F.col("_digest")))).alias(out)
        for s, out in outs.items()])


def _joined(name: Column | str) -> Column:
    return sha256(F.array_join(F.array_sort(F.collect_set(name)), "\n"))


def digest_sql(source: str, keys: str, out: str) -> str:
    """The same in SQL. ``source`` gives the keys and ``line``."""
    return f"""SELECT {keys}, sha256(string_agg(leaf, chr(10) ORDER BY leaf)) AS {out} FROM (
    SELECT {keys}, sha256(string_agg(line, chr(10) ORDER BY line)) AS leaf FROM (SELECT DISTINCT {keys}, line FROM ({source}))
    GROUP BY {keys}, substr(sha256(line), 1, 4)) GROUP BY {keys}"""
