"""Corpus preparation: toxic documents, near copies and benchmark passages go, secrets are struck out, the rest is tokenised.

Every stage but the last returns the columns of its documents as they are, further ones
too. Null and empty texts are scored as texts without words, are near copies of each other
(one stays), hold no benchmark words and no secrets, and give no tokens. Documents without
an id are scored as others, and then stay: they are linked to and compared with none. Rows that repeat an id
share its fate and stay repeated. An empty table gives an empty result; without labels of
both classes the smoothed share of toxic ones is every document's score (0.25 without any).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontaminate, secrets, simhash, toxicity
from llm.common import bucket, durable, table, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of one bucket in five stay unread, as for the operator's query."""
    tune(spark)
    held_out = bucket("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of linked fingerprints."""
    tune(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is inside benchmark windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def strike_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    tune(spark)
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    tune(spark)
    return bpe.round_trip(docs, bpe.vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", strike_secrets),
    ("bpe", tokenise),
]

#: SQL can express neither the models nor the merges; tests compare each stage with its operator, which has tests of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
