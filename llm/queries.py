"""The registered queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontaminate, html, language, lexical, lm, neighbours, packing, prefixes, secrets, simhash, toxicity, warc
from llm.common import bucket, durable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCHMARK_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op6_bpe")
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and their text again, as digests."""
    return bpe.round_trip(table(spark, folder, "documents"), bpe.vocabulary())


@query("op2_html")
def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages")
    return html.extract(pages, html.fit(pages))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four buckets in five."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = bucket("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_secrets")
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets in every document."""
    docs = table(spark, folder, "documents")
    return secrets.findings(docs, secrets.fit(docs))


@query("op5_lm")
def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document, learned from six buckets in seven."""
    docs = table(spark, folder, "documents")
    held_out = bucket("doc_id", 7) == 2
    known = docs.where(~held_out)
    counts = durable(lm.word_counts(known))
    vocab, net = lm.fit(known, counts)
    return lm.score(docs, counts, vocab, net).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_language")
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two buckets in three."""
    docs = table(spark, folder, "documents")
    held_out = bucket("doc_id", 3) == 1
    known = language.profiles(docs.where(~held_out))
    found = language.identify(docs, known)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page through an ARC file and its WARC conversion."""
    return warc.through_archives(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_decontamination", f"""
WITH d AS (SELECT doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_BENCHMARK_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins)),
occ AS (SELECT s.doc_id, wins.item_id, s.i, s.n FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM spots) s JOIN wins USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of the benchmark's items."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query("op11_packing")
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), packing.vocabulary()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_lexical", f"""
WITH d AS (SELECT doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
sized AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
b AS (SELECT DISTINCT item_id, unnest({_BENCHMARK_WORDS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM b JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (doc_id), whole GROUP BY ALL)
SELECT item_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""")
def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents that match each benchmark item best."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the rebuilt conversations."""
    return prefixes.conversation_trie(table(spark, folder, "conversations"))
