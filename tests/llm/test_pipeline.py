import corpus_pipeline
from llm import bpe, decontaminate, secrets, simhash, toxicity
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_keeps_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs.where(~held), spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held))
    out = steps["toxicity"](spark, docs, FOLDER)
    assert out.columns == docs.columns and ids(out) == ids(toxicity.scores(docs, model).where("predicted = 0"))
    out = steps["simhash_near_dedup"](spark, docs, FOLDER)
    assert out.columns == docs.columns and ids(out) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
    out = steps["decontamination"](spark, docs, FOLDER)
    assert out.columns == docs.columns and ids(out) == ids(decontaminate.contamination(docs, bench).where("n_hit = 0 OR 20 * n_hit < n_words"))
    out = steps["secrets"](spark, docs, FOLDER)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    left = secrets.findings(docs, secrets.fit(docs)).select("doc_id").distinct().count()
    assert out.where(F.contains("text", F.lit("[SECRET]"))).count() == left
    assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
    out = steps["bpe"](spark, docs, FOLDER)
    assert ids(out) == ids(docs) and bpe.decode(out.select("doc_id", F.unhex(F.array_join(F.transform(
        "ids", lambda i: F.reverse(F.lpad(F.hex(i.cast("long")), 8, "0"))), "")).alias("x")).limit(0), bpe.vocabulary(), ids="x").count() == 0


def test_run_and_odd_rows(spark, write):
    end = corpus_pipeline.run(spark, FOLDER)
    assert 0 < end.count() < spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "some words of a text here", "en", "s", 25), (4, "some words of a text here", "en", "s", 25), (None, "no key", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = write(documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    # Without labels nothing is rejected.
    assert sorted((r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == [(0, 2), (1, 0), (3, 6)]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 3
    nothing = write(documents=docs.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, nothing)
        assert none.count() == 0, name


def test_near_copies_stage_broadcasts_no_index_of_fingerprints(spark, monkeypatch):
    made, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: made.append(links(*a, **k)) or made[-1])
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(20)], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 7
    assert "Broadcast" not in made[0]._jdf.queryExecution().executedPlan().toString()
