import numpy as np

from llm import toxicity as t


def test_label_model_finds_accuracies_and_doubled_voters():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(int)
    vote = lambda right: np.where(rng.random(4000) < right, 2 * y - 1, 1 - 2 * y)
    one = vote(0.7)
    votes = np.stack([vote(0.95), vote(0.8), one, one, np.zeros(4000, int)], axis=1).astype(np.int8)
    known = np.where(np.arange(4000) < 400, y, -1)
    post, accuracy, corr = t.label_model(votes, known)
    assert ((post > 0.5) == y).mean() > 0.93 and abs(accuracy[0] - 0.95) < 0.04
    assert corr[2, 3] > 0.9 and corr[0, 1] < 0.2  # only agreement beyond the class counts


def documents(spark, n=400):
    rng = np.random.default_rng(2)
    word = lambda k: " ".join("".join(rng.choice(list("bdgklmnprst"), 2)) + "a" for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        rows.append((i, word(40) + (" zorgish idiot zorgally" if toxic else "") + " " + word(10), "en", 0.5))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_learning_scoring_and_odd_rows(spark):
    docs, labels, rows = documents(spark)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (2, 1, None), (0, 1, 1)], labels.schema))
    model = t.fit(docs, labels)
    odd = spark.createDataFrame([(-1, None, "x", 0.0), (-2, "", "x", 0.0), (None, "zorgish " * 9, "x", 0.0), (-3, "pa ka " * 30_000, "x", 0.0), (-3, "pa ka " * 30_000, "x", 0.0)], docs.schema)
    got = t.scores(docs.union(odd), model).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    of = {r.doc_id: r.predicted for r in got}
    assert sum(of[i] == (i % 5 == 0) for i in range(400)) >= 396 and of[-1] == of[-2] == of[-3] == 0
    clean = t.drop_toxic(docs.union(odd), model)
    assert clean.columns == docs.columns and clean.count() == sum(1 for r in got if not r.predicted)


def test_unlabelled_rows_are_bounded_by_their_own_count(spark):
    docs, marks = spark.range(20_000).withColumnRenamed("id", "doc_id"), spark.createDataFrame([(i, i % 2) for i in range(0, 400, 4)], "doc_id long, y int")
    got = [r.doc_id for r in t.unlabelled(docs, marks, "doc_id", 1_000).collect()]
    assert 700 < len(got) <= 1_000 and len(set(got)) == len(got) and not set(got) & set(range(0, 400, 4))
    assert t.unlabelled(docs, marks, "doc_id", 20_000).count() == 19_900


def test_one_class_or_no_labels(spark):
    docs, labels, _ = documents(spark, 40)
    assert {round(r.score, 6) for r in t.scores(docs, t.fit(docs, labels.limit(0))).collect()} == {0.25}
    assert max(r.score for r in t.scores(docs, t.fit(docs, labels.where("toxic = 0"))).collect()) < 0.1
    assert t.scores(docs.limit(0), t.fit(docs.limit(0), labels)).count() == 0


def test_held_out_rows_of_the_tables(spark):
    from llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = QUERIES["op3_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    clean = [r for r in got if r.toxic == 0]
    assert len(clean) > 40 and sum(r.predicted for r in clean) <= 0.05 * len(clean)
