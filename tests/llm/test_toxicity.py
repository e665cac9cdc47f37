"""Held-out accuracy of the learned scores, and the edges of their contract."""

import random

import numpy as np

from pitstats.llm import toxicity as tx


def corpus(n=900):
    r = random.Random(2)
    syllables = ["an", "the", "or", "in", "st", "er", "ou", "li", "ch", "ne"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    bad = ["scumm", "idioth", "clownz", "lowei", "vequ"]
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.choice([20, 60, 300]))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(max(3, len(words) // 12)):
                words.insert(r.randrange(len(words)), r.choice(bad) + (r.choice(syllables) if r.random() < 0.5 else ""))
        docs.append((i, " ".join(words), i, 0.5))
        if r.random() < 0.7:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    more = [(None, "scumm idioth clownz", 0, 0.0), (5000, None, 0, 0.0), (5001, "", 0, 0.0), (docs[0][0], docs[0][1], 0, 0.0)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, y int, score double").repartition(4)
    ls = spark.createDataFrame([*labels, labels[0], (None, 1), (3, None), (7777, 1)], "doc_id long, toxic int")
    rows = tx.toxicity(df, ls).collect()
    assert len(rows) == len(docs) + len(more)
    truth = dict(labels)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (tx.crc_fold(r.doc_id) == 1) for r in rows if r.doc_id is not None)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = {r.doc_id for r in tx.drop_toxic(df, ls).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_held_out_recall_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = tx.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    found = [r.toxic for r in rows if r.predicted]
    assert sum(found) / sum(r.toxic for r in rows) >= 0.9 and sum(found) / len(found) >= 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string, y int, score double")
    flipped = [(i, 1 - y if tx.crc_fold(i) == 1 else y) for i, y in labels]
    a, b = (sorted(map(tuple, tx.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flipped))
    assert a == b


def test_no_positives_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in tx.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert tx.toxicity(docs.limit(0), none).collect() == []
    assert tx.drop_toxic(docs, none).count() == 1


def test_non_negative_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.random((600, 20)) < 0.3
    y = x[:, 0] & x[:, 1]
    rows = lambda a: tx.Rows([(np.flatnonzero(r), np.ones(int(r.sum()))) for r in a])
    w, b = tx.fit_pu(rows(x[y]), rows(x), 20, float(y.mean()), 0)
    score = x @ w + b
    assert score[y].min() > score[~y].mean() and w[0] > 0 and w[1] > 0
