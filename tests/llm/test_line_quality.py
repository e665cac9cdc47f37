"""Held-out accuracy of the line field, its inference against brute force, and the edges of its contract."""

import itertools

import numpy as np
import pytest

from pitstats.llm import line_quality as lq


def test_marginals_equal_all_labellings(monkeypatch):
    monkeypatch.setattr(lq, "BLOCK", 3)
    rng = np.random.default_rng(0)
    sizes = np.array([1, 7, 2, 4])
    emission, moves = rng.normal(size=14) * 2, rng.normal(size=(2, 2))
    got, at = lq.marginals(emission, sizes, moves), 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + i] * y for i, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            good += w * (1 - np.array(labels))
        assert np.allclose(got[at : at + n], good / total, rtol=1e-9)
        at += n


def test_gradient_is_of_the_likelihood():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4])
    e, m, y = rng.normal(size=8), rng.normal(size=(2, 2)), rng.integers(0, 2, 8)

    def value(e, m):
        out, at = 0.0, 0
        for n in sizes:
            score = lambda ls: sum(e[at + i] * v for i, v in enumerate(ls)) + sum(m[a, b] for a, b in zip(ls, ls[1:]))  # noqa: B023,E731
            out += score(y[at : at + n]) - np.log(sum(np.exp(score(ls)) for ls in itertools.product((0, 1), repeat=int(n))))
            at += n
        return out

    by_line, by_move = lq._likelihood(e, y, sizes, m)
    d = 1e-6
    assert np.allclose([(value(e + d * u, m) - value(e - d * u, m)) / 2 / d for u in np.eye(8)], by_line, atol=1e-7)
    steps = np.eye(4).reshape(4, 2, 2)
    assert np.allclose([(value(e, m + d * u) - value(e, m - d * u)) / 2 / d for u in steps], by_move.ravel(), atol=1e-7)


def test_slices_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["The", "of", "thér", "AB!!", "x|y", "###", "", "two,"]
    texts = [" ".join(rng.choice(words, n)).replace("of The", "of\nThe").encode() for n in (0, 1, 30_000, 5, 9_000)]
    whole = [lq.line_bins([t]) for t in texts]
    bins, lengths, sizes = lq.line_bins(texts)
    assert (np.concatenate([b for b, _, _ in whole]) == bins).all() and sizes.tolist() == [s[0] for _, _, s in whole]
    weights = rng.normal(size=lq.SHAPE)
    emission = lq.emissions(bins, sizes, weights)
    monkeypatch.setattr(lq, "SLICE", 9_000)
    monkeypatch.setattr(lq, "BLOCK", 50)
    again, length, count = lq.line_bins(texts)
    assert (length == lengths).all() and (count == sizes).all() and (again != bins).any(axis=1).mean() < 0.02
    assert np.allclose(lq.emissions(bins, sizes, weights), emission)


def test_held_out_accuracy_on_the_given_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = lq.quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert all(lq.crc_fold(r.doc_id) == 2 for r in rows)
    good, bad = [[r.predicted for r in rows if r.quality == k] for k in (1, 0)]
    assert np.mean(good) >= 0.99 and 1 - np.mean(bad) >= 0.97


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(5)
    line = lambda bad: " ".join((w.upper() + "!!" if bad else w) for w in r.choice(["the", "house", "was", "old", "and", "warm"], 8))
    docs = [(i, "\n".join(line(i % 4 == 0 and j % 3 > 0) for j in range(1 + i % 9)), "x", 0.5) for i in range(300)]
    return docs, [(i, 0 if i % 4 == 0 and i % 9 else 1) for i in range(300) if i % 7]


def test_rows_labels_and_lines(spark, small):
    docs, labels = small
    more = [(None, "THE HOUSE!!\nWAS!! OLD!!", "x", 0.0), (900, None, "x", 0.0), (901, "", "x", 0.0), (docs[1][0], docs[1][1], "x", 0.0)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, y string, score double").repartition(3)
    ls = spark.createDataFrame([*labels, labels[0], (None, 1), (3, None), (4, 7), (7777, 1)], "doc_id long, quality int")
    rows = lq.quality(df, ls).collect()
    assert len(rows) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out
    score = {r.doc_id: r.score for r in rows}
    assert score[900] == score[901]
    truth = dict(labels)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - y if lq.crc_fold(i) == 2 else y) for i, y in labels], "doc_id long, quality int")
    assert sorted(map(tuple, lq.quality(spark.createDataFrame(docs, df.schema), flipped).collect())) == sorted(tuple(r) for r in lq.quality(spark.createDataFrame(docs, df.schema), spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    field = lq.train(df, ls)
    lines = lq.line_labels(df.where("doc_id in (8, 12, 16)"), field).collect()
    assert len(lines) == sum(1 + i % 9 for i in (8, 12, 16))
    assert np.mean([r.label == ("bad" if r.line % 3 > 0 else "good") for r in lines]) > 0.9


def test_one_kind_of_label_and_empty(spark, small):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in lq.quality(docs, none).collect()] == [0.5]
    ids = [i for i in range(20) if lq.crc_fold(i) != 2]
    assert [r.score for r in lq.quality(docs, spark.createDataFrame([(i, 1) for i in ids], none.schema)).collect()] == [1.0]
    full = spark.createDataFrame(small[1], none.schema)
    assert lq.quality(docs.limit(0), full).collect() == []
