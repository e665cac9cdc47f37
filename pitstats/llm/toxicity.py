"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, whatever their label, are unlabelled. With the class prior p,
the risk of the negative class is the unlabelled risk less p times the positives' share of it, and where a step would
push that difference below zero it is turned back (Kiryo et al.). Several logistic classifiers in numpy, each with its
own draw of unlabelled texts, are averaged. Features are the words of a text and their beginnings, present or not, and
how many of the text's words have a beginning, as a share of which RATE and more count as 1.

The classifiers are fitted on a bounded sample (MAX_POSITIVE and MAX_UNLABELLED documents, taken by a hash of the id);
scoring covers every whole text.

Defined results: a null or empty text scores as a text without known words; texts may be of any length (one text's
words are held at a time); without any positive the score is 0 for all, and where no feature tells the positives apart
it is the prior; repeated labels count once, a document with any
toxic label is toxic; a null id is not held out and not learned from, and its row is scored; rows of one id are scored
each by its own text; equal scores need no order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import doc_columns, in_batches, texts_of

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 6_000
#: Lengths of the word beginnings that are features beside whole words, and the share of words that counts as 1.
STEMS = (4, 5, 6, 7)
RATE = 0.01
MODELS = 5
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    """Whether an id is kept from learning: its crc32, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of(text: str) -> dict[str, float]:
    """Words, beginnings of words marked with `*`, and with `~` and a value the share of words that have them."""
    words = Counter(_WORD.findall(text.lower()))
    out = dict.fromkeys(words, 1.0)
    stems = Counter()
    for word, times in words.items():
        for n in STEMS:
            if len(word) > n:
                stems[word[:n]] += times
    whole = RATE * max(1, words.total())
    for stem, times in stems.items():
        out[f"{stem}*"] = 1.0
        out[f"{stem}~"] = min(1.0, times / whole)
    return out


class Model:
    """Feature -> weight, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.intercept = intercept
        self.words = {f: w for f, w in weights.items() if f[-1] not in "*~"}
        stems = {f[:-1] for f in weights if f[-1] in "*~"}
        #: beginning -> weights of its presence and of its share
        self.stems = {s: (weights.get(f"{s}*", 0.0), weights.get(f"{s}~", 0.0)) for s in stems}

    def score(self, text: str) -> float:
        words = Counter(_WORD.findall(text.lower()))
        total = self.intercept + sum(map(self.words.__getitem__, self.words.keys() & words.keys()))
        known, times = self.stems, Counter()
        for word, n in words.items():
            for size in STEMS:
                if len(word) > size and (stem := word[:size]) in known:
                    times[stem] += n
        whole = RATE * max(1, words.total())
        for stem in sorted(times):
            present, share = known[stem]
            total += present + share * min(1.0, times[stem] / whole)
        return 1.0 / (1.0 + math.exp(-min(40.0, max(-40.0, total))))


def pick_features(featured: DataFrame, sizes: dict[int, int]) -> list[str]:
    """Features whose mean among positives is well above their mean among unlabelled texts."""
    n_p, n_u = float(max(1, sizes.get(1, 0))), float(max(1, sizes.get(0, 0)))
    v, y = F.col("f.v"), F.col("y")
    sums = [F.sum(F.when(y == k, x)).alias(f"{name}{k}") for k in (0, 1) for name, x in (("s", v), ("q", v * v))]
    counts = featured.select("y", F.explode("f").alias("f")).groupBy(F.col("f.g").alias("g")).agg(*sums).na.fill(0.0)
    a, b = F.col("s1") / n_p, F.col("s0") / n_u
    spread = F.sqrt((F.col("q1") / n_p - a * a) / n_p + (F.col("q0") / n_u - b * b) / n_u) + 1e-9
    good = counts.where("s1 >= 2.5").withColumn("z", (a - b) / spread).where((F.col("z") > 2.5) & (a > 2 * b))
    return sorted(r["g"] for r in good.select("g").collect())


class Rows:
    """Sparse rows: all places and values one after another, and where each row begins."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.size = np.array([len(at) for at, _ in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.at = np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def __len__(self) -> int:
        return len(self.size)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, values, and for each the row's number among those taken."""
        size = self.size[rows]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        entry = np.repeat(self.begin[rows], size) + inner
        return self.at[entry], self.value[entry], np.repeat(np.arange(len(rows)), size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logistic_loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + exp(z)) of a negative, its slope, and the slope of log(1 + exp(-z)) of a positive."""
    return np.logaddexp(0, z), _sigmoid(z), -_sigmoid(-z)


def _sigmoid_loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """s(z) of a negative, its slope, and the slope of s(-z) of a positive."""
    s = _sigmoid(z)
    return s, s * (1 - s), -s * (1 - s)


def fit_pu(
    positive: Rows, unlabelled: Rows, features: int, prior: float, seed: int, epochs: tuple[int, int] = (15, 45),
    rate: float = 0.05, decay: float = 1e-6, batch: int = 256,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier under the non-negative risk, by Adam on minibatches.

    The convex logistic loss finds the direction; the bounded sigmoid loss of the paper, from there on, lets single
    texts of the wrong kind among the positives or the unlabelled pull less.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for loss, rounds in zip((_logistic_loss, _sigmoid_loss), epochs):
        m, v, step = np.zeros(features + 1), np.zeros(features + 1), 0
        for _ in range(rounds):
            order = rng.permutation(len(unlabelled))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                drawn = rng.integers(0, len(positive), min(batch, len(positive)))
                (at_u, v_u, row_u), (at_p, v_p, row_p) = unlabelled.take(chosen), positive.take(drawn)
                loss_u, slope_u, _ = loss(np.bincount(row_u, w[at_u] * v_u, len(chosen)) + w[-1])
                loss_p, slope_p, as_positive = loss(np.bincount(row_p, w[at_p] * v_p, len(drawn)) + w[-1])
                if loss_u.mean() - prior * loss_p.mean() >= 0:
                    on_p, on_u = prior * (as_positive - slope_p) / len(drawn), slope_u / len(chosen)
                else:  # turned back: up the negative part only
                    on_p, on_u = prior * slope_p / len(drawn), -slope_u / len(chosen)
                g = np.zeros(features + 1)  # without any entry a count has whole numbers
                g += np.bincount(at_p, on_p[row_p] * v_p, features + 1)
                g += np.bincount(at_u, on_u[row_u] * v_u, features + 1)
                g[-1] = on_p.sum() + on_u.sum()
                g[:-1] += decay * w[:-1]
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_models(positive: list, unlabelled: list, features: int, prior: float) -> tuple[np.ndarray, float]:
    """Mean weights and intercept of MODELS classifiers, each with four fifths of the unlabelled rows."""
    xp, fits = Rows(positive), []
    for seed in range(MODELS):
        draw = np.random.default_rng(100 + seed).permutation(len(unlabelled))[: max(1, len(unlabelled) * 4 // 5)]
        fits.append(fit_pu(xp, Rows([unlabelled[i] for i in draw]), features, prior, seed))
    return np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits]))


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` ids, the same ones whatever the partitioning."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    prior: float | None = None,
) -> Model | None:
    """Fits the averaged classifier on ids that are not held out; None where no toxic text is known.

    `prior` is the share of toxic texts; by default their share among the labelled ids that may be learned from.
    """
    docs = doc_columns(documents, id_col, text_col)
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    if prior is None:
        share = known.agg(F.avg("y")).first()[0] or 0.0
        prior = min(0.9, max(0.001, share))
    positive = _sample(known.where("y = 1").select("doc_id"), MAX_POSITIVE).withColumn("y", F.lit(1))
    rest = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    unlabelled = _sample(rest, MAX_UNLABELLED).withColumn("y", F.lit(0))
    # at most MAX_POSITIVE + MAX_UNLABELLED ids, so the broadcast is bounded
    picked = docs.join(F.broadcast(positive.unionByName(unlabelled)), "doc_id")
    pair = pa.struct([("g", pa.string()), ("v", pa.float64())])

    def make():
        def step(batch):
            found = [[{"g": g, "v": v} for g, v in sorted(features_of(t).items())] for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pair))], ["y", "f"])

        return step

    featured = in_batches(picked, make, "y int, f array<struct<g: string, v: double>>")
    sizes = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}
    if not sizes.get(1):
        return None
    names = pick_features(featured, sizes)
    if not names:
        return Model({}, math.log(prior / (1 - prior)))
    index = {f: i for i, f in enumerate(names)}

    def make_places():
        def step(batch):
            found = [sorted((index[f], v) for f, v in features_of(t).items() if f in index) for t in texts_of(batch)]
            places = pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32()))
            values = pa.array([[v for _, v in x] for x in found], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y")), places, values], ["doc_id", "y", "at", "v"])

        return step

    # one short row of numbers for each document of the bounded sample
    rows = in_batches(picked, make_places, "doc_id long, y int, at array<int>, v array<double>").collect()
    rows.sort(key=lambda r: (r["y"], r["doc_id"], r["at"], r["v"]))
    sides = {y: [(np.array(r["at"], np.int64), np.array(r["v"], float)) for r in rows if r["y"] == y] for y in (0, 1)}
    w, b = fit_models(sides[1], sides[0], len(index), prior)
    return Model({f: float(x) for f, x in zip(names, w)}, b)


def score_documents(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is 0.7 or more) of each whole text."""
    docs = doc_columns(documents, id_col, text_col)

    def make():
        def step(batch):
            scores = [model.score(t) if model else 0.0 for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return step

    scored = in_batches(docs, make, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def toxicity(documents: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Trains on the labels and scores all documents."""
    return score_documents(documents, train(documents, labels, **kw))


def drop_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all of their columns."""
    model = train(documents, labels, id_col, text_col)
    if model is None:
        return documents

    def make():
        def step(batch):
            keep = [model.score(t or "") < 0.7 for t in texts_of(batch, text_col)]
            return batch.filter(pa.array(keep, pa.bool_()))

        return step

    return in_batches(documents, make, documents.schema)


def crc_fold(doc_id: int) -> int:
    """The remainder that decides whether an id is held out."""
    return zlib.crc32(str(doc_id).encode()) % 3
