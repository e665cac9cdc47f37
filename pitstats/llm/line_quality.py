"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. Its features are the bins of its own shares (letters, capitals, signs, repeated
words and so on), lengths and whether it repeats the line before, and the same bins of the lines before and after it; a
transition weight ties neighbouring labels. The field is fitted by its likelihood in numpy. Labels are of documents: all
lines of one start with its label, first by their own bins alone; then lines of bad documents that are found good are
labelled good (never all lines of a document), and the field is fitted on. Forward-backward marginals of being good, weighted by the lines'
lengths in bytes, are a document's mean, and a logistic curve over that mean, fitted with the classes' true shares, is
its score.

It is fitted on at most MAX_DOCS documents of each label, taken by a hash of the id, with up to MAX_LINES lines each;
scoring covers every whole text. Bytes are counted in slices of SLICE bytes with all lines of many documents in one
array, so a text or a line of any length takes some bytes for each of its lines and a bounded buffer.

Defined results: a null or empty text is one empty line; without labels of both kinds the score is the share of good
labels, and 0.5 without any; labels other than 0 and 1 are left out; of an id with several labels the least counts; a
null id is not held out and not learned from, and its row is scored; rows of one id are scored each by its own text;
equal scores need no order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import bytes_of, doc_columns, in_batches, pack, unpack

MAX_DOCS = 1_500
MAX_LINES = 2_000
SLICE = 2 << 20
BLOCK = 1 << 16
PREDICTED = 0.7

#: Classes of bytes that are counted; bytes of several classes count in each.
_SETS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:",
    "mark": b"!?", "quote": b"'\"()-", "bar": b"|_=/\\<>[]{}", "sign": b"#$%&*+@^~`", "space": b" \t\r",
}
#: Bounds of the bins of a share.
EDGES = np.array([1e-9, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85, 0.97])
BINS = 20
_TABLE = np.zeros((len(_SETS) + 1, 256), bool)
for _at, _bytes in enumerate(_SETS.values()):
    _TABLE[_at, list(_bytes)] = True
_TABLE[-1, 0xC0:] = True  # first bytes of other characters
LAGS = 4
#: Columns of the counts of a line: bytes, the classes, words, words that begin with a capital, words equal to the one
#: LAG before, bytes of words squared.
_COUNTS = 1 + len(_TABLE) + 2 + LAGS + 1
_NEWLINE, _MIX = 10, np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[begin:end] for each word: its bytes times powers of an odd number, from the word's first byte."""
    at = begin[0]
    place = np.arange(at, len(data)) - np.repeat(begin, np.diff(np.r_[begin, len(data)]))
    powers = np.cumprod(np.full(256, _MIX))
    value = (data[at:].astype(np.uint64) + np.uint64(1)) * powers[place & 255]
    total = np.r_[np.uint64(0), np.cumsum(value)]
    return (total[end - at] - total[begin - at]) ^ ((end - begin).astype(np.uint64) * _MIX)


def _slice_counts(data: np.ndarray) -> np.ndarray:
    """Counts of each line of a buffer; newlines part lines."""
    breaks = data == _NEWLINE
    line = np.cumsum(breaks) - breaks  # a newline belongs to the line it ends, and is not counted
    lines = int(breaks.sum()) + 1
    out = np.zeros((lines, _COUNTS))
    text = ~breaks
    out[:, 0] = np.bincount(line[text], minlength=lines)
    for k, table in enumerate(_TABLE, 1):
        hit = table[data]
        out[:, k] = np.bincount(line[hit], minlength=lines)
    gap = _TABLE[list(_SETS).index("space")][data] | breaks
    inner = ~gap
    begin = np.flatnonzero(inner & np.r_[True, gap[:-1]]) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inner & np.r_[gap[1:], True]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(begin):
        k = 1 + len(_TABLE)
        own = line[begin]
        out[:, k] = np.bincount(own, minlength=lines)
        capital = _TABLE[list(_SETS).index("upper")][data[begin]]
        out[:, k + 1] = np.bincount(own[capital], minlength=lines)
        words = _word_hashes(data, begin, end)
        for lag in range(1, LAGS + 1):
            same = (words[lag:] == words[:-lag]) & (own[lag:] == own[:-lag])
            out[:, k + 1 + lag] = np.bincount(own[lag:][same], minlength=lines)
        out[:, -1] = np.bincount(own, ((end - begin) ** 2).astype(float), minlength=lines)
    return out


def _cut(text: np.ndarray, at: int) -> int:
    """Where the slice that begins at `at` ends: after a space or newline where there is one in its last part."""
    end = at + SLICE
    if end >= len(text):
        return len(text)
    last = text[end - 4096 : end]
    gaps = np.flatnonzero((last == _NEWLINE) | (last == 32))
    return end - 4096 + int(gaps[-1]) + 1 if len(gaps) else end


def _bins(counts: np.ndarray, previous: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """Bins of each line's own features, a column each; `previous` are the counts of the line before the first one."""
    size, k = counts[:, 0], 1 + len(_TABLE)
    byte, words, letters = np.maximum(size, 1), np.maximum(counts[:, k], 1), np.maximum(counts[:, 1] + counts[:, 2], 1)
    shares = [counts[:, i] / byte for i in range(1, k)]
    shares += [counts[:, 2] / letters, counts[:, k + 1] / words, *(counts[:, k + 1 + lag] / words for lag in range(1, LAGS + 1))]
    shares += [counts[:, k + 2 : k + 2 + LAGS].sum(axis=1) / words]
    bins = [np.searchsorted(EDGES, s, side="right") for s in shares]
    logs = [np.log2(1 + size), np.log2(1 + counts[:, k]), np.log2(1 + counts[:, -1] / words), 2 * np.log2(1 + np.where(counts[:, k] > 0, size / words, 0))]
    bins += [np.minimum(BINS - 1, v).astype(np.int64) for v in logs]
    before = np.concatenate([counts[:1] * np.nan if previous is None else previous[None, :], counts[:-1]])
    bins.append(np.where(first, 2, (counts == before).all(axis=1)))
    return np.stack(bins, axis=1).astype(np.uint8)


def _sliced(text: np.ndarray) -> Iterator[np.ndarray]:
    """Counts of a text's lines in order, some at a time: the slice's last line waits for what the next one adds."""
    at, open_ = 0, None
    while at < len(text):
        end = _cut(text, at)
        counts = _slice_counts(text[at:end])
        if open_ is not None:
            counts[0] += open_
        open_, at = counts[-1], end
        if len(counts) > 1:
            yield counts[:-1]
    yield open_[None, :]


def line_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins and bytes of all lines of the texts one after another, and how many lines each text has."""
    bins, lengths, sizes = [], [], []
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and total + len(texts[stop]) < SLICE:
            total += len(texts[stop]) + 1
            stop += 1
        if stop > start:
            counts = _slice_counts(np.frombuffer(b"\n".join(texts[start:stop]), np.uint8))
            own = [t.count(b"\n") + 1 for t in texts[start:stop]]
            first = np.zeros(len(counts), bool)
            first[np.cumsum(own) - own] = True
            bins.append(_bins(counts, None, first))
            lengths.append(counts[:, 0])
            sizes += own
        else:  # a text of more than a slice
            previous, lines, stop = None, 0, start + 1
            for counts in _sliced(np.frombuffer(texts[start], np.uint8)):
                first = np.zeros(len(counts), bool)
                first[0] = previous is None
                bins.append(_bins(counts, previous, first))
                lengths.append(counts[:, 0])
                previous, lines = counts[-1], lines + len(counts)
            sizes.append(lines)
        start = stop
    if not bins:
        return np.zeros((0, FEATURES), np.uint8), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(bins), np.concatenate(lengths), np.array(sizes, np.int64)


FEATURES = len(_TABLE) + 3 + LAGS + 4 + 1
#: Weights: for each of the line itself, the one before and the one after, for each feature one for each bin; the bin
#: BINS of a neighbour says that there is none.
SHAPE = (3, FEATURES, BINS + 1)


class Field(NamedTuple):
    """Emission weights towards bad, transition weights (good/bad to good/bad), and the curve over a document's mean."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    level: float


def around(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the active weights of each line: its own bins and both neighbours'."""
    none = np.full((1, FEATURES), BINS, np.uint8)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    stops = np.cumsum(sizes)
    before[stops - sizes], after[stops - 1] = BINS, BINS
    step = np.arange(FEATURES) * (BINS + 1)
    block = FEATURES * (BINS + 1)
    return np.concatenate([bins + step, before + step + block, after + step + 2 * block], axis=1)


def emissions(bins: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of each line's active weights, BLOCK lines at a time."""
    ends = np.zeros(len(bins) + 1, bool)
    ends[np.cumsum(sizes)] = True
    ends[0] = True
    out = np.zeros(len(bins))
    for at in range(0, len(bins), BLOCK):
        low, high = max(0, at - 1), min(len(bins), at + BLOCK + 1)
        cuts = np.flatnonzero(ends[low + 1 : high]) + 1
        places = around(bins[low:high], np.diff(np.r_[0, cuts, high - low]))
        out[at : at + BLOCK] = weights.ravel()[places[at - low : at - low + BLOCK]].sum(axis=1)
    return out


def marginals(emission: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of being good, text by text, from the odds of bad to good.

    Of long texts only the messages at every BLOCK-th line are kept on the way forward, and a block's are made again on
    the way back.
    """
    (gg, gb), (bg, bb) = np.exp(moves).tolist()
    out = np.zeros(len(emission))

    def forward(odds: list[float], r: float | None) -> list[float]:
        ahead = []
        for e in odds:
            r = e if r is None else e * (gb + r * bb) / (gg + r * bg)
            r = 1e-13 if r < 1e-13 else min(r, 1e13)
            ahead.append(r)
        return ahead

    def odds_of(at: int, end: int) -> list[float]:
        return np.exp(np.clip(emission[at:end], -30, 30)).tolist()

    start = 0
    for n in sizes.tolist():
        stop, into, r = start + n, [], None
        for at in range(start, stop, BLOCK):
            into.append(r)
            if at + BLOCK < stop:
                r = forward(odds_of(at, at + BLOCK), r)[-1]
        back = 1.0
        for at, r in zip(reversed(range(start, stop, BLOCK)), reversed(into)):
            own = odds_of(at, min(stop, at + BLOCK))
            ahead, found = forward(own, r), [0.0] * len(own)
            for i in range(len(own) - 1, -1, -1):
                found[i] = 1.0 / (1.0 + ahead[i] * back)
                x = own[i] * back
                back = (bg + bb * x) / (gg + gb * x)
            out[at : at + len(own)] = found
        start = stop
    return out


def document_means(good: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals of being good weighted by bytes (and one for each line, so that empty ones have a weight)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weight = lengths + 1
    return np.bincount(doc, good * weight, len(sizes)) / np.bincount(doc, weight, len(sizes))


def _likelihood(emission: np.ndarray, bad: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the chains' log-likelihood by each line's emission and by the transitions; all chains step by step."""
    order = np.argsort(-sizes, kind="stable")
    start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    m = np.exp(moves)
    e = np.ones((len(emission), 2))
    e[:, 1] = np.exp(np.clip(emission, -30, 30))
    ahead, back = np.zeros_like(e), np.ones_like(e)
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    for t, n in enumerate(live):
        now = start[:n] + t
        ahead[now] = e[now] if t == 0 else e[now] * (ahead[now - 1] @ m)
        ahead[now] /= ahead[now].sum(axis=1, keepdims=True)
    moved = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        now = start[: live[t + 1]] + t
        next_ = e[now + 1] * back[now + 1]
        pair = ahead[now][:, :, None] * m * next_[:, None, :]
        moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[now] = next_ @ m.T
        back[now] /= back[now].sum(axis=1, keepdims=True)
    both = ahead * back
    expected = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(bad), bool)
    inner[start] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (bad[at - 1], bad[at]), 1)
    return bad - expected, seen - moved


def _fit_field(places: np.ndarray, bad: np.ndarray, sizes: np.ndarray, weights: np.ndarray, moves: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean log-likelihood with a small quadratic penalty."""
    total, rate, decay = len(bad), 0.05, 1e-4
    state = [np.zeros(weights.size + 4), np.zeros(weights.size + 4)]
    theta = np.r_[weights.ravel(), moves.ravel()]
    for step in range(1, steps + 1):
        w, m = theta[:-4], theta[-4:].reshape(2, 2)
        by_line, by_move = _likelihood(w[places].sum(axis=1), bad, sizes, m)
        g = np.r_[np.bincount(places.ravel(), np.repeat(by_line, places.shape[1]), len(w)), by_move.ravel()] / total - decay * theta
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g
        theta = theta + rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
    return theta[:-4].reshape(weights.shape), theta[-4:].reshape(2, 2)


def _fit_curve(mean: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope, at least 0, and level of a logistic curve by weighted Newton steps with a small penalty on the slope."""
    x = np.stack([mean - 0.5, np.ones(len(mean))], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (good - p)) - np.array([1e-3, 1e-6]) * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, g)
        theta += step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
    return max(0.0, float(theta[0])), float(theta[1])


def fit_field(bins: list[np.ndarray], lengths: list[np.ndarray], good: np.ndarray, share: float) -> Field:
    """A field from documents' line bins, lengths and labels; `share` is the true share of good documents."""
    sizes = np.array([len(b) for b in bins], np.int64)
    rows, length = np.concatenate(bins), np.concatenate(lengths)
    places = around(rows, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bad_doc = (1 - good)[doc]
    bad = bad_doc.copy()
    weights, moves = np.zeros(SHAPE), np.zeros((2, 2))
    alone = np.ones(len(bad), np.int64)
    # first each line by its own bins, as if it were a text: else a bad document's good lines are told by their place
    for steps, used, chains in ((40, places[:, :FEATURES], alone), (60, places, sizes), (30, places, sizes)):
        weights, moves = _fit_field(used, bad, chains, weights, moves, steps)
        p = marginals(weights.ravel()[used].sum(axis=1), chains, moves)
        worst = np.full(len(sizes), np.inf)
        np.minimum.at(worst, doc, p)
        bad = bad_doc * ((p < 0.5) | (p <= worst[doc])).astype(np.int64)
    p = marginals(weights.ravel()[places].sum(axis=1), sizes, moves)
    mean = document_means(p, length, sizes)
    weight = np.where(good == 1, share / max(1, good.sum()), (1 - share) / max(1, (1 - good).sum())) * len(good)
    return Field(weights, moves, *_fit_curve(mean, good, weight))


def held_out(doc_id):
    """Whether an id is kept from learning: its crc32, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc_fold(doc_id: int) -> int:
    """The remainder that decides whether an id is held out."""
    return zlib.crc32(str(doc_id).encode()) % 4


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | float:
    """Fits the field on ids that are not held out; the share of good labels where they are all of one kind."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return share if counts else 0.5
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    chosen = [known.where(F.col("y") == y).orderBy(*by_hash).limit(MAX_DOCS) for y in (0, 1)]
    # at most 2 MAX_DOCS ids, so the broadcast is bounded
    picked = doc_columns(documents, id_col, text_col).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def make():
        def step(batch):
            out = []
            for text in bytes_of(batch):
                bins, lengths, _ = line_bins([text])
                out.append(pack([bins.ravel(), lengths]) if len(bins) <= MAX_LINES else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "data"])

        return step

    # one packed row for each document of the bounded sample
    rows = in_batches(picked, make, "doc_id long, y int, data binary").where("data is not null").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["data"])))
    if len({r["y"] for r in rows}) < 2:
        return share
    found = [unpack(r["data"]) for r in rows]
    return fit_field([b.reshape(-1, FEATURES) for b, _ in found], [n for _, n in found], np.array([r["y"] for r in rows], np.int64), share)


def scores(texts: list[bytes], field: Field | float) -> np.ndarray:
    """The quality of each text."""
    if not isinstance(field, Field):
        return np.full(len(texts), field)
    means = []
    for some in _grouped(texts):
        bins, lengths, sizes = line_bins(some)
        good = marginals(emissions(bins, sizes, field.weights), sizes, field.moves)
        means.append(document_means(good, lengths, sizes))
    mean = np.concatenate(means) if means else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(field.slope * (mean - 0.5) + field.level, -30, 30)))


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, some slices' worth at a time."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= 4 * SLICE or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, total = i + 1, 0


def score_documents(documents: DataFrame, field: Field | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is 0.7 or more) of each whole text."""

    def make():
        def step(batch):
            found = scores(bytes_of(batch), field)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

        return step

    scored = in_batches(doc_columns(documents, id_col, text_col), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"))


def line_labels(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), n_bytes, good (the marginal) and label of every line of every text."""

    def make():
        def step(batch):
            bins, lengths, sizes = line_bins(bytes_of(batch))
            if not len(bins):
                return None
            good = marginals(emissions(bins, sizes, field.weights), sizes, field.moves)
            number = np.arange(len(good)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            label = pa.array(np.where(good >= 0.5, "good", "bad").tolist(), pa.string())
            columns = [doc, pa.array(number, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(good), label]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "n_bytes", "good", "label"])

        return step

    return in_batches(doc_columns(documents, id_col, text_col), make, "doc_id long, line long, n_bytes long, good double, label string")


def quality(documents: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Trains on the labels and scores all documents."""
    return score_documents(documents, train(documents, labels, **columns))
