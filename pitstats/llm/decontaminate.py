"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

An item of m characters within e edits of a passage shares at least m + 1 - q (e + 1) q-grams with it, and the places
of these, in the text less in the item, lie within e + 1 diagonals. Diagonals are cut into bands that overlap by e, so
one band holds them all. Bands with fewer shared q-grams are left; in the others a banded alignment finds the least
number of edits between the whole item and any passage on these diagonals, and where that passage begins and ends.

The budget of edits is a share of the item's length. Items have the longest q-grams up to Q bytes that keep the bound
positive, so short items have shorter ones; items below Q bytes have no edit to spend and are looked up as they are.

Texts are compared as UTF-8 bytes after lower-casing, with each run of white space as one blank. The items are a query
set: they are sent to the tasks in blocks of bounded size, and each block meets all documents.

Defined results: null and empty texts and items match nothing; texts and items may be of any length (memory is bounded
by the text, the item and fixed sizes); of several passages of an item in a text the one with the fewest edits is
given, then the one of the first band, with the first end and the last begin; items with equal texts each match;
repeated document rows each match; a null id is kept as such; an empty benchmark matches nothing; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import doc_columns, in_batches, texts_of

#: Longest q-gram in bytes (one machine word) and edits allowed per byte of an item.
Q, RATE = 8, 0.1
#: Bytes of items in one block of the query set.
BLOCK_BYTES = 4 << 20
#: Bytes of texts searched at a time, meetings of q-grams counted at a time, and cells of the alignments made together.
CHUNK, MEETINGS, CELLS = 256 << 10, 250_000, 4_000_000
_U = np.uint64


def normalised(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed for an item of m bytes."""
    return int(rate * m)


def gram_size(m: int, edits: int) -> int:
    """The longest q-gram, up to Q bytes, for which the lemma's bound m + 1 - q (edits + 1) is positive."""
    return min(Q, m // (edits + 1))


@dataclass(frozen=True)
class Hit:
    item: int
    edits: int
    start: int
    end: int


def _codes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at each place as an integer."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    code = np.concatenate((data, np.zeros(Q - q, np.uint8))).astype(np.uint64)
    for width, bits in ((1, 8), (2, 16), (4, 32)):
        code = code[:-width] << _U(bits) | code[width:]
    return code >> _U(8 * (Q - q))


def banded_edits(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item and text: least edits between the item and a passage on diagonals low to high, its begin and end.

    All alignments advance together, a row of each table at a time; longer items stay when shorter ones are done. An
    entry is the edits so far and, below them, the diagonal on which the passage begins, counted from the last.
    """
    size = np.array([len(x) for x in items], np.int64)
    order = np.argsort(-size, kind="stable")
    size, low, width = size[order], low[order], (high - low + 1)[order]
    length = np.array([len(texts[n]) for n in order], np.int64)
    most, wide = int(size[0]), int(width.max())
    edit, far = np.int64(1) << 31, np.int64(1) << 61
    item = np.full((len(order), most), -1, np.int16)
    text = np.full((len(order), most + wide), 256, np.int16)  # 256: outside the text
    for row, n in enumerate(order):
        item[row, : size[row]] = items[n]
        a, b = max(0, low[row]), min(length[row], low[row] + most + wide)
        if b > a:
            text[row, a - low[row] : b - low[row]] = texts[n][a:b]
    steps = np.arange(wide, dtype=np.int64)
    place = low[:, None] + steps  # of the next byte of the text, on each diagonal
    unused = steps >= width[:, None]
    begun = wide - steps
    previous = np.where((place >= 0) & (place <= length[:, None]) & ~unused, begun, far)
    shift = steps * edit
    edits, starts, ends = (np.zeros(len(order), np.int64) for _ in range(3))
    live = len(order)
    for i in range(most):
        own = text[:live, i : i + wide]
        previous = previous[:live]
        cost = previous + np.where(own == 256, far, (own != item[:live, i, None]) * edit)
        cost[:, :-1] = np.minimum(cost[:, :-1], previous[:, 1:] + edit)
        # before the text begins nothing is aligned: all bytes of the item so far are edits
        at = -(low[:live] + i + 1)
        rows = np.flatnonzero((at >= 0) & (at < width[:live]))
        cost[rows, at[rows]] = np.minimum(cost[rows, at[rows]], (i + 1) * edit + begun[at[rows]])
        now = place[:live] + (i + 1)
        cost[(now < 0) | unused[:live]] = far
        cost = np.minimum.accumulate(cost - shift, axis=1) + shift
        cost[(now > length[:live, None]) | unused[:live]] = far
        np.minimum(cost, far, out=cost)
        done = live - int(np.searchsorted(-size[:live], -(i + 1), side="left"))
        if done:
            for row in range(live - done, live):
                best = int(np.argmin(cost[row] // edit))
                edits[row], ends[row] = cost[row, best] // edit, low[row] + size[row] + best
                starts[row] = max(0, low[row] + wide - cost[row, best] % edit)
            live -= done
            if not live:
                break
        previous = cost
    back = np.argsort(order)
    return edits[back], starts[back], ends[back]


class _Index:
    """The q-gram index of some items that share one q."""

    def __init__(self, numbers: list[int], items: list[bytes], edits: np.ndarray, q: int):
        self.numbers, self.raw, self.edits, self.q = numbers, items, edits, q
        self.items = [np.frombuffer(x, np.uint8) for x in items]
        m = np.array([len(x) for x in items], np.int64)
        self.least = m + 1 - q * (self.edits + 1)
        self.band = np.maximum(self.edits + 1, 16)
        codes = [_codes(x, q) for x in self.items]
        of_item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes])
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.of_item, self.place = of_item[order], place[order]
        self.code, self.first, self.times = np.unique(code[order], return_index=True, return_counts=True)
        self.may = np.zeros(1 << 22, bool)
        self.may[self._cell(self.code)] = True

    @staticmethod
    def _cell(code: np.ndarray) -> np.ndarray:
        return ((code * _U(0x9E3779B97F4A7C15)) >> _U(42)).astype(np.int64)

    def _meetings(self, data: np.ndarray, bounds: np.ndarray):
        """(text, item, diagonal) of all shared q-grams, a bounded number at a time but for one place of the text."""
        code = _codes(data, self.q)
        at = np.flatnonzero(self.may[self._cell(code)])
        found = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        real = self.code[found] == code[at]
        at, found = at[real], found[real]
        doc = np.searchsorted(bounds, at, side="right") - 1
        whole = at + self.q <= bounds[doc + 1]
        at, found, doc = at[whole], found[whole], doc[whole]
        times = self.times[found]
        sums = np.cumsum(times)
        cuts = np.unique(np.searchsorted(sums, np.arange(0, (sums[-1] if len(sums) else 0) + MEETINGS, MEETINGS)))
        for i, j in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(at)]):
            t = times[i:j]
            entry = np.repeat(self.first[found[i:j]], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            d = np.repeat(doc[i:j], t)
            yield d, self.of_item[entry], np.repeat(at[i:j], t) - bounds[d] - self.place[entry]

    def candidates(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first and last diagonal) of the bands that share enough q-grams."""
        parts = []
        for doc, item, diagonal in self._meetings(data, bounds):
            # each diagonal is in the band that begins at or before it, and in the one before while that one overlaps
            width = self.band[item]
            band = np.floor_divide(diagonal, width)
            twice = diagonal - band * width < self.edits[item]
            key = np.stack((np.concatenate((doc, doc[twice])), np.concatenate((item, item[twice])), np.concatenate((band, band[twice] - 1))), axis=1)
            order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
            key = key[order]
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else order
            parts.append((key[begin], np.diff(np.append(begin, len(key)))))
        if not parts:
            return []
        key, count = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        if len(parts) > 1:
            order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
            key, count = key[order], count[order]
            begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            key, count = key[begin], np.add.reduceat(count, begin)
        key = key[count >= self.least[key[:, 1]]]
        low = key[:, 2] * self.band[key[:, 1]]
        high = low + self.band[key[:, 1]] + self.edits[key[:, 1]] - 1
        return list(zip(key[:, 0].tolist(), key[:, 1].tolist(), low.tolist(), high.tolist()))


class Searcher:
    """Items indexed by their q-grams."""

    def __init__(self, items: list[bytes], rate: float = RATE):
        groups: dict[int, list[int]] = {}
        for number, item in enumerate(items):
            if item:
                groups.setdefault(gram_size(len(item), budget(len(item), rate)) if len(item) >= Q else 0, []).append(number)
        self.short = [(n, items[n]) for n in groups.pop(0, [])]
        self.indexes = [
            _Index(own, [items[n] for n in own], np.array([budget(len(items[n]), rate) for n in own], np.int64), q) for q, own in groups.items()
        ]

    def search(self, texts: list[bytes]) -> list[list[Hit]]:
        """The hits of each text, one for each item at most (its least edits)."""
        out: list[list[Hit]] = [[] for _ in texts]
        for number, item in self.short:
            for hits, text in zip(out, texts):
                if (at := text.find(item)) >= 0:
                    hits.append(Hit(number, 0, at, at + len(item)))
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        for index in self.indexes:
            for (d, _), hit in self._of_index(index, texts, data, bounds).items():
                out[d].append(hit)
        return out

    def _of_index(self, index: _Index, texts: list[bytes], data: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], Hit]:
        best: dict[tuple[int, int], Hit] = {}
        left: list[tuple[int, int, int, int]] = []
        for d, i, low, high in index.candidates(data, bounds):
            if (d, i) in best:
                continue
            raw = index.raw[i]
            exact = texts[d].find(raw, max(0, low), max(0, high + len(raw) + 1))
            if exact >= 0:
                best[d, i] = Hit(index.numbers[i], 0, exact, exact + len(raw))
            else:
                left.append((d, i, low, high))
        left = sorted((x for x in left if x[:2] not in best), key=lambda x: len(index.raw[x[1]]))
        at = 0
        while at < len(left):  # alignments of like length together
            stop = at + 1
            while stop < min(len(left), at + 256) and (stop - at + 1) * len(index.raw[left[stop][1]]) <= CELLS:
                stop += 1
            some = left[at:stop]
            at = stop
            low, high = (np.array([x[j] for x in some], np.int64) for j in (2, 3))
            found = banded_edits([index.items[x[1]] for x in some], [np.frombuffer(texts[x[0]], np.uint8) for x in some], low, high)
            for (d, i, first, _), e, start, end in sorted(zip(some, *(x.tolist() for x in found)), key=lambda x: x[0]):
                if e <= index.edits[i] and ((d, i) not in best or e < best[d, i].edits):
                    best[d, i] = Hit(index.numbers[i], e, start, end)
        return best

    def search_all(self, texts: list[bytes]) -> list[list[Hit]]:
        """`search` over many texts, some of them at a time."""
        out: list[list[Hit]] = []
        some: list[bytes] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= CHUNK:
                out += self.search(some)
                some, size = [], 0
        return out + self.search(some) if some else out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES):
    """The query set in blocks of about `most` bytes: lists of (item id, normalised text)."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.orderBy("i", "t").toLocalIterator():
        text = normalised(row["t"])
        if not text:
            continue
        block.append((row["i"], text))
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(
    documents: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, edits, start and end (in the normalised text) of each document and item that it contains."""
    docs = doc_columns(documents, id_col, text_col)
    schema = "doc_id long, item_id long, edits int, start long, end long"
    parts = []
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            ids = [i for i, _ in shared.value]
            searcher = Searcher([t for _, t in shared.value], rate)

            def step(batch):
                hits = searcher.search_all([normalised(t) for t in texts_of(batch)])
                rows = [(d, ids[h.item], h.edits, h.start, h.end) for d, own in zip(batch.column("doc_id").to_pylist(), hits) for h in own]
                if not rows:
                    return None
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "edits", "start", "end"]
                )

            return step

        parts.append(in_batches(docs, make, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows that contain no item, with all of their columns."""
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            searcher = Searcher([t for _, t in shared.value], rate)

            def step(batch):
                hits = searcher.search_all([normalised(t or "") for t in texts_of(batch, text_col)])
                return batch.filter(pa.array([not h for h in hits], pa.bool_()))

            return step

        documents = in_batches(documents, make, documents.schema)
    return documents
