"""Exact removal of repeated byte strings by a sparse suffix array, range-partitioned over the cluster.

A byte goes where a string of `span` bytes covers it that also starts in a document with a smaller id. Listing every
suffix would multiply the corpus, so suffixes start only at anchors: in each window of `span` bytes the leftmost
k-gram with the least hash. Equal windows have equal anchors, so windows meet their copies at their anchors' suffixes.
The consecutive windows of one anchor form a cell.

1. Each task lists its documents' cells under 48 bits of their anchors' hashes. Anchors that occur in several documents
   are open; all others are left. This only chooses candidates: a chance meeting of hashes opens an anchor in vain. A
   task sends an anchor that it finds open itself as one mark, so no bucket gets a hot anchor's cells.
2. The texts give the bytes of open cells: the suffix from the anchor on, and what stands before it. Splitters sampled
   from them range-partition the suffixes by their leading tokens. Tasks settle equal cells of their own before that.
3. Each partition sorts its suffixes by multikey quicksort on machine words. Of equal cells those of larger documents
   go; of different cells under one anchor the windows are sorted and compared likewise.
4. Leading tokens that would fill a whole partition by themselves are known from the splitters, as several of these are
   equal. Their cells are spread by all their bytes, equal ones are settled, and the windows of the rest are
   range-partitioned by their bytes and the document, so that even one string's copies spread over partitions; runs of
   equal windows are compared across the partitions' boundaries.

All removals rest on compared bytes.

Defined results: a null, empty or shorter text loses nothing; texts may be of any length (cells are found and sent some
at a time); of equal ids none strips the other, each row gives its own row, and rows with equal id and text lose the
same bytes; documents without an id are neither searched nor stripped; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitstats.llm.common import bytes_of, in_batches, pack, slices, trim, unpack, written

#: Bytes of an anchor (16 to 32), and bytes of a string that must not repeat. Shorter anchors meet by chance: pairs of
#: unrelated texts that share one grow with the square of the corpus.
K, SPAN = 20, 50
#: Bytes of text per bucket of anchors, and cells of one task before they are dealt out.
BUCKET_BYTES, FLUSH = 16 << 20, 400_000
#: Open cells of one partition of suffixes; leading tokens that have more are hot. Open cells of one task before they
#: are dealt out, and documents in the sample for splitters.
HOT, CELLS, SAMPLE = 150_000, 100_000, 20_000
#: Cells whose windows are sorted together.
TOGETHER = 10_000
_BLOCK = 60_000
_U = np.uint64
_KEY = "doc_id long, row_hash int"


class Hasher:
    """Rolling hashes of the bytes of a block (at most 2**16 of them)."""

    def __init__(self):
        rng = np.random.default_rng(20240501)
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.steps = rng.integers(0, 1 << 63, 4, dtype=np.uint64) * _U(2) + _U(1)

    def cells(self, data: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
        """Anchor hash, first and last window start, and anchor place of each cell of a block."""
        values = self.of_byte[data]
        grams = values
        for step, width in zip(self.steps, (1, 2, 4, 8)):
            grams = grams[:-width] * step + grams[width:]
        if K > 16:
            grams = grams[: 16 - K] * self.steps[0] + grams[K - 16 :]
        grams = grams ^ (grams >> _U(31))
        grams *= _U(0x9FB21C651E98DF25)
        grams ^= grams >> _U(28)
        # the place in the low bits makes the leftmost of equal hashes the least
        least = (grams & ~_U(0xFFFF)) | np.arange(len(grams), dtype=np.uint64)
        wide, have = span - K + 1, 1
        while have * 2 <= wide:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if wide > have:
            least = np.minimum(least[: have - wide], least[wide - have :])
        place = (least & _U(0xFFFF)).astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        # least hashes are small numbers: mixed again, so that buckets by range fill alike
        anchor = grams[place[first]]
        anchor ^= anchor >> _U(32)
        anchor *= _U(0xD6E8FEB86659FD93)
        anchor ^= anchor >> _U(32)
        return anchor >> _U(16), first.astype(np.int32), last.astype(np.int32), place[first]


def cells_of(hasher: Hasher, data: bytes, span: int) -> tuple[np.ndarray, ...] | None:
    """Anchor hash, first window, windows less one, and place of the anchor in the cell, of a whole text's cells.

    They are found in overlapping blocks so that every window lies in one.
    """
    if len(data) < span:
        return None
    array, out = np.frombuffer(data, np.uint8), []
    for at in range(0, len(array) - span + 1, _BLOCK - span + 1):
        anchor, first, last, place = hasher.cells(array[at : at + _BLOCK], span)
        out.append((anchor, first + at, (last - first).astype(np.uint8), (place - first).astype(np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*out)) if len(out) > 1 else out[0]


def _starts(first: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """True where a sorted table's key changes."""
    return _changes(len(first), (first, *columns))


def _changes(n: int, columns: Iterable[np.ndarray]) -> np.ndarray:
    """True where one of the columns, which are taken one after another, differs from the row before."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    begin = np.flatnonzero(_starts(sorted_keys))
    return zip(begin.tolist(), [*begin[1:].tolist(), len(sorted_keys)])


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the key of each row of a table sorted by key occurs in several documents."""
    new = _starts(key)
    begin = np.flatnonzero(new)
    if not len(begin):
        return new
    return (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[np.cumsum(new) - 1]


def _list_cells(docs: DataFrame, buckets: int, span: int) -> DataFrame:
    """Packed by bucket of the anchor: cells; and cells whose anchors are open within one task, with any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple] = []
        ids: list[int] = []
        hashes: list[int] = []
        size = 0

        def deal() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(h[0]) for h in held])
            anchor, first, wide, lead = (np.concatenate(c) for c in zip(*held))
            of_doc, of_row = np.array(ids, np.int64), np.array(hashes, np.int32)
            order = np.argsort(anchor, kind="stable")
            anchor, first, wide, lead, doc = (x[order] for x in (anchor, first, wide, lead, doc))
            open_ = _several(anchor, of_doc[doc])
            # of an anchor that is open here one mark goes to its bucket; its cells need nothing more
            mark, cells = open_ & _starts(anchor), ~open_
            bucket_of = (anchor >> _U(16)).astype(np.int64) * buckets >> 32
            number, blobs = [], []
            spread = np.where(open_, of_doc[doc] % buckets, bucket_of)
            order = np.argsort(spread, kind="stable")
            bounds = np.searchsorted(spread[order], np.arange(buckets + 1))
            marks = np.searchsorted(bucket_of[mark], np.arange(buckets + 1))
            marked = anchor[mark]
            for b in range(buckets):
                own = order[bounds[b] : bounds[b + 1]]
                m = marked[marks[b] : marks[b + 1]]
                if not len(own) and not len(m):
                    continue
                names, local = np.unique(doc[own], return_inverse=True)
                kind = np.uint16 if len(names) <= 1 << 16 else np.uint32
                number.append(b)
                blobs.append(pack([
                    anchor[own][cells[own]], cells[own], local.astype(kind), first[own], wide[own], lead[own], of_doc[names], of_row[names], m,
                ]))
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

        for batch in slices(batches):
            for doc_id, row_hash, data in zip(batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist(), bytes_of(batch)):
                found = None if doc_id is None else cells_of(hasher, data, span)
                if found is None:
                    continue
                held.append(found)
                ids.append(doc_id)
                hashes.append(row_hash)
                size += len(found[0])
                if size >= FLUSH:
                    yield deal()
                    held, ids, hashes, size = [], [], [], 0
        if held:
            yield deal()
        trim()

    return docs.mapInArrow(run, "bucket int, data binary")


def _open_cells(dealt: DataFrame, buckets: int, span: int) -> DataFrame:
    """The cells whose anchors occur in several documents; one partition is one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(d) for batch in batches for d in batch.column("data").to_pylist()]
        if not parts:
            return

        def column(i: int) -> np.ndarray:
            """A column of all parts, which are let go of it."""
            found = np.concatenate([p[i] for p in parts])
            for p in parts:
                p[i] = None
            return found

        for p in parts:
            p[7] = p[7][p[2]]
            p[6], p[2] = p[6][p[2]], None
        anchor, cells, first, wide, lead, doc, row_hash, marked = (column(i) for i in (0, 1, 3, 4, 5, 6, 7, 8))
        del parts
        marked = np.unique(marked)
        some = np.flatnonzero(cells).astype(np.int32)
        order = np.argsort(anchor, kind="stable")
        anchor, some = anchor[order], some[order]
        del order
        open_ = _several(anchor, doc[some])
        if len(marked):
            at = np.minimum(np.searchsorted(marked, anchor), len(marked) - 1)
            open_ |= marked[at] == anchor
        cells[some[open_]] = False  # what is left as a cell is not open
        keep = np.flatnonzero(~cells)
        for i in range(0, len(keep), 100_000):
            k = keep[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[k]), pa.array(row_hash[k]), pa.array(first[k]), pa.array(wide[k].astype(np.int16)), pa.array(lead[k].astype(np.int16))],
                ["doc_id", "row_hash", "start", "wide", "lead"],
            )
        trim()

    return dealt.repartitionById(buckets, "bucket").select("data").mapInArrow(run, f"{_KEY}, start int, wide short, lead short")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of big-endian words, and the number of each row's class of equal rows in that order.

    Multikey quicksort after a first pass by the leading word: a segment is parted around the median of three of its
    words at one depth; smaller and greater rows stay at that depth, equal ones go on to the next word. All open
    segments take this step together.
    """
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    if not n:
        return order, order
    cut = np.flatnonzero(_starts(words[order, 0]))
    lo, hi = cut, np.append(cut[1:], n)
    depth = np.ones(len(lo), np.int64)
    while True:
        live = (hi - lo > 1) & (depth < width)
        lo, hi, depth = lo[live], hi[live], depth[live]
        if not len(lo):
            break
        size = hi - lo
        segment = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size - lo, size)
        rows = order[at]
        word = words[rows, depth[segment]]
        three = np.stack([words[order[x], depth] for x in (lo, (lo + hi) // 2, hi - 1)])
        pivot = np.maximum(np.minimum(three[0], three[1]), np.minimum(np.maximum(three[0], three[1]), three[2]))[segment]
        side = 3 * segment + 1 + (word > pivot) - (word < pivot)
        order[at] = rows[np.argsort(side, kind="stable")]
        less, equal, _ = np.bincount(side, minlength=3 * len(lo)).reshape(-1, 3).T
        a, b = lo + less, lo + less + equal
        lo, hi, depth = np.concatenate((lo, a, b)), np.concatenate((a, b, hi)), np.concatenate((depth, depth + 1, depth))
    # word by word: all words in order at once would be two more copies of the table
    return order, np.cumsum(_changes(n, (words[order, i] for i in range(width)))) - 1


class Suffixes:
    """Rows of open cells: the suffix from the anchor on, what stands before the anchor (backwards), and both lengths."""

    def __init__(self, span: int):
        self.span, self.before = span, span - K
        self.used = self.span + self.before + 2
        self.width = -(-self.used // 8) * 8

    def rows(self, flat: np.ndarray, anchor: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of anchors at places of a text that has `span` bytes more at both ends."""
        out = np.zeros((len(anchor), self.width), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view
        out[:, : self.span] = views(flat, self.span)[anchor]
        out[:, self.span : self.span + self.before] = views(flat, self.before)[anchor - self.before][:, ::-1]
        steps = np.arange(self.span)
        out[:, : self.span][steps >= right[:, None]] = 0
        out[:, self.span : self.span + self.before][steps[: self.before] >= left[:, None]] = 0
        out[:, self.used - 2], out[:, self.used - 1] = right, left
        return out

    @staticmethod
    def words(rows: np.ndarray) -> np.ndarray:
        return rows.view(">u8").astype(np.uint64)

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the rows' cells, each with its row and its place in the cell."""
        right, left = rows[:, self.used - 2].astype(np.int64), rows[:, self.used - 1].astype(np.int64)
        whole = np.concatenate((rows[:, self.span : self.span + self.before][:, ::-1], rows[:, : self.span]), axis=1)
        count = right + left - self.span + 1
        row = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = row * whole.shape[1] + self.before - left[row] + at
        out = np.zeros((len(row), -(-self.span // 8) * 8), np.uint8)
        out[:, : self.span] = np.lib.stride_tricks.sliding_window_view(whole.ravel(), self.span)[begin]
        return out, row, at


def _token(rows: np.ndarray) -> np.ndarray:
    """The leading token of each row as a signed number in the same order."""
    return (np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64) ^ _U(1 << 63)).view(np.int64)


def _asked_cells(batch: pa.RecordBatch, suffixes: Suffixes, most: int):
    """doc_id, row_hash, start of the cell, and row of the asked cells of a batch of texts, at most so many at a time."""
    plain, span = zstandard.ZstdDecompressor(), suffixes.span
    pad = bytes(span)
    texts = [plain.decompress(d) for d in batch.column("data").to_pylist()]
    flat = np.frombuffer(pad.join([b"", *texts, b""]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size + span) - size
    del texts
    asked = batch.column("asked")
    start, wide, lead = (asked.flatten().field(i).to_numpy().astype(np.int64) for i in range(3))
    of = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
    doc, row_hash = batch.column("doc_id").to_numpy()[of], batch.column("row_hash").to_numpy()[of]
    for i in range(0, len(start), most):
        s = slice(i, i + most)
        yield doc[s], row_hash[s], start[s], suffixes.rows(flat, base[of[s]] + start[s] + lead[s], wide[s] + span - lead[s], lead[s])


def _equal_cells(rows: np.ndarray, doc: np.ndarray):
    """Order of the rows, class of each in that order, and the smallest document of each class."""
    order, group = multikey_order(Suffixes.words(rows))
    begin = np.flatnonzero(_starts(group))
    return order, group, np.minimum.reduceat(doc[order], begin) if len(begin) else doc[:0]


def _deal_suffixes(joined: DataFrame, splitters: np.ndarray, hot: np.ndarray, span: int) -> DataFrame:
    """Packed by range of the leading token: suffixes; and, to any partition in turn, cells that are settled here.

    Settled cells need no comparison, so a hot cell's copies stay with the tasks that found them.
    """
    spark = joined.sparkSession
    shared = spark.sparkContext.broadcast((splitters, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, hot = shared.value
        suffixes, press = Suffixes(span), zstandard.ZstdCompressor(level=3)
        held: list[tuple] = []
        size, turn = 0, TaskContext.get().partitionId() * 7

        def deal() -> pa.RecordBatch:
            nonlocal turn
            doc, row_hash, start, rows = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, group, least = _equal_cells(rows, doc)
            doc, row_hash, start, rows = doc[order], row_hash[order], start[order], rows[order]
            token = _token(rows)
            part = np.searchsorted(splitters, token, side="right")
            if len(hot):
                spread = np.isin(token, hot)
                words = Suffixes.words(rows[spread])
                mixed = np.zeros(len(words), np.uint64)
                for i in range(words.shape[1]):
                    mixed = (mixed ^ words[:, i]) * _U(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> _U(29)
                part[spread] = (mixed % _U(len(splitters) + 1)).astype(np.int64)
            gone = doc > least[group]
            wide = rows[:, suffixes.used - 2].astype(np.int32) + rows[:, suffixes.used - 1]
            # the texts' numbers in this piece of work, and a cell of each
            by, text = np.lexsort((row_hash, doc)), np.empty(len(doc), np.int64)
            new = _starts(doc[by], row_hash[by])
            text[by], first = np.cumsum(new) - 1, by[new]
            live = np.flatnonzero(~gone)
            live = live[np.argsort(part[live], kind="stable")]
            none, number, blobs = live[:0], [], []
            pieces = [(int(part[live[i]]), live[i:j], none) for i, j in _slices(part[live])]
            if gone.any():
                pieces.append((turn % (len(splitters) + 1), none, np.flatnonzero(gone)))
                turn += 1
            for to, out, go in pieces:
                names, local = np.unique(np.concatenate((text[out], text[go])), return_inverse=True)
                local = local.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
                number.append(to)
                columns = pack([
                    local[: len(out)], start[out].astype(np.int32), local[len(out) :], start[go].astype(np.int32), wide[go].astype(np.uint8),
                    doc[first[names]], row_hash[first[names]],
                ])
                flat = press.compress(np.ascontiguousarray(rows[out, : suffixes.used]).tobytes())
                blobs.append(len(columns).to_bytes(8, "little") + columns + flat)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blobs, pa.binary())], ["part", "data"])

        for batch in slices(batches, 500):
            for piece in _asked_cells(batch, suffixes, CELLS):
                held.append(piece)
                size += len(piece[0])
                if size >= CELLS:
                    yield deal()
                    held, size = [], 0
        if held:
            yield deal()
        trim()

    return joined.mapInArrow(run, "part int, data binary")


def _runs(doc: np.ndarray, row_hash: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges with those that touch or overlap joined."""
    order = np.lexsort((start, row_hash, doc))
    doc, row_hash, start, stop = doc[order], row_hash[order], start[order], stop[order]
    new = _starts(doc, row_hash)
    new[1:] |= start[1:] > stop[:-1]  # all windows are equally long, and cells hold whole windows
    begin = np.flatnonzero(new)
    return doc[begin], row_hash[begin], start[begin], np.maximum.reduceat(stop, begin) if len(begin) else stop


def _compare_suffixes(dealt: DataFrame, partitions: int, hot: np.ndarray, span: int) -> DataFrame:
    """Ranges that also start in a smaller document; and, with their bytes, the windows under hot tokens."""
    shared = dealt.sparkSession.sparkContext.broadcast(hot)
    names = ["doc_id", "row_hash", "start", "stop", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, hot = Suffixes(span), shared.value

        def ranges(doc, row_hash, start, stop):
            doc, row_hash, start, stop = _runs(doc, row_hash, start.astype(np.int32), stop.astype(np.int32))
            for i in range(0, len(doc), 100_000):
                s = slice(i, i + 100_000)
                columns = [pa.array(x[s]) for x in (doc, row_hash, start, stop)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], names)

        plain = zstandard.ZstdDecompressor()
        columns, rows = [], []
        for batch in batches:
            for data in batch.column("data").to_pylist():
                at = 8 + int.from_bytes(data[:8], "little")
                local, start, gone, start_gone, wide, ids, hashes = unpack(data[8:at])
                columns.append((ids[local], hashes[local], start, ids[gone], hashes[gone], start_gone, wide.astype(np.int32)))
                rows.append(data[at:])
        if not columns:
            return
        doc, row_hash, start, *done = (np.concatenate(c) for c in zip(*columns))
        yield from ranges(done[0], done[1], done[2], done[2] + done[3])
        whole = np.zeros((len(doc), suffixes.width), np.uint8)
        at = 0
        for flat in rows:  # still compressed, so that only the whole table stands in memory
            flat = np.frombuffer(plain.decompress(flat), np.uint8).reshape(-1, suffixes.used)
            whole[at : at + len(flat), : suffixes.used] = flat
            at += len(flat)
        del columns, rows, done, flat
        order, group, least = _equal_cells(whole, doc)
        doc, row_hash, start, rows = doc[order], row_hash[order], start[order].astype(np.int64), whole[order]
        del whole
        gone = doc > least[group]
        wide = rows[:, suffixes.used - 2].astype(np.int64) + rows[:, suffixes.used - 1]
        yield from ranges(doc[gone], row_hash[gone], start[gone], (start + wide)[gone])
        # of each class the rows of its smallest document go on; anchors with one class, or one document, are done
        doc, row_hash, start, rows, group = (x[~gone] for x in (doc, row_hash, start, rows, group))
        classes = np.flatnonzero(_starts(group))
        members = np.append(classes[1:], len(group)) - classes
        head = rows[classes, : (K + 7) // 8 * 8].copy()
        head[:, K:] = 0
        new = np.ones(len(classes), bool)
        new[1:] = (head[1:] != head[:-1]).any(axis=1)
        del head
        anchors = np.flatnonzero(new)
        owner = least  # class numbers have no gaps: each class keeps its smallest document's rows
        if len(anchors):
            differ = np.minimum.reduceat(owner, anchors) < np.maximum.reduceat(owner, anchors)
            differ = differ[np.cumsum(new) - 1]
        else:
            differ = new
        is_hot = np.isin(_token(rows[classes]), hot)
        todo = np.flatnonzero(differ & ~is_hot)
        anchor_of = (np.cumsum(new) - 1)[todo]
        bounds = np.flatnonzero(_starts(anchor_of))
        at = 0
        while at < len(todo):  # whole anchors, about so many cells at a time
            later = bounds[np.searchsorted(bounds, at + TOGETHER) :]
            stop = int(later[0]) if len(later) else len(todo)
            own = todo[at:stop]
            at = stop
            bytes_, row, place = suffixes.windows(rows[classes[own]])
            by, same = multikey_order(Suffixes.words(bytes_))
            of = owner[own][row[by]]
            first = np.minimum.reduceat(of, np.flatnonzero(_starts(same)))
            again = by[of > first[same]]
            yield from ranges(*_of_members(doc, row_hash, start, classes[own][row[again]], members[own][row[again]], place[again], span))
        # hot tokens may have cells elsewhere, whatever the documents here
        todo = np.flatnonzero(is_hot)
        for i in range(0, len(todo), TOGETHER // 4):
            own = todo[i : i + TOGETHER // 4]
            bytes_, row, place = suffixes.windows(rows[classes[own]])
            times = members[own][row]
            d, h, s, t = _of_members(doc, row_hash, start, classes[own][row], times, place, span)
            cut = [x[:span].tobytes() for x in np.repeat(bytes_, times, axis=0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(h), pa.array(s.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(cut, pa.binary())], names
            )
        del rows
        trim()

    return dealt.repartitionById(partitions, "part").select("data").mapInArrow(run, f"{_KEY}, start int, stop int, suffix binary")


def _of_members(doc, row_hash, start, begin, times, place, span: int):
    """Windows of a class at these places, for each row of the class: begin and number of its rows are given."""
    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - begin, times)
    at = start[rows] + np.repeat(place, times)
    return doc[rows], row_hash[rows], at, at + span


def _compare_windows(single: DataFrame, partitions: int) -> DataFrame:
    """The same of single windows, range-partitioned by all their bytes and the document.

    One string's copies may fill several partitions; each partition says with which string it begins and ends and the
    smallest document of its last run, and goes on from what stands before it. These are three values a partition.
    """
    spark = single.sparkSession
    ranged = written(
        single.repartitionByRange(partitions, "suffix", "doc_id").withColumn("part", F.spark_partition_id()), "windows"
    )
    ends = ranged.groupBy("part").agg(
        F.min("suffix").alias("low"), F.max("suffix").alias("high"), F.max(F.struct("suffix", (-F.col("doc_id")).alias("d")))["d"].alias("least")
    ).orderBy("part").collect()
    carried, before = [], None  # (string, smallest document so far) that stands before each partition
    for e in ends:
        if before is not None and bytes(e["low"]) == before[0]:
            carried.append((e["part"], bytes(before[0]), before[1]))
        least = -e["least"]
        high = bytes(e["high"])
        if before is not None and before[0] == high:
            least = min(least, before[1])
        before = (high, least)
    left = spark.createDataFrame(carried, "part int, suffix binary, carried long")
    least = ranged.groupBy("part", "suffix").agg(F.min("doc_id").alias("least"))
    # a row for each partition at most
    least = least.join(F.broadcast(left), ["part", "suffix"], "left").select(
        "part", "suffix", F.least("least", F.coalesce("carried", "least")).alias("least")
    )
    again = ranged.join(least, ["part", "suffix"]).where("doc_id > least")
    return again.select("doc_id", "row_hash", "start", "stop")


def _keyed(documents: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    row_hash = F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), row_hash.alias("row_hash"), text.alias("text"), *more)


def _packed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """The texts as compressed bytes, to be joined by document."""

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def step(batch):
            data = [press.compress(b) for b in bytes_of(batch)]
            names = ["doc_id", "row_hash", *(["rest"] if rest else [])]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(data, pa.binary())], [*names, "data"])

        return step

    more = f", rest {docs.schema['rest'].dataType.simpleString()}" if rest else ""
    return in_batches(docs, make, f"{_KEY}{more}, data binary")


def _splitters(open_cells: DataFrame, docs: DataFrame, partitions: int, n_docs: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the leading tokens of a sample of the open cells, and those that fill a partition by themselves.

    The sample is of whole documents, about SAMPLE of them; what is fitted to it is only how evenly partitions fill.
    """
    if partitions < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(max(1, n_docs // SAMPLE))) == 0
    joined = _packed(docs.where(some)).join(_asked(open_cells.where(some)), ["doc_id", "row_hash"])

    def make():
        suffixes = Suffixes(span)

        def step(batch):
            found = [_token(rows) for _, _, _, rows in _asked_cells(batch, suffixes, CELLS)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["token"])

        return step

    share = [i / partitions for i in range(1, partitions)]
    row = in_batches(joined, make, "token long").agg(F.percentile_approx("token", share, 20 * partitions).alias("q")).first()
    cuts = np.array(row["q"] or [], np.int64)
    return np.unique(cuts), np.unique(cuts[1:][cuts[1:] == cuts[:-1]])


def _asked(open_cells: DataFrame) -> DataFrame:
    return open_cells.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "wide", "lead")).alias("asked"))


def repeated_ranges(documents: DataFrame, span: int = SPAN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash and `ranges`, the repeated byte ranges of each row that has any.

    `hot` is the number of open cells for which one partition is made.
    """
    spark = documents.sparkSession
    docs = _keyed(documents, id_col, text_col)
    total, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(8, -(-(total or 0) // BUCKET_BYTES))
    open_cells = written(_open_cells(_list_cells(docs, buckets, span), buckets, span), "cells")
    partitions = max(1, -(-open_cells.count() // hot))
    splitters, tokens = _splitters(open_cells, docs, partitions, n_docs, span)
    joined = _packed(docs).join(_asked(open_cells), ["doc_id", "row_hash"])
    dealt = _deal_suffixes(joined, splitters, tokens, span)
    found = written(_compare_suffixes(dealt, len(splitters) + 1, tokens, span), "ranges")
    ranges = found.where("suffix is null").select("doc_id", "row_hash", "start", "stop")
    if len(tokens):
        width = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ranges = ranges.unionByName(_compare_windows(found.where("suffix is not null"), width))
    return ranges.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def kept_parts(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many went, and in how many maximal runs."""
    out, at, gone, runs = [], 0, 0, 0
    end = -1
    for start, stop in sorted(ranges):
        if start > end:
            runs += 1
        if start > at:
            out.append(data[at:start])
        if stop > max(at, start):
            gone += stop - max(at, start)
        at, end = max(at, stop), max(end, stop)
    out.append(data[at:])
    return b"".join(out), gone, runs


def dedup_report(documents: DataFrame, span: int = SPAN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row."""

    def make():
        plain = zstandard.ZstdDecompressor()

        def step(batch):
            rows = []
            for data, ranges in zip(batch.column("data").to_pylist(), batch.column("ranges").to_pylist()):
                data = plain.decompress(data)
                kept, gone, runs = kept_parts(data, [(r["start"], r["stop"]) for r in ranges or ()])
                rows.append((len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

        return step

    lists = repeated_ranges(documents, span, hot, id_col, text_col)
    joined = _packed(_keyed(documents, id_col, text_col)).join(lists, ["doc_id", "row_hash"], "left")
    return in_batches(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(documents: DataFrame, span: int = SPAN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with what is left of their texts; of a character cut by a removed range the rest goes too.

    All columns stay; a null text becomes empty.
    """
    rest = F.struct(*(F.col(c) for c in documents.columns if c != text_col)).alias("rest")
    docs = _keyed(documents, id_col, text_col, rest)

    def make():
        plain = zstandard.ZstdDecompressor()

        def step(batch):
            out = []
            for data, ranges in zip(batch.column("data").to_pylist(), batch.column("ranges").to_pylist()):
                kept, _, _ = kept_parts(plain.decompress(data), [(r["start"], r["stop"]) for r in ranges or ()])
                out.append(kept.decode("utf-8", "ignore"))
            return pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out)], ["rest", "kept"])

        return step

    lists = repeated_ranges(documents, span, hot, id_col, text_col)
    joined = _packed(docs, rest=True).join(lists, ["doc_id", "row_hash"], "left")
    done = in_batches(joined, make, f"rest {docs.schema['rest'].dataType.simpleString()}, kept string")
    return done.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in documents.columns))
