"""Exact n-gram Jaccard self-join of documents by a grouped prefix join.

A document is its set of word n-grams. Two sets whose Jaccard similarity reaches the threshold share an n-gram among
the first few of each, in any order that is the same for all; the order here is by how often an n-gram's cell of a
fixed-size count sketch occurs in the corpus, rare first. Sets with identical prefixes and sizes are one group; only
groups are filed under n-grams. Pairs of groups that meet there are filtered by size, by their places in the prefixes
and by how many prefix n-grams they share; what is left is expanded into pairs of members, which are verified on whole
sets.

What is asked for is the classes of linked documents, so pairs are not listed where they tell nothing new. Under each
n-gram the groups first meet a few leaders, and each member one member of the other group; likewise within a group.
Groups whose members then are all in one class need no further look at each other; of the rest all pairs are filtered,
expanded, and verified between classes. No link between different texts is lost, and a large number of near copies
costs a few comparisons each.

Hash sizes: an n-gram is known by 64 bits, so two different n-grams of one pair of sets are taken for one with a chance
of size * size / 2^64; groups and sets are known by 128 bits each. Two groups that meet are taken to be of one class where
64 bits of their classes' roots agree.

Defined results: a null or blank text has an empty set, is linked with nothing and is its own class; a text of fewer
than n words is one n-gram; texts may be of any length (one text's n-grams are held at a time); equal sets are linked;
rows of one id share its class only if their sets are linked; rows without an id are linked with nothing and have no
class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitstats.llm.common import bytes_of, doc_columns, in_batches, merged_pieces, pack, slices, trim, unpack, written
from pitstats.llm.components import components

N, THRESHOLD = 5, Fraction(80, 100)
#: Cells of the count sketch (a fixed 4 MB) and the blocks in which it is summed.
CELLS, BLOCKS = 1 << 20, 64
#: Leaders under each n-gram.
LEADERS = 5
#: Bits of the filter on documents that are to be verified, per document and at most (64 MB).
FILTER_RATE, FILTER_BITS = 16, 1 << 29
#: N-grams for which one bucket of prefixes is made, and prefix n-grams that a task holds before it deals them out.
POSTINGS, FLUSH = 4_000_000, 600_000
#: A cell is crowded at so many times the mean count (and 1,000 more).
CROWDED = 20
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Shingler:
    """Texts to sorted distinct n-gram hashes; the words of many texts are hashed together."""

    #: Bytes hashed at a time.
    PIECE = 1 << 20

    def __init__(self, n: int):
        self.n = n
        rng = np.random.default_rng(5)
        self.steps = rng.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(0, 1 << 62)) * 8 + 5
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(9, 14)]] = True
        self._grow(self.PIECE + 1)

    def _grow(self, size: int) -> None:
        self.up, self.down = (np.full(size, b & (1 << 64) - 1, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of a piece."""
        if len(data) >= len(self.up):
            self._grow(len(data) + 1)
        array = np.frombuffer(data, np.uint8)
        edge = np.diff(np.concatenate(([True], self.space[array], [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(array) + 1, np.uint64)
        np.cumsum(self.of_byte[array] * self.up[: len(array)], out=sums[1:])
        return _mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64)), begin

    def _long(self, data: bytes) -> np.ndarray:
        """Words of a text of any length, cut into pieces at white space."""
        out, at = [], 0
        cut = re.compile(rb"[\x20\x09-\x0d]")
        while at < len(data):
            found = cut.search(data, at + self.PIECE)
            stop = found.end() if found else len(data)
            out.append(self._words(data[at:stop])[0])
            at = stop
        return np.concatenate(out)

    def _sets(self, words: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """The set of each text, from all words in order and the number of words of each text."""
        n, stop = self.n, np.cumsum(of)
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            grams = grams * self.steps[i] + words[i : len(words) - n + 1 + i] if len(grams) else grams
        grams = _mix(grams)
        out = []
        for size, end in zip(of.tolist(), stop.tolist()):
            if size >= n:
                own = np.sort(grams[end - size : end - n + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif size:  # the whole sequence is one
                h = np.full(1, size, np.uint64)
                for i in range(size):
                    h = h * self.steps[i] + words[end - size + i]
                own = _mix(h)
            else:
                own = words[:0]
            out.append(own)
        return out

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of UTF-8 bytes: A-Z are lower-cased, words are runs without ASCII white space."""
        out: list[np.ndarray] = []
        some: list[bytes] = []
        size = 0

        def flush():
            if some:
                bounds = np.cumsum([len(t) + 1 for t in some])
                words, begin = self._words(b"\n".join(some).lower())
                of = np.diff(np.searchsorted(begin, bounds), prepend=0)
                out.extend(self._sets(words, of))
                some.clear()

        for text in texts:
            if len(text) > self.PIECE:
                flush()
                words = self._long(text.lower())
                out.extend(self._sets(words, np.array([len(words)])))
                size = 0
                continue
            if size + len(text) + 1 > self.PIECE:
                flush()
                size = 0
            some.append(text)
            size += len(text) + 1
        flush()
        return out


def prefix_size(n: int, threshold: Fraction) -> int:
    """How many first elements of a set of n must meet those of any set that is similar enough."""
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def similar(common, a, b, threshold: Fraction):
    """Whether the Jaccard similarity reaches the threshold, in whole numbers."""
    return threshold.denominator * common >= threshold.numerator * (a + b - common)


def _hash128(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_PROFILE = "doc_id long, h long, size long, set binary, part long, piece long, data binary"


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text hash, size and set of each document; and, as rows with a piece, each task's part of the sketch."""
    names = [f.split()[0] for f in _PROFILE.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        shingler, counts = Shingler(n), np.zeros(CELLS, np.uint32)
        for batch in slices(batches):
            sizes, keys = [], []
            for found in shingler.shingles(bytes_of(batch)):
                np.add.at(counts, (found >> _U(44)).astype(np.int64), 1)
                sizes.append(len(found))
                keys.append(_hash128(found.tobytes()) if len(found) else None)
            k = len(sizes)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
        width = CELLS // BLOCKS
        pieces = [pack([counts[i : i + width]]) for i in range(0, CELLS, width)]
        part = TaskContext.get().partitionId()
        columns = [pa.nulls(BLOCKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        columns += [pa.array([part] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int64()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)
        del shingler, counts
        trim()

    return docs.mapInArrow(run, _PROFILE)


def _saturated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x.astype(np.int64) + y, np.iinfo(np.uint32).max).astype(np.uint32)


def _sketch(parts: DataFrame, tasks: int) -> np.ndarray:
    """How many documents have an n-gram in each cell; a fixed number of cells whatever the corpus."""
    found = merged_pieces(parts, tasks, _saturated)
    return np.concatenate(found) if found else np.zeros(CELLS, np.uint32)


def _ordered(found: np.ndarray, counts: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The prefix: the first n-grams in the order of their cells' counts, then of their hashes."""
    size = prefix_size(len(found), threshold)
    key = counts[(found >> _U(44)).astype(np.int64)]
    if size < len(found):
        limit = np.partition(key, size - 1)[size - 1]
        found, key = found[key <= limit], key[key <= limit]
    return found[np.lexsort((found, key))][:size]


_DEALT = "bucket int, crowded boolean, data binary, gid binary, set binary, size long, doc_id long"


def _deal_postings(docs: DataFrame, shared, n: int, threshold: Fraction, buckets: int) -> DataFrame:
    """Groups under their prefix n-grams, packed by bucket of the n-gram; and, as rows with a gid, their members.

    N-grams of crowded cells surely meet others; they are marked as such and dealt by group too, so that no bucket gets
    a long list.
    """
    names = [f.split()[0] for f in _DEALT.split(", ")]
    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        shingler = Shingler(n)
        counts, crowded = shared.value
        groups: dict[bytes, tuple[int, np.ndarray]] = {}  # group -> size, prefix
        members: dict[bytes, tuple[bytes, int, int]] = {}  # set -> group, size, a document
        held = 0

        def deal():
            ids = np.frombuffer(b"".join(groups), "<u8").reshape(-1, 2)
            size = np.array([k for k, _ in groups.values()], np.uint32)
            token = np.concatenate([p for _, p in groups.values()])
            times = [len(p) for _, p in groups.values()]
            grp = np.repeat(np.arange(len(size)), times)
            pos = np.concatenate([np.arange(k, dtype=np.uint32) for k in times])
            many = crowded[(token >> _U(44)).astype(np.int64)]
            bucket = np.where(many, (token + ids[grp, 0]) % _U(buckets), (token >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
            order = np.lexsort((token, many, bucket))
            token, grp, pos, many, bucket = token[order], grp[order], pos[order], many[order], bucket[order]
            out = [], [], []
            cuts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (many[1:] != many[:-1]), [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own, local = np.unique(grp[i:j], return_inverse=True)
                kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
                out[0].append(int(bucket[i]))
                out[1].append(bool(many[i]))
                out[2].append(pack([token[i:j], local.astype(kind), pos[i:j], ids[own, 0], ids[own, 1], size[own]]))
            k = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds)), *(pa.nulls(k, t) for t in kinds[3:])], names)
            k = len(members)
            gid, size, doc = zip(*members.values())
            columns = [pa.array(c, t) for c, t in zip((gid, list(members), size, doc), kinds[3:])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:3]), *columns], names)

        for batch in slices(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), shingler.shingles(bytes_of(batch))):
                if not len(found):
                    continue
                key = _hash128(found.tobytes())
                if key in members:
                    gid, size, doc = members[key]
                    members[key] = gid, size, min(doc, doc_id)
                    continue
                prefix = _ordered(found, counts, threshold)
                gid = _hash128(prefix.tobytes() + len(found).to_bytes(8, "little"))
                members[key] = gid, len(found), doc_id
                if gid not in groups:
                    groups[gid] = len(found), prefix
                    held += len(prefix)
            if held > FLUSH:
                yield from deal()
                groups, members, held = {}, {}, 0
        if groups:
            yield from deal()
        del shingler, groups, members
        trim()

    return docs.where("doc_id is not null").mapInArrow(run, _DEALT)


def _sixteen(one: np.ndarray, two: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(np.stack((one, two), axis=1))
    return pa.Array.from_buffers(pa.binary(16), len(one), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _meetings(dealt: DataFrame, buckets: int) -> DataFrame:
    """N-grams under which several groups are filed, with each of these; one partition is one bucket."""
    names = ["token", "gid", "size", "pos", "crowded"]

    def run(batches):
        parts: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for crowded, data in zip(batch.column("crowded").to_pylist(), batch.column("data").to_pylist()):
                parts[crowded].append(unpack(data))
        for crowded, own in parts.items():
            if not own:
                continue
            token = np.concatenate([p[0] for p in own])
            base = np.cumsum([0, *(len(p[3]) for p in own)])
            grp = np.concatenate([p[1].astype(np.uint32) + np.uint32(b) for p, b in zip(own, base)])
            pos, one, two, size = (np.concatenate([p[i] for p in own]) for i in (2, 3, 4, 5))
            own.clear()
            order = np.argsort(token, kind="stable")
            if not crowded:  # most n-grams are filed once
                sorted_ = token[order]
                again = np.zeros(len(order), bool)
                again[1:] = sorted_[1:] == sorted_[:-1]
                again[:-1] |= again[1:]
                order = order[again]
            token, grp, pos = token[order], grp[order], pos[order]
            order = np.lexsort((two[grp], one[grp], token))
            token, grp, pos = token[order], grp[order], pos[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (one[grp[1:]] != one[grp[:-1]]) | (two[grp[1:]] != two[grp[:-1]])
            token, grp, pos = token[new], grp[new], pos[new]
            if not crowded:
                again = np.zeros(len(token), bool)
                again[1:] = token[1:] == token[:-1]
                again[:-1] |= again[1:]
                token, grp, pos = token[again], grp[again], pos[again]
            for i in range(0, len(token), 100_000):
                t, g, p = token[i : i + 100_000], grp[i : i + 100_000], pos[i : i + 100_000]
                columns = [pa.array(t.view(np.int64)), _sixteen(one[g], two[g]), pa.array(size[g].astype(np.int64)), pa.array(p.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(t), crowded))], names)
        trim()

    rows = dealt.where("data is not null").select("bucket", "crowded", "data").repartitionById(buckets, "bucket")
    return rows.mapInArrow(run, "token long, gid binary, size long, pos long, crowded boolean")


def _vertex(doc: Column, set_: Column) -> Column:
    """A set as a key in the order of its smallest document's id: that id, then the set's hash."""
    return F.concat(F.unhex(F.lpad(F.hex(doc.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), set_)


def _vertex_doc(vertex: Column) -> Column:
    return F.conv(F.hex(F.substring(vertex, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def _vertex_set(vertex: Column) -> Column:
    return F.substring(vertex, 9, 16)


def _filter(hashed: DataFrame):
    """A filter of bounded size on the hashes `h`: `make(kept, columns)` for `in_batches` keeps the rows whose `k` may
    be (or surely isn't) one of them. It saves texts from being shuffled; exact joins follow."""
    bits = 1 << 20
    while bits < min(FILTER_BITS, FILTER_RATE * hashed.count()):
        bits *= 2

    def marks(batches):
        from pyspark import TaskContext

        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64) & _U(bits - 1)
            np.bitwise_or.at(out, (h >> _U(3)).astype(np.int64), (1 << (h & _U(7)).astype(np.uint8)).astype(np.uint8))
        width = len(out) // BLOCKS
        part = TaskContext.get().partitionId()
        pieces = [pack([out[i : i + width]]) for i in range(0, len(out), width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int64()), pa.array(pieces, pa.binary())], ["part", "piece", "data"]
        )

    found = merged_pieces(hashed.coalesce(256).mapInArrow(marks, "part long, piece long, data binary"), 256, np.bitwise_or)
    shared = hashed.sparkSession.sparkContext.broadcast(np.concatenate(found) if found else np.zeros(bits // 8, np.uint8))

    def make(kept: bool, columns: list[str]):
        mask = shared.value

        def step(batch):
            h = batch.column("k").to_numpy().astype(np.uint64) & _U(bits - 1)
            keep = mask[(h >> _U(3)).astype(np.int64)] >> (h & _U(7)).astype(np.uint8) & 1
            return batch.filter(pa.array(keep.astype(bool) == kept)).select(columns)

        return step

    return make


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """`v` and its set's sorted n-grams, of the wanted vertices."""
    wanted = wanted.select("v", _vertex_doc(F.col("v")).alias("doc_id"), _vertex_set(F.col("v")).alias("set"))
    make_filter = _filter(wanted.select(F.xxhash64("doc_id").alias("h")))

    def make_sets():
        shingler = Shingler(n)
        seen: set[bytes] = set()  # rows of one id and one set give one and the same entry; the join has put them together

        def step(batch):
            found = shingler.shingles(bytes_of(batch))
            keep = []
            for i, (f, w, v) in enumerate(zip(found, batch.column("set").to_pylist(), batch.column("v").to_pylist())):
                if v not in seen and _hash128(f.tobytes()) == w:
                    seen.add(v)
                    keep.append(i)
            return pa.RecordBatch.from_arrays(
                [batch.column("v").take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["v", "grams"]
            )

        return step

    near = in_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k")), lambda: make_filter(True, ["doc_id", "text"]), "doc_id long, text string")
    # where a task of a crowded id is split an entry may come twice; its links then come twice too, which adds nothing
    return in_batches(near.join(wanted, "doc_id"), make_sets, "v binary, grams binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs `a`, `b` of vertices that are similar enough, compared on whole sets."""

    def make():
        def step(batch):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bool(similar(common, len(x) // 8, len(y) // 8, threshold)))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    joined = pairs.join(sets.select(F.col("v").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("v").alias("b"), F.col("grams").alias("y")), "b"
    )
    return in_batches(joined.select("a", "b", "x", "y"), make, "a binary, b binary")


def _size_filter(x, y, threshold: Fraction):
    return F.least(x, y) * threshold.denominator >= F.greatest(x, y) * threshold.numerator


def _overlap(x, y, threshold: Fraction):
    """The n-grams that sets of these sizes must share."""
    up, down = threshold.numerator, threshold.denominator
    return F.ceil((x + y) * up / F.lit(float(up + down)) - 1e-9)


def _first_meeting(size, pos, size2, pos2, threshold: Fraction):
    """Whether similar sets of these sizes can meet first at these places of their prefixes.

    Before the first n-gram in common lies nothing shared, so after it there must be room for the overlap.
    """
    need = _overlap(size, size2, threshold)
    return _size_filter(size, size2, threshold) & (pos <= size - need) & (pos2 <= size2 - need)


def _promising(pairs: DataFrame, postings: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs of groups `ga`, `gb` that share enough n-grams of their prefixes.

    N-grams in common beyond the shorter-reaching prefix are at most what is left of that set, so the prefixes must
    share the rest of the overlap that the threshold asks for. N-grams with one group only can't be shared and needn't
    be looked at.
    """
    own = postings.groupBy("gid").agg(F.collect_set("token").alias("tokens"), F.first("size").alias("size"))
    side = lambda n: own.select(F.col("gid").alias(f"g{n}"), F.col("tokens").alias(f"t{n}"), F.col("size").alias(f"n{n}"))
    up, down = threshold.numerator, threshold.denominator
    overlap = _overlap(F.col("na"), F.col("nb"), threshold)
    # a prefix of p of n leaves n - p = ceil(n * threshold) - 1
    left = F.ceil(F.greatest("na", "nb") * up / F.lit(float(down)) - 1e-9) - 1
    joined = pairs.join(side("a"), "ga").join(side("b"), "gb")
    return joined.where(F.size(F.array_intersect("ta", "tb")) >= overlap - left).select("ga", "gb")


def _ordered_pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _compared(docs: DataFrame, pairs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """Those of the pairs of vertices that are similar, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    return _verified(pairs, written(_sets_of(docs, wanted, n), "sets"), threshold)


def _leader_pairs(postings: DataFrame, threshold: Fraction) -> DataFrame:
    """Groups against a few leaders of their n-gram: the one whose prefix is most shared, and some by hash."""
    ranked = postings.withColumn("w", -F.count("*").over(Window.partitionBy("gid")) / F.col("size"))
    entry = F.struct("gid", "size", "pos")
    ranks = [F.struct("w", "gid"), *(F.xxhash64("gid", F.lit(i)) for i in range(1, LEADERS))]
    least = [F.min(F.struct(r.alias("r"), entry.alias("e"))) for r in ranks]
    leaders = F.array_distinct(F.array(*(F.col(f"l{i}.e") for i in range(LEADERS)))).alias("leaders")

    # few groups meet under most n-grams: entries are moved once and get their leaders where they meet; of crowded
    # n-grams each task's leaders are moved, so that no task gets all entries of one
    token = Window.partitionBy("token")
    plain = ranked.where("not crowded").repartition("token").select("gid", "size", "pos", *(m.over(token).alias(f"l{i}") for i, m in enumerate(least)))
    many = ranked.where("crowded").groupBy("token").agg(*(m.alias(f"l{i}") for i, m in enumerate(least))).select("token", leaders)
    both = plain.select("gid", "size", "pos", leaders).unionByName(
        postings.where("crowded").join(many, "token").select("gid", "size", "pos", "leaders")
    )
    fits = F.filter(
        "leaders", lambda e: (e["gid"] != F.col("gid")) & _first_meeting(e["size"], e["pos"], F.col("size"), F.col("pos"), threshold)
    )
    met = both.select("gid", F.transform(fits, lambda e: e["gid"]).alias("others")).groupBy("gid").agg(
        F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")
    )
    return met.select("gid", F.explode("others").alias("o")).select(F.least("gid", "o").alias("ga"), F.greatest("gid", "o").alias("gb")).distinct()


def _leader_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Each member against the first member of the other group, and of its own."""
    first = members.groupBy("gid").agg(F.min("v").alias("f"))
    both = pairs.union(pairs.select("gb", "ga"))
    across = both.join(members, F.col("ga") == F.col("gid")).select("gb", "v").join(first, F.col("gb") == F.col("gid")).select("v", "f")
    within = members.join(first, "gid").where("v <> f").select("v", "f")
    return across.union(within).select(*_ordered_pairs("v", "f")).distinct()


def _rest_pairs(postings: DataFrame, threshold: Fraction, members: DataFrame) -> DataFrame:
    """Pairs of groups that meet under an n-gram and are not all in one class; `members` have roots."""
    # a group's class by 64 bits, null where its members are of several
    spread = members.groupBy("gid").agg(F.when(F.min("root") == F.max("root"), F.xxhash64(F.min("root"))).alias("c"))
    several = lambda over: (over(F.count("c")) < over(F.count("*"))) | (over(F.min("c")) != over(F.max("c")))

    def among(rows: DataFrame) -> DataFrame:
        # both sides name their columns anew: the plans are alike then, and one exchange serves both
        left, right = (rows.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("gid", "size", "pos", "c"))) for i in (1, 2))
        return (
            left.join(right, "token").where("gid1 < gid2 and not (c1 <=> c2 and c1 is not null)")
            .where(_first_meeting(F.col("size1"), F.col("pos1"), F.col("size2"), F.col("pos2"), threshold))
            .select(F.col("gid1").alias("ga"), F.col("gid2").alias("gb"))
        )

    # entries of crowded n-grams don't move before it is known that their groups are of several classes
    plain, crowded = (postings.where(x).join(spread, "gid") for x in ("not crowded", "crowded"))
    plain = plain.withColumn("several", several(lambda x: x.over(Window.partitionBy("token")))).where("several")
    mixed = crowded.groupBy("token").agg(several(lambda x: x).alias("several")).where("several").select("token")
    return among(plain).union(among(crowded.join(mixed, "token", "left_semi"))).distinct()


def _rest_members(pairs: DataFrame, members: DataFrame, tested: DataFrame) -> DataFrame:
    """Members of different classes, of the pairs of groups and within groups, that have not been compared."""
    one = members.select(F.col("gid").alias("ga"), F.col("v").alias("x"), F.col("root").alias("rx"))
    two = members.select(F.col("gid").alias("gb"), F.col("v").alias("y"), F.col("root").alias("ry"))
    across = pairs.join(one, "ga").join(two, "gb").where("rx <> ry").select("x", "y")
    mixed = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid")
    inner = members.join(mixed, "gid", "left_semi")
    within = inner.join(inner.select("gid", F.col("v").alias("y"), F.col("root").alias("ry")), "gid").where("v < y and root <> ry")
    pairs = across.union(within.select("v", "y")).select(*_ordered_pairs("x", "y")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def linked_sets(docs: DataFrame, n: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(profiles of all documents, roots of the sets that are linked with another set)."""
    spark = docs.sparkSession
    made = _first_pass(docs, n)
    tasks = made.rdd.getNumPartitions()
    first = written(made, "profiles")
    profiles = first.where("piece is null").select("doc_id", "h", "size", "set")
    counts = _sketch(first.where("piece is not null").select("part", "piece", "data"), tasks)
    crowded = counts > CROWDED * max(1.0, counts.mean()) + 1_000
    total = profiles.agg(F.sum("size")).first()[0] or 0
    buckets = max(8, total // POSTINGS)
    shared = spark.sparkContext.broadcast((counts, crowded))
    dealt = written(_deal_postings(docs, shared, n, threshold, buckets), "prefixes")
    met = written(_meetings(dealt, buckets), "postings")
    # crowded n-grams' groups come from several buckets
    postings = met.where("not crowded").union(met.where("crowded").distinct())
    members = dealt.where("gid is not null").groupBy("gid", "set").agg(F.min("doc_id").alias("doc"))
    members = written(members.select("gid", _vertex(F.col("doc"), F.col("set")).alias("v")), "members")
    pairs = written(_promising(_leader_pairs(postings, threshold), postings, threshold), "pairs")
    tested = written(_leader_members(pairs, members), "tested")
    links = written(_compared(docs, tested, n, threshold), "links")
    roots = components(links)
    rooted = written(members.join(roots, F.col("v") == F.col("vertex"), "left").select("gid", "v", F.coalesce("root", "v").alias("root")), "rooted")
    rest = written(_rest_members(_promising(_rest_pairs(postings, threshold, rooted), postings, threshold), rooted, tested), "rest")
    more = written(_compared(docs, rest, n, threshold), "links")
    # the trees of the first components stand for their links
    return profiles, components(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(more))


def _with_roots(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """doc_id, h, size, set, and the smallest vertex of its class, of each row; no vertex without a set or an id."""
    profiles, roots = linked_sets(docs, n, threshold)
    sets = profiles.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc"))
    sets = sets.select("set", _vertex(F.col("doc"), F.col("set")).alias("v"))
    sets = sets.join(roots, F.col("v") == F.col("vertex"), "left").select("set", F.coalesce("root", "v").alias("root"))
    return profiles.join(sets, "set", "left").select(
        "doc_id", "h", "size", "set", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root")
    )


def _docs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = doc_columns(documents, id_col, text_col)
    return docs.withColumn("h", F.xxhash64("text"))


def join_classes(
    documents: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles (the set's size) and component_id (the smallest id reachable by links) of each row."""
    rooted = _with_roots(_docs(documents, id_col, text_col), n, threshold)
    return rooted.select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce(_vertex_doc(F.col("root")), "doc_id").alias("component_id")
    )


def keep_one(
    documents: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each class of linked rows, with all of its columns; rows without an id or without words all stay.

    Of a class the row with the smallest id stays; of several rows of that id the one whose set, then whose text, has
    the least hash; of rows that are equal in id and text, one.
    """
    rooted = written(_with_roots(_docs(documents, id_col, text_col), n, threshold).where("root is not null"), "classes")
    first = rooted.where((F.col("doc_id") == _vertex_doc(F.col("root"))) & (F.col("set") == _vertex_set(F.col("root"))))
    kept = first.groupBy("doc_id", "set").agg(F.min("h").alias("h")).select("doc_id", "h")
    gone = written(rooted.select("doc_id", "h").distinct().join(kept, ["doc_id", "h"], "left_anti"), "gone")
    again = rooted.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h").join(kept, ["doc_id", "h"], "left_semi")
    again = written(again, "again")
    key = [F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    named = documents.select(F.struct(*documents.columns).alias("row"), key[0].alias("doc_id"), key[1].alias("h"))
    # only rows that may go or come again are moved
    make = _filter(gone.union(again).select(F.xxhash64("doc_id", "h").alias("h")))
    near, sure = (
        in_batches(named.withColumn("k", F.xxhash64("doc_id", "h")), lambda kept=kept: make(kept, ["row", "doc_id", "h"]), named.schema)
        for kept in (True, False)
    )
    left = near.join(gone, ["doc_id", "h"], "left_anti")
    if again.limit(1).count():
        one = left.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
        left = left.join(again, ["doc_id", "h"], "left_anti").unionByName(one)
    return sure.unionByName(left).select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))
