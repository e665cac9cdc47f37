"""A trie of conversations' prefixes, in double arrays per shard of prefixes.

Turns are known by the 128-bit hash of role and text. Rows are range-partitioned by conversation and turn, so that a
conversation of any length is spread over tasks, and cut into segments of SEGMENT turns. A segment is filed under the
hash of the prefix before it; equal segments under equal prefixes become one with a weight. Shards are runs of the
segments' order by prefix and first turns, up to SHARD turns each: their turns get dense ids, and BASE and CHECK are
packed level by level; a walk over all segments then finds the nodes, their weights and, from the leaves up, what
their subtrees hold.

Nodes that another shard may hold too (those on the paths of a shard's first and last group of segments with equal
first turns, and those above the end of a full segment) are added up by their prefix's hash; sums over their subtrees
take logarithmically many rounds, in each of which a node's sum goes to the node as far above it as the sum reaches
down. All other nodes are final within their shard.

Defined results: a null role or text is empty; rows of one conversation with equal turns are ordered by the hash of role
and text, null turns come first; rows without a conversation are left out; repeated rows are turns of their own. A
conversation without turns ends at the root. An empty table gives no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitstats.llm.common import slices, written

#: Turns of a segment, and turns that one shard packs.
SEGMENT = 1_024
SHARD = 200_000
#: First turns by which segments are ordered.
LEAD = 8
#: Bytes of a piece of a list of ids that is hashed.
LIST = 1 << 20
_FP, _KEY = 16, ("k1", "k2")


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id`, `turn`, `fp` (hash of role and text) and `n` (bytes of the text) of each row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("fp"),
        F.octet_length(text).cast("long").alias("n"),
    )


def pieces_of(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """`conv_id`, `start` (turns before it), `size`, `fps` and `ns` (packed) of runs of up to `segment` turns in order."""
    key = ["conv_id", F.col("turn").asc_nulls_first(), "fp", "n"]
    ordered = turns.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "fp", "n")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, open_ = TaskContext.get().partitionId(), 0, None

        def out(pieces: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            nonlocal at
            conv, fps, ns = zip(*pieces)
            order = range(at, at + len(conv))
            at += len(conv)
            sizes = [len(f) // _FP for f in fps]
            columns = [pa.array(conv, pa.int64()), pa.array([part] * len(conv), pa.int32()), pa.array(order, pa.int64()), pa.array(sizes, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.binary()), pa.array(ns, pa.binary())], ["conv_id", "part", "at", "size", "fps", "ns"])

        for batch in slices(batches):
            conv = batch.column("conv_id").to_numpy()
            fps, ns = b"".join(batch.column("fp").to_pylist()), batch.column("n").to_numpy().astype(np.int64).tobytes()
            cuts = np.r_[0, np.flatnonzero(np.diff(conv)) + 1, len(conv)].tolist()
            done = []
            for a, b in zip(cuts, cuts[1:]):
                own = (int(conv[a]), fps[a * _FP : b * _FP], ns[a * 8 : b * 8])
                if open_ and open_[0] == own[0]:
                    own = (own[0], open_[1] + own[1], open_[2] + own[2])
                elif open_:
                    done.append(open_)
                while len(own[2]) > segment * 8:
                    done.append((own[0], own[1][: segment * _FP], own[2][: segment * 8]))
                    own = (own[0], own[1][segment * _FP :], own[2][segment * 8 :])
                open_ = own
            if done:
                yield out(done)
        if open_:
            yield out([open_])

    pieces = written(ordered.mapInArrow(runs, "conv_id long, part int, at long, size long, fps binary, ns binary"), "trie-pieces")
    before = F.sum("size").over(W.partitionBy("conv_id").orderBy("part", "at").rowsBetween(W.unboundedPreceding, -1))
    return pieces.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).drop("part", "at")


def share_heads(pieces: DataFrame, group: int, heads: int) -> DataFrame:
    """Pieces of conversations rebuilt: the first h turns become those of conversation c - c % group.

    h is the unsigned crc32 of the decimal c, modulo `heads`.
    """
    most = heads - 1
    first = F.substring("fps", 1, _FP * most), F.substring("ns", 1, 8 * most)
    head = (
        pieces.where(F.col("start") < most).groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("start", first[0].alias("fps"), first[1].alias("ns")))).alias("h"))
        .select("base", *(F.expr(f"array_join(transform(h, x -> hex(x.{c})), '') as head_{c}") for c in ("fps", "ns")))
    )
    rows = pieces.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    at_start = rows.where("start = 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(head, "base", "left")
    begun = at_start.select(
        "conv_id", F.lit(-1).cast("long").alias("start"),
        *(F.coalesce(F.unhex(F.substring(f"head_{c}", F.lit(1), F.col("h") * F.lit(2 * w))), F.lit(b"")).alias(c) for c, w in (("fps", _FP), ("ns", 8))),
    ).withColumn("shift", F.length("ns") / 8)
    # own turns after the first h; how far they move is known from the head
    skip = F.least(F.greatest(F.col("h") - F.col("start"), F.lit(0)), F.col("size")).cast("int")
    rest = rows.withColumn("skip", skip).where("skip < size").select(
        "conv_id", (F.col("start") + F.col("skip") - F.col("h")).alias("start"),
        *(F.expr(f"substring({c}, skip * {w} + 1)").alias(c) for c, w in (("fps", _FP), ("ns", 8))),
    )
    moved = begun.select("conv_id", F.col("shift").cast("long").alias("shift"))
    rest = rest.join(moved, "conv_id").select("conv_id", (F.col("start") + F.col("shift")).alias("start"), "fps", "ns")
    return begun.select("conv_id", F.lit(0).cast("long").alias("start"), "fps", "ns").unionByName(rest)


_U = np.uint64


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Two 64-bit words to one (finaliser of a 64-bit hash)."""
    x = (a ^ _U(salt)) * _U(0x9E3779B97F4A7C15) + b
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    return x ^ (x >> _U(31))


def _step(h: tuple[np.ndarray, np.ndarray], fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of a prefix from that of the prefix a turn shorter; `fp` is an array of pairs of words."""
    return _mix(_mix(h[0], fp[:, 0], 11), fp[:, 1], 12), _mix(_mix(h[1], fp[:, 1], 13), fp[:, 0], 14)


def segments_of(pieces: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """`conv_id`, `j` (number of the segment), `f1`, `f2` (hash of the prefix before it), `x1`, `x2` (its own), `fps`, `ns`.

    A conversation without turns has one empty segment. The hash of a whole prefix is the exclusive or of its segments'.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for conv, start, fps, ns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "fps", "ns"))):
                at, size = 0, len(ns) // 8
                while at < size or at == 0:
                    j, off = divmod(start + at, segment)
                    end = min(size, at + segment - off)
                    out.append((conv, j, off, fps[at * _FP : end * _FP], ns[at * 8 : end * 8]))
                    if size == 0:
                        break
                    at = end
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "j", "off", "fps", "ns"])

    parts = pieces.select("conv_id", "start", "fps", "ns").mapInArrow(cut, "conv_id long, j long, off int, fps binary, ns binary")
    # up to `segment` turns of one conversation
    gathered = parts.groupBy("conv_id", "j").agg(F.array_sort(F.collect_list(F.struct("off", "fps", "ns"))).alias("p"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column("p").to_pylist()
            fps, ns = ([b"".join(p[c] for p in row) for row in rows] for c in ("fps", "ns"))
            sizes = np.array([len(n) // 8 for n in ns])
            words = np.frombuffer(b"".join(fps), "<u8").reshape(-1, 2)
            begin = np.cumsum(sizes) - sizes
            j = batch.column("j").to_numpy().astype(_U)
            h = start_hash(j)
            for d in range(int(sizes.max(initial=0))):
                on = np.flatnonzero(sizes > d)
                a, b = _step((h[0][on], h[1][on]), words[begin[on] + d])
                h[0][on], h[1][on] = a, b
            x1, x2 = _local(h, j)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("j"), pa.array(x1.view(np.int64)), pa.array(x2.view(np.int64)), pa.array(fps, pa.binary()), pa.array(ns, pa.binary())],
                ["conv_id", "j", "x1", "x2", "fps", "ns"],
            )

    rows = gathered.mapInArrow(hashed, "conv_id long, j long, x1 long, x2 long, fps binary, ns binary")
    own = W.partitionBy("conv_id").orderBy("j")
    before = [F.coalesce(F.expr(f"bit_xor({x})").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f) for x, f in (("x1", "f1"), ("x2", "f2"))]
    return rows.select("conv_id", "j", *before, "x1", "x2", "fps", "ns", F.lead("j").over(own).isNull().alias("last"))


def start_hash(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash that segment j's turns are added to."""
    return _mix(j, j, 1), _mix(j, j, 2)


def _local(h: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a part of segment j adds to its prefix's hash: nothing where it is empty."""
    zero = start_hash(j)
    return h[0] ^ zero[0], h[1] ^ zero[1]


class Shard(NamedTuple):
    """BASE and CHECK over slots; slot r < roots is the root of group r. A free slot's CHECK is -1."""

    base: np.ndarray
    check: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    levels: list[np.ndarray]


def pack_shard(words: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> Shard:
    """Double arrays over segments (their turns' hashes one after another), of which each belongs to a group with a root.

    The children of a node with one child take the next free place; those of others the first free window among a few
    places and else the array's end, so that packing takes time in proportion to the turns.
    """
    codes = np.unique(words.view([("a", "<u8"), ("b", "<u8")]).ravel(), return_inverse=True)[1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    alphabet, roots = int(codes.max(initial=-1)) + 1, int(group.max(initial=-1)) + 1
    room = roots + len(codes) + 2 * alphabet + 64
    base, check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
    check[:roots] = -2
    free, end = roots, roots
    at, begin = group.copy(), np.cumsum(sizes) - sizes
    levels = [np.arange(roots)]
    for d in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > d)
        pair = at[on] * alphabet + codes[begin[on] + d]
        wanted, back = np.unique(pair, return_inverse=True)
        parent, code = wanted // alphabet, wanted % alphabet
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[first, len(parent)])
        slots = np.empty(len(wanted), np.int64)
        for i in np.flatnonzero(count > 1).tolist():
            own = code[first[i] : first[i] + count[i]]
            spread = own - own[0]
            for slot in (free, free + 1, free + 2, free + 5, end):
                if slot + spread[-1] >= len(check):
                    grow = slot + int(spread[-1]) + 1 - len(check) + len(check) // 2
                    base, check = np.r_[base, np.zeros(grow, np.int64)], np.r_[check, np.full(grow, -1, np.int64)]
                if (check[slot + spread] == -1).all():
                    break
            node = parent[first[i]]
            base[node], check[slot + spread] = slot - own[0], node
            slots[first[i] : first[i] + count[i]] = slot + spread
            end = max(end, slot + int(spread[-1]) + 1)
            while check[free] != -1:
                free += 1
                if free == len(check):
                    base, check = np.r_[base, np.zeros(room, np.int64)], np.r_[check, np.full(room, -1, np.int64)]
        one = first[count == 1]
        if len(one):
            holes = np.flatnonzero(check[free:end] == -1)[: len(one)] + free
            more = np.arange(end, end + len(one) - len(holes))
            if len(more) and more[-1] >= len(check) - 1:
                grow = int(more[-1]) + 2 - len(check) + len(check) // 2
                base, check = np.r_[base, np.zeros(grow, np.int64)], np.r_[check, np.full(grow, -1, np.int64)]
            place = np.r_[holes, more]
            base[parent[one]], check[place], slots[one] = place - code[one], parent[one], place
            end = max(end, int(place[-1]) + 1)
            while free < end and check[free] != -1:
                free += 1
        at[on] = slots[back]
        levels.append(slots)
    return Shard(base[:end], check[:end], codes, at, levels)


def walk(shard: Shard, sizes: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Depth, segments that reach it, their slots there and their turns' places; each step must pass CHECK."""
    at, begin = group.copy(), np.cumsum(sizes) - sizes
    yield 0, np.arange(len(sizes)), at, begin
    for d in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > d)
        slot = shard.base[at[on]] + shard.codes[begin[on] + d]
        if not (shard.check[slot] == at[on]).all():
            raise AssertionError("a segment left the trie")
        at[on] = slot
        yield d + 1, on, slot, begin[on] + d


_NODE = (
    "k1 long, k2 long, depth long, p1 long, p2 long, parent_conv_id long, conv_id long, n_convs long, n_bytes long, n_children long, "
    "n_leaves long, saved_tokens long, shared boolean, shared_parent boolean, shard long"
)


def shard_nodes(rows: dict[str, np.ndarray], fps: list[bytes], ns: list[bytes], shard_id: int, segment: int) -> pa.RecordBatch:
    """The nodes of one shard's segments: final ones, and what it knows of those that others may hold too."""
    sizes = np.array([len(n) // 8 for n in ns], np.int64)
    words, length = np.frombuffer(b"".join(fps), "<u8").reshape(-1, 2), np.frombuffer(b"".join(ns), np.int64)
    roots, group = np.unique(np.stack([rows[c] for c in ("j", "f1", "f2")], axis=1), axis=0, return_inverse=True)
    group = group.ravel().astype(np.int64)
    trie = pack_shard(words, sizes, group)
    total = len(trie.check)
    n, conv, n_bytes = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max), np.zeros(total, np.int64)
    lead = [f[: LEAD * _FP] for f in fps]
    same = lambda i: np.array([a == lead[i] and g == group[i] for a, g in zip(lead, group)])
    flagged = same(0) | same(len(fps) - 1) | (sizes == segment)
    shared, hashes = np.zeros(total, bool), [np.zeros(total, _U), np.zeros(total, _U)]
    root_j = roots[:, 0].astype(_U)
    for h, zero in zip(hashes, start_hash(root_j)):
        h[: len(roots)] = zero
    of_root, depth = np.zeros(total, np.int64), np.zeros(total, np.int64)
    of_root[: len(roots)] = np.arange(len(roots))
    for d, on, slot, place in walk(trie, sizes, group):
        np.add.at(n, slot, rows["w"][on])
        np.minimum.at(conv, slot, rows["conv_id"][on])
        shared[slot[flagged[on]]] = True
        if d:
            parent = trie.check[slot]
            n_bytes[slot], depth[slot], of_root[slot] = length[place], d, of_root[parent]
            for h, v in zip(hashes, _step((hashes[0][parent], hashes[1][parent]), words[place])):
                h[slot] = v
    inner = roots[:, 0] > 0  # their roots are the ends of the segments before
    shared[: len(roots)] |= inner
    n[: len(roots)][inner] = 0
    children, leaves, saved = (np.zeros(total, np.int64) for _ in range(3))
    for level in reversed(trie.levels):
        own = level[~shared[level]]
        leaves[own] += children[own] == 0
        saved[own] += (n[own] - 1) * n_bytes[own]
        own = own[own >= len(roots)]
        parent = trie.check[own]
        np.add.at(children, parent, 1)
        np.add.at(leaves, parent, leaves[own])
        np.add.at(saved, parent, saved[own])
    nodes = np.flatnonzero(trie.check != -1)
    local = _local((hashes[0], hashes[1]), roots[of_root, 0].astype(_U))
    key = [(local[i].view(np.int64) ^ roots[of_root, i + 1])[nodes] for i in (0, 1)]
    where = np.full(total, -1)
    where[nodes] = np.arange(len(nodes))
    is_root = nodes < len(roots)
    up = np.where(is_root, 0, where[np.where(is_root, 0, trie.check[nodes])])
    null = lambda values, kind=pa.int64(): pa.array(values, kind, mask=is_root)
    columns = [
        *(pa.array(k) for k in key), pa.array(depth[nodes] + roots[of_root[nodes], 0] * segment), *(null(k[up]) for k in key),
        null(conv[nodes][up]), pa.array(conv[nodes]), pa.array(n[nodes]), pa.array(n_bytes[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]),
        pa.array(saved[nodes]), pa.array(shared[nodes]), null(shared[nodes][up], pa.bool_()), pa.array(np.full(len(nodes), shard_id)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _NODE.split(", ")])


def partial_nodes(segments: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """Rows of _NODE: the nodes of all shards, written to the shared folder."""
    weights = (F.count("*").alias("w"), F.min("conv_id").alias("conv_id"), F.first("fps").alias("fps"), F.first("ns").alias("ns"))
    distinct = segments.groupBy("j", "f1", "f2", "x1", "x2").agg(*weights)
    order = ["j", "f1", "f2", F.substring("fps", 1, LEAD * _FP), "x1", "x2"]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            rows = {c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("j", "f1", "f2", "w", "conv_id")}
            fps, ns = ([x for b in held for x in b.column(c).to_pylist()] for c in ("fps", "ns"))
            return shard_nodes(rows, fps, ns, (part << 32) + number, segment)

        for batch in slices(batches, max(1, min(200, shard // 8))):
            held.append(batch)
            turns += sum(len(x) for x in batch.column("ns").to_pylist()) // 8
            if turns >= shard:
                yield from slices([close()], 20_000)
                number, held, turns = number + 1, [], 0
        if held:
            yield from slices([close()], 20_000)

    ordered = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(shards, _NODE), "trie-nodes")


def _merged(partial: DataFrame) -> DataFrame:
    """Shared nodes with their subtrees' sums: key, parent's key, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens."""
    shared = partial.where("shared").groupBy(*_KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.sum("n_children").alias("own"), F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved"),
    )
    shared = written(shared, "trie-shared")
    counts = shared.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    nodes = shared.join(counts, list(_KEY), "left").na.fill(0, ["more"]).withColumn("n_children", F.col("own") + F.col("more"))
    sums = nodes.select(
        *_KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"),
        (F.col("below") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        # each node holds the sum of what is less than `reach` below it; a1, a2 is the node `reach` above it
        sums = written(sums, "trie-sums")
        gained = sums.where("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = sums.where("a1 is not null").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        sums = (
            sums.join(gained, list(_KEY), "left").join(above, ["a1", "a2"], "left")
            .select(*_KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), *((F.col(c) + F.coalesce(g, F.lit(0).cast("long"))).alias(c) for c, g in (("n_leaves", "l"), ("saved_tokens", "s"))))
        )
        reach *= 2
    sums = sums.select(*_KEY, "n_leaves", "saved_tokens")
    found = nodes.select(*_KEY, "p1", "p2", "depth", "conv_id", "n_convs", "n_children").join(sums, list(_KEY))
    return written(found, "trie-merged")


def list_hashes(ends: DataFrame, most: int = LIST) -> DataFrame:
    """`k1`, `k2`, `ends_sha256`: the hash of each key's `conv_id`s, ascending, joined by commas.

    Ids are range-partitioned, so a key with any number of them is spread over tasks; keys within one partition are
    hashed there, and those that cross a bound arrive as pieces of about `most` bytes, in order.
    """
    order = [*_KEY, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, own, size, first, seen = None, [], 0, None, 0

        def close(cut: bool, edge: bool) -> None:
            """Ends a piece: `cut` within its key, `edge` where the key may go on in another partition."""
            nonlocal own, size, first, seen
            text = ",".join(own)
            whole = not cut and not edge and seen == 0
            held.append((*key, first, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None))
            own, size, first, seen = [], 0, None, seen + 1 if cut else 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["k1", "k2", "first", "ids", "sha"])
            held.clear()
            return rows

        at_edge = True  # the first key may have begun in the partition before
        for batch in slices(batches):
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id"))):
                if key != (k1, k2):
                    if key is not None:
                        close(False, at_edge)
                        at_edge = False
                    key = (k1, k2)
                elif size >= most:
                    close(True, at_edge)
                first = conv if first is None else first
                own.append(str(conv))
                size += len(own[-1]) + 1
            if len(held) >= 1_000:
                yield out()
        if key is not None:
            close(False, True)
        if held:
            yield out()

    found = written(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "k1 long, k2 long, first long, ids string, sha string"), "trie-ends")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
            done.clear()
            return rows

        for batch in slices(batches, 16):
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if key != (k1, k2):
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if len(done) >= 1_000:
                yield out()
        if key is not None:
            done.append((*key, digest.hexdigest()))
        if done:
            yield out()

    crossing = found.where("sha is null").select(*_KEY, "first", "ids").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return found.where("sha is not null").select(*_KEY, F.col("sha").alias("ends_sha256")).unionByName(crossing.mapInArrow(joined, "k1 long, k2 long, ends_sha256 string"))


def trie(pieces: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie over conversations given as pieces (conv_id, start, fps, ns)."""
    segments = written(segments_of(pieces, segment), "trie-segments")
    partial = partial_nodes(segments, segment, shard)
    merged = _merged(partial)
    conv = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    fields = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    upper = merged.join(conv, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("up")).select(*_KEY, *fields)
    inner = partial.where("not shared and not shared_parent").select(*_KEY, *fields)
    # children of shared nodes ask once for each shard, whatever their number
    asked = partial.where("shared").select("shard", *_KEY).join(merged.select(*_KEY, F.col("conv_id").alias("up")), list(_KEY))
    asked = asked.select("shard", F.col("k1").alias("p1"), F.col("k2").alias("p2"), "up")
    under = partial.where("not shared and shared_parent").join(asked, ["shard", "p1", "p2"]).withColumn("parent_conv_id", F.col("up")).select(*_KEY, *fields)
    ends = segments.where("last").select(F.col("f1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("f2").bitwiseXOR(F.col("x2")).alias("k2"), "conv_id")
    nodes = upper.unionByName(inner).unionByName(under).join(list_hashes(ends), list(_KEY), "left")
    return nodes.select(*fields, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), *_KEY)


def prefix_trie(conversations: DataFrame, group: int = 1, heads: int = 1, segment: int = SEGMENT, shard: int = SHARD, **columns: str) -> DataFrame:
    """Nodes of the trie over conversations, whose heads are shared within groups of `group` ids where `heads` is over 1.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and
    k1, k2, the hash of the prefix.
    """
    if segment < heads:
        raise ValueError("a head must fit in a segment")
    pieces = pieces_of(turns_of(conversations, **columns), segment)
    return trie(share_heads(pieces, group, heads) if heads > 1 else pieces, segment, shard)
