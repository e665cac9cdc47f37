"""The trie against plain nested dictionaries, with segments and shards of a few turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pitstats.llm import prefix_trie as pt

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group, heads):
    fp = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest()
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, fp(r, x), (r, x)))
    own = {c: [turn for *_, turn in sorted(turns)] for c, turns in conv.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        rest = c % group if c >= 0 else -(-c % group)
        whole[c] = tuple(own.get(c - rest, [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def result(spark, rows, group, heads, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", k1 int, depth string").repartition(5)
    return sorted((tuple(r) for r in pt.prefix_trie(df, group, heads, **sizes).select(*FIELDS).collect()), key=str)


def chats(seed, convs, turns, words):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.choice(turns)):
            rows.append((c, t, r.choice(["user", "assistant"]) if words > 2 else "user", r.choice("abcdefgh"[:words]) * r.randint(1, 2)))
    return rows


@pytest.mark.parametrize(
    "rows,group,heads,sizes",
    [
        (chats(1, 60, range(1, 7), 2), 5, 9, {"segment": 9, "shard": 16}),
        (chats(2, 50, range(1, 30), 1), 1, 1, {"segment": 3, "shard": 8}),  # nearly equal, many segments
        (chats(3, 40, range(1, 9), 6) + [(7, 100 + i, "user", str(i % 3)) for i in range(150)], 5, 9, {"segment": 10, "shard": 30}),
        ([(c, t, "user", "hot") for c in range(120) for t in range(4)] + chats(4, 30, range(1, 5), 3), 5, 9, {"segment": 9, "shard": 9}),
    ],
)
def test_equals_brute_force(spark, rows, group, heads, sizes):
    assert result(spark, rows, group, heads, **sizes) == brute(rows, group, heads)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 3, "user", "x"), (2, 3, "user", "y"), (None, 1, "user", "z"),
            (3, 1, "", ""), (3, 2, None, None), (-7, 1, "user", "a"), (11, 0, "user", "only")]
    assert result(spark, rows, 5, 9) == brute(rows, 5, 9)
    assert result(spark, rows, 1, 1, segment=2, shard=2) == brute(rows, 1, 1)
    assert result(spark, [], 5, 9) == [] and result(spark, [(None, 1, "user", "z")], 5, 9) == []


def test_hash_of_a_long_list(spark):
    ends = spark.createDataFrame([(1, 2, i) for i in range(-50, 3000)] + [(1, 3, 5), (4, 4, 8), (4, 4, 7)], "k1 long, k2 long, conv_id long").repartition(9)
    got = {(r.k1, r.k2): r.ends_sha256 for r in pt.list_hashes(ends, most=100).collect()}
    text = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): text(range(-50, 3000)), (1, 3): text([5]), (4, 4): text([7, 8])}


def test_double_array_holds_each_segment_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 12, 400)
    words = rng.integers(0, 30, (int(sizes.sum()), 2)).astype(np.uint64)
    words[:, 1] = 7
    group = rng.integers(0, 3, 400)
    shard = pt.pack_shard(words, sizes, np.unique(group, return_inverse=True)[1].astype(np.int64))
    paths, at = set(), 0
    for n, g in zip(sizes, group):
        paths |= {(g, *words[at : at + d, 0].tolist()) for d in range(n + 1)}
        at += n
    assert int((shard.check != -1).sum()) == len(paths)
    assert len(shard.check) < 1.5 * len(paths)
    ends = [at for _, at, _, _ in pt.walk(shard, sizes, np.unique(group, return_inverse=True)[1].astype(np.int64))]
    assert len(ends) == sizes.max() + 1
