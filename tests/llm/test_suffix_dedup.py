"""Suffix dedup against brute force over all strings."""

import hashlib
import random

import numpy as np
import pytest

from pitstats.llm import suffix_dedup as sd


def brute(rows, span):
    """doc_id, n_bytes, n_removed, n_spans, kept hash of each row, by a dictionary of all strings."""
    first = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            s = data[i : i + span]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if doc_id is not None:
            for i in range(len(data) - span + 1):
                if first[data[i : i + span]] < doc_id:
                    gone[i : i + span] = True
        flags = gone[: len(data)]
        spans = int(np.sum(flags & ~np.concatenate(([False], flags[:-1])))) if len(data) else 0
        kept = bytes(b for b, g in zip(data, flags) if not g)
        out.append((doc_id, len(data), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abéñ") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(0, 80))) for _ in range(30)]
    for _ in range(40):
        a, b = r.choice(texts), r.choice(texts)
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        texts.append(b[:j] + a[i : i + r.randint(30, 200)] + b[j:])
    texts += ["", "short", "x" * 300, "x" * 170, "ab" * 200, None, texts[3], texts[3]]
    texts.append(" ".join(word() for _ in range(60_000)) + texts[5])
    texts.append("tail " + texts[-1][100_000:])
    ids = [i * 3 % 101 for i in range(len(texts))]
    rows = list(zip(ids, texts))
    return [*rows, (5, texts[2]), (5, texts[2]), (None, texts[1]), (4, texts[40])]


@pytest.mark.parametrize("hot", [sd.HOT, 40])
def test_against_brute_force(spark, hot):
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, "z", i) for i, t in rows], "doc_id long, text string, data string, start long")
    got = sorted((tuple(r) for r in sd.dedup_report(df.repartition(5), hot=hot).collect()), key=str)
    assert got == brute(rows, 50)


def test_settled_copies_of_a_line_are_spread(spark, monkeypatch):
    """One line in all documents: what each task settles goes to the partitions in turn, not to that of the line's bytes."""
    line = "a common line of one licence, which all documents begin with, " * 3
    docs = spark.createDataFrame([(i, f"{line}\nand {i} of its own") for i in range(4_000)], "doc_id long, text string").repartition(8)
    seen = {}
    inner = sd._deal_suffixes
    monkeypatch.setattr(sd, "CELLS", 3_000)

    def dealt(*args):
        out = inner(*args)
        spread = out.rdd.map(lambda r: (r["part"], len(sd.unpack(r["data"][8 : 8 + int.from_bytes(r["data"][:8], "little")])[2]))).collect()
        for part, n in spread:
            seen[part] = seen.get(part, 0) + n
        return out

    monkeypatch.setattr(sd, "_deal_suffixes", dealt)
    ranges = sd.repeated_ranges(docs, hot=2_000)
    assert ranges.count() == 3_999
    assert sum(seen.values()) > 20_000 and max(seen.values()) <= 0.5 * sum(seen.values()) and len(seen) >= 4


def test_empty(spark):
    assert sd.dedup_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_multikey_order():
    r = np.random.default_rng(3)
    words = r.integers(0, 3, (500, 6)).astype(np.uint64)
    order, group = sd.multikey_order(words)
    rows = [tuple(w) for w in words[order]]
    assert rows == sorted(map(tuple, words))
    assert all((rows[i] == rows[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(rows)))


def test_kept_parts():
    assert sd.kept_parts(b"abcdefgh", [(1, 3), (2, 4), (4, 5), (6, 8)]) == (b"af", 6, 2)


def test_ordering_holds_few_copies():
    """Beside the order and the classes no two more copies of the table stand in memory."""
    import tracemalloc

    words = np.random.default_rng(3).integers(0, 2, (60_000, 11)).astype(np.uint64)
    words[:, 0] = np.arange(len(words)) // 2
    tracemalloc.start()
    order, group = sd.multikey_order(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = list(map(tuple, words[order].tolist()))
    assert keys == sorted(map(tuple, words.tolist()))
    assert group.tolist() == np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))]).tolist()
    assert peak < 2 * words.nbytes, peak / words.nbytes
