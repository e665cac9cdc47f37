"""Decontamination against the full table of edit distances."""

import random

import numpy as np

from pitstats.llm import decontaminate as dc


def least_edits(item: bytes, text: bytes) -> int:
    """Of the item against any passage of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def distance(a: bytes, b: bytes) -> int:
    """Edits between two whole strings."""
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i - 1] + (x != c), row[i] + 1, new[i - 1] + 1))
        row = new
    return row[-1]


def edited(r, text, n):
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars))
        kind = r.random()
        if kind < 0.4:
            chars[at] = r.choice("abcdefgh é")
        elif kind < 0.7:
            chars.insert(at, r.choice("abcdefgh é"))
        else:
            del chars[at]
    return "".join(chars)


def corpus():
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [words(n) for n in (3, 5, 8, 12, 20, 20, 35)] + ["", None, "ab"]
    docs = [words(r.randint(0, 40)) for _ in range(20)]
    for _ in range(80):
        item = r.choice([i for i in items if i and len(i) > 20])
        part = edited(r, item, r.choice([0, 0, 1, 2, 4, 7, 12, 20]))
        lead, tail = words(r.randint(0, 15)), words(r.randint(0, 15))
        docs.append(r.choice([f"{lead} {part} {tail}", f"{part} {tail}", f"{lead} {part}", part.upper(), lead + part.replace(" ", "\n ") + tail]))
    return [*enumerate(docs), (None, items[4]), (7, None), (8, ""), (9, items[3]), (9, items[3])], list(enumerate(items))


def test_against_full_table(spark):
    docs, items = corpus()
    expected = []
    for d, text in docs:
        for i, item in items:
            a, b = dc.normalised(item or ""), dc.normalised(text or "")
            if a and (e := least_edits(a, b)) <= dc.budget(len(a)):
                expected.append((d, i, e))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.matches(df, bench).collect()
    got = [(r.doc_id, r.item_id, r.edits) for r in rows]
    assert len(expected) > 40
    assert sorted(got, key=str) == sorted(expected, key=str)
    texts = [(d, dc.normalised(t or "")) for d, t in docs]
    for r in rows:  # the passage from start to end is as many edits from the whole item
        assert r.edits in [distance(dc.normalised(items[r.item_id][1]), t[r.start : r.end]) for d, t in texts if d == r.doc_id]
    kept = sorted((r.doc_id, r.text, r.item_id) for r in dc.drop_contaminated(df, bench).where("doc_id is not null").collect() if r.text is not None)
    hit = {(d, dc.normalised(t or "")) for d, t in docs for i, item in items if (d, i) in {(x, y) for x, y, _ in expected} and least_edits(dc.normalised(item or ""), dc.normalised(t or "")) <= dc.budget(len(dc.normalised(item or "")))}
    assert kept == sorted((d, t, 1) for d, t in docs if d is not None and t is not None and (d, dc.normalised(t)) not in hit)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text of a document")], "doc_id long, text string")
    assert dc.matches(docs, none).collect() == []
    assert dc.drop_contaminated(docs, none).count() == 1
    bench = spark.createDataFrame([(1, "some text of a benchmark")], "item_id long, text string")
    assert dc.matches(docs.limit(0), bench).collect() == []


def test_banded_edits():
    r = random.Random(5)
    text = lambda low, high: "".join(r.choice("ab") for _ in range(r.randint(low, high))).encode()
    items, texts = [text(8, 20) for _ in range(200)], [text(0, 30) for _ in range(200)]
    low, high = np.array([-len(i) for i in items]), np.array([len(t) for t in texts])
    arrays = lambda rows: [np.frombuffer(x, np.uint8) for x in rows]
    got, starts, ends = dc.banded_edits(arrays(items), arrays(texts), low, high)
    assert got.tolist() == [least_edits(i, t) for i, t in zip(items, texts)]
    assert got.tolist() == [distance(i, t[a:b]) for i, t, a, b in zip(items, texts, starts, ends)]


def test_true_begin_of_a_passage():
    r = random.Random(3)
    item = "".join(r.choice("abcdefgh ") for _ in range(200))
    (hit,) = dc.Searcher([item.encode()]).search([("x" * 180 + item[:90] + "zz" + item[95:] + "y" * 60).encode()])[0]
    assert (hit.start, hit.end, hit.edits) == (180, 377, 5)


def test_hot_grams_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(dc, "MEETINGS", 500)
    r = random.Random(6)
    texts = [b"a" * 300 + b"b" * 20 + b"a" * 90, "".join(r.choice("ab") for _ in range(400)).encode(), b""]
    items = [b"a" * 100, b"b" * 25, "".join(r.choice("ab") for _ in range(60)).encode(), b"aab", texts[1][100:180]]
    got = [[(h.item, h.edits) for h in sorted(own, key=lambda h: h.item)] for own in dc.Searcher(items).search(texts)]
    assert got == [[(i, e) for i, x in enumerate(items) if (e := least_edits(x, t)) <= dc.budget(len(x))] for t in texts]


def test_memory_of_a_search_is_small():
    """Texts are searched a quarter of a megabyte at a time: what is held beside them stays in proportion to that."""
    import random
    import tracemalloc

    from pitstats.llm import decontaminate as dc

    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2_000)]
    texts = [" ".join(r.choice(words) for _ in range(300)).encode() for _ in range(1_500)]
    items = [texts[i][100:300] for i in range(0, 1_500, 50)]
    searcher = dc.Searcher(items)
    tracemalloc.start()
    try:
        hits = searcher.search_all(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(any(h.item == i for h in hits[50 * i]) for i in range(len(items)))
    assert peak < 40_000_000
