"""The n-gram join against all pairs."""

import random
from fractions import Fraction

import pytest

from pitstats.llm import ngram_join as nj


def brute(rows, n=5):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = []
    for size in (3, 8, 20, 60, 150, 150, 400):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.2:
                copy += [r.choice(vocabulary) for _ in range(r.randint(1, 12))]
            rows.append(" ".join(copy))
    rows += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows += ["", None, " \t\n", "One two", "one  TWO", " ", "É é", rows[3], rows[3].upper()]
    r.shuffle(rows)
    return [*((i * 7 % 1009, t) for i, t in enumerate(rows)), (14, rows[5]), (None, rows[6]), (None, "alone " * 9)]


@pytest.mark.parametrize(("seed", "crowded"), [(1, 20), (2, 20), (3, -1000)])
def test_against_all_pairs(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(nj, "CROWDED", crowded)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, size long, token string")
    got = sorted((tuple(r) for r in nj.join_classes(df.repartition(5)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert nj.join_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_size():
    for size in range(1, 300):
        p = nj.prefix_size(size, nj.THRESHOLD)
        # two sets of which the larger has `size`: the least overlap leaves no room outside the prefix
        assert size - p + 1 == -(-size * 4 // 5)
    assert nj.similar(8, 9, 9, Fraction(80, 100)) and not nj.similar(7, 9, 9, Fraction(80, 100))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "a"), (1, text + " x", "b"), (2, "other", "c"), (9, "", "d"), (8, None, "e")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in nj.keep_one(df).collect()) == [(1, "b"), (2, "c"), (8, "e"), (9, "d")]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(nj.Shingler, "PIECE", 64)
    text = b"one two three four five six seven eight nine " * 20 + b"x" * 200 + b" end"
    small = nj.Shingler(5).shingles([text, b"", b"a b", text])
    monkeypatch.setattr(nj.Shingler, "PIECE", 1 << 16)
    whole = nj.Shingler(5).shingles([text, b"", b"a b", text])
    assert [s.tolist() for s in small] == [s.tolist() for s in whole]
    assert [len(s) for s in whole[1:3]] == [0, 1]


def test_leaders_move_entries_and_not_each_tasks_leaders(spark):
    """Under n-grams that few groups share a task's leaders are larger than the entries; crowded ones are summed first."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(t, bytes([g] * 16), 20, r.randrange(4)) for t in range(40) for g in r.sample(range(30), r.choice([2, 3, 20]))]
    postings = spark.createDataFrame(rows, "token long, gid binary, size long, pos long")
    found = {c: nj._leader_pairs(postings.withColumn("crowded", F.lit(c) | F.col("token").isNull()), nj.THRESHOLD) for c in (False, True)}
    got = {c: sorted((bytes(x.ga), bytes(x.gb)) for x in df.collect()) for c, df in found.items()}
    assert got[False] and got[False] == got[True]
    plan = found[False]._jdf.queryExecution().toString()
    entries = [line for line in plan.splitlines() if "Exchange hashpartitioning(token" in line and "REPARTITION_BY_COL" in line]
    assert entries


def test_entries_move_once_for_each_key(spark):
    """Leaders and what is left each move an entry once by its group and once by its n-gram; crowded ones give the same."""
    from pyspark.sql import functions as F

    r = random.Random(6)
    rows = [(t, bytes([g] * 16), 20, r.randrange(4)) for t in range(40) for g in r.sample(range(30), r.choice([1, 2, 3, 12]))]
    postings = spark.createDataFrame(rows, "token long, gid binary, size long, pos long")
    members = [(bytes([g] * 16), bytes([g, m] * 12), bytes([g % 7 if g % 5 else 90 + m] * 24)) for g in range(30) for m in range(2)]
    classes = {g: {root for gid, _, root in members if gid == g} for g, _, _ in members}
    members = spark.createDataFrame(members, "gid binary, v binary, root binary")
    want = {
        (a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]
        and len(classes[a[1]] | classes[b[1]]) > 1 and max(a[3], b[3]) <= 20 - 18
    }  # sets of 20 must share 18
    for crowded in (False, True):
        own = postings.withColumn("crowded", F.lit(crowded) | F.col("token").isNull())
        rest = nj._rest_pairs(own, nj.THRESHOLD, members)
        found = [(bytes(x.ga), bytes(x.gb)) for x in rest.collect()]
        assert want and len(found) == len(set(found)) and set(found) == want
        if not crowded:
            by_token = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(token")
            leaders = nj._leader_pairs(own, nj.THRESHOLD)
            leaders.collect()
            assert by_token(leaders) == 1


def test_sets_of_repeated_rows_come_once_and_are_not_moved_again(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text.upper()), (1, text + " x"), (2, text)], "doc_id long, text string")
    keys = {t: nj._hash128(nj.Shingler(5).shingles([t.encode()])[0].tobytes()) for t in (text, text + " x")}
    wanted = spark.createDataFrame([(1, bytearray(keys[text])), (1, bytearray(keys[text + " x"]))], "doc long, set binary").select(
        nj._vertex(F.col("doc"), F.col("set")).alias("v")
    )
    sets = nj._sets_of(docs, wanted, 5)
    assert sorted(len(r.grams) // 8 for r in sets.collect()) == [26, 27]
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0]


def test_keep_one_moves_only_rows_that_may_go(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, " ".join(f"{i}x{j}" for j in range(30)), [i]) for i in range(300)] + [(500 + i, text, [i]) for i in range(5)]
    rows += [(7, rows[7][1], [7]), (None, text, [0]), (None, text, [0]), (900, None, [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, more array<int>")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = nj.keep_one(df)
        want = [(i, rows[i][1], [i]) for i in range(300)] + [(500, text, [0]), (None, text, [0]), (None, text, [0]), (900, None, [1])]
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        moved = plan.splitlines()
        assert plan.count("MapInArrow") >= 2 and moved[0].startswith("Union")  # rows that surely stay meet no join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
