"""The pipeline on a small corpus with planted cases, stage by stage."""

import hashlib
import random

import corpus_pipeline as cp


def planted(path, spark):
    r = random.Random(12)
    syllables = ["an", "the", "or", "in", "st", "er", "ou", "li", "ch", "ne", "ra", "mo"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    bad = ["scumm", "idioth", "clownz"]
    docs = [text(r.choice([40, 90, 200])) for _ in range(120)]
    toxic = set(range(60))
    for i in toxic:
        words = docs[i].split()
        for _ in range(max(4, len(words) // 10)):
            words.insert(r.randrange(len(words)), r.choice(bad))
        docs[i] = " ".join(words)
    near = len(docs)
    base = docs[100].split()
    docs += [docs[100], " ".join([*base[:-1], "changed"])]
    leak = len(docs)
    item = text(30)
    docs.append(f"{text(20)} {item} {text(20)}")
    passage = text(25)
    docs += [f"{text(20)} {passage} {text(10)}", f"{text(15)} {passage} {text(12)}"]
    docs += ["", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, text(30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, toxic, near, leak, passage


def test_planted_cases(spark, tmp_path):
    docs, toxic, near, leak, passage = planted(str(tmp_path), spark)
    sf_dir, now, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        now = stage(spark, now, sf_dir)
        if i < len(cp.STAGES) - 1:
            assert now.columns == columns
            now = cp.written(now, f"test-{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    # learned from forty texts: nearly all toxic documents go, and no clean one
    assert len(toxic & set(kept["toxicity"])) <= 3 and set(range(len(docs))) - toxic <= set(kept["toxicity"])
    assert set(kept["toxicity"]) - set(kept["ngram_join"]) == {near, near + 1} and 100 in kept["ngram_join"]
    cut = kept["suffix_dedup"]
    assert passage in cut[leak + 1].text and passage not in cut[leak + 2].text
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert set(kept["suffix_dedup"]) - set(kept["decontaminate"]) == {leak}
    for i, r in kept["byte_bpe"].items():
        assert r.decoded_sha256 == hashlib.sha256(kept["decontaminate"][i].text.encode()).hexdigest()
        assert len(r.ids) == r.n_tokens
    assert {r["doc_id"] for r in cp.run(spark, sf_dir).collect()} == set(kept["byte_bpe"])


CLASHING = "row string, h int, data binary, rest string, size int, set string, v string, root string, part int, score double, asked int"


def edge_rows():
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c, long = text(40), text(40), text(40), text(60_000)
    texts = [(1, a), (5, a), (5, b), (9, b + " more"), (9, b + " more"), (None, a), (None, None), (3, None), (3, ""), (3, ""), (4, " "), (7, long), (8, c), (8, c), (6, "one two"), (2, "One  TWO")]
    return [(i, t, None, "s" if k % 2 else None, None if k % 3 else len(t or ""), *([None] * 11)) for k, (i, t) in enumerate(texts)], (a, b, c, long)


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated ids and rows, and columns that clash with the operators' own."""
    planted(str(tmp_path), spark)
    rows, (a, b, c, long) = edge_rows()
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    sf_dir, seen = str(tmp_path), {}
    now = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        now = stage(spark, now, sf_dir)
        if i < len(cp.STAGES) - 1:
            assert now.columns == docs.columns
            now = cp.written(now, f"edges-{name}")
            seen[name] = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
    assert len(seen["toxicity"]) == len(rows)
    # of each class one row: (1, a) for a; (5, b) for b and its near copy; one of two equal rows; the least id of "one two"
    left = [(1, a), (5, b), (None, a), (None, None), (3, None), (3, ""), (3, ""), (4, " "), (7, long), (8, c), (2, "One  TWO")]
    assert seen["ngram_join"] == sorted(left, key=str)
    cut = [(i, t or "") for i, t in left]
    assert seen["suffix_dedup"] == sorted(cut, key=str) and seen["decontaminate"] == sorted(cut, key=str)
    assert now.count() == len(left)


def test_empty_tables(spark, tmp_path):
    planted(str(tmp_path), spark)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        now = cp.written(stage(spark, now, str(tmp_path)), f"empty-{name}")
        assert now.count() == 0
