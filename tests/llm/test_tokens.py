"""Encoders, counts and token files against the public libraries on difficult texts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pitstats.llm import byte_bpe, token_counts, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(8)
    alphabet = [*"abcdefgh'strvmld ETR  \n\t09.,!-<|>", "é", "ß", "ñ", "中", "😀", " ", "　", "é", "İ", "Σ", "​", "½", "'s", "'re", "'ll", "'v", " the", "ing", "\r\n"]
    out = ["", " ", "  ", "\n\n", "'", "''s", "a'", "a's b're 'r 'l 'lx", "<|endoftext|>", "x <|endoftext|>  y<|startoftext|>", "   a", "a   ", "a \n b"]
    out += ["".join(r.choices(alphabet, k=r.randint(1, 200))) for _ in range(400)]
    out += ["ab" * 5000, "".join(r.choices(alphabet, k=80_000)), "z" * 70_000, " " * 40_000 + "x", "It's FINE, isn't it? " * 3000]
    return out


@pytest.fixture(scope="module")
def rows():
    found = texts()
    return [*enumerate(found), (3, found[20]), (3, found[20]), (None, "no id"), (900, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(6).cache()


def test_byte_bpe(df, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    ids = byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert all(len(r.ids) == r.n_tokens for r in ids)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((bytes(r.bytes) for r in back.collect())) == sorted((t or "").encode() for _, t in rows)


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 37])
def test_token_counts(df, rows, chunk):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    short = df if chunk > 1000 else df.where("length(text) < 6000 or text is null")
    if chunk <= 1000:
        want = [w for w, (_, t) in zip(want, rows) if t is None or len(t) < 6000]
    got = sorted(map(tuple, token_counts.count_tokens(short, BYTES, chunk=chunk).collect()), key=str)
    assert got == sorted(want, key=str)


def test_scan_equals_whole_count():
    machine = token_counts.transducer(BYTES)
    text = "".join(texts()[:150])
    for size in (7, 31, 64):
        maps = [machine.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        done = machine.scan(maps)
        assert machine.total(done[-1]) == machine.count(text)
        assert len(done) == len(maps)


def test_token_files(spark, df, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for files in (None, 5):
        got = sorted(map(tuple, token_files.token_files(df, WORDS, partitions=files).collect()), key=lambda r: r[1])
        assert got == want
    assert token_files.token_files(df.limit(0), WORDS).collect() == []


def test_number_of_files_follows_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1_000) for i in range(64)], "doc_id long, text string")
    found = []
    for most, least in ((1 << 30, 1 << 20), (1 << 30, 4_000), (1 << 30, 1_000), (2_000, 1_000)):
        monkeypatch.setattr(token_files, "FILE_BYTES", most)
        monkeypatch.setattr(token_files, "LEAST_BYTES", least)
        found.append(token_files._files_for(docs, "text"))
    assert found == [1, 8, 8, 32]  # 8 shuffle partitions in tests


def test_words_put_together_from_stems_and_marks():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    assert encoder.splits and encoder.folds
    r = random.Random(1)
    bits = ["ΣΑΣ", "İstanbul", "ÉCOLE", "e\u0301cole.", "STRASSE", "ﬁn", "don't", "x's.", "'S", "''", "...", "***", "a.b", "3.14,", "日本。", "\t", "ǅ", "ŉ", "<|endoftext|>,", "OK,", "(x)", "we'RE."]
    for _ in range(1_500):
        text = "".join(r.choice(bits) + r.choice([" ", "  ", "\n", "\u00a0", ""]) for _ in range(r.randint(0, 12)))
        got = np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused(tmp_path):
    import json

    with open(BYTES, encoding="utf-8") as f:
        made = json.load(f)
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(made))
    with pytest.raises(ValueError):
        token_counts.Transducer(str(tmp_path / "other.json"))


def test_empty(df):
    assert byte_bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert token_counts.count_tokens(df.limit(0), BYTES).collect() == []
