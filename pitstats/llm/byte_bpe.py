"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A sentencepiece BPE model joins the adjacent pair whose joined piece scores highest, leftmost first. With one
printable character for each byte, scores of minus the rank, and identity normalisation, these are the merges that
the ranks define, so the model is written out from the vocabulary alone and nothing is trained. Each match of the
splitting pattern is a sentence of its own. Decoding maps ids back to bytes.

Defined results: a null or empty text has no ids; a row's text may be of any length; repeated rows and repeated ids
of documents each give their own row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitstats.llm.common import doc_columns, in_batches, texts_of

#: Pre-tokens kept in a task's memory before the store starts anew, and characters of them.
CACHE, CACHE_CHARS = 400_000, 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where printable, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for value in range(256):
        if value in printable:
            out.append(chr(value))
        else:
            out.append(chr(free))
            free += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, ints varints, floats 32-bit."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the positions of the tokens in rank order."""
    letters = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda item: item[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    # model_type, vocab_size, unk_id, and no begin, end or padding pieces (-1 as an unsigned 64-bit varint)
    absent = (1 << 64) - 1
    trainer = (
        _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
        + _field(41, absent) + _field(42, absent) + _field(43, absent)
    )
    # identity, no dummy prefix, blanks neither removed nor escaped
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        order = sorted(ranks.items(), key=lambda item: item[1])
        self.id_of_piece = [rank for _, rank in order]
        self.plain = self.id_of_piece == list(range(len(order)))
        self.bytes_of_id = {rank: token for token, rank in order}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.split = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        # a pre-token that is itself a token stays whole, whatever its merges would give
        self.whole = {}
        for token, rank in order:
            try:
                self.whole[token.decode()] = (rank,)
            except UnicodeDecodeError:
                continue
        self.known: dict[str, tuple[int, ...]] = dict(self.whole)
        self.chars = 0

    def _learn(self, parts: Iterable[str]) -> None:
        fresh = [p for p in parts if p not in self.known]
        if len(self.known) + len(fresh) > CACHE + len(self.whole) or self.chars > CACHE_CHARS:
            self.known, self.chars = dict(self.whole), 0
            fresh = list({p for p in parts if p not in self.known})
        self.chars += sum(map(len, fresh))
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in fresh]
        for part, ids in zip(fresh, self.model.encode(mapped, num_threads=1)):
            self.known[part] = tuple(ids) if self.plain else tuple(self.id_of_piece[i] for i in ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern encoded separately."""
        parts = self.split(text)
        known = self.known
        if missing := {p for p in parts if p not in known}:
            full = len(known) + len(missing) > CACHE + len(self.whole) or self.chars > CACHE_CHARS
            self._learn(set(parts) if full else missing)
            known = self.known
        return list(chain.from_iterable(map(known.__getitem__, parts)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of_id.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(
    documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and `ids`, the token ids of each whole text."""

    def make():
        bpe = codec(ranks_path, pattern)

        def step(batch):
            ids = [bpe.encode(text) for text in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return in_batches(doc_columns(documents, id_col, text_col), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and `bytes`, the decoded bytes of each row's `ids` (null: none)."""

    def make():
        bpe = codec(ranks_path, pattern)

        def step(batch):
            out = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

        return step

    return in_batches(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def round_trip(
    documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encodes each text, decodes its ids, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Both directions run in one pass so that the decoded bytes never leave the task; `with_ids` also returns `ids`.
    """

    def make():
        bpe = codec(ranks_path, pattern)
        decimal = {i: str(i) for i in bpe.bytes_of_id}

        def step(batch):
            counts, of_ids, of_bytes, all_ids = [], [], [], []
            for text in texts_of(batch):
                ids = bpe.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(array("i", ids))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                flat = pa.array(np.frombuffer(b"".join(a.tobytes() for a in all_ids), np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, flat))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    return in_batches(
        doc_columns(documents, id_col, text_col),
        make,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""),
    )
