"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id, so that file order is id order. Each partition becomes three flat files in the
shared folder: `.bin` (all ids one after another, 16-bit where the vocabulary allows it, else 32-bit), `.off`
(64-bit offsets of its documents, one more than there are) and `.doc` (document ids). A partition's base in the whole
sequence is the prefix sum of the id counts before it, so no task waits for another. Readers map the files into
memory. Files are written under a temporary name and renamed, so a repeated task leaves the same file.

Defined results: a null or empty text has only the end id; texts may be of any length (one text's words and ids are held
at a time); documents without an id come first and have a null id again when read; documents of one id are in the order of their texts; an empty table gives no files; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitstats.llm.common import doc_columns, in_batches, local_path, shared_dir, slices, texts_of

#: Words, stems, and characters of stems kept by a worker before its stores start anew.
CACHE, STEMS, STEM_CHARS = 900_000, 800_000, 16_000_000
#: Bytes of text for which one file is made, and the least for which another task is worth while.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
#: Marks that are split off a word's end.
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Pre-tokenisation patterns that leave white space out, so that what stands between blanks is independent, and that
#: end a run of letters at any mark: fixed values, compared with the tokenizer file's own.
APART = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
_DOC = np.dtype([("known", "<i8"), ("id", "<i8")])


class WordEncoder:
    """Ids of a text whose tokenizer drops white space, so that words between blanks are independent.

    Each distinct word goes through the library once; a text's ids are its words' ids in order. New words are given to
    the library some thousands at a time, in one text with a special token between them. Where the file lower-cases,
    a word is put together from its lower-case stem and the marks at its end. Whether all this holds is read from the
    tokenizer file; texts of other tokenizers go through the library whole.
    """

    #: Words in one call.
    TOGETHER = 4_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"": b""}
        self.chars = 0
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special and not t[1].single_word]
        self.mark_id, self.mark = (special[-1][0], special[-1][1].content) if special else (None, None)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        patterns = {x["pattern"].get("Regex") for x in splits if x["behavior"] == "Removed" and x["invert"]}
        whole = not any(t[1].single_word or t[1].lstrip or t[1].rstrip for t in self.tokenizer.get_added_tokens_decoder().items())
        self.splits = len(splits) == 1 and patterns <= APART and bool(patterns) and whole and set(steps) <= {"NFC", "Replace", "Lowercase"}
        self.folds = self.splits and "Lowercase" in steps

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, ids).tobytes() for ids in self._ids(texts)]

    def _parts(self, word: str) -> tuple[str, str]:
        """A stem and marks whose ids, one after the other, are the word's."""
        stem = word.rstrip(MARKS)
        if not self.folds or not stem.isalpha() or "\u03a3" in stem or not unicodedata.is_normalized("NFC", stem):
            return word, ""
        low = stem.lower()
        return (low, word[len(stem) :]) if len(low) == len(stem) else (word, "")

    def _learn(self, words: list[str]) -> None:
        """Fills `known` for words that are not in it."""
        made = [self._parts(w) for w in words]
        stems = self.stems
        if fresh := set(chain.from_iterable(made)).difference(stems):
            if len(stems) + len(fresh) > STEMS or self.chars > STEM_CHARS:
                stems = self.stems = {"": b""}
                self.chars, fresh = 0, set(chain.from_iterable(made)) - {""}
            self._ask(list(fresh))
        self.known.update((w, stems[x] + stems[y] if y else stems[x]) for w, (x, y) in zip(words, made))

    def _ask(self, words: list[str]) -> None:
        """Fills `stems` by the library."""
        self.chars += sum(map(len, words))
        if self.mark is None:
            self.stems.update(zip(words, self._encoded(words)))
            return
        apart = [w for w in words if self.mark[0] in w]  # may hold the mark
        self.stems.update(zip(apart, self._encoded(apart)))
        rest = [w for w in words if self.mark[0] not in w]
        for at in range(0, len(rest), self.TOGETHER):
            some = rest[at : at + self.TOGETHER]
            ids = np.array(self._ids([f" {self.mark} ".join(some)])[0], self.dtype)
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            data, width = ids.tobytes(), self.dtype.itemsize
            begin = [0, *((e + 1) * width for e in ends)]
            self.stems.update((w, data[b : e * width]) for w, b, e in zip(some, begin, ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of `dtype`; the texts' new words are learned together."""
        if not self.splits:
            return self._encoded(texts)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        split = [text.replace("\n", " ").split(" ") for text in texts]
        missing = list(set(chain.from_iterable(split)).difference(known))
        if missing:
            self._learn(missing)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """`encode` over many texts, a few megabytes at a time."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > 2 << 20:
                yield from self.encode(some)
                some, size = [], 0
        yield from self.encode(some)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _put(path: str, data) -> None:
    with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(data)
    os.replace(f.name, path)


def _files_for(documents: DataFrame, text_col: str) -> int:
    """One file for FILE_BYTES of text and more; below that as many as there are shuffle partitions, of LEAST_BYTES at least."""
    total = documents.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // FILE_BYTES), min(width, -(-total // LEAST_BYTES)))


def write_token_files(
    documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, partitions: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[dict]:
    """Writes the files and returns one entry per partition: part, n_docs, n_ids, item bytes and base."""
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)
    partitions = partitions or _files_for(documents, text_col)
    ordered = (
        doc_columns(documents, id_col, text_col)
        .repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        lengths, docs = array("q"), []
        name = os.path.join(root, f"part-{part:05d}")
        tmp = f"{name}.bin.{uuid.uuid4().hex}"
        with open(tmp, "wb") as out:  # batch by batch: a partition's ids are never all in memory
            for batch in slices(batches):
                ids = batch.column("doc_id")
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                rows = np.zeros(len(ids), _DOC)
                rows["known"], rows["id"] = valid, pc.fill_null(ids, 0).to_numpy()
                docs.append(rows)
                for data in encoder.encode_all(texts_of(batch)):
                    data += end
                    out.write(data)
                    lengths.append(len(data) // encoder.dtype.itemsize)
        if not lengths:
            os.remove(tmp)
            return
        os.replace(tmp, f"{name}.bin")
        offsets = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        _put(f"{name}.off", offsets.tobytes())
        _put(f"{name}.doc", np.concatenate(docs).tobytes())
        row = [[part], [len(lengths)], [int(offsets[-1])], [encoder.dtype.itemsize]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], ["part", "n_docs", "n_ids", "item"])

    rows = ordered.mapInArrow(run, "part long, n_docs long, n_ids long, item long").collect()  # a row per file
    rows = sorted((r.asDict() for r in rows), key=lambda r: r["part"])
    bases = accumulate((r["n_ids"] for r in rows), initial=0)
    return [r | {"base": base} for r, base in zip(rows, bases)]


def read_token_files(spark: SparkSession, folder: str, parts: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian unsigned 32-bit integers) from the mapped files."""
    root = local_path(folder)
    rows = [(p["part"], p["base"], p["item"]) for p in parts]
    index = spark.createDataFrame(rows, "part long, base long, item long")
    index = index.repartitionByRange(max(1, len(rows)), "part") if rows else index

    def make():
        def step(batch):
            out = []
            for part, base, item in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "item"))):
                name = os.path.join(root, f"part-{part:05d}")
                ids = np.memmap(f"{name}.bin", f"<u{item}", "r")
                offsets = np.memmap(f"{name}.off", "<u8", "r").astype(np.int64)
                docs = np.memmap(f"{name}.doc", _DOC, "r")
                sums = np.fromiter(
                    (zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())),
                    np.int64, len(docs),
                )
                out.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(docs["id"]), mask=np.asarray(docs["known"]) == 0), pa.array(base + offsets[:-1]),
                     pa.array(np.diff(offsets)), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                ))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return step

    return in_batches(index, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer_path: str, end_id: int = 1, **kw) -> DataFrame:
    """Writes the files into a folder of their own in the shared folder and reads them back."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(spark, folder, write_token_files(documents, tokenizer_path, folder, end_id, **kw))
