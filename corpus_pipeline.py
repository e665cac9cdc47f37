"""The corpus pipeline (counted as part of the llm subpackage).

Toxic documents go; of each class of near copies the document with the smallest id stays; strings of 50 bytes that
also start in an earlier document are cut out; documents that contain a benchmark item go; the rest is encoded to
token ids and decoded again. Each stage works on all rows that the one before it kept.

Defined results: ids may repeat, and what holds for a row is decided by its own text. A null or empty text is not toxic,
is near no other, loses nothing, holds no item and has no tokens, so its row comes out (a null one as an empty text
after the third stage); rows without an id stay in the second and third stage. Of rows that are equal in id and text one
stays. Of a class of near copies the smallest id stays, and of its rows the one with the least hash of words and text.
Texts may be of any length; an empty table gives no rows; other columns of any name are carried along up to the last
stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitstats.llm import byte_bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from pitstats.llm.common import table, vocabulary, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_texts(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_strings),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL can't express the learned scores, the classes of links or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
