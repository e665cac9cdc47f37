"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of an Arrow batch. Texts are long: batches of Spark's default size hold many megabytes on both sides of each
#: task, and these buffers, not the operators, would decide how much memory an executor needs.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, for the registered queries.

    They run in sessions that others make. Where such a session leaves the Arrow batch size at its default it is made
    fit for texts, for as long as the session lives, as plans run after this call; a smaller setting stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Without that setting a local session gets a folder of its own; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"spark-{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_columns(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as `doc_id` and `text`; a null text is empty. Other columns can't clash."""
    return documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that texts are copied a few megabytes at a time; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """`mapInArrow` with state made once per task; `make` returns the function for one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches):
            if (out := step(batch)) is not None:
                yield out
        del step
        trim()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).to_pylist()


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def trim() -> None:
    """Gives freed memory back: a worker lives on after its task, and what it keeps adds to the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pack(arrays: list[np.ndarray]) -> bytes:
    """Columns split into byte planes and compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(d).itemsize, n).T).view(d).ravel() for d, n, b in planes]


#: Parts that one task merges.
FAN = 64


def merged_pieces(parts: DataFrame, tasks: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """`part`, `piece`, `data` (a packed array): the pieces of all tasks merged by `add`, as a tree of fan-in FAN.

    A task merges FAN arrays one after another, whatever the number of tasks; one array for each piece is returned.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = unpack(rows["data"].iloc[0])[0]
        for data in rows["data"].iloc[1:]:
            total = add(total, unpack(data)[0])
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "piece": [int(rows["piece"].iloc[0])], "data": [pack([total])]})

    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("piece", "part").applyInPandas(merge, "part long, piece long, data binary")
        if tasks <= 1:
            return [unpack(r["data"])[0] for r in sorted(parts.collect(), key=lambda r: r["piece"])]


def local_path(uri: str) -> str:
    """A POSIX path for `file:` URIs and plain paths (a mounted shared folder)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped files need a mounted shared folder")
    return os.path.abspath(uri)
