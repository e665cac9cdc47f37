"""Tamper-evident archives: manifests, verification, official records, fingerprints."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ArchiveError(ValueError):
    """An archive or manifest does not keep its contract."""


def append_manifest(manifest: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest with new rows; refuses other columns and keys that are there already."""
    if manifest.columns != rows.columns:
        raise ArchiveError(f"columns differ: {manifest.columns} and {rows.columns}")
    again = rows.join(manifest, keys, "left_semi").limit(1).collect()
    if again:
        raise ArchiveError(f"registered already: {again[0].asDict()}")
    return manifest.unionByName(rows)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """File name, bytes and SHA-256 of every file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: Bytes of a leaf of a hash tree, and digests that one node joins.
LEAF, JOINED = 8 << 20, 256


def hash_tree(spark: SparkSession, path: str, leaf: int = LEAF, joined: int = JOINED, pattern: str = "*") -> DataFrame:
    """`file`, `bytes`, `leaves` and `root` of every file of a folder, whatever its size.

    A file is cut into ranges of `leaf` bytes, which tasks read and hash by themselves; the SHA-256 of up to `joined`
    neighbouring digests, one after another, is the digest above them, up to one root. Spark's readers don't list empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    number = F.ceil(F.col("length") / leaf).cast("long")
    ranges = files.select("path", "length", number.alias("leaves"), F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("i"))

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            out, open_ = [], {}
            for file, i in zip(batch.column("path").to_pylist(), batch.column("i").to_pylist()):
                if file not in open_:
                    open_ = {file: file_of(fs, file)}
                open_[file].seek(i * leaf)
                out.append(hashlib.sha256(open_[file].read(leaf)).digest())
            columns = [batch.column(c) for c in ("path", "length", "leaves", "i")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["path", "length", "leaves", "i", "digest"])

    def file_of(fs, uri):
        system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        return system.open_input_file(place)

    spread = ranges.repartition("path", F.floor(F.col("i") / joined))
    digests = spread.mapInArrow(read, "path string, length long, leaves long, i long, digest binary").withColumn("left", F.col("leaves"))
    most = files.agg(F.max(number)).first()[0] or 0
    while most > 1:
        # up to `joined` digests of 32 bytes
        parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda v: F.hex(v["digest"]))
        keys = ["path", "length", "leaves", "left"]
        above = digests.groupBy(*keys, F.floor(F.col("i") / joined).alias("i")).agg(F.array_join(parts, "").alias("d"))
        # a file's one digest that is left is its root
        digest = F.when(F.col("left") == 1, F.unhex("d")).otherwise(F.unhex(F.sha2(F.unhex("d"), 256)))
        digests = above.select(*keys[:3], F.ceil(F.col("left") / joined).alias("left"), "i", digest.alias("digest"))
        most = -(-most // joined)
    return digests.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "leaves", F.lower(F.hex("digest")).alias("root"))


def verify(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per file: identical, CHANGED, missing or unregistered."""
    now = manifest_of(spark, path).select("file", F.col("sha256").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unregistered").when(F.col("now") == F.col("sha256"), "identical").otherwise("CHANGED")
    return manifest.select("file", "sha256").join(now, "file", "full").select("file", status.alias("status"))


def official(runs: DataFrame, keys: list[str], made: str, seen: str, cutoff: str, tie: list[str]) -> DataFrame:
    """Per key the latest run that was made before the cutoff from a snapshot before it."""
    valid = runs.where((F.col(made) < F.col(cutoff)) & (F.col(seen) < F.col(cutoff)))
    w = Window.partitionBy(*keys).orderBy(F.desc(made), *tie)
    return valid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fingerprint(preds: DataFrame, model: str, key: list[str], pred: str) -> DataFrame:
    """Per model: rows, mean and an order-free content hash."""
    row = F.xxhash64(*key, F.format_string("%.6f", F.col(pred)))
    return preds.groupBy(model).agg(F.count("*").alias("n"), F.avg(pred).alias("mean"), F.bit_xor(row).alias("content"))


def compare_prints(now: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Prints of now with a status: identical, CHANGED, or unverifiable where none is stored."""
    kept = stored.select(model, F.col("n").alias("_n"), F.col("content").alias("_content"))
    same = (F.col("n") == F.col("_n")) & (F.col("content") == F.col("_content"))
    status = F.when(F.col("_n").isNull(), "unverifiable").when(same, "identical").otherwise("CHANGED")
    return now.join(kept, model, "left").withColumn("status", status).drop("_n", "_content")


def next_after(rows: DataFrame, records: DataFrame, by: list[str], at: str, cutoff: str, payload: list[str]) -> DataFrame:
    """For each row the first record of its key at or after its cutoff; of records of one instant the smallest payload.

    Rows and records are put in one order, latest first, in which a row sees the records that came before it. A task
    holds a day of a key: where no record follows on the same day, the first of the key's next day with records counts.
    Rows whose cutoff or key is missing get none.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, at]])
    record = F.struct(F.col(at).alias("_at"), *payload)
    events = records.where(known).select(*by, F.col(at).alias("_t"), record.alias("_rec")).withColumn("_row", F.lit(None).cast(rows.schema))
    asked = rows.select(*by, F.col(cutoff).alias("_t"), F.struct(*rows.columns).alias("_row"))
    both = asked.unionByName(events, allowMissingColumns=True).withColumn("_day", F.date_trunc("day", "_t"))

    latest_first = Window.partitionBy(*by, "_day").orderBy(F.desc("_t"), F.col("_row").isNotNull(), F.desc("_rec"))
    seen = F.last("_rec", ignorenulls=True)
    same_day = both.withColumn("_first", seen.over(latest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_row is not null")
    days = both.groupBy(*by, "_day").agg(F.min("_rec").alias("_rec"))
    later = Window.partitionBy(*by).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.where("_day is not null").select(*by, "_day", seen.over(later).alias("_next"))
    found = same_day.join(days, [*by, "_day"], "left").withColumn("_first", F.coalesce("_first", "_next"))
    return found.select("_row.*", *(F.col(f"_first.{p}").alias(p) for p in payload))
