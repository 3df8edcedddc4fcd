"""Shard assignment by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import positioned
from .store import small_batches
from .text import U64

#: Multiplier of the published generator.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last bucket below ``shards`` that the key's jumps reach.

    No table is kept.  With one more shard, a key either stays or moves to the new shard.
    """
    key = keys.astype(np.int64).view(U64).copy()
    bucket, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        bucket[going] = ahead[going]
        key[going] = key[going] * U64(MULTIPLIER) + U64(1)
        far = (bucket[going] + 1) * (2.0**31 / ((key[going] >> U64(33)) + U64(1)).astype(np.float64))
        ahead[going] = np.minimum(far, 2.0**62).astype(np.int64)
        going = going[ahead[going] < shards]
    return bucket


def assigned(docs: DataFrame, shards: int) -> DataFrame:
    """One row for each document with its shard and its slot there.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (from 0
    without a gap in each shard, in order of doc_id), grown_shard (with one shard more).  The
    law is ``key``: doc_id and the shard count alone decide.  Only ids, sizes and checksums are
    shuffled, by ranges of doc_id, so that no shard has to pass through one task.

    Cases: a null text has size 1 and the checksum of no bytes; a null doc_id is placed as key
    0; repeated rows share a shard and have a slot each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(jump(keys, s).astype(np.int32)) for s in (shards, shards + 1))], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    placed = thin.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    out = positioned(placed, "doc_id", ["text_crc32", "size"], within="shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("pos").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """Writes the rows of docs below path, in one folder for each shard."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("doc_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(jump(keys, shards).astype(np.int32))], names=[*names, "__shard"])

    docs.mapInArrow(place, T.StructType([*docs.schema.fields, T.StructField("__shard", T.IntegerType())])).write.partitionBy("__shard").parquet(path)

