"""Sharding by jump consistent hashing: a stable key and the shard count decide, and no ring table is kept.

Going from n to n + 1 shards moves rows only into the new shard, about 1 / (n + 1) of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rank_within, read, utf8_crc32

#: The multiplier of the published algorithm's linear congruential generator (Lamping and Veach, 2014).
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; all keys jump together until none lands inside the range."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.uint64).copy()
    here, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        here[going] = ahead[going]
        with np.errstate(over="ignore"):
            key[going] = key[going] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = ((here[going] + 1) * step).astype(np.int64)
        going = going[ahead[going] < shards]
    return here


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (int) of a long key column; null keys count as 0."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.fillna(0).to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key, F.lit(0).cast("long")))


def key_number(docs: DataFrame, key: str) -> Column:
    """The long that a key column is placed by: whole numbers as they are, other types by their XXH64."""
    whole = dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    return F.col(f"`{key}`").cast("long") if whole else F.xxhash64(F.col(f"`{key}`"))


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of docs but the text, plus size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard.

    slot counts a shard's rows from 0 in the order of the key, null first; equal keys by checksum and size. grown_shard is
    the place with one more shard. Null keys hash as 0, null texts have size 1. Equal keys share a shard: the law is `key`.
    Clashing column names of docs are replaced. An empty table gives an empty table.
    """
    number = key_number(docs, key)
    sized = (
        docs.withColumn("size", F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1)
        .withColumn("text_crc32", utf8_crc32(F.col(f"`{text}`")))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", jump_shard(number, shards))
        .withColumn("grown_shard", jump_shard(number, shards + 1))
    )
    return rank_within(sized.drop(text), ["shard"], [key, "text_crc32", "size"], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text") -> None:
    """Write whole documents as one folder of Parquet for each shard, the one that shard() names, each in many files if it is large."""
    placed = docs.withColumn("shard", jump_shard(key_number(docs, key), shards))
    placed.repartition("shard", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(64))).write.partitionBy("shard").parquet(path)


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
