"""Shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.scratch import numbered, save

#: The multiplier of the linear congruential generator in the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: at most one jump for each shard, and no ring table."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    while (moving := ahead < shards).any():
        shard = np.where(moving, ahead, shard)
        key = np.where(moving, key * MULTIPLIER + np.uint64(1), key)
        draw = (key >> np.uint64(33)).astype(np.int64) + 1
        ahead = np.where(moving, ((shard + 1) * (2147483648.0 / draw)).astype(np.int64), ahead)
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of jump(); a null key counts as 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def shard_by_key(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 1), text_crc32, shard, slot and grown_shard of every row.

    The key and the number of shards alone decide the shard; with one more shard, rows
    move only into the new one (grown_shard). Slots number a shard's rows from 0. Null
    texts have size 1 and the checksum of no bytes; null keys count as 0; repeated rows
    keep a slot each; an empty table gives an empty table; other columns are ignored.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return numbered(save(rows, "shards"), ["shard"], [key], "slot")
