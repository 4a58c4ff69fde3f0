"""Sharding by jump consistent hashing: no ring table, and an appended shard only takes rows.

A row's shard depends on its key and the number of shards alone.  With one more
shard, 1/(n+1) of the keys move, all of them into it.

Defined results: a null key hashes like any other value; rows with equal keys
share a shard; a null text has no bytes; slots number the rows of each shard
from 0 without gaps, rows that are equal in all columns in any order; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.batches import cut

#: Rows of a shard that one task numbers, about.
SLOT_ROWS = 500_000


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014), for all keys at once."""
    keys = keys.astype(np.uint64)
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = ahead[going]
        keys[going] = keys[going] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[going] = ((at[going] + 1) * (2.0**31 / ((keys[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        going = going[ahead[going] < n_shards]
    return at.astype(np.int32)


def shard_of(key: Column, n_shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), n_shards))

    return shard(F.xxhash64(key.cast("string")))


def slots(rows: DataFrame, group: str, order: list[str], per_task: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each group, however large a group is.

    A group is dealt into parts by hash, parts are numbered on their own, and a
    part begins where the parts before it end.  Rows are cut first, so counts and
    numbers are of the same rows; ``__row`` tells equal rows apart.
    """
    rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()))
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    n_parts = max(1, -(-largest // per_task))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*order, "__row"), F.lit(n_parts)))
    counts = rows.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # n_parts rows a group
    offsets = counts.select(F.col(group), "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy(group, "__part").orderBy(*order, "__row")
    numbered = rows.withColumn("__at", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [group, "__part"]).withColumn("slot", F.col("__from") + F.col("__at")).drop("__row", "__part", "__from", "__at")


def shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes of the text plus 16), text_crc32, shard, grown_shard (with one shard more), slot."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    small = docs.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = small.withColumn("shard", shard_of(F.col(key), n_shards)).withColumn("grown_shard", shard_of(F.col(key), n_shards + 1))
    return slots(placed, "shard", [key, "text_crc32", "size"])
