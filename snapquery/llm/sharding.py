"""Shard assignment by jump consistent hashing.

Law ``key``: the id and the number of shards decide the shard; with one more shard a row either stays
where it is or moves to the new shard.  No ring table exists: each task computes the jumps of its ids.

Nulls and edges: a null id is hashed like any value, so such rows share a shard; a null text has size
16 and the checksum of no bytes; a very long text is only measured and checksummed; repeated rows go to one shard and get slots of their own; an empty
table returns no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import numbered

#: Fixed value: the multiplier of the generator of the published jump hash.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; moves the least when ``shards`` grows."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, shard = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = np.floor((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = to < shards
        live = live[inside]
        shard[live] = to[inside]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard (int) of a column of any hashable type; its 64-bit hash is the key of the jumps."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in parts:
            yield pd.Series(jump_hash(k.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.xxhash64(key))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, grown_shard, slot) of each row; slots run from 0 in each shard without gaps."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"),
        shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    return numbered(rows, "shard").withColumnRenamed("rank", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", name: str = "shard") -> None:
    """Write whole rows as Parquet folders ``name=N``; a large shard is written by many tasks, in many files.

    A column of the input with that name would be lost, so it is refused.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name!r}; give the folders another name")
    docs.withColumn(name, shard_of(F.col(f"`{id_col}`"), shards)).write.partitionBy(name).parquet(path)
