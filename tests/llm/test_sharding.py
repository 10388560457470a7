import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapquery.llm.sharding import jump_hash, shard, write_shards
from tests.llm.helpers import documents, empty, odd


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    rng = random.Random(1)
    keys = [0, 1, 2**64 - 1, *(rng.getrandbits(64) for _ in range(500))]
    for n in (1, 2, 40, 41, 1000):
        assert jump_hash(np.array(keys, np.uint64), n).tolist() == [brute_jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        jump_hash(np.array([1], np.uint64), 0)


def test_shards(spark):
    docs = odd() + [(1000 + i, f"t{i}") for i in range(3000)]
    rows = shard(documents(spark, docs).repartition(5), 40).collect()
    assert len(rows) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    by_shard, by_key = {}, {}
    for r in rows:
        assert (r.size, r.text_crc32) in [(len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts[r.id]]
        assert r.grown_shard in (r.shard, 40)
        by_key.setdefault(r.id, set()).add((r.shard, r.grown_shard))
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert len(by_shard) == 40 and max(map(len, by_shard.values())) < 2 * len(docs) / 40
    assert 0 < sum(r.grown_shard == 40 for r in rows) < 3 * len(docs) / 41
    assert shard(empty(spark)).collect() == []


def test_a_third_of_rows_under_one_id(spark):
    rows = shard(documents(spark, [(7, "t")] * 500 + [(i, "u") for i in range(1000)]).repartition(6), 8).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_written_shards(spark, tmp_path):
    df = documents(spark, [(i, f"t{i}") for i in range(50)]).withColumn("shard", F.lit("own"))
    with pytest.raises(ValueError):
        write_shards(df, str(tmp_path / "s"), 4)
    write_shards(df, str(tmp_path / "t"), 4, name="part")
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert {r.shard for r in rows.collect()} == {"own"} and set(df.columns) < set(rows.columns)
    write_shards(df.drop("shard"), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2, 3}
