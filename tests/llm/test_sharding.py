import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aeroledger.llm.sharding import jump_shard, moved_rows, shard_rows, stable_key, write_shards


def key_of(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:16], 16)


def jump(key, shards):
    """The published loop."""
    shard, further = -1, 0
    while further < shards:
        shard = further
        key = (key * 2862933555777941757 + 1) % 2**64
        further = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


@pytest.mark.parametrize("shards", [1, 2, 24, 64, 65, 1000, 1_000_000])
def test_keys_lie_where_the_published_loop_puts_them(spark, shards):
    found = spark.range(200).select("id", jump_shard(stable_key(F.col("id")), shards).alias("shard")).collect()
    assert all(r["shard"] == jump(key_of(r["id"]), shards) for r in found)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard_rows(df, 24, 25).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 120 < len(moved) < 290
    assert {r["doc_id"] for r in moved_rows(df, 24, 25).collect()} == {r["doc_id"] for r in moved}
    assert {r["doc_id"] for r in moved_rows(df, 25, 24).collect()} == {r["doc_id"] for r in moved}
    sizes = Counter(r["shard"] for r in rows).values()
    assert len(sizes) == 24 and max(sizes) < 1.5 * min(sizes)


def test_nulls_repeated_rows_and_clashing_columns(spark, documents):
    df = documents(
        (None, "a"), (None, None), (7, "é"), (7, "é"), (7, ""), (8, None), *[(9, "copy")] * 50,
    ).withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")).withColumn("key", F.lit("z"))
    rows = shard_rows(df, 5, 6).collect()
    assert len(rows) == 56
    for shard in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in rows:
        assert r["shard"] == jump(key_of(r["doc_id"]), 5) and r["grown_shard"] == jump(key_of(r["doc_id"]), 6)
    assert sorted((r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 7) == [
        (8, 0), (10, zlib.crc32("é".encode())), (10, zlib.crc32("é".encode()))]
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 8] == [(8, 0)]


def test_slots_follow_the_ids_however_rows_are_dealt(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one = shard_rows(df.repartition(7), 3).orderBy("doc_id").collect()
    assert one == shard_rows(df.coalesce(1), 3).orderBy("doc_id").collect()
    assert all(r["grown_shard"] is None for r in one)


def test_empty_table_and_files(spark, documents, tmp_path):
    assert shard_rows(documents(), 24, 25).collect() == []
    df = documents(*[(i, f"text {i}") for i in range(40)]).drop("set")
    write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(i, f"text {i}") for i in range(40)]
    assert all(r["shard"] == jump(key_of(r["doc_id"]), 4) for r in back)


def test_no_python_in_the_plan(spark, documents):
    plan = shard_rows(documents((1, "a")), 24, 25)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan
